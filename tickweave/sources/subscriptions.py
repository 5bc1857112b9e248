"""What to connect to and what to ask for, by the configured symbols."""

from __future__ import annotations

import json

#: Hosts of the venues' public streams.
HOSTS = {"com": "wss://stream.binance.com:9443", "us": "wss://stream.binance.us:9443"}
MATCHES = "wss://ws-feed.exchange.coinbase.com"


def by_venue(symbols: list[str]) -> dict[str, list[str]]:
    """Names without their venue, in the order given; symbols without a venue belong to none."""
    out: dict[str, list[str]] = {}
    for s in symbols:
        venue, mark, name = s.partition(":")
        if mark and name:
            out.setdefault(venue, []).append(name)
    return out


def subscriptions(symbols: list[str], host: str = "com", levels: int = 10) -> list[dict]:
    """A connection for each venue that has symbols: its url, and the messages to send whenever it opens, reconnects included.

    One venue takes trades and book levels as streams of the url, the other a message that names products and channel. An unknown
    host raises KeyError.
    """
    venues, out = by_venue(symbols), []
    if names := venues.get("binance"):
        streams = [f"{n.lower()}@{kind}" for n in names for kind in ("trade", f"depth{levels}@100ms")]
        out.append({"venue": "binance", "url": f"{HOSTS[host]}/stream?streams={'/'.join(streams)}", "send": []})
    if names := venues.get("coinbase"):
        out.append({"venue": "coinbase", "url": MATCHES, "send": [json.dumps({"type": "subscribe", "product_ids": names, "channels": ["matches"]})]})
    return out
