"""Alert payloads: validation, text, status ladder, throttles, delivery."""

from __future__ import annotations

import hmac
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats of symbols and driver names.
SYMBOL, DRIVER = r"^[a-z]{3,12}:[A-Z0-9-]{3,20}$", r"^[a-z_]{1,32}$"
PAYLOAD = "symbol string, t double, price double, score double, threshold double, top array<struct<name:string,contribution:double>>"
MOST_BYTES = 4096


def parsed(body: Column) -> Column:
    return F.from_json(body, PAYLOAD)


def valid(body: Column) -> Column:
    """True for a payload of the right types with sane names, finite numbers and at most six drivers."""
    p = parsed(body)
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    raw = lambda k: F.get_json_object(body, f"$.{k}")
    typed = F.lit(True)
    for k in ("t", "price", "score", "threshold"):  # the parser gives null for a number in quotes
        typed = typed & number(p[k])
    drivers = (F.size(p["top"]) <= 6) & F.forall(p["top"], lambda d: F.coalesce(d["name"].rlike(DRIVER), F.lit(False)) & number(d["contribution"]))
    return F.coalesce(p.isNotNull() & raw("symbol").rlike(SYMBOL) & ~raw("symbol").contains("\n") & typed & p["top"].isNotNull() & drivers, F.lit(False))


def status(has_key: Column, key_ok: Column, limited: Column, body: Column) -> Column:
    """The code that a request gets: the first test that fails decides."""
    return F.when(~has_key, 503).when(~key_ok, 401).when(limited, 429).when(F.octet_length(body) > MOST_BYTES, 413).when(~valid(body), 400).otherwise(200)


def text(p: Column) -> Column:
    """Plain text of a payload."""
    signed = lambda x: F.concat(F.when(x >= 0, "+").otherwise("-"), F.format_string("%.2f", F.abs(x)))
    drivers = F.concat_ws(", ", F.transform(p["top"], lambda d: F.concat(d["name"], F.lit(" "), signed(d["contribution"]))))
    at = F.date_format(F.timestamp_millis(p["t"].cast("long")), "yyyy-MM-dd HH:mm")
    return F.concat_ws("\n", F.concat(F.lit("Alert "), p["symbol"]), F.format_string("score %.1f (threshold %.2f) at price %s", p["score"], p["threshold"], p["price"].cast("string")), drivers, F.concat(at, F.lit(" UTC")))


def key_matches(given: str | None, wanted: str | None) -> bool:
    """Compared in constant time; without either it fails."""
    return bool(given) and bool(wanted) and hmac.compare_digest(given.encode(), wanted.encode())


class Limiter:
    """At most n events in any trailing period."""

    def __init__(self, n: int = 20, period: int = 60_000):
        self.n, self.period, self.times = n, period, []

    def __call__(self, t: float) -> bool:
        self.times = [x for x in self.times if x > t - self.period]
        if len(self.times) >= self.n:
            return False
        self.times.append(t)
        return True


class Throttle:
    """Notifications only if switched on, with a key, of high enough score, and a minute after the symbol's last."""

    def __init__(self, enabled: bool = True, key: bool = True, least: float = 80.0, pause: int = 60_000):
        self.on, self.least, self.pause, self.last = enabled and key, least, pause, {}

    def __call__(self, symbol: str, t: float, score: float) -> bool:
        if not self.on or score < self.least or t - self.last.get(symbol, float("-inf")) < self.pause:
            return False
        self.last[symbol] = t
        return True


def dispatch(message: str, channels: dict[str, str | None], send: Callable[[str, dict], bool]) -> dict[str, bool | None]:
    """Send to each configured channel: true or false by its answer, null if it isn't configured; a failing transport is a false."""
    out: dict[str, bool | None] = {}
    for name, url in channels.items():
        if not url:
            out[name] = None
            continue
        try:
            out[name] = bool(send(url, {"content": message, "text": message, "allowed_mentions": {"parse": []}}))
        except Exception:
            out[name] = False
    return out
