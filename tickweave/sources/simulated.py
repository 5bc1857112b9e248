"""Synthetic price series with injected events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from ..functions.rng import Uniform32


#: Fixed value: the base volatility of a bar.
BASE = 0.0005


def simulate(n: int, seed: int, events: list[dict] = (), with_book: bool = False, start: int = 0, width: int = 60_000) -> tuple[list[dict], list[dict]]:
    """Bars and event windows: autoregressive log volatility, Student shocks of 4 degrees, volume that follows moves.

    Events: {type: vol | drift | jump, at, len, mag}; a volatility event trebles the volume, a drift doubles it and tilts the book
    its way; a jump does so at its first bar, with five times the volume, and doubles the volatility for the rest. A window ends
    with the bar after the event. Draws per bar: volatility, shock (5 normals), volume, then book if asked for.
    """
    draw = Uniform32(seed)
    level, log_vol, bars = 100.0, 0.0, []
    for i in range(n):
        log_vol = 0.995 * log_vol + 0.06 * draw.normal()
        z = draw.normal()
        shock = z / math.sqrt(sum(draw.normal() ** 2 for _ in range(4)) / 4) / math.sqrt(2)
        sigma, move, busy, tilt = BASE * math.exp(log_vol), 0.0, 1.0, 0.0
        for e in events:
            if e["at"] <= i < e["at"] + e.get("len", 1):
                first = i == e["at"]
                if e["type"] == "vol":
                    sigma, busy = sigma * e["mag"], 3 * busy
                elif e["type"] == "jump" and not first:
                    sigma *= 2
                else:
                    move += e["mag"] * BASE
                    busy *= 2 if e["type"] == "drift" else 5
                    tilt += math.copysign(0.4, e["mag"]) if e["mag"] else 0.0
        move += sigma * shock
        level *= math.exp(move)
        bar = {"t": start + i * width, "close": level, "volume": 10 * math.exp(0.3 * draw.normal()) * (1 + 1000 * abs(move)) * busy}
        if with_book:
            bar["obi"] = max(-1.0, min(1.0, 0.15 * draw.normal() + tilt))
        bars.append(bar)
    windows = [{"name": f"{e['type']}-{e['at']}", "start": start + e["at"] * width, "end": start + (e["at"] + e.get("len", 1)) * width, "onset": start + e["at"] * width} for e in events]
    return bars, windows


def simulated(spark: SparkSession, seeds: list[int], n: int, events: list[dict] = (), with_book: bool = False) -> DataFrame:
    """(symbol, t, close, volume, obi): one series per seed, made in parallel."""
    ship(spark)
    listed = [dict(e) for e in events]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed in pdf["seed"]:
                bars, _ = simulate(n, int(seed), listed, with_book)
                yield pd.DataFrame([{"symbol": f"sim:{seed}", "obi": None, **b} for b in bars], columns=["symbol", "t", "close", "volume", "obi"])

    rows = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(len(seeds), F.col("seed"))
    return rows.mapInPandas(each, "symbol string, t long, close double, volume double, obi double")
