"""Ticks to bars: validity, event-time buckets, late ticks, duplicates, bounded gap filling, book imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, clamp


def valid(ticks: DataFrame) -> DataFrame:
    """Ticks with a positive price, a non-negative quantity and a time; NaN and infinities are invalid."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ticks.where(finite("price") & finite("qty") & F.col("t").isNotNull() & (F.col("price") > 0) & (F.col("qty") >= 0))


def known(ticks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ticks of configured symbols; others are passed over. ``symbols`` has a row for each and is small only if the user's list is."""
    return ticks.join(symbols.select("symbol").where("symbol is not null").distinct(), "symbol", "left_semi")


def bars(ticks: DataFrame, width: int) -> DataFrame:
    """(symbol, t, close, volume): close is the price of the latest time, of equal times the later arrival."""
    return valid(ticks).groupBy("symbol", bucket(F.col("t"), width).alias("t")).agg(F.max_by("price", F.struct("t", "seq")).alias("close"), F.sum("qty").alias("volume"))


def fill_gaps(made: DataFrame, width: int, most: int = 10) -> DataFrame:
    """Flat bars of no volume in gaps of at most ``most`` bars; longer gaps stay."""
    w = Window.partitionBy("symbol").orderBy("t")
    missing = F.floor((F.lead("t").over(w) - F.col("t")) / width) - 1
    steps = F.when((F.col("missing") > 0) & (F.col("missing") <= most), F.sequence(F.lit(0).cast("long"), F.col("missing"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = made.withColumn("missing", missing.cast("long")).withColumn("k", F.explode(steps))
    flat = F.col("k") > 0
    return rows.select("symbol", (F.col("t") + F.col("k") * width).alias("t"), "close", F.when(flat, 0.0).otherwise(F.col("volume")).alias("volume"), flat.alias("filled"))


def lateness(ticks: DataFrame, width: int, grace: int, cell: int = 1 << 20) -> DataFrame:
    """Ticks in arrival order with ``late``: their bar was already final when they came.

    A bar is final once the largest time seen has passed its end and the grace period; nothing is late before the first bar is.
    Arrivals are cut into cells of ``cell`` numbers: the largest time of the cells before comes from one row a cell, that of the
    ticks before within a cell from a window, so a symbol's ticks are dealt out over as many tasks as it has cells.
    """
    rows = valid(ticks).withColumn("cell", F.floor(F.col("seq") / cell))
    tops = rows.groupBy("symbol", "cell").agg(F.max("t").alias("top"))
    before = Window.partitionBy("symbol").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = tops.select("symbol", "cell", F.max("top").over(before).alias("ahead"))
    within = Window.partitionBy("symbol", "cell").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("own", F.max("t").over(within)).join(ahead, ["symbol", "cell"]).withColumn("seen", F.greatest("ahead", "own"))
    end = bucket(F.col("t"), width) + width
    return seen.withColumn("late", F.coalesce(end + grace <= F.col("seen"), F.lit(False))).drop("cell", "own", "ahead")


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the given order."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def attach_imbalance(made: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """Bars with the last imbalance sample that arrived in each, clamped to [-1, 1]; null without one."""
    last = samples.groupBy("symbol", bucket(F.col("t"), width).alias("t")).agg(clamp(F.max_by("value", "seq"), -1.0, 1.0).alias("obi"))
    return made.join(last, ["symbol", "t"], "left")


def log_returns(made: DataFrame) -> DataFrame:
    """``ret``: log of close over the previous close; null on the first bar and next to closes that are not positive."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("t"))
    return made.withColumn("prev", before).withColumn("ret", F.when((F.col("prev") > 0) & (F.col("close") > 0), F.log(F.col("close") / F.col("prev")))).drop("prev")
