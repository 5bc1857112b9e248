"""Event selection and onsets from daily and intraday prices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY


def daily(ticks: DataFrame) -> DataFrame:
    """(symbol, day, open, high, low, close) by event time; ``day`` is a number of days since 1970."""
    rows = ticks.where("price > 0").withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    at = F.struct("t", "seq")
    return rows.groupBy("symbol", "day").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"))


def ranked(days: DataFrame) -> DataFrame:
    """Days by range in per cent of the open, largest first, earlier first among equals."""
    out = days.where("open > 0 and high >= low and low > 0").withColumn("range_pct", 100 * (F.col("high") - F.col("low")) / F.col("open"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("range_pct"), "day")))


def greedy(days: DataFrame, k: int, apart: int, by: str = "rank", value: str = "range_pct") -> DataFrame:
    """The first k days in order that are at least ``apart`` days from all picked before; each depends on the last, so a fold per symbol."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        rows = []
        for r in pdf.sort_values(by).itertuples(index=False):
            if len(taken) == k:
                break
            if all(abs(r.day - d) >= apart for d in taken):
                taken.append(r.day)
                rows.append((r.symbol, r.day, float(getattr(r, value)), len(taken)))
        return pd.DataFrame(rows, columns=["symbol", "day", value, "pick"])

    # Far days can't be picked without all larger ranges; what can be picked lies in the first k * (2 apart - 1) ranks.
    few = days.where(F.col(by) <= k * (2 * apart - 1)).select("symbol", "day", value, by)
    return few.groupBy("symbol").applyInPandas(pick, f"symbol string, day long, {value} double, pick int")


def split_picks(picks: DataFrame, first: int) -> DataFrame:
    """``part``: the first picks of a greedy choice are ``chosen``, those after them ``held``."""
    return picks.withColumn("part", F.when(F.col("pick") <= first, "chosen").otherwise("held"))


def regime(days: DataFrame, shocks: DataFrame, back: int = 7, least_pct: float = 4.0, near: int = 1) -> DataFrame:
    """Days whose range is large against the median of the ``back`` days before, without a gap in them, and far from shock days."""
    by_day = Window.partitionBy("symbol").orderBy("day")
    seen = by_day.rowsBetween(-back, -1)
    rows = days.withColumn("usual", F.percentile("range_pct", 0.5).over(seen)).withColumn("whole", F.lag("day", back).over(by_day) == F.col("day") - back)
    rows = rows.where("whole and usual > 0").withColumn("ratio", F.col("range_pct") / F.col("usual")).where(F.col("range_pct") >= least_pct)
    apart = shocks.select(F.col("symbol").alias("s"), F.explode(F.sequence(F.col("day") - near, F.col("day") + near)).alias("d")).distinct()
    rows = rows.join(apart, (F.col("symbol") == F.col("s")) & (F.col("day") == F.col("d")), "left_anti")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ratio"), "day")))


def exact_lag(bars: DataFrame, lag: int) -> DataFrame:
    """``lag_ret``: log return against the bar exactly ``lag`` ms before; null where there is none. An equi-join, as rows may be missing."""
    old = bars.select("symbol", (F.col("t") + lag).alias("t"), F.col("close").alias("old"))
    return bars.join(old, ["symbol", "t"], "left").withColumn("lag_ret", F.when((F.col("old") > 0) & (F.col("close") > 0), F.log(F.col("close") / F.col("old")))).drop("old")


def onset_by_open(bars: DataFrame, days: DataFrame, pct: float, least: int) -> DataFrame:
    """First bar of the day that lies ``pct`` per cent or more off the open; null onset with too few bars or no such bar."""
    rows = bars.withColumn("day", F.floor(F.col("t") / DAY).cast("long")).join(days.select("symbol", "day"), ["symbol", "day"])
    opened = rows.groupBy("symbol", "day").agg(F.min_by("close", "t").alias("open"), F.count(F.lit(1)).alias("n"))
    hit = rows.join(opened, ["symbol", "day"]).where(F.abs(F.col("close") / F.col("open") - 1) * 100 >= pct)
    first = hit.groupBy("symbol", "day").agg(F.min("t").alias("at"))
    return opened.join(first, ["symbol", "day"], "left").select("symbol", "day", "n", F.when(F.col("n") >= least, F.col("at")).alias("onset"))


def onset_by_past(moves: DataFrame, days: DataFrame, back: int = 7, multiple: float = 6.0, coverage: float = 0.8, per_day: int = 1440) -> DataFrame:
    """First bar of the day whose absolute lagged return reaches ``multiple`` times the median of the ``back`` days before.

    theta is null with too little history; in_progress tells that the day's first known bar was already over it.
    """
    span = days.select("symbol", "day", F.explode(F.sequence(F.col("day") - back, F.col("day"))).alias("of"))
    rows = moves.where("lag_ret is not null").select("symbol", "t", F.abs("lag_ret").alias("m"), F.floor(F.col("t") / DAY).cast("long").alias("of"))
    both = rows.join(span, ["symbol", "of"])
    past = both.where("of < day").groupBy("symbol", "day").agg(F.percentile("m", 0.5).alias("med"), F.count("m").alias("n"))
    theta = past.select("symbol", "day", F.when(F.col("n") >= coverage * back * per_day, multiple * F.col("med")).alias("theta"))
    now = both.where("of = day").join(theta, ["symbol", "day"])
    first = now.groupBy("symbol", "day").agg(F.min(F.when(F.col("m") >= F.col("theta"), F.col("t"))).alias("onset"), F.min("t").alias("start"))
    return theta.join(first, ["symbol", "day"], "left").select("symbol", "day", "theta", "onset", F.coalesce(F.col("onset") == F.col("start"), F.lit(False)).alias("in_progress"))
