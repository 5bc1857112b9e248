"""Causal rolling statistics as window expressions; frames end before the current row unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY, guarded_corr, mad_scale, sorted_median

SYMBOL = ("symbol",)


def before(size: int, by: tuple[str, ...] = SYMBOL):
    return Window.partitionBy(*by).orderBy("t").rowsBetween(-size, -1)


def numbered(rows: DataFrame, cell: int = DAY) -> DataFrame:
    """``idx``: the row's number within its symbol in time order, from 0.

    Rows are numbered within cells of time, and counts of cells say how many came before; only those are summed up by symbol, so
    a symbol's rows are dealt out over as many tasks as it has cells.
    """
    cells = rows.withColumn("cell", F.floor(F.col("t") / cell))
    counts = cells.groupBy("symbol", "cell").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("symbol").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = cells.withColumn("own", F.row_number().over(Window.partitionBy("symbol", "cell").orderBy("t")))
    return own.join(counts.select("symbol", "cell", ahead.alias("ahead")), ["symbol", "cell"]).withColumn("idx", F.col("ahead") + F.col("own") - 1).drop("cell", "own", "ahead")


def in_chunks(rows: DataFrame, overlap: int, column: Callable[[tuple[str, ...]], Column], name: str, size: int | None = None, cell: int = DAY) -> DataFrame:
    """The rows with a causal window's column, for series too long for one task a symbol.

    A symbol is cut into chunks of ``size`` rows; the last ``overlap`` rows of each also go into the next one, where they only fill
    frames. ``column`` is given the names to partition by. Frames must reach back at most ``overlap`` rows; results are those of
    one window over the symbol. t must be unique within a symbol; neither is null.
    """
    size = size or max(8 * overlap, 4096)
    if not 0 < overlap <= size:
        raise ValueError("overlap must be positive and at most size")
    home = F.floor(F.col("idx") / size)
    places = F.when(F.col("idx") % size >= size - overlap, F.array(home, home + 1)).otherwise(F.array(home))
    dealt = numbered(rows, cell).withColumn("chunk", F.explode(places))
    return dealt.withColumn(name, column(("symbol", "chunk"))).where(F.col("chunk") == home).drop("chunk", "idx")


def robust_z(x: str, size: int = 240, least: int = 60, by: tuple[str, ...] = SYMBOL) -> Column:
    """Rows whose value is null must be filtered first, as frames count rows."""
    seen = F.collect_list(x).over(before(size, by))
    return F.when(F.size(seen) >= least, F.abs(F.col(x) - sorted_median(seen)) / F.greatest(mad_scale(seen), F.lit(1e-6)))


def mid_rank(x: str, size: int = 2000, least: int = 200, by: tuple[str, ...] = SYMBOL) -> Column:
    seen = F.collect_list(x).over(before(size, by))
    count = lambda test: F.size(F.filter(seen, test))
    u = (count(lambda y: y < F.col(x)) + 0.5 * count(lambda y: y == F.col(x))) / (F.size(seen) + 1)
    return F.when(F.size(seen) >= least, -F.log(1 - u))


def quantiles(x: str, qs: list[float], size: int = 1440, least: int = 300, by: tuple[str, ...] = SYMBOL) -> Column:
    """Quantiles of one window for many budgets at once."""
    w = before(size, by)
    return F.when(F.count(x).over(w) >= least, F.percentile(x, F.array(*map(F.lit, qs))).over(w))


def volume_spike(size: int = 240, least: int = 60, by: tuple[str, ...] = SYMBOL) -> Column:
    w = before(size, by)
    return F.when(F.count("volume").over(w) >= least, F.col("volume") / F.greatest(F.percentile("volume", 0.5).over(w), F.lit(1e-9)))


def plain_z(x: str = "ret", size: int = 100, by: tuple[str, ...] = SYMBOL) -> Column:
    w = before(size, by)
    sd = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) == size) & (sd > 0), F.abs(F.col(x) - F.avg(x).over(w)) / sd).otherwise(0.0)


def largest_move(horizon: int = 30) -> Column:
    """Largest absolute return of the following bars; null unless there are as many."""
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(1, horizon)
    return F.when(F.count("ret").over(w) == horizon, F.max(F.abs("ret")).over(w))


def aligned(rows: DataFrame, value: str, n_symbols: int) -> DataFrame:
    """(symbol, t, x, ret, idx): rows at times that every symbol has; ``idx`` is their number in time order. Where ``rows`` has no returns ``ret``, the values stand for them."""
    times = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_symbols).select("t")
    both = rows.join(times, "t").select("symbol", "t", F.col(value).alias("x"), F.col("ret" if "ret" in rows.columns else value).alias("ret"))
    return both.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("t")))


def _sums(n: str, x: str, y: str, w=None):
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    X, Y = F.col(x), F.col(y)
    return guarded_corr(over(F.count(F.lit(1))).cast("double"), over(F.sum(X)), over(F.sum(Y)), over(F.sum(X * X)), over(F.sum(Y * Y)), over(F.sum(X * Y)))


def rolling_corr(rows: DataFrame, size: int = 240) -> DataFrame:
    """(a, b, t, corr) of unordered pairs over the last ``size`` aligned rows, the current one included."""
    a, b = (rows.select(F.col("symbol").alias(s), "t", F.col("x").alias(f"x{s}")) for s in "ab")
    w = Window.partitionBy("a", "b").orderBy("t").rowsBetween(1 - size, 0)
    return a.join(b, "t").where("a < b").select("a", "b", "t", _sums("n", "xa", "xb", w).alias("corr"))


def lead_lag(rows: DataFrame, size: int = 240, most: int = 6, least_corr: float = 0.3, margin: float = 0.05, least: int = 24) -> DataFrame:
    """Per pair the correlation of returns (``corr``) and the lag of the strongest correlation of scores over the last aligned rows, and who leads.

    A positive lag means that a leads b. Of equal correlations the first lag from -most on counts. There is a leader if the lag is
    not 0 and its correlation reaches least_corr and beats that of the scores at lag 0 by the margin.
    """
    last = rows.groupBy().agg(F.max("idx").alias("top"))
    recent = rows.join(F.broadcast(last), F.col("idx") > F.col("top") - size).drop("top")
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    a = recent.select(F.col("symbol").alias("a"), "idx", F.col("x").alias("xa"), F.col("ret").alias("ra"), lags).withColumn("at", F.col("idx") + F.col("lag"))
    b = recent.select(F.col("symbol").alias("b"), F.col("idx").alias("at"), F.col("x").alias("xb"), F.col("ret").alias("rb"))
    by_lag = a.join(b, "at").where("a < b").groupBy("a", "b", "lag").agg(_sums("n", "xa", "xb").alias("corr"), _sums("n", "ra", "rb").alias("ret_corr"), F.count(F.lit(1)).alias("n"))
    best = by_lag.groupBy("a", "b").agg(F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("lag"), F.max("corr").alias("lag_corr"), F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("zero"), F.max(F.when(F.col("lag") == 0, F.col("ret_corr"))).alias("corr"), F.max("n").alias("n"))
    led = (F.col("lag") != 0) & (F.col("lag_corr") >= least_corr) & (F.col("lag_corr") > F.col("zero") + margin)
    first = F.col("lag") > 0
    return best.where(F.col("n") >= least).select("a", "b", "corr", "lag", "lag_corr", F.when(led, F.when(first, F.col("a")).otherwise(F.col("b"))).alias("leader"), F.when(led, F.when(first, F.col("b")).otherwise(F.col("a"))).alias("follower"))


def warnings(links: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """(leader, follower, lag_bars, lag_corr, score) of the links whose leader's latest score reaches the threshold."""
    latest = scores.groupBy(F.col("symbol").alias("leader")).agg(F.max_by("x", "t").alias("score"))
    return links.where("leader is not null").join(latest.where(F.col("score") >= threshold), "leader").select("leader", "follower", F.abs("lag").alias("lag_bars"), "lag_corr", "score")


def strongest(links: DataFrame, most: int = 5) -> DataFrame:
    """The links of the highest correlation of scores, in order."""
    return links.orderBy(F.desc("lag_corr"), "a", "b").limit(most)
