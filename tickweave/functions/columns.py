"""Column helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


#: Plain decimal numbers, with an exponent or without.
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """The finite number that a text of plain decimal form stands for; null for any other text."""
    value = F.when(text.cast("string").rlike(DECIMAL), text.cast("string").try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def whole(x: Column) -> Column:
    """A double without its fraction as a long; null beyond the longs."""
    return F.when(F.abs(x) < 9.2e18, x).try_cast("long")


def normal_ms(t: Column) -> Column:
    """Milliseconds from a time that may be in microseconds; null beyond the longs."""
    kept = F.when(F.abs(t) < 9.2e18, t)
    return F.when(kept > 1e14, F.floor(kept / 1000)).otherwise(kept).try_cast("long")


def bucket(t: Column, width: int) -> Column:
    return t - F.pmod(t, F.lit(width))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sorted_median(values: Column) -> Column:
    """Median of an array: the middle of the sorted values, or the mean of the middle two."""
    s, n = F.sort_array(values), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def mad_scale(values: Column) -> Column:
    """1.4826 times the median distance from the median."""
    return F.element_at(F.transform(F.array(sorted_median(values)), lambda m: 1.4826 * sorted_median(F.transform(values, lambda x: F.abs(x - m)))), 1)


def guarded_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums: 0 for under three pairs or where a side does not vary."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    flat = (n < 3) | (vx <= 1e-12 * n * sxx) | (vy <= 1e-12 * n * syy)
    return F.when(flat, 0.0).otherwise((n * sxy - sx * sy) / F.sqrt(F.greatest(vx, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300))))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))

