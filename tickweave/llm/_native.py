"""Column helpers for operators that stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The runs of characters other than space and 0x09-0x0D; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def running(values: Column, join: Callable[[Column, Column], Column], size: int = 256) -> Column:
    """Running results of an associative ``join`` over an array without nulls.

    A fold that appends copies what it has at each step, so the array is folded in pieces of ``size``; their last results are
    folded in turn and joined to the pieces after them.
    """

    def fold(a: Column) -> Column:
        start = F.struct(F.get(a, F.size(a)).alias("at"), F.slice(a, F.lit(1), F.lit(0)).alias("out"))
        grown = lambda s, v: F.struct(v.alias("at"), F.concat(s["out"], F.array(v)).alias("out"))
        return F.aggregate(a, start, lambda s, x: let(F.when(s["at"].isNull(), x).otherwise(join(s["at"], x)), lambda v: grown(s, v)), lambda s: s["out"])

    def joined(parts: Column) -> Column:
        ends = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        before = F.sequence(F.lit(0), F.size(parts) - 1)
        return let(ends, lambda e: F.flatten(F.zip_with(parts, before, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: join(F.get(e, k - 1), x))))))

    def whole(a: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(a), F.lit(size))
        return let(F.transform(firsts, lambda k: fold(F.slice(a, k, F.lit(size)))), joined)

    return let(values, lambda a: F.when(F.size(a) < 2, a).when(F.size(a) <= size, fold(a)).otherwise(whole(a)))


def span_array(text: Column, pattern: str, gate: str | None = None) -> Column:
    """array<struct<start, end, first, last, hit>> of the leftmost non-overlapping matches of a pattern that never matches nothing.

    ``start`` and ``end`` count code points, ``first`` and ``last`` bytes; ends are exclusive. Splitting at the pattern gives the
    pieces between the matches, so running sums of the lengths of pieces and matches are the offsets. ``gate`` is a cheaper
    pattern that finds something in any text with a match.
    """
    empty = F.array().cast("array<struct<start:int,end:int,first:int,last:int,hit:string>>")
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda a, b: F.struct((F.length(a) + F.length(b)).alias("n"), (F.octet_length(a) + F.octet_length(b)).alias("b"))
    add = lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), (x["b"] + y["b"]).alias("b"))
    span = lambda e, h: F.struct((e["n"] - F.length(h)).alias("start"), e["n"].alias("end"), (e["b"] - F.octet_length(h)).alias("first"), e["b"].alias("last"), h.alias("hit"))

    def found(h: Column) -> Column:
        # The last piece has no match after it; zip only pairs as many as there are matches.
        ends = running(F.zip_with(F.slice(pieces, F.lit(1), F.size(h)), h, size), add)
        return F.when(F.size(h) == 0, empty).otherwise(F.zip_with(ends, h, span))

    return F.when(text.rlike(gate or pattern), let(hits, found)).otherwise(empty)
