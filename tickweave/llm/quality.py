"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source, then a joined filter."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._native import BLANKS, let, word_array
from ._store import written

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rate, ``count`` over ``units``, and its fence: the quantile at ``level`` of a group's texts, and ``reach`` times its distance to the median beyond it.

    With ``far`` that distance is at least the one of the quantile at ``far`` over ``ratio``, so that a group with one usual value
    keeps a width; for the normal distribution the two are equal.

    Incidental marks are rare in good texts, so a tenth of a group may be junk before it moves the fence of symbols; repetition
    is frequent in good texts, so its fence lies beyond the last hundredth.
    """

    name: str
    count: str
    units: str
    level: float
    reach: float
    both_sides: bool = False
    far: float | None = None
    ratio: float = 1.0


RULES = (
    Rule("symbol_rate", "n_symbols", "n_words", 0.9, 0.0),
    Rule("dup_line_rate", "n_dup_lines", "n_lines", 0.99, 0.5),
    Rule("repeat_rate", "n_repeat_words", "n_words", 0.99, 0.5),
    Rule("word_length", "word_chars", "n_words", 0.75, 2.0, both_sides=True, far=0.95, ratio=2.44),
)
#: A group's quantiles are mixed with its language's, and those with the corpus's, as if so many texts came from there.
PRIOR_TEXTS = 50.0
#: A text is outside if its count differs from the fence's by more than so many deviations of a count.
DEVIATIONS = 3.0
#: Relative width of a sketch's buckets: quantiles are exact but for half of it.
GAMMA = 1.01
#: The bucket of rates of 0.
ZERO = -1_000_000
#: Thresholds are broadcast up to so many groups (some 150 bytes each), else joined by a shuffle.
MOST_BROADCAST = 100_000


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array, the first find included.

    Windows are sorted with their places, equal neighbours give the places of repeated windows, and the gaps between sorted
    places, three at most, add up to the words covered.
    """
    empty = F.array().cast("array<int>")

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))

    def places(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        n = F.size(hashes)
        pairs = let(tagged, lambda t: F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.coalesce(places(hashes), empty), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.element_at(w, i + 2), F.element_at(w, i + 3)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), count))).cast("long")


def measure(text: Column) -> Column:
    """struct of the counts that the rules use; null texts count as empty."""
    body = F.coalesce(text, F.lit(""))
    squeezed = F.translate(body, BLANKS, "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))

    found = let(word_array(text), counts)
    return F.struct(
        found["n_words"].alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
        found["n_repeat_words"].alias("n_repeat_words"),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def rate(m: Column, r: Rule) -> Column:
    """What a rule's sketch holds; null for texts without words."""
    return m[r.count] / F.nullif(m[r.units], F.lit(0).cast("long")).cast("double")


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, rule, bucket, n): quantile sketches with buckets of a constant relative width.

    Two sketches merge by adding the counts of equal buckets, in any order and always to the same result, so reruns agree. A group
    has some 700 buckets to a factor of a thousand, whatever its rows; tasks count their own rows first.
    """
    bucket = lambda x: F.when(x > 0, F.ceil(F.log(x) / math.log(GAMMA)).cast("int")).otherwise(F.lit(ZERO))
    found = F.array(*(F.struct(F.lit(r.name).alias("rule"), rate(F.col("m"), r).alias("x")) for r in RULES))
    each = rows.select(*keys, F.explode(found).alias("f")).where("f.x is not null")
    return each.groupBy(*keys, F.col("f.rule").alias("rule"), bucket(F.col("f.x")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


QUANTILES = ("mid", "hi", "lo", "far_hi", "far_lo")


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, rule, n, mid, hi, lo, far_hi, far_lo): the median, and the quantiles at a rule's two levels and opposite to them."""
    by = Window.partitionBy(*keys, "rule")
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (GAMMA + 1)))
    of_rule = lambda get: F.element_at(F.create_map(*(F.lit(x) for r in RULES for x in (r.name, get(r)))), F.col("rule"))
    rows = sketch.withColumn("seen", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by)).withColumn("value", value)
    rows = rows.withColumn("level", of_rule(lambda r: r.level)).withColumn("far", of_rule(lambda r: r.far or r.level))
    at = lambda p: F.min(F.when(F.col("seen") >= F.greatest(F.lit(1), F.ceil(p * F.col("all") - 1e-9)), F.col("value")))
    return rows.groupBy(*keys, "rule").agg(F.max("all").alias("n"), at(F.lit(0.5)).alias("mid"), *(at(c).alias(n) for n, c in zip(QUANTILES[1:], (F.col("level"), 1 - F.col("level"), F.col("far"), 1 - F.col("far")))))


def thresholds(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) with n and lo_/hi_ bounds of each rule; ``rows`` has the counts as a struct ``m``.

    What is shuffled is a group's buckets in each task; sketches of groups are merged into those of languages and of the corpus.
    """
    keys = ["lang", "source"]
    own = written(sketches(rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), "m"), keys), "quality-sketches")
    renamed = lambda df, mark: df.select(*(F.col(c).alias(f"{mark}_{c}") for c in df.columns))
    total, by_lang = (merged(own, k) for k in ([], ["lang"]))
    total, by_lang = renamed(quantiles(total, []), "a"), renamed(quantiles(by_lang, ["lang"]), "l")
    mixed = lambda n, x, y: (n * x + PRIOR_TEXTS * y) / (n + PRIOR_TEXTS)
    rows = quantiles(own, keys).join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(total, F.col("rule") == F.col("a_rule"))
    rows = rows.select("lang", "source", "rule", "n", *(mixed(F.col("n"), F.col(c), mixed(F.col("l_n"), F.col(f"l_{c}"), F.col(f"a_{c}"))).alias(c) for c in QUANTILES))
    out = []
    for r in RULES:
        up, down = (F.greatest(sign * (F.col(q) - F.col("mid")), sign * (F.col(f"far_{q}") - F.col("mid")) / r.ratio) for q, sign in (("hi", 1), ("lo", -1)))
        hi, lo = F.col("hi") + r.reach * up, F.col("lo") - r.reach * down
        out.append(F.max(F.when(F.col("rule") == r.name, hi)).alias(f"hi_{r.name}"))
        out.append(F.max(F.when((F.col("rule") == r.name) & F.lit(r.both_sides), lo)).alias(f"lo_{r.name}"))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *out)


def outside(m: Column, r: Rule, low: Column, high: Column) -> Column:
    """Whether a text's count lies beyond a fence by more than the chance of a text of its length explains; null bounds hold nothing out."""
    k, n = m[r.count].cast("double"), m[r.units].cast("double")
    spread = lambda bound: DEVIATIONS * F.sqrt(F.greatest(bound, F.lit(0.0)) * n + 1)
    return F.coalesce(k - high * n > spread(high), F.lit(False)) | F.coalesce(low * n - k > spread(low), F.lit(False))


def judge(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", carry: bool = False) -> DataFrame:
    """One row per row of ``documents`` with its counts, base_failed and the verdict ``kept``.

    A text that the base rules fail is not kept, and no sketch counts it. Another is kept if each measure lies within the fences
    of its (lang, source); rows without language or source form groups of their own. Null and empty texts have no words and so
    fail the base. Repeated rows are judged one by one, and each counts in its group's sketch. With ``carry`` the columns of
    ``documents`` come along as a struct ``row``; otherwise no column but those named here is read. An empty table gives no rows.
    """
    base = documents.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), measure(F.col(text)).alias("m"), *([F.struct("*").alias("row")] if carry else []))
    rated = written(base.withColumn("base_failed", base_failed(F.col("m"))), "quality-measures")
    bounds = thresholds(rated.where(~F.col("base_failed")))
    bounds = written(bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in bounds.columns if c[:3] in ("hi_", "lo_")]), "quality-bounds")
    if bounds.count() <= MOST_BROADCAST:
        bounds = F.broadcast(bounds)
    joined = rated.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = F.lit(False)
    for r in RULES:
        out = out | outside(F.col("m"), r, F.col(f"lo_{r.name}"), F.col(f"hi_{r.name}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~out)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, "base_failed", "kept")


def _oracle() -> str:
    """The same rows from sorted lists of bucket numbers instead of sketches."""
    rates = " UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {r.count} / {r.units}::DOUBLE AS x FROM m WHERE NOT base_failed AND {r.units} > 0" for r in RULES)
    of_rule = lambda get: "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {get(r)}" for r in RULES) + " END"
    level, far = of_rule(lambda r: r.level), of_rule(lambda r: r.far or r.level)
    at = lambda p: f"(l[greatest(1, ceil(({p}) * len(l) - 1e-9))::BIGINT])"
    value = lambda p: f"CASE WHEN {at(p)} = {ZERO} THEN 0 ELSE pow({GAMMA}, {at(p)}) * {2 / (GAMMA + 1)!r} END"
    points = ", ".join(f"{value(p)} AS {n}" for n, p in zip(QUANTILES, ("0.5", level, f"1 - {level}", far, f"1 - {far}")))
    lists = lambda keys: f"SELECT {keys}rule, len(l) AS n, {points} FROM (SELECT {keys}rule, list_sort(list(b)) AS l FROM x GROUP BY {keys}rule)"
    mix = lambda n, x, y: f"({n} * {x} + {PRIOR_TEXTS} * {y}) / ({n} + {PRIOR_TEXTS})"
    mixed = ", ".join(f"{mix('g.n', f'g.{q}', '(' + mix('k.n', f'k.{q}', f'a.{q}') + ')')} AS {q}" for q in QUANTILES)
    fences, tests = [], []
    for r in RULES:
        own = lambda e, r=r: f"max({e}) FILTER (WHERE rule = '{r.name}')"
        fences.append(f"{own(f'hi + {r.reach} * greatest(hi - mid, (far_hi - mid) / {r.ratio})')} AS hi_{r.name}")
        beyond = lambda bound: f"{DEVIATIONS} * sqrt(greatest({bound}, 0) * m.{r.units} + 1)"  # noqa: B023, E731
        tests.append(f"coalesce(m.{r.count} - hi_{r.name} * m.{r.units} > {beyond(f'hi_{r.name}')}, false)")
        if r.both_sides:
            fences.append(f"{own(f'lo - {r.reach} * greatest(mid - lo, (mid - far_lo) / {r.ratio})')} AS lo_{r.name}")
            tests.append(f"coalesce(lo_{r.name} * m.{r.units} - m.{r.count} > {beyond(f'lo_{r.name}')}, false)")
    return rf"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT row, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS run FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, run) AS k FROM g) WHERE k > 1),
v AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM c) GROUP BY row),
n AS (SELECT row, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
m AS (SELECT n.* EXCLUDE (lines), len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(v.n, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(v.n, 0) > 50 * n_words AS base_failed FROM n LEFT JOIN v USING (row)),
x AS (SELECT lang, source, rule, CASE WHEN x > 0 THEN ceil(ln(x) / ln({GAMMA}))::BIGINT ELSE {ZERO} END AS b FROM ({rates})),
own AS ({lists("lang, source, ")}), langs AS ({lists("lang, ")}), every AS ({lists("")}),
f AS (SELECT lang, source, {", ".join(fences)} FROM (SELECT g.lang, g.source, g.rule, {mixed} FROM own g JOIN langs k ON k.lang IS NOT DISTINCT FROM g.lang AND k.rule = g.rule JOIN every a ON a.rule = g.rule) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(tests)}) AS kept
FROM m LEFT JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source"""


ORACLE = {"op9_quality": _oracle()}
