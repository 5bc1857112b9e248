"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import let, running, span_array

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of candidate strings.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: A candidate is a secret if its log-likelihood ratio is over this many nats in all and over LEAST_RATE for each character.
LEAST_TOTAL = 12.0
LEAST_RATE = 0.55
#: Ordinary words that the built-in samples of identifiers are made of.
COMMON = (
    "get set user name file path data list index value count node tree page text line word token type class object method field "
    "table column row key map item order price total date time start end first last next previous parent child open close read "
    "write send receive request response message error status config option default width height color image button form input "
    "output buffer stream thread process task queue event handler listener service client server session cache memory size length "
    "version update delete insert create remove build test check parse format convert encode decode login account address phone"
).split()


def sample_strings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples (text, random): digests in hexadecimal, base64 and base32 letters, and what else is long in texts.

    Ordinary strings are identifiers of two to five common words in usual styles, with and without numbers, paths, dates, plain
    numbers, rules of one character, and long words without a language.
    """
    words = F.array(*(F.lit(w) for w in COMMON))
    seed = lambda k: F.xxhash64(F.col("id"), F.lit(k))
    word = lambda k: F.element_at(words, (F.pmod(seed(k), F.lit(len(COMMON))) + 1).cast("int"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    style, few = F.pmod(F.col("id"), F.lit(11)), F.pmod(seed(11), F.lit(4)).cast("int") + 2
    parts = F.slice(F.array(*(word(k) for k in range(5))), F.lit(1), few)
    number = F.pmod(seed(9), F.lit(10_000)).cast("string")
    date = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(seed(12), F.lit(15_000)).cast("int")), "yyyy-MM-dd")
    camel = F.regexp_replace(F.initcap(F.concat_ws(" ", parts)), " ", "")
    plain = (
        F.when(style == 0, F.concat_ws("_", parts)).when(style == 1, F.concat_ws("-", parts)).when(style == 2, camel)
        .when(style == 3, F.upper(F.concat_ws("_", parts))).when(style == 4, F.concat(F.lit("/"), F.concat_ws("/", parts))).when(style == 5, F.concat(F.array_join(parts, ""), number))
        .when(style == 6, F.concat_ws("-", date, parts)).when(style == 7, F.concat_ws("_", parts, number)).when(style == 8, F.concat_ws("/", date, F.repeat(number, 4)))
        .when(style == 9, F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 24), "0123456789abcdef", "aeiouxeainrstlmd"))
        .otherwise(F.repeat(F.element_at(F.array(*map(F.lit, "-_/+xX0")), (F.pmod(seed(13), F.lit(7)) + 1).cast("int")), 24))
    )
    kind = F.pmod(F.col("id"), F.lit(6))
    base32 = F.translate(F.upper(F.conv(F.substring(digest, 1, 15), 16, 32)), "0189", "WXYZ")
    secret = F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.upper(F.substring(digest, 1, 32))).when(kind == 2, F.concat(base32, F.reverse(base32))).otherwise(base64)
    rows = spark.range(n)
    return rows.select(plain.alias("text"), F.lit(False).alias("random")).unionByName(rows.select(secret.alias("text"), F.lit(True).alias("random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> dict[str, float]:
    """Log-likelihood ratio (random over ordinary) of each pair of characters, from labelled samples (text, random).

    Counting is a distributed aggregation; only the table of pairs, 66 x 66 at most, reaches the driver. Null texts, null labels
    and pairs with other characters are passed over; without samples every ratio is 0.
    """
    text = F.col("text")
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    rows = samples.where(F.col("random").isNotNull() & (F.length("text") > 1)).select("random", F.explode(pairs).alias("pair")).where(F.col("pair").rlike("^[A-Za-z0-9+/_-]{2}$"))
    counts = {(r["random"], r["pair"]): r["n"] for r in rows.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, size = {}, len(ALPHABET)
    after = {(kind, a): sum(counts.get((kind, a + b), 0) for b in ALPHABET) for kind in (False, True) for a in ALPHABET}
    log = lambda kind, a, b: math.log((counts.get((kind, a + b), 0) + smoothing) / (after[kind, a] + smoothing * size))
    for a in ALPHABET:
        for b in ALPHABET:
            out[a + b] = log(True, a, b) - log(False, a, b)
    return out


def ratio(text: Column, model: dict[str, float]) -> Column:
    """The summed log-likelihood ratio of a string of ALPHABET's characters, by a table look-up for each pair."""
    table = F.split(F.lit(",".join(f"{model[a + b]:.5f}" for a in ALPHABET for b in ALPHABET)), ",").cast("array<double>")
    size = len(ALPHABET)
    codes = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    fold = lambda t: let(codes, lambda k: F.aggregate(F.sequence(F.lit(1), F.size(k) - 1), F.lit(0.0), lambda s, i: s + F.element_at(t, (F.element_at(k, i) - 1) * size + F.element_at(k, i + 1))))
    return F.when(F.length(text) < 2, F.lit(0.0)).otherwise(let(table, fold))


def spans(text: Column, model: dict[str, float]) -> Column:
    """array<struct<start, end, kind, first, last>> of all secrets in a text, in order of start and then of KINDS; null texts have none.

    Fixed patterns find whole matches first and drop those that are too short afterwards, so a short one hides what it covers.
    A candidate string that touches no pattern's span is a secret if the random model explains it better by both margins;
    candidates are whole runs, so none overlap. ``start`` and ``end`` count code points, ``first`` and ``last`` bytes; ends are
    exclusive. Time grows with the text and with hits times the logarithm of their number.
    """
    body = F.coalesce(text, F.lit(""))

    def tagged(found: Column, rank: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["first"].alias("first"), x["last"].alias("last"), (x["hit"] if rank == 3 else F.lit("")).alias("hit")))

    assign = F.filter(span_array(body, ASSIGN, r"(?i)(?:pass|secret|token|api)[a-z_]*[\"']?\x20*[:=]"), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 8)
    found = F.concat(tagged(assign, 0), tagged(span_array(body, ACCESS), 1), tagged(span_array(body, HEX), 2), tagged(span_array(body, CANDIDATE), 3))

    def chosen(a: Column) -> Column:
        # A span of a pattern touches a candidate if an earlier one ends beyond its start, or the next one begins before its end.
        reach = running(F.transform(a, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(0)), lambda x, y: F.greatest(x, y))
        ahead = F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.lit(None)))
        near = F.zip_with(F.zip_with(a, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), ahead, lambda p, y: F.struct(p["x"].alias("x"), ((p["r"] > p["x"]["start"]) | F.coalesce((y["rank"] < 3) & (y["start"] < p["x"]["end"]), F.lit(False))).alias("met")))
        random = lambda x: let(ratio(x["hit"], model), lambda r: (r >= LEAST_TOTAL) & (r >= LEAST_RATE * F.length(x["hit"])))
        return F.transform(F.filter(near, lambda p: (p["x"]["rank"] < 3) | ~p["met"] & random(p["x"])), lambda p: p["x"])

    names = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(names, x["rank"] + 1).alias("kind"), x["first"].alias("first"), x["last"].alias("last"))
    return F.transform(let(F.sort_array(found), lambda a: F.when(F.size(a) == 0, a).otherwise(chosen(a))), shown)


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans) for every row; rows without secrets have an empty array. One pass over the texts and no shuffle.

    Repeated rows are scanned one by one, an empty table gives no rows, and no other column of ``documents`` is read.
    """
    model = train(sample_strings(documents.sparkSession) if samples is None else samples)
    return documents.select(F.col(doc_id).alias("doc_id"), spans(F.col(text), model).alias("spans"))


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each secret of ``spans`` replaced; spans that overlap become one mark. Null texts stay null.

    Pieces are cut from the text's bytes, which takes no longer for a piece far behind.
    """
    raw = text.cast("binary")

    def cut(a: Column) -> Column:
        ends = running(F.transform(a, lambda x: x["last"]), lambda x, y: F.greatest(x, y))
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        # One that begins within an earlier span has neither a piece nor a mark of its own.
        piece = lambda x, at: F.when(x["first"] >= at, F.concat(F.substring(raw, at + 1, x["first"] - at).cast("string"), F.lit(mark))).otherwise("")
        fresh = F.zip_with(a, before, piece)
        return F.concat(F.array_join(fresh, ""), F.substring(raw, F.element_at(ends, -1) + 1, F.octet_length(text)).cast("string"))

    return F.when(F.size(found) == 0, text).otherwise(let(found, cut))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
