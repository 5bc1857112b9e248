"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, and an exact weighted check."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import let, word_array
from ._store import written

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of sets this similar differ in some 10 of 64 bits with a deviation of 3; all within RADIUS are found.
RADIUS = 19
#: With RADIUS // BLOCKS errors at most in one of so many blocks, by the pigeonhole principle.
BLOCKS = 5
#: The index holds some 1800 rows of 50 bytes an item and is broadcast up to so many items, else joined by a shuffle.
MOST_BROADCAST = 1_000
#: Shingles of items (8 bytes each) are broadcast up to so many items, else joined by a shuffle.
MOST_ITEMS = 20_000
#: Bits of the filter of benchmark shingles that is sent with the plan: from and to.
FILTER_BITS = (1 << 16, 1 << 22)


def grams(hashes: Column, n: int) -> Column:
    """array<long>: a hash for each run of n words, given the words' hashes; none for fewer words."""
    runs = F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - (n - 1)), lambda x, i: F.xxhash64(x, *(F.element_at(hashes, i + k + 1) for k in range(1, n))))
    return F.when(F.size(hashes) < n, F.array().cast("array<long>")).otherwise(runs)


def word_hashes(text: Column) -> Column:
    """array<long>: the words' hashes in order, lower-cased."""
    return F.transform(word_array(F.lower(text)), lambda x: F.xxhash64(x))


def item(text: Column) -> Column:
    """struct<size, hashes>: an item's five-word shingles and their number; of fewer words the whole sequence, its size minus the number of words."""
    short = lambda w: F.coalesce(*(F.when(F.size(w) == n, F.struct(F.lit(-n).alias("size"), grams(w, n).alias("hashes"))) for n in range(1, SHINGLE)))
    made = lambda w: F.when(F.size(w) < SHINGLE, short(w)).otherwise(F.struct((F.size(w) - (SHINGLE - 1)).alias("size"), grams(w, SHINGLE).alias("hashes")))
    return let(word_hashes(text), made)


def need(size: Column) -> Column:
    """Shingles that two lists of this length must share at least, to be SIMILARITY alike."""
    return F.ceil(size * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-9).cast("int")


def simhash(hashes: Column) -> Column:
    """64 bits: each is set if most shingles, repeated ones counted as often, have it set."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")).cast("int") * 2 - 1) > 0
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(bit(b), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out


def _parts() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def blocks(code: Column, near: bool) -> Column:
    """array<struct<block, value>>: the parts of a fingerprint; with ``near`` also all values within RADIUS // BLOCKS bits."""

    def spots(k: int, at: int, width: int) -> Column:
        value = F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")
        flips = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1 if near else 1) for bits in combinations(range(width), n)]
        masks = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>")
        return let(value, lambda v: F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), v.bitwiseXOR(m).alias("value"))))

    return F.flatten(F.array(*(spots(k, *part) for k, part in enumerate(_parts()))))


def occurrences(hashes: Column) -> Column:
    """Hashes made distinct by how often each came before, so that intersections of sets count repeats."""
    plain = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(0)))
    numbered = F.transform(hashes, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(hashes, F.lit(1), i), lambda y: y == h))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), plain).otherwise(numbered)


def _bits(values: DataFrame, n: int) -> Column:
    """array<long> with bit ``hash mod n`` set for each value, as a literal of fixed size."""
    slot = F.col("h").bitwiseAND(F.lit(n - 1).cast("long"))
    rows = values.select(F.shiftrightunsigned(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63).cast("long")).alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).collect()
    filled = ["0"] * (n // 64)
    for r in rows:
        filled[r["word"]] = str(r["bits"])
    return F.split(F.lit(",".join(filled)), ",").cast("array<long>")


def _set(bits: Column, hashed: Column, n: int) -> Column:
    slot = hashed.bitwiseAND(F.lit(n - 1).cast("long"))
    word = F.element_at(bits, (F.shiftrightunsigned(slot, 6) + 1).cast("int"))
    return F.call_function("getbit", word, slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def windows(documents: DataFrame, items: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, size, first, hashes): the item-sized windows that can be SIMILARITY alike to an item of that size.

    Such a window shares ``need(size)`` shingles with the item. Two filters of fixed size tell which shingles occur in any item,
    and in an item of this size; a window with fewer of them is not alike, whatever its fingerprint. As sliding a window right to
    its next such shingle loses none, windows begin at one, or end with the text. Texts shorter than the items of a size are one
    window of it. Runs as long as an item of fewer than five words are windows where they first occur. All this happens inside
    the row: no shuffle, and a text without benchmark shingles makes no window. Sizes for which a text has too few benchmark
    shingles cost it one comparison each; there are no more sizes than words in the longest item.
    """
    flat = items.select("size", F.explode("hashes").alias("h"))
    n = min(max(1 << (64 * max(1, flat.count()) - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    any_bits = _bits(flat.where("size > 0"), n)
    sized_bits = _bits(flat.select(F.xxhash64("h", "size").alias("h")), n)
    known = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]
    sizes, short = [s for s in known if s > 0], [-s for s in known if s < 0]
    kind = "array<struct<size:int,first:int,hashes:array<long>>>"
    none = F.array().cast(kind)
    if not known:
        return documents.select(F.col(doc_id).alias("doc_id"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("array<long>").alias("hashes")).where("false")
    listed = F.split(F.lit(",".join(map(str, sizes))), ",").cast("array<int>")

    def enough(count: Column, size: Column) -> Column:
        """Shingles to share; a text shorter than the size must share those of the longer list with it."""
        return F.when(count >= size, need(size)).otherwise(F.ceil((count + size) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).cast("int"))

    def for_size(h: Column, places: Column, size: Column, bits: Column) -> Column:
        least, last = enough(F.size(h), size), F.greatest(F.lit(0), F.size(h) - size)
        own = F.filter(places, lambda i: _set(bits, F.xxhash64(F.element_at(h, i + 1), size), n))
        dense = lambda p: F.filter(F.transform(p, lambda x, j: F.when((j + least <= F.size(p)) & (F.get(p, j + least - 1) - x < size), F.least(x, last))), lambda x: x.isNotNull())
        starts = let(own, lambda p: F.when(F.size(p) < least, F.array().cast("array<int>")).otherwise(F.array_distinct(dense(p))))
        return F.transform(starts, lambda s: F.struct(size.alias("size"), s.alias("first"), F.slice(h, s + 1, size).alias("hashes")))

    def found(h: Column) -> Column:
        # A text shorter than all items may hold as little as SIMILARITY of the smallest one's shingles and no others.
        least = max(1, math.ceil(SIMILARITY * sizes[0] - 1e-9))
        places = let(any_bits, lambda bits: F.filter(F.transform(h, lambda x, i: F.when(_set(bits, x, n), i)), lambda i: i.isNotNull()))
        able = lambda p: F.filter(listed, lambda s: F.size(p) >= enough(F.size(h), s))
        every = lambda p: let(sized_bits, lambda bits: F.flatten(F.transform(able(p), lambda s: for_size(h, p, s, bits))))
        return let(places, lambda p: F.when(F.size(p) < least, none).otherwise(every(p).cast(kind)))

    def runs(w: Column, k: int) -> Column:
        hits = lambda g: let(sized_bits, lambda bits: F.array_distinct(F.filter(g, lambda x: _set(bits, F.xxhash64(x, F.lit(-k)), n))))
        return let(grams(w, k), lambda g: F.transform(hits(g), lambda x: F.struct(F.lit(-k).alias("size"), (F.array_position(g, x) - 1).cast("int").alias("first"), F.array(x).alias("hashes"))).cast(kind))

    def every(w: Column) -> Column:
        parts = [let(grams(w, SHINGLE), found)] if sizes else []
        return F.concat(*parts, *(runs(w, k) for k in short))

    rows = documents.where(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), let(word_hashes(F.col(text)), every).alias("w"))
    return rows.where(F.size("w") > 0).select("doc_id", F.explode("w").alias("w")).select("doc_id", "w.size", "w.first", "w.hashes")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingles: common occurrences over all."""
    common = F.size(F.array_intersect(occurrences(a), occurrences(b)))
    return common / (F.size(a) + F.size(b) - common)


def leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (doc_id, item_id) whose text has a window of the item's size that is SIMILARITY alike to it, or more.

    Columns: doc_id, item_id, similarity (of the best window), first_word and n_words of that window. Pairs come from the index of
    fingerprints and are then compared exactly. Null, empty and blank texts have no shingles; an item of fewer than five words is
    found where its words stand in a row. Of equal windows the earliest is reported, repeated rows are reported once, and items
    with the same text each have their row; an item_id that repeats with another text counts by its best one. Either table may
    be empty; then no row results. No other columns are read.
    """
    made = benchmark.select(F.col(item_id).alias("item_id"), item(F.col(item_text)).alias("i")).where("i is not null").select("item_id", "i.size", "i.hashes")
    items = written(made.distinct().select("item_id", F.xxhash64("item_id", "hashes").alias("item"), "size", "hashes", simhash(F.col("hashes")).alias("code")), "decontam-items")
    count = items.count()
    spots = windows(documents, items, doc_id, text)
    # In a frame of its own, so that later steps read the windows, not the texts again.
    spots = written(spots.select("doc_id", "size", "first", "hashes", simhash(F.col("hashes")).alias("code")), "decontam-windows")
    # One number for size, block and value, 16 bits for the last two.
    key = (F.col("size").cast("long") * (1 << 16) + F.col("b.block") * (1 << 13) + F.col("b.value")).alias("key")
    index = items.select("item", "size", F.col("code").alias("item_code"), F.explode(blocks(F.col("code"), near=True)).alias("b")).select("item", "item_code", "b.block", key)
    probes = spots.select("doc_id", "size", "first", "hashes", "code", F.explode(blocks(F.col("code"), near=False)).alias("b")).select("doc_id", "first", "hashes", "code", key)
    within = F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= RADIUS
    # A pair may be met in several blocks; the first block within reach keeps it, so none is compared twice.
    first_block = F.lit(BLOCKS)
    for k, (at, width) in reversed(list(enumerate(_parts()))):
        differ = F.bit_count(F.shiftrightunsigned(F.col("code").bitwiseXOR(F.col("item_code")), at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        first_block = F.when(differ <= RADIUS // BLOCKS, F.lit(k)).otherwise(first_block)
    met = probes.join(F.broadcast(index) if count <= MOST_BROADCAST else index, "key").where(within & (F.col("block") == first_block))
    full = items.select("item", "item_id", "size", F.col("hashes").alias("item_hashes"))
    pairs = met.select("item", "doc_id", "first", "hashes").join(F.broadcast(full) if count <= MOST_ITEMS else full, "item")
    words = F.when(F.col("size") < 0, -F.col("size")).otherwise(F.size("hashes") + SHINGLE - 1)
    alike = pairs.select("doc_id", "item_id", "first", words.alias("n"), similarity(F.col("hashes"), F.col("item_hashes")).alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    best = alike.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first")).alias("back"), "n")).alias("m"))
    return best.select("doc_id", "item_id", F.round("m.similarity", 6).alias("similarity"), (-F.col("m.back")).cast("long").alias("first_word"), F.col("m.n").cast("long").alias("n_words"))


def op5_decontam(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same rows by comparing items with all windows that begin at one of their shingles, or end with the text.
ORACLE = {
    "op5_decontam": r"""WITH i AS (SELECT *, CASE WHEN len(w) >= 5 THEN 5 ELSE len(w) END AS g FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
a AS (SELECT item_id, g, list_transform(range(1, len(w) - g + 2), lambda k: array_to_string(w[k:k + g - 1], ' ')) AS a FROM i),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text <> ''),
s AS (SELECT row, doc_id, g, list_transform(range(1, len(w) - g + 2), lambda k: array_to_string(w[k:k + g - 1], ' ')) AS s FROM d, (SELECT DISTINCT g FROM i) WHERE len(w) >= g),
c AS (SELECT DISTINCT row, g, item_id, a FROM (SELECT row, g, unnest(s) AS h FROM s) JOIN (SELECT item_id, g, a, unnest(a) AS h FROM a) USING (g, h)),
p AS (SELECT doc_id, item_id, g, a, s, unnest(list_filter(range(1, greatest(1, len(s) - len(a) + 1) + 1), lambda k: list_contains(a, s[k]) OR k = greatest(1, len(s) - len(a) + 1))) AS k FROM c JOIN s USING (row, g)),
b AS (SELECT doc_id, item_id, g, a, k, s[k:k + len(a) - 1] AS b FROM p),
m AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS n FROM b),
r AS (SELECT doc_id, item_id, g, len(b) AS size, k, n / (len(a) + len(b) - n)::DOUBLE AS similarity FROM m),
z AS (SELECT doc_id, item_id, max((similarity, -k, size, g)) AS z FROM r WHERE similarity >= 0.8 GROUP BY doc_id, item_id)
SELECT doc_id, item_id, round(z[1], 6) AS similarity, (-z[2] - 1)::BIGINT AS first_word, CASE WHEN z[4] < 5 THEN z[4] ELSE z[3] + 4 END::BIGINT AS n_words FROM z"""
}
