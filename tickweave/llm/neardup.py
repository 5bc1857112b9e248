"""MinHash near-duplicate detection: banded candidates, odd sketches to thin them, and exact comparison of full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from . import _flat
from ._store import small_batches, trimmed, written

SHINGLE = 5
#: Links: percent * union <= 100 * intersection. What op6_neardup links at, and what others do.
OP6_PERCENT, PERCENT = 85, 80
#: 25 bands of 5 minima find a pair of similarity 0.85 but for one in two million, of 0.80 but for one in twenty thousand.
BANDS, ROWS = 25, 5
MINIMA = 128
SKETCH_BITS = 512
#: Members of larger buckets first meet one centre each; all members of a smaller bucket meet its centre.
LARGE = 64
#: Rows of a bucket that one task compares with as many others: by sketches (some 100 bytes each), and by full sets.
SKETCHES, BLOCK = 8192, 500
#: Shingles that a block of full sets holds on average at most: where sets are large, it has fewer rows.
BLOCK_SHINGLES = 1 << 21
#: Ids are broadcast up to so many (8 bytes each), else joined by a shuffle.
MOST_BROADCAST = 2_000_000

_rng = np.random.Generator(np.random.PCG64(85))
_A = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_SALT = _flat.mix(np.arange(1, MINIMA + 1, dtype=np.uint64))


def text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; of the whole sequence if it has fewer words."""
    data, offsets = _flat.buffers(texts)
    for first, last in _flat.pieces(offsets):
        hashes, marks = _flat.words(data, offsets[first : last + 1])
        runs = _flat.grams(hashes, SHINGLE)
        for k in range(last - first):
            a, b = int(marks[k]), int(marks[k + 1])
            if b - a >= SHINGLE:
                own = np.sort(runs[a : b - SHINGLE + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                yield _flat.mix(_flat.grams(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(values):
        return 0, 0
    return int(np.sum(_flat.mix(values), dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(_flat.mix(values + np.uint64(77))).astype(np.int64))


def minima(values: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.uint64(2**64 - 1))
    for k in range(0, len(values), 512):
        part = values[k : k + 512, None] * _A
        part += _B
        np.minimum(out, part.min(0), out=out)
    return out


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the minima: a bit is set if an odd number of (place, minimum) falls on it."""
    at = _flat.mix(low + _SALT) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def sketched(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands, sketch): set size, 128 bits that stand for the set, band keys and odd sketch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, bands, sketches = [], [], [], [], []
            for values in text_sets(batch.column(1)):
                n.append(len(values))
                one, two = signature(values)
                s1.append(one)
                s2.append(two)
                low = minima(values)
                bands.append(_flat.mix(_flat.grams(low[: BANDS * ROWS], ROWS)[::ROWS] + np.arange(BANDS, dtype=np.uint64)).view(np.int64) if len(values) else None)
                sketches.append(odd_sketch(low) if len(values) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs)], names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])

    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: trimmed(each(b)), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>")


def full_sets(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, shingles): the sets that confirm links, for the (node, doc_id, s1, s2) wanted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(text_sets(batch.column(1)))
            s1, s2 = zip(*map(signature, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "s1", "s2", "shingles"])

    wanted = wanted.withColumnRenamed("doc_id", "of")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    own = F.col("doc_id").eqNullSafe(F.col("of"))
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(wanted.select("of"), own, "left_semi")
    made = texts.mapInArrow(lambda b: trimmed(each(b)), "doc_id long, s1 long, s2 long, shingles array<long>")
    sets = made.join(wanted.withColumnsRenamed({"s1": "w1", "s2": "w2"}), own & (F.col("s1") == F.col("w1")) & (F.col("s2") == F.col("w2")))
    return written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "neardup-sets")


@cache
def most_odd(percent: int) -> int:
    """Bits in which the sketches of a pair that is to be compared may differ.

    By the distribution of the bits: a pair of similarity ``percent`` differs in more no oftener than the bands miss it.
    """
    like, k = percent / 100, np.arange(SKETCH_BITS + 1)
    up, down = (SKETCH_BITS - k) / SKETCH_BITS, k / SKETCH_BITS
    tossed, odd = np.zeros(SKETCH_BITS + 1), np.zeros(SKETCH_BITS + 1)
    tossed[0] = 1
    for differ in range(MINIMA + 1):
        odd += comb(MINIMA, differ) * (1 - like) ** differ * like ** (MINIMA - differ) * tossed
        for _ in range(2):  # a minimum of either set
            tossed = np.concatenate(([0], (tossed * up)[:-1])) + np.concatenate(((tossed * down)[1:], [0]))
    more = np.append(np.cumsum(odd[::-1])[::-1][1:], 0)
    return int(np.flatnonzero(more <= (1 - like**ROWS) ** BANDS)[0])


def odd_bits(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def estimate(a: Column, b: Column) -> Column:
    """Similarity that two odd sketches show: XOR leaves the parity of the minima in which the sets differ."""
    share = F.least(2.0 * odd_bits(a, b) / SKETCH_BITS, F.lit(0.999))
    return 1 + SKETCH_BITS / (4.0 * MINIMA) * F.log(1 - share)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", both.alias("n"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return written(joined.where(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("a", "b"), "neardup-links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the links (a, b); a component is named by its smallest node.

    Alternates large-star and small-star steps, which keep the number of edges and reach the stars in few rounds. Each round is
    written to the shared folder. Nothing but counts reaches the driver.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        both = both if large else both.where("v <= u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumn("k", F.xxhash64("u"))
        # The second key has both sides dealt out for the join itself, so that a node with very many links can be split.
        met = both.withColumn("k", F.xxhash64("u")).join(least, ["u", "k"])
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    edges, before = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), None
    while True:
        edges = written(star(star(edges, True), False), "components")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _tiles(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each key cut into parts by a hash of rep, and every two parts of a key as one group (i, j); ``rows`` has their number n."""
    parts = F.ceil(F.col("n") / size).cast("int")
    part = F.pmod(F.xxhash64("rep", "key"), parts).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j")))
    return rows.withColumn("parts", parts).withColumn("part", part).withColumn("t", F.explode(tiles)).withColumn("i", F.col("t.i")).withColumn("j", F.col("t.j")).drop("t", "parts", "n")


def _sketches(table: pa.Table) -> np.ndarray:
    return table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)


def _rest(buckets: DataFrame, seen: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that lie in different components so far.

    A bucket is cut into blocks, and every two blocks meet in a group of their own, so no task holds more than two blocks and
    what a large bucket costs is spread over tasks. First large blocks of ids and sketches alone tell which members have one of
    another component with a sketch like theirs. Only those are then compared on full sets, in blocks that are small in rows and
    in shingles. A link joins two components, so a group has fewer links than members.
    """
    most = most_odd(percent)

    def alike(table: pa.Table) -> pa.Table:
        part, rep, comp = (table.column(c).to_numpy() for c in ("part", "rep", "component"))
        sketch, met = _sketches(table), np.zeros(len(rep), bool)
        left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
        for x in left:
            near = (comp[right] != comp[x]) & (np.bitwise_count(sketch[right] ^ sketch[x]).sum(1, dtype=np.int64) <= most)
            if near.any():
                met[x] = True
                met[right[near]] = True
        key, size = table.column("key").to_numpy(), table.column("n_shingles").to_numpy()
        return pa.table({"key": pa.array(key[met], pa.int64()), "rep": pa.array(rep[met], pa.int64()), "size": pa.array(size[met], pa.int64())})

    def compare(table: pa.Table) -> pa.Table:
        part, rep, comp = (table.column(c).to_numpy() for c in ("part", "rep", "component"))
        comp = comp.copy()
        sketch, column = _sketches(table), table.column("shingles").combine_chunks()
        values, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())
        begins = np.concatenate(([0], ends[:-1]))
        size = ends - begins
        one, two = int(part.min()), int(part.max())
        left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
        links = []
        for x in left:
            odd = np.bitwise_count(sketch[right] ^ sketch[x]).sum(1, dtype=np.int64)
            near = right[(odd <= most) & (comp[right] != comp[x]) & ((right > x) | (one != two))]
            if not len(near):
                continue
            own = values[begins[x] : ends[x]]
            others = np.concatenate([values[begins[y] : ends[y]] for y in near])
            found = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            common = np.add.reduceat(found.astype(np.int64), np.cumsum(size[near]) - size[near])
            for y in near[100 * common >= percent * (size[near] + size[x] - common)]:
                if comp[y] != comp[x]:
                    links.append((rep[x], rep[y]))
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    labelled = buckets.join(seen.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi and n > 2").select("key", "n", F.xxhash64("key").alias("k"))
    rows = labelled.withColumn("k", F.xxhash64("key")).join(mixed, ["key", "k"]).select("key", "rep", "component", "n")
    rows = written(rows.join(reps.select(F.col("node").alias("rep"), "sketch", "n_shingles"), "rep"), "neardup-mixed")
    pairs = _tiles(rows, SKETCHES).groupBy("key", "i", "j").applyInArrow(alike, "key long, rep long, size long")
    wanted = written(pairs.distinct(), "neardup-alike")
    weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("size") * (BLOCK / BLOCK_SHINGLES)))
    counts = wanted.groupBy("key").agg(weight.alias("n")).withColumn("k", F.xxhash64("key"))
    few = rows.drop("n", "n_shingles").join(wanted, ["key", "rep"], "left_semi").withColumn("k", F.xxhash64("key")).join(counts, ["key", "k"]).drop("k")
    full = few.join(sets.select(F.col("node").alias("rep"), "shingles"), "rep")
    return written(_tiles(full, BLOCK).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "neardup-rest")


def cluster(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; sets of a similarity of ``percent`` / 100 or more link.

    Equal sets are one representative, so copies never meet in pairs. Representatives that share a band are first compared with
    the smallest of their bucket (of large buckets, with the smallest of all theirs); then buckets that still hold several
    components are compared in blocks, each pair in different components whose odd sketches are alike. Every link is confirmed on
    full sets.

    Null, empty and blank texts have no set and link with nothing; texts of one to four words are one shingle. Repeated rows of a
    doc_id keep their rows and share a component, whatever their texts: each of them is compared. Rows without doc_id are no
    smallest one: a component of such rows alone has none, and its rows are kept. An empty table gives no rows; other columns are
    not read.
    """
    ship(documents.sparkSession)
    docs = written(sketched(documents, doc_id, text), "neardup-sketches")
    same = ["s1", "s2", "n_shingles"]
    # A node for each different set, numbered once it is written, so that a doc_id with several texts has as many nodes.
    group = docs.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("doc_id"))
    group = written(group.withColumn("node", F.monotonically_increasing_id()), "neardup-groups")
    # The second key has both sides dealt out for the join itself, so that a set of very many copies can be split.
    key = F.xxhash64("s1")
    rows = written(docs.select("doc_id", *same).withColumn("k", key).join(group.select(*same, "node", key.alias("k")), [*same, "k"], "left").select("doc_id", "n_shingles", "node"), "neardup-rows")
    reps = docs.select("doc_id", *same, "bands", "sketch").join(group, ["doc_id", *same]).union(docs.where("doc_id is null").select("doc_id", *same, "bands", "sketch").join(group.where("doc_id is null").drop("doc_id"), same).select("doc_id", *same, "bands", "sketch", "node"))
    reps = written(reps.dropDuplicates(["node"]).select("node", "doc_id", "n_shingles", "s1", "s2", "bands", "sketch"), "neardup-reps")
    keyed = reps.select(F.col("node").alias("rep"), "doc_id", F.explode("bands").alias("key"))
    # Centres are the smallest doc_ids, as originals mostly come before their copies.
    shared = keyed.groupBy("key").agg(F.coalesce(F.min_by("rep", "doc_id"), F.min("rep")).alias("center"), F.min("doc_id").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("k", F.xxhash64("key"))
    buckets = written(keyed.drop("doc_id").withColumn("k", F.xxhash64("key")).join(shared, ["key", "k"]).select("key", "rep", "center", "of", "n"), "neardup-buckets")
    members = written(reps.select("node", "doc_id", "s1", "s2").join(buckets.select(F.col("rep").alias("node")).distinct(), "node", "left_semi"), "neardup-members")
    sets = full_sets(documents, members, doc_id, text)
    small = buckets.where(F.col("n") <= LARGE).select(F.col("center").alias("a"), F.col("rep").alias("b"))
    large = buckets.where(F.col("n") > LARGE).groupBy(F.col("rep").alias("b")).agg(F.coalesce(F.min_by("center", "of"), F.min("center")).alias("a")).select("a", "b")
    stars = small.union(large).where("a != b").distinct()
    marks = reps.select("node", "sketch")
    near = stars.join(marks.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(marks.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    near = written(near.where(odd_bits(F.col("sketch_a"), F.col("sketch_b")) <= most_odd(percent)).select("a", "b"), "neardup-stars")
    # Texts of one doc_id are one document's.
    ids = rows.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    links = confirmed(near, sets, percent).union(rows.join(ids, "doc_id").select("a", F.col("node").alias("b")).where("a != b"))
    first = written(components(links), "neardup-first")
    rest = _rest(buckets.select("key", "rep"), first, reps, sets, percent)
    if rest.take(1):
        first = written(components(links.union(rest)), "neardup-second")
    # A component is named by its smallest doc_id; one of a single set, by that of its rows.
    label = first.join(group.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("name"))
    # The second key once more, for a component of very many sets.
    whole = F.xxhash64("component")
    named = first.withColumn("k", whole).join(label.withColumn("k", whole), ["component", "k"]).select("node", "name")
    found = group.select("node", "doc_id").join(named, "node", "left").select("node", F.coalesce("name", "doc_id").alias("name"), F.xxhash64("node").alias("k"))
    out = rows.withColumn("k", F.xxhash64("node")).join(found, ["node", "k"], "left")
    component = F.coalesce("name", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op6_neardup(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=OP6_PERCENT)


#: The same rows from exact sets alone, for tables small enough to join all shingles.
ORACLE = {
    "op6_neardup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
x AS (SELECT doc_id, i, n, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS h FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, list_sort(list(DISTINCT h)) AS s FROM x WHERE i <= greatest(1, n - 4) GROUP BY doc_id),
g AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS h FROM g),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.h = b.h AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM c WHERE 100 * shared >= 85 * (na + nb - shared)),
r AS (SELECT rep AS node, rep AS seen FROM g UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
k AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
m AS (SELECT s.doc_id, len(s.s) AS n, k.component FROM s JOIN g ON g.s = s.s JOIN k ON k.node = g.rep)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id"""
}
