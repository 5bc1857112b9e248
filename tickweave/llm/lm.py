"""Language-model scoring: an interpolated modified Kneser-Ney model of order 2 or 3 in sorted, memory-mapped arrays.

The model is counted in three Spark steps (five with order 3), each of which leaves arrays in the shared folder:

1. words: hashes of all training words, sorted, with counts; a word's id is its place in that order;
2. pairs: (id, id) in one 64-bit key, sorted, with counts, and for each first word how many pairs follow it once, twice, more often;
3. followers: for each word how many different words it follows;
4. triples: a pair's place in its range and the word that follows, in one key, sorted, with counts, and for each pair how many
   words follow it once, twice, more often;
5. before pairs: for each pair how many different words it follows, which stands for its count below triples. Only pairs that
   begin texts, which nothing precedes, keep their counts.

Ids are dealt to shards by ranges, so shards in order are one sorted array, and as ids rank hashes every range has as many words.
Pairs are dealt by ranges of their keys that the words' counts make equally heavy: a range has first words that occur PAIRS times
in all, and a word that alone occurs more often has several ranges, by its second words. So a shard of pairs stays as small in a
large corpus, and there are more of them. A range's triples are a shard, too: they occur no oftener than its pairs. Rows are
pre-aggregated before each shuffle. Only counts of counts and the list of shards reach the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from . import _flat
from ._store import folder, map_array, put_array, small_batches, trimmed, written

#: Stands for the end of a text among the word hashes.
END = np.uint64(0x5BD1E9955BD1E995)
#: Training words whose pairs one shard holds at most.
PAIRS = 1 << 22
#: Keys that a task gathers before it sums them.
GATHER = 1 << 21


class Tally:
    """Sums counts of 64-bit keys in bounded steps; what is kept is one row for each different key of the task."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.fresh.append((keys, counts))
        self.size += len(keys)
        if self.size > max(GATHER, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        parts = []
        plain = [k for k, c in self.fresh if c is None]
        if plain:
            keys = np.sort(np.concatenate(plain))
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
            parts.append((keys[at], np.diff(np.append(at, len(keys)))))
        parts += [(k, c) for k, c in self.fresh if c is not None]
        if parts:
            keys = np.concatenate([self.keys, *(k for k, _ in parts)])
            counts = np.concatenate([self.counts, *(c for _, c in parts)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
            self.keys = keys[at]
            self.counts = np.add.reduceat(counts, at) if len(at) else np.zeros(0, np.int64)
        self.fresh, self.size = [], 0


def _rows(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(keys), 1 << 16):
        cut = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(keys[cut].view(np.int64)), pa.array(counts[cut].astype(np.int64))], names=["shard", "key", "n"])


ROWS = "shard int, key long, n long"


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[int, Tally]:
    """The shard of a partition (-1 if it has no rows) and its summed rows."""
    tally, shard = Tally(), -1
    for b in batches:
        if len(b):
            shard = b.column(0)[0].as_py()
            tally.add(b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy())
    tally.settle()
    return shard, tally


def _told(shard: int, facts: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([shard], pa.int64()), pa.array([0], pa.int64()), pa.array([json.dumps(facts)])], names=["shard", "key", "n", "facts"])


TOLD = ROWS + ", facts string"


def _facts(rows: DataFrame) -> dict[int, dict]:
    return {r["key"]: json.loads(r["facts"]) for r in rows.where("facts is not null").select("key", "facts").collect()}


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return [int(x) for x in np.bincount(np.minimum(counts, 5), minlength=6)[1:5]]


def _kinds(at: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """For each of the places, how many counts of 1, of 2 and of more it has."""
    return np.stack([np.bincount(at[pick], minlength=size) for pick in (counts == 1, counts == 2, counts > 2)])


def _count_type(counts: np.ndarray) -> str:
    top = int(counts.max()) if len(counts) else 0
    return next(t for t, most in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if top < most)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))[: len(values)])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)]):
        yield int(values[a]), a, b


def _added(facts: dict[int, dict]) -> list[int]:
    return [sum(f["m"][j] for f in facts.values()) for j in range(4)]


def discounts(m: list[int]) -> list[float]:
    """What is taken from counts of 1, 2 and 3 or more; halves of the count where too few counts are known."""
    if min(m) <= 0:
        return [0.5, 1.0, 1.5]
    y = m[0] / (m[0] + 2 * m[1])
    return [min(max(k - (k + 1) * y * m[k] / m[k - 1], 0.05 * k), 0.95 * k) for k in (1, 2, 3)]


@dataclass
class Words:
    """A range of words: the first id, their number, and the names of their arrays."""

    first: int
    size: int
    name: str = ""
    followers: str = ""


@dataclass
class Pairs:
    """A range of pairs: its first words, or the one that it shares with other ranges, and the names of its arrays."""

    first: int
    size: int
    split: bool = False
    name: str = ""
    n: int = 0
    count_type: str = "<u4"
    triples: str = ""
    n_triples: int = 0
    triple_type: str = "<u4"
    #: Arrays of how many words come before each pair.
    lower: str = ""


@dataclass
class Model:
    """What a worker needs to open the arrays."""

    words: list[Words]
    n_words: int
    n_tokens: int
    n_texts: int
    pairs: list[Pairs] = field(default_factory=list)
    #: The first key of each range of pairs.
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: Of first words whose pairs are split: how many follow once, twice, more often, and with order 3 what is before their pairs in all.
    kinds: dict[int, list[int]] = field(default_factory=dict)
    lower_totals: dict[int, int] = field(default_factory=dict)
    total_followers: int = 0
    order: int = 2
    triple_discounts: tuple = (0.5, 1.0, 1.5)
    pair_discounts: tuple = (0.5, 1.0, 1.5)
    word_discounts: tuple = (0.5, 1.0, 1.5)
    word_rest: float = 1.0

    def cut_pairs(self, facts: dict[int, dict]) -> None:
        """Lay out the ranges of pairs from what the words' shards tell."""
        cuts: list[int] = []

        def add(first: int, size: int, pieces: int) -> None:
            for j in range(pieces):
                cuts.append((first << 32) | (j * (self.n_words + 1) // pieces))
                self.pairs.append(Pairs(first, size, pieces > 1))

        for k, w in enumerate(self.words):
            for first, size, pieces in facts.get(k, {}).get("ranges", []):
                add(w.first + first, size, pieces)
        add(self.n_words, 1, max(1, -(-self.n_texts // PAIRS)))  # what begins texts
        self.cuts = np.array(cuts, np.uint64)


def _ranges(counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, size, pieces): places in the array in ranges that count up to PAIRS; one with more alone, in pieces."""
    out, first = [], 0
    heavy = np.flatnonzero(counts > PAIRS).tolist()
    sums = np.concatenate(([0], np.cumsum(counts)))
    for stop in [*heavy, len(counts)]:
        while first < stop:
            last = min(stop, max(first + 1, int(np.searchsorted(sums, sums[first] + PAIRS, "right")) - 1))
            out.append((first, last - first, 1))
            first = last
        if stop < len(counts):
            out.append((stop, 1, -(-int(counts[stop]) // PAIRS)))
            first = stop + 1
    return out


class Reader:
    """A model's arrays, mapped when first used."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}
        self.firsts = np.array([s.first for s in model.words], np.int64)
        self.bos, self.end = model.n_words, -1
        found, _ = self.words(np.array([END]))
        self.end = int(found[0])

    def array(self, uri: str, kind: str) -> np.ndarray:
        if uri not in self.maps:
            self.maps[uri] = map_array(uri, kind)
        return self.maps[uri]

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(len(self.model.words))) >> np.uint64(32)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not met in training) and counts."""
        order = np.argsort(hashes)
        keys = hashes[order]
        fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
        own = keys[fresh]
        ids, counts = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
        shard = self.shard_of(own)
        edges = np.searchsorted(shard, np.arange(len(self.model.words) + 1, dtype=np.uint64))
        for s, a, b in zip(self.model.words, edges[:-1], edges[1:]):
            if a < b and s.size:
                table = self.array(s.name + ".hash", "<u8")
                at = np.minimum(np.searchsorted(table, own[a:b]), s.size - 1)
                hit = table[at] == own[a:b]
                ids[a:b] = np.where(hit, at + s.first, -1)
                counts[a:b] = np.where(hit, self.array(s.name + ".count", "<u8")[at], 0)
        repeat = np.diff(np.append(fresh, len(keys)))
        out_ids, out_counts = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        out_ids[order], out_counts[order] = np.repeat(ids, repeat), np.repeat(counts, repeat)
        return out_ids, out_counts

    def per_word(self, ids: np.ndarray, uri: Callable[[Words], str], kind: str) -> np.ndarray:
        """What an array of the words' shards holds for sorted known ids."""
        out = np.zeros(len(ids), np.int64)
        edges = np.searchsorted(ids, np.append(self.firsts, self.model.n_words))
        for s, a, b in zip(self.model.words, edges[:-1], edges[1:]):
            if a < b:
                out[a:b] = self.array(uri(s), kind)[ids[a:b] - s.first]
        return out

    def word_chance(self, ids: np.ndarray) -> np.ndarray:
        """The lower order: how many words a word follows, discounted, and an equal share of the rest for every word, unknown ones too."""
        m = self.model
        order = np.argsort(ids)
        known = ids[order] >= 0
        n = np.zeros(len(ids), np.int64)
        n[order[known]] = self.per_word(ids[order[known]], lambda w: w.followers, "<u4")
        own = np.maximum(n - np.array([0, *m.word_discounts])[np.minimum(n, 3)], 0) / max(1, m.total_followers)
        return own + m.word_rest / (m.n_words + 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted pairs, the range that each belongs to and its place there (-1: not met in training)."""
        m = self.model
        shard, place = np.searchsorted(m.cuts, keys, "right") - 1, np.full(len(keys), -1, np.int64)
        for k, a, b in _runs(shard):
            s = m.pairs[k]
            if s.n:
                table = self.array(s.name + ".key", "<u8")
                at = np.minimum(np.searchsorted(table, keys[a:b]), s.n - 1)
                place[a:b] = np.where(table[at] == keys[a:b], at, -1)
        return shard, place

    def chance(self, earlier: np.ndarray, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Probability of each word after the one or two before; unknown words and contexts fall back to the lower order."""
        low = self.after_one(before, ids, self.word_chance(ids))
        return self.after_two(earlier, before, ids, low) if self.model.order > 2 else low

    def after_one(self, before: np.ndarray, ids: np.ndarray, low: np.ndarray) -> np.ndarray:
        m = self.model
        out = low.copy()
        some = np.flatnonzero(before >= 0)
        keys = (before[some].astype(np.uint64) << np.uint64(32)) | np.where(ids[some] < 0, 0xFFFFFFFF, ids[some]).astype(np.uint64)
        order = np.argsort(keys)
        keys, some = keys[order], some[order]
        first = (keys >> np.uint64(32)).astype(np.int64)
        # A word is followed as often as it occurs; what begins texts, as often as there are texts.
        total = np.full(len(first), float(m.n_texts))
        if m.order == 2:
            begins = int(np.searchsorted(first, self.bos))
            total[:begins] = self.per_word(first[:begins], lambda w: w.name + ".count", "<u8")
        take = np.array([0, *m.pair_discounts])
        shard, place = self.places(keys)
        for k, a, b in _runs(shard):
            s = m.pairs[k]
            lower = m.order > 2 and s.first != self.bos
            name, own, n, kinds = s.lower if lower else s.name, first[a:b] - s.first, np.zeros(b - a, np.int64), np.zeros((3, 1))
            if s.n:
                n = np.where(place[a:b] >= 0, self.array(name + ".count", "<u4" if lower else s.count_type)[place[a:b]], 0).astype(np.int64)
            if s.split:
                kinds = np.array(m.kinds.get(s.first, [0, 0, 0])).reshape(3, 1)
            elif s.n:
                kinds = self.array(name + ".kinds", "<u4").reshape(3, -1)[:, own]
            if lower and s.split:
                total[a:b] = m.lower_totals.get(s.first, 0)
            elif lower:
                total[a:b] = self.array(name + ".total", "<u8")[own] if s.n else 0
            rest = sum(d * k for d, k in zip(m.pair_discounts, kinds))
            p = (np.maximum(n - take[np.minimum(n, 3)], 0) + rest * low[some[a:b]]) / np.maximum(total[a:b], 1)
            out[some[a:b]] = np.where(rest > 0, p, low[some[a:b]])
        return out

    def after_two(self, earlier: np.ndarray, before: np.ndarray, ids: np.ndarray, low: np.ndarray) -> np.ndarray:
        m = self.model
        out = low.copy()
        some = np.flatnonzero((earlier >= 0) & (before >= 0))
        keys = (earlier[some].astype(np.uint64) << np.uint64(32)) | before[some].astype(np.uint64)
        order = np.argsort(keys)
        some = some[order]
        shard, place = self.places(keys[order])
        met = place >= 0
        some, shard, place = some[met], shard[met], place[met]
        take = np.array([0, *m.triple_discounts])
        for k, a, b in _runs(shard):
            s, at, own = m.pairs[k], place[a:b], some[a:b]
            keys = (at.astype(np.uint64) << np.uint64(32)) | np.where(ids[own] < 0, 0xFFFFFFFF, ids[own]).astype(np.uint64)
            table = self.array(s.triples + ".key", "<u8")
            found = np.minimum(np.searchsorted(table, keys), s.n_triples - 1)
            n = np.where(table[found] == keys, self.array(s.triples + ".count", s.triple_type)[found], 0).astype(np.int64)
            # A pair is followed as often as it occurs.
            total = self.array(s.name + ".count", s.count_type)[at]
            rest = sum(d * k for d, k in zip(m.triple_discounts, self.array(s.triples + ".kinds", "<u4").reshape(3, -1)[:, at]))
            out[own] = (np.maximum(n - take[np.minimum(n, 3)], 0) + rest * low[own]) / total
        return out


def _contexts(reader: Reader, hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids and counts of the words of texts and their ends, the ids one and two places before (-1: none), and where texts begin and end."""
    ids, counts = reader.words(np.insert(hashes, marks[1:], END))
    ends = marks[1:] + np.arange(1, len(marks))
    begins = np.concatenate(([0], ends[:-1]))
    before = np.concatenate(([reader.bos], ids[:-1]))
    before[begins] = reader.bos
    earlier = np.concatenate(([-1], before[:-1]))
    earlier[begins] = -1
    return ids, counts, before, earlier, begins, ends


def _streams(batch_text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and the first word's index of each text, for pieces of a batch."""
    data, offsets = _flat.buffers(batch_text)
    for a, b in _flat.pieces(offsets):
        yield _flat.words(data, offsets[a : b + 1])


def train(documents: DataFrame, text: str = "text", shards: int | None = None, order: int = 2) -> Model:
    """Counts a model over all texts; null and empty texts count as an end alone. ``order`` is 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = documents.sparkSession
    ship(spark)
    small_batches(spark)
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    home = folder(spark, "lm")
    texts = documents.select(F.col(text).cast("string").alias("text"))

    def count_words(batches):
        tally = Tally()
        for batch in batches:
            for hashes, _ in _streams(batch.column(0)):
                tally.add(hashes)
            tally.add(np.array([END]), np.array([len(batch)]))
        tally.settle()
        yield from _rows(((tally.keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32), tally.keys, tally.counts)

    def store_words(batches):
        shard, tally = _gather(batches)
        if shard >= 0:
            name = f"{home}/words-{shard}-{uuid.uuid4().hex}"
            put_array(name + ".hash", tally.keys)
            put_array(name + ".count", tally.counts.astype("<u8"))
            ends = int(tally.counts[tally.keys == END].sum())
            yield _told(shard, {"name": name, "n": len(tally.keys), "sum": int(tally.counts.sum()), "texts": ends, "ranges": _ranges(tally.counts)})

    told = _facts(written(texts.mapInArrow(lambda b: trimmed(count_words(b)), ROWS).repartitionById(count, F.col("shard")).mapInArrow(store_words, TOLD), "lm-words"))
    layout, first = [], 0
    for k in range(count):
        f = told.get(k, {"name": "", "n": 0})
        layout.append(Words(first, f["n"], f["name"]))
        first += f["n"]
    if first >= (1 << 32) - 1:
        raise ValueError("more distinct words than two 32-bit ids in a key can tell apart")
    model = Model(layout, first, sum(f["sum"] for f in told.values()), sum(f["texts"] for f in told.values()))
    model.cut_pairs(told)
    firsts, cuts = np.array([s.first for s in layout], np.int64), model.cuts
    spark_model = spark.sparkContext.broadcast(model)

    def count_pairs(batches):
        reader, tally = Reader(spark_model.value), Tally()
        for batch in batches:
            for hashes, marks in _streams(batch.column(0)):
                ids, _ = reader.words(hashes)
                before = np.insert(ids, marks[:-1], reader.bos).astype(np.uint64)
                after = np.insert(ids, marks[1:], reader.end).astype(np.uint64)
                tally.add((before << np.uint64(32)) | after)
        tally.settle()
        yield from _rows(np.searchsorted(cuts, tally.keys, "right") - 1, tally.keys, tally.counts)

    def store_pairs(batches):
        shard, tally = _gather(batches)
        if shard < 0:
            return
        own = spark_model.value.pairs[shard]
        context = (tally.keys >> np.uint64(32)).astype(np.int64) - own.first
        kind = "<u4" if not len(tally.counts) or tally.counts.max() < 2**32 else "<u8"
        name = f"{home}/pairs-{shard}-{uuid.uuid4().hex}"
        put_array(name + ".key", tally.keys)
        put_array(name + ".count", tally.counts.astype(kind))
        kinds = _kinds(context, tally.counts, own.size)
        if not own.split:
            put_array(name + ".kinds", kinds.astype("<u4"))
        yield _told(shard, {"name": name, "n": len(tally.keys), "type": kind, "m": _of_counts(tally.counts), "kinds": kinds[:, 0].tolist() if own.split else None})
        after = np.sort(tally.keys & np.uint64(0xFFFFFFFF))
        at = np.flatnonzero(np.concatenate(([True], after[1:] != after[:-1])))
        ids, n = after[at], np.diff(np.append(at, len(after)))
        target = np.searchsorted(firsts, ids.astype(np.int64), "right") - 1
        for b in _rows(target, ids, n):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.string())], names=["shard", "key", "n", "facts"])

    stored = written(texts.mapInArrow(lambda b: trimmed(count_pairs(b)), ROWS).repartitionById(len(cuts), F.col("shard")).mapInArrow(store_pairs, TOLD), "lm-pairs")
    told = _facts(stored)
    for k, f in told.items():
        s = model.pairs[k]
        s.name, s.n, s.count_type = f["name"], f["n"], f["type"]
        if s.split:
            model.kinds[s.first] = [x + y for x, y in zip(model.kinds.get(s.first, [0, 0, 0]), f["kinds"])]

    def store_followers(batches):
        shard, tally = _gather(batches)
        if shard < 0:
            return
        own = spark_model.value.words[shard]
        dense = np.zeros(own.size, "<u4")
        dense[tally.keys.astype(np.int64) - own.first] = tally.counts
        name = f"{home}/followers-{shard}-{uuid.uuid4().hex}"
        put_array(name, dense)
        yield _told(shard, {"name": name, "sum": int(tally.counts.sum()), "m": _of_counts(tally.counts), "more": int((tally.counts > 2).sum())})

    rows = stored.where("facts is null").select("shard", "key", "n")
    below = _facts(written(rows.repartitionById(count, F.col("shard")).mapInArrow(store_followers, TOLD), "lm-followers"))
    for k, f in below.items():
        layout[k].followers = f["name"]
    model.pair_discounts, model.word_discounts = tuple(discounts(_added(told))), tuple(discounts(_added(below)))
    model.total_followers = sum(f["sum"] for f in below.values())
    kinds = [*_added(below)[:2], sum(f["more"] for f in below.values())]
    model.word_rest = sum(d * k for d, k in zip(model.word_discounts, kinds)) / model.total_followers if model.total_followers else 1.0
    if order > 2:
        _third(texts, model, home, {k: f for k, f in told.items() if model.pairs[k].first == model.n_words})
    return model


def _third(texts: DataFrame, model: Model, home: str, begins: dict[int, dict]) -> None:
    """Counts triples, and the words before pairs, into the model; ``begins`` is what the pairs that begin texts told."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    cuts = model.cuts

    def count_triples(batches):
        reader, fresh, size = Reader(shared.value), [], 0

        def settled():
            shard, key = (np.concatenate(x) for x in zip(*fresh))
            fresh.clear()
            order = np.lexsort((key, shard))
            shard, key = shard[order], key[order]
            at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]))))
            return _rows(shard[at], key[at], np.diff(np.append(at, len(key))))

        for batch in batches:
            for hashes, marks in _streams(batch.column(0)):
                ids, _, before, earlier, *_ = _contexts(reader, hashes, marks)
                some = earlier >= 0
                pairs = (earlier[some].astype(np.uint64) << np.uint64(32)) | before[some].astype(np.uint64)
                order = np.argsort(pairs)
                shard, place = reader.places(pairs[order])
                fresh.append((shard, (place.astype(np.uint64) << np.uint64(32)) | ids[some][order].astype(np.uint64)))
                size += len(order)
                if size > GATHER:
                    yield from settled()
                    size = 0
        if size:
            yield from settled()

    def store_triples(batches):
        shard, tally = _gather(batches)
        if shard < 0:
            return
        own, word = shared.value.pairs[shard], np.uint64(0xFFFFFFFF)
        place, kind = (tally.keys >> np.uint64(32)).astype(np.int64), _count_type(tally.counts)
        name = f"{home}/triples-{shard}-{uuid.uuid4().hex}"
        put_array(name + ".key", tally.keys)
        put_array(name + ".count", tally.counts.astype(kind))
        put_array(name + ".kinds", _kinds(place, tally.counts, own.n).astype("<u4"))
        yield _told(shard, {"name": name, "n": len(tally.keys), "type": kind, "m": _of_counts(tally.counts)})
        second = map_array(own.name + ".key", "<u8")[place] & word
        keys = np.sort((second << np.uint64(32)) | (tally.keys & word))
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for b in _rows(np.searchsorted(cuts, keys[at], "right") - 1, keys[at], np.diff(np.append(at, len(keys)))):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.string())], names=["shard", "key", "n", "facts"])

    def store_lower(batches):
        shard, tally = _gather(batches)
        if shard < 0:
            return
        # Every pair has a word or the begin of a text before it, but those that begin texts, which have no rows here.
        own = shared.value.pairs[shard]
        context, counts = (tally.keys >> np.uint64(32)).astype(np.int64) - own.first, tally.counts
        name = f"{home}/lower-{shard}-{uuid.uuid4().hex}"
        kinds = _kinds(context, counts, own.size)
        put_array(name + ".count", counts.astype("<u4"))
        if not own.split:
            put_array(name + ".kinds", kinds.astype("<u4"))
            put_array(name + ".total", np.bincount(context, counts, own.size).astype("<u8"))
        yield _told(shard, {"name": name, "m": _of_counts(counts), "kinds": kinds[:, 0].tolist(), "total": int(counts.sum())})

    stored = written(texts.mapInArrow(lambda b: trimmed(count_triples(b)), ROWS).repartitionById(len(cuts), F.col("shard")).mapInArrow(store_triples, TOLD), "lm-triples")
    told = _facts(stored)
    rows = stored.where("facts is null").select("shard", "key", "n")
    below = _facts(written(rows.repartitionById(len(cuts), F.col("shard")).mapInArrow(store_lower, TOLD), "lm-lower"))
    for k, f in told.items():
        s = model.pairs[k]
        s.triples, s.n_triples, s.triple_type = f["name"], f["n"], f["type"]
    split = {model.pairs[k].first for k in below if model.pairs[k].split}
    model.kinds |= {first: [0, 0, 0] for first in split}
    for k, f in below.items():
        s = model.pairs[k]
        s.lower = f["name"]
        if s.split:
            model.kinds[s.first] = [x + y for x, y in zip(model.kinds[s.first], f["kinds"])]
            model.lower_totals[s.first] = model.lower_totals.get(s.first, 0) + f["total"]
    model.triple_discounts, model.pair_discounts = tuple(discounts(_added(told))), tuple(discounts(_added(below | begins)))
    model.order = 3


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row: log10 probabilities of the whole text with its end.

    base_score is the add-one unigram model of the same counts. Perplexity is 10 ** (-score / n_tokens). Null, empty and blank
    texts are an end alone; repeated rows are scored one by one; an empty table gives no rows; other columns are not read. With
    an empty training set every word has the same chance.
    """
    spark = documents.sparkSession
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def each(batches):
        reader = Reader(shared.value)
        base = float(np.log10(model.n_tokens + model.n_words + 1))
        for batch in batches:
            out = []
            for hashes, marks in _streams(batch.column(1)):
                ids, counts, before, earlier, begins, ends = _contexts(reader, hashes, marks)
                logs = np.log10(reader.chance(earlier, before, ids))
                add = lambda x: np.add.reduceat(x, begins)
                out.append(np.stack([ends - begins, add((counts > 0).astype(float)), add(np.log10(counts + 1) - base), add(logs)]))
            if out:
                n, known, low, high = np.concatenate(out, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(low), pa.array(high)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: trimmed(each(b)), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def op10_lm(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents.where(~held_out("doc_id", 7, 2)))
    out = score(documents, model)
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
