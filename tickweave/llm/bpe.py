"""Byte-level BPE: batched numpy merge rounds over many words at once, and a table decoder."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ._store import small_batches, trimmed

#: Words kept encoded by a worker; beyond that its table starts anew.
CACHED_WORDS = 200_000
#: Longer words are merged one by one with a heap, as rounds over them would take a pass for each distinct pair.
LONG_WORD = 256
_NONE = np.int64(2**62)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """The tables of one vocabulary file (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, letters = data["model"]["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.pattern = pattern
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        back = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.ends = np.cumsum([len(p) for p in pieces])
        self.lengths = np.array([len(p) for p in pieces], np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the sorted pair keys and rank of each pair; the rank of no pair is _NONE."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, np.where(self.keys[at] == keys, self.rank[at], _NONE)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One word, with a heap of (rank, place)."""
        at, rank = self.look_up(symbols[:-1], symbols[1:])
        n, value = len(symbols), symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, value[i], value[i + 1], int(self.made[a])) for i, (a, r) in enumerate(zip(at, rank)) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if value[i] != a or j >= n or value[j] != b:
                continue
            value[i], value[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    key = value[x] << 32 | value[y]
                    k = int(np.searchsorted(self.keys, key))
                    if k < len(self.keys) and self.keys[k] == key:
                        heapq.heappush(heap, (int(self.rank[k]), x, value[x], value[y], int(self.made[k])))
        return np.array([v for v in value if v >= 0], np.int64)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. In every round each word's lowest-ranked pair is merged wherever the word has it, left to right."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.merge_long(self.first[np.frombuffer(w, np.uint8)])
        symbols = self.first[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        lengths = np.array([len(words[i]) for i in short], np.int64)
        names = np.array(short, np.int64)
        while len(names):
            starts = np.cumsum(lengths) - lengths
            at, rank = self.look_up(symbols[:-1], symbols[1:])
            rank = np.append(rank, _NONE)
            at = np.append(at, 0)
            rank[starts + lengths - 1] = _NONE
            best = np.minimum.reduceat(rank, starts)
            for k in np.flatnonzero(best == _NONE):
                out[names[k]] = symbols[starts[k] : starts[k] + lengths[k]]
            spot = np.flatnonzero((rank == np.repeat(best, lengths)) & (rank < _NONE))
            # Of equal pairs that overlap, every second one of a run is merged.
            fresh = np.concatenate(([True], np.diff(spot) != 1))[: len(spot)]
            run = np.arange(len(spot)) - np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
            spot = spot[run % 2 == 0]
            symbols = symbols.copy()
            symbols[spot] = self.made[at[spot]]
            keep = np.repeat(best < _NONE, lengths)
            keep[spot + 1] = False
            gone = np.bincount(np.searchsorted(starts, spot, "right") - 1, minlength=len(lengths))
            live = best < _NONE
            symbols, lengths, names = symbols[keep], (lengths - gone)[live], names[live]
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.lengths[ids]
        total = np.cumsum(size)
        flat = self.bytes[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.ends[ids] - total, size)].tobytes()
        ends = np.concatenate(([0], total))[np.cumsum(counts)]
        firsts = np.concatenate(([0], ends[:-1]))
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(firsts.tolist(), ends.tolist())]


class Encoder:
    """A worker's encoder: words that it has met are looked up, new ones of a batch are merged together."""

    def __init__(self, codec: Codec):
        import regex

        self.codec = codec
        self.find = regex.compile(codec.pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(codec.special, key=len, reverse=True))) + ")").split if codec.special else None
        self.known: dict[str, np.ndarray] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a word of its own and parts the text before all else."""
        if self.cut and any(s in text for s in self.codec.special):
            return [w for k, part in enumerate(self.cut(text)) for w in ([part] if k % 2 else self.find(part))]
        return self.find(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if not self.known:
            self.known.update({s: np.int32(i).tobytes() for s, i in self.codec.special.items()})
        known = self.known
        parted = [self.words(t) for t in texts]
        new = list(set().union(*parted).difference(known))
        known.update(zip(new, [x.astype(np.int32).tobytes() for x in self.codec.merge([w.encode() for w in new])]))
        return [b"".join([known[w] for w in words]) for words in parted]

    def arrays(self, texts: pa.Array) -> pa.Array:
        """list<int32> of the ids of an array of texts; texts are taken in pieces of some 512 kB, or one text."""
        texts, ids, first = texts.to_pylist(), [], 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < 1 << 19):
                size += len(texts[last] or "")
                last += 1
            ids += self.encode([t or "" for t in texts[first:last]])
            first = last
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def load(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a vocabulary file; by default the 50k byte-level one of the public tokenizers."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    return Codec(path, pattern)


def _decoded(codec: Codec, ids: pa.Array) -> pa.Array:
    counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(codec.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts), pa.string())


def encode(documents: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, ids) for every row: token ids of the whole text; null and empty texts have none.

    With ``back`` also ``text``, decoded from the ids in the same task. Memory is bounded by a batch of texts. Repeated rows are encoded one
    by one, an empty table gives no rows, and other columns are not read. The tables (2 MB) travel as a broadcast.
    """
    spark = documents.sparkSession
    ship(spark)
    small_batches(spark)
    tables = spark.sparkContext.broadcast(codec)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            ids = encoder.arrays(batch.column(1))
            if not back:
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, _decoded(tables.value, ids)], names=["doc_id", "ids", "text"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: trimmed(each(b)), "doc_id long, ids array<int>" + ", text string" * back)


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, ids, text) for every row of (doc_id, ids); null ids give an empty text."""
    spark = encoded.sparkSession
    ship(spark)
    small_batches(spark)
    tables = spark.sparkContext.broadcast(codec)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(tables.value, batch.column(1))], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lambda b: trimmed(each(b)), "doc_id long, ids array<int>, text string")


def digests(documents: DataFrame) -> DataFrame:
    back = encode(documents, load(), back=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
