"""Toxicity: a linear classifier learned from confirmed toxic texts and unlabelled ones (non-negative PU risk)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from . import _flat
from ._store import small_batches, trimmed, written

#: Bounds of the samples that the classifier is fitted on; which rows are taken is fixed by a hash of doc_id.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 6000
#: Words that the classifier looks at: all whose share of texts differs by so high a z-score.
LEAST_Z = 4.0

#: ASCII characters other than letters part words here, so that a word next to signs is the same word.
_PARTS = np.zeros(256, bool)
_PARTS[:128] = True
_PARTS[[*range(65, 91), *range(97, 123)]] = False


@dataclass
class Classifier:
    """Sorted word hashes, a weight for each, and what a text without any of them has."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = _flat.buffers(texts)
        out = [np.zeros(0)]
        for a, b in _flat.pieces(offsets):
            hashes, marks = _flat.words(data, offsets[a : b + 1], _PARTS)
            logits = np.full(b - a, self.bias)
            if len(self.words):
                at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
                hit = np.flatnonzero(self.words[at] == hashes)
                text = np.searchsorted(marks, hit, "right") - 1
                met = np.unique(text * len(self.words) + at[hit])
                logits += np.bincount(met // len(self.words), self.weights[met % len(self.words)], minlength=b - a)
            out.append(1 / (1 + np.exp(-np.clip(logits, -40, 40))))
        return np.concatenate(out)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.05, decay: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of a linear classifier with the logistic loss.

    Risk: prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]). Where the second part falls below 0 its gradient
    is reversed, which undoes the overfit. The penalty shrinks with the confirmed texts. Full-batch Adam; the result depends on the rows alone, not on their order.
    """
    n = positive.shape[1]
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive.astype(float), unlabelled.astype(float)))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up = -prior * (sigmoid(-fp) @ p) / len(p)
        down = (sigmoid(fu) @ u) / len(u) - prior * (sigmoid(fp) @ p) / len(p)
        g = up + down if negative >= 0 else -down
        g[:n] += decay / len(p) * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def fit(samples: list[tuple[bool, np.ndarray]], prior: float) -> Classifier:
    """A classifier from (confirmed, distinct word hashes of a text). Without confirmed or unlabelled texts it gives the prior.

    The prior may be any share; 0 and 1 count as a millionth from them, as a bias must be finite.
    """
    positive, unlabelled = ([x for c, x in samples if c is kind] for kind in (True, False))
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    nothing = Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return nothing
    words, np_ = np.unique(np.concatenate(positive), return_counts=True)
    other, nu = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(other, words), max(0, len(other) - 1))
    nu = np.where(other[at] == words, nu[at], 0) if len(other) else np.zeros(len(words))
    rp, ru = np_ / len(positive), nu / len(unlabelled)
    pooled = (np_ + nu) / (len(positive) + len(unlabelled))
    z = (rp - ru) / np.sqrt(pooled * (1 - pooled) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    good = np.flatnonzero(z >= LEAST_Z)
    words = words[good]
    if not len(words):
        return nothing
    table = lambda rows: np.stack([np.isin(words, r) for r in rows])
    weights, bias = fit_pu(table(positive), table(unlabelled), prior)
    return Classifier(words, weights, bias)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None) -> Classifier:
    """A classifier from the texts whose label is 1, and from texts whatever their label.

    The class prior is the share of 1 among the given labels, unless stated. A row's label is read only to confirm a toxic text
    and for that share; the unlabelled sample is taken from all documents given. Rows with null labels or null texts confirm
    nothing. Samples have at most MOST_POSITIVE and MOST_UNLABELLED texts, each as its distinct word hashes; of rows that repeat
    a doc_id one text is taken.
    """
    spark = documents.sparkSession
    ship(spark)
    small_batches(spark)
    order = F.xxhash64("doc_id", F.lit(5))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("label")).where("label is not null and doc_id is not null")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("toxic")).first()
    share = prior if prior is not None else total["toxic"] / max(1, total["n"])
    chosen = known.where("label = 1").select("doc_id").distinct().orderBy(order).limit(MOST_POSITIVE)
    confirmed = {r["doc_id"] for r in chosen.collect()}
    some = {r["doc_id"] for r in documents.select(F.col(doc_id).cast("long").alias("doc_id")).where(F.col(doc_id).isNotNull()).orderBy(order).limit(MOST_UNLABELLED).collect()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _flat.buffers(batch.column(1))
            out = []
            for a, b in _flat.pieces(offsets):
                hashes, marks = _flat.words(data, offsets[a : b + 1], _PARTS)
                out += [np.unique(hashes[x:y]).view(np.int64) for x, y in zip(marks[:-1], marks[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "words"])

    ids = spark.createDataFrame([(x,) for x in sorted(confirmed | some)], "doc_id long")
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    taken = rows.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(each, "doc_id long, words array<long>").dropDuplicates(["doc_id"])
    samples = []
    for r in written(taken, "toxicity-sample").orderBy("doc_id").toLocalIterator():
        hashes = np.array(r["words"], np.int64).view(np.uint64)
        samples += [(True, hashes)] * (r["doc_id"] in confirmed) + [(False, hashes)] * (r["doc_id"] in some)
    return fit(samples, share)


def rate(documents: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, by the text alone; null and empty texts have the score of a text without known words.

    Repeated rows are scored one by one; an empty table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    small_batches(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classifier.scores(batch.column(1)))], names=["doc_id", "score"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: trimmed(each(b)), "doc_id long, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    classifier = train(documents.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    out = rate(documents, classifier)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
