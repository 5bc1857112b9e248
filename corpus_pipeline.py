"""A corpus cleaned in stages: quality rules, near-duplicates, benchmark passages, secrets, then token ids.

Each stage works on all that the one before has kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import bpe, decontam, neardup, quality, secrets
from tickweave.llm._store import folder, removed, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged; null and empty texts have too few words. Repeated rows are judged one by one."""
    return quality.judge(docs, carry=True).where("kept").select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 80 % alike: that with the smallest doc_id.

    Texts without words, and rows without doc_id that are like no other, stay. Rows that repeat a doc_id stay or go together.
    """
    gone = written(neardup.cluster(docs, percent=80).where(~F.col("kept")).select("doc_id").distinct(), "pipeline-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; all, texts without words too, if it is empty. Rows that repeat a doc_id go together."""
    leaks = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(leaks.select("doc_id").distinct(), "pipeline-leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows. Null texts stay null."""
    model = secrets.train(secrets.sample_strings(spark))
    text = secrets.masked(F.col("text"), F.col("found"))
    out = docs.withColumn("found", secrets.spans(F.col("text"), model)).withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of the text, their number, and digests of the ids and of the text decoded from them; null texts have no ids. A row for each row."""
    back = bpe.encode(docs, bpe.load(), back=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scans", masked_secrets),
    ("bpe", token_ids),
]

#: No stage but the masking can be told in SQL (sketches, fingerprints, merges); tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves besides its output goes with it, its input with the next one's end."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
