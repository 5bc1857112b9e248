"""WARC archives: writing captures, reading records back as streams, and assembling transactions."""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from ._store import folder, put_stream, small_batches, trimmed, written

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Digests that occur more than once are broadcast up to so many (some 40 bytes each), else joined by a shuffle.
MOST_BROADCAST = 200_000
PRIMARY = ("response", "revisit", "resource")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, each written in base 32 and in the other alphabet."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, page: Column, digest: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), digest, F.nullif(row, F.lit(0).cast("long")).cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the blank lines after it; fields whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.lit(VERSION), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("\r\n"), block)


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a request, a response (or revisit) and a metadata record for each row, as WARC files under ``path``, each record a gzip member.

    The payload is the html in UTF-8; null is an empty one. Of rows with equal payloads that with the smallest page_id is the
    response and the others are revisits that refer to it; rows without page_id come after all others, and where no row has one,
    all are responses. Rows that repeat a page_id and its payload are captures of their own, with record ids of their own; if
    theirs is the smallest page_id, each is a response, and revisits refer to one of them. Null urls are empty and line breaks
    in them become spaces. An empty table leaves an empty folder.

    A task writes one file under a name that readers pass over; files of tasks that ended well are renamed at last, so those of
    lost or repeated tasks are never read.
    """
    spark = pages.sparkSession
    ship(spark)
    small_batches(spark)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\r\n]", " ").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("row", F.lit(0).cast("long"))

    def repeated(df: DataFrame) -> DataFrame:
        """Digests of several rows: smallest page_id, its smallest row number, and the most rows of one page."""
        pairs = df.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
        met = pairs.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("row", "page_id").alias("first_row"), F.sum("n").alias("n"), F.max("n").alias("most"))
        return written(met.where("n > 1").select("digest", "first", "first_row", "most"), "warc-shared")

    shared = repeated(rows)
    facts = shared.agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most")).first()
    if (facts["most"] or 1) > 1:
        # Equal rows are told apart by numbers, which are stored with the rows, so that whatever reads them again sees the same.
        rows = written(rows.withColumn("row", F.monotonically_increasing_id() + 1), "warc-rows")
        shared = repeated(rows)
    if facts["n"] <= MOST_BROADCAST:
        shared = F.broadcast(shared)
    else:  # a second key has both sides dealt out for the join itself, so that a payload of very many pages can be split
        rows, shared = rows.withColumn("k", F.xxhash64("digest")), shared.withColumn("k", F.xxhash64("digest"))
    rows = rows.join(shared, [c for c in ("digest", "k") if c in shared.columns], "left")
    page, digest = F.col("page_id"), F.col("digest")
    # Only payloads that a page has several times need numbers in their record ids.
    row, first_row = (F.when(F.col("most") > 1, F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("row", "first_row"))
    again = F.col("first").isNotNull() & ~page.eqNullSafe(F.col("first"))
    own, stamp, target = _urn("response", page, digest, row), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    line = F.concat(F.lit("GET "), F.regexp_extract("url", r"^(?:[a-z]+://[^/?#]*)?([^#]*)", 1), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    kind = lambda c: ("WARC-Type", c if isinstance(c, Column) else F.lit(c))
    media = lambda c: ("Content-Type", F.lit(c))
    request = _record([kind("request"), ("WARC-Record-ID", _urn("request", page, digest, row)), stamp, target, ("WARC-Concurrent-To", own), media("application/http;msgtype=request")], line)
    response = _record(
        [kind(F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", own), stamp, target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), ("WARC-Refers-To", F.when(again, _urn("response", F.col("first"), digest, first_row))), ("WARC-Profile", F.when(again, PROFILE)), media("application/http;msgtype=response")],
        F.when(again, head).otherwise(F.concat(head, F.col("payload"))),
    )
    notes = F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record([kind("metadata"), ("WARC-Record-ID", _urn("metadata", page, digest, row)), stamp, target, ("WARC-Concurrent-To", own), media("application/warc-fields")], notes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        with contextlib.ExitStack() as open_files:
            for batch in batches:
                if out is None and len(batch):
                    out = open_files.enter_context(put_stream(f"{path}/_{name}"))
                for record in (x for row in zip(*(c.to_pylist() for c in batch.columns)) for x in row):
                    out.write(gzip.compress(record + END.encode(), 6, mtime=0))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    records = rows.select(*(r.cast("binary").alias(n) for r, n in ((request, "q"), (response, "r"), (metadata, "m"))))
    made = written(records.mapInArrow(lambda b: trimmed(write(b)), "name string"), "warc-files")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    for r in made.toLocalIterator():
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_{r['name']}"), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['name']}"))


RECORD = "record_id string, kind string, target_uri string, concurrent_to array<string>, refers_to string, declared_digest string, payload_bytes long, payload_digest string, fields string, payload binary"


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all WARC files under ``path``, in any order.

    Compressed files are read as one stream each, cut at the version line; a piece shorter than its Content-Length goes on in
    the next ones, so a payload may hold version lines. Memory is bounded by the largest record. Digests are of the block's HTTP
    body; ``fields`` has the block of records that are neither responses nor revisits, ``payload`` the body if asked for.
    Pieces without a Content-Length are no records.
    """
    ship(spark)
    small_batches(spark)

    def parse(head: bytes, body: bytes) -> tuple:
        names: dict[str, list[str]] = {}
        for line in head.split(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            names.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda k: names.get(k, [None])[0]
        kind = one("warc-type")
        content = body.partition(b"\r\n\r\n")[2] if kind == "response" and (one("content-type") or "").startswith("application/http") else body
        whole = kind in ("response", "resource")
        digest = base64.b32encode(hashlib.sha1(content).digest()).decode() if whole else None
        declared = (one("warc-payload-digest") or "").rpartition(":")[2] or None
        note = None if kind in PRIMARY else body.decode("utf-8", "replace")
        return one("warc-record-id"), kind, one("warc-target-uri"), names.get("warc-concurrent-to", []), one("warc-refers-to"), declared, len(content) if whole else None, digest, note, content if whole and payload else None

    def length(head: bytes) -> int | None:
        for line in head.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return int(value)
        return None

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        parts, size, head, need, file = [], 0, None, 0, None
        for batch in batches:
            for path_, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path_ != file:
                    file, head = path_, None
                if head is None:
                    top, mark, rest = piece.partition(b"\r\n\r\n")
                    n = length(top) if mark else None
                    if n is None:
                        continue
                    head, need, parts, size = top, n, [rest], len(rest)
                else:
                    parts += [VERSION.encode(), piece]
                    size += len(VERSION) + len(piece)
                if size >= need:
                    yield parse(head, b"".join(parts)[:need])
                    head = None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        held, weight = [], 0
        for r in records(batches):
            held.append(r)
            weight += 500 + len(r[9] or b"") + len(r[8] or "")
            if weight > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    lines = spark.read.option("lineSep", VERSION).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(each, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request and metadata (an array by record_id).

    Concurrent-to identifiers are followed in either direction to a response, revisit or resource, directly or through one other
    record. What leads to none is a capture of its own with a null response. Of several requests that with the largest record_id
    is shown; records that repeat a record_id count once in ``request`` and ``response``. Null or empty tables give no captures.
    """
    known = records.where(F.col("record_id").isNotNull())
    primary = F.col("kind").isin(*PRIMARY)
    pairs = known.select("record_id", F.explode("concurrent_to").alias("to"))
    edges = pairs.select(F.col("record_id").alias("x"), F.col("to").alias("y")).union(pairs.select(F.col("to").alias("x"), F.col("record_id").alias("y")))
    main = known.where(primary).select(F.col("record_id").alias("y")).distinct()
    direct = edges.join(main, "y").groupBy("x").agg(F.min("y").alias("key"))
    other = edges.join(main.withColumnRenamed("y", "x"), "x", "left_anti").join(direct.select(F.col("x").alias("y"), "key"), "y").groupBy("x").agg(F.min("key").alias("key2"))
    rows = known.join(direct.withColumnRenamed("x", "record_id"), "record_id", "left").join(other.withColumnRenamed("x", "record_id"), "record_id", "left")
    rows = rows.withColumn("capture_id", F.when(primary, F.col("record_id")).otherwise(F.coalesce("key", "key2", "record_id")))
    shown = F.struct("record_id", "kind", "target_uri", "refers_to", F.coalesce("payload_digest", "declared_digest").alias("payload_digest"), "payload_bytes", "payload")
    note = F.struct("record_id", "target_uri", "fields")
    return rows.groupBy("capture_id").agg(
        F.max(F.when(primary, shown)).alias("response"), F.max(F.when(F.col("kind") == "request", note)).alias("request"),
        F.array_sort(F.collect_list(F.when(~primary & (F.col("kind") != "request"), note))).alias("metadata"),
    )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    home = folder(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), home)
    # The assembly looks at the records several times; the archives are parsed once.
    captures = written(assemble(written(read_records(spark, home), "warc-records")), "warc-captures")
    page = F.expr("try_cast(regexp_extract(metadata[0].fields, 'page-id: (-?[0-9]+)', 1) AS BIGINT)")
    rows = captures.select(page.alias("page_id"), "capture_id", "response")
    full = rows.where("response.kind = 'response'").select(F.col("capture_id").alias("refers"), F.col("response.payload_digest").alias("digest"), F.col("response.payload_bytes").alias("full_bytes"), F.col("page_id").alias("of_page"))
    # By identifier and digest: a revisit counts only if the record it names has its payload.
    met = rows.withColumn("refers", F.col("response.refers_to")).withColumn("digest", F.col("response.payload_digest")).join(full, ["refers", "digest"], "left")
    return met.select("page_id", F.coalesce("response.payload_bytes", "full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("of_page").alias("refers_to"))


ORACLE = {
    "op3_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10))::UBIGINT >> (35 - 5 * (i % 8))::UBIGINT) & 31)::INT, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f"""
}
