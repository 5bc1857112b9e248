"""Files: minute and daily klines, zip archives, event and configuration JSON."""

from __future__ import annotations

import io
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normal_ms, number


def _cells(line: Column) -> Column:
    return F.split(line, ",")


def _cell(k: int) -> Column:
    return number(F.get("c", F.lit(k)))


def minute_klines(lines: DataFrame, start: int | None = None, end: int | None = None, positive: bool = True, line: str = "value") -> DataFrame:
    """(t, open, close, volume, order...) of kline lines; headers, short rows and junk are no rows; micro- or milliseconds."""
    keep = [c for c in lines.columns if c != line]
    rows = lines.select(*keep, _cells(F.col(line)).alias("c")).where(F.size("c") >= 6)
    rows = rows.select(*keep, normal_ms(_cell(0)).alias("t"), _cell(1).alias("open"), _cell(4).alias("close"), _cell(5).alias("volume")).where("t is not null and close is not null and volume is not null")
    if start is not None:
        rows = rows.where(F.col("t") >= start)
    if end is not None:
        rows = rows.where(F.col("t") <= end)
    return rows.where("close > 0") if positive else rows


def kline_folder(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, positive: bool = True) -> DataFrame:
    """All *.csv files of a folder; where several rows have a time, that of the last file by name counts, then the later row."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    rows = minute_klines(lines, start, end, positive)
    return rows.groupBy("t").agg(F.max(F.struct("file", "row", "open", "close", "volume")).alias("r")).select("t", "r.open", "r.close", "r.volume")


def daily_klines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(day, open, high, low) of daily kline lines with open > 0, high >= low > 0."""
    rows = lines.select(_cells(F.col(line)).alias("c")).where(F.size("c") >= 6)
    rows = rows.select(F.timestamp_millis(normal_ms(_cell(0))).alias("at"), _cell(1).alias("open"), _cell(2).alias("high"), _cell(3).alias("low"))
    return rows.where("at is not null and open > 0 and high >= low and low > 0").select(F.date_format("at", "yyyy-MM-dd").alias("day"), "open", "high", "low")


def first_entry(data: bytes) -> bytes:
    """The first file of a zip archive; ValueError if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if not z.namelist():
                raise ValueError("empty archive")
            return z.read(z.infolist()[0])
    except (zipfile.BadZipFile, NotImplementedError, OSError) as e:
        raise ValueError(f"not a readable zip archive: {e}") from e


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the lines of each archive's first entry, archives spread over tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = first_entry(data).decode("utf-8", "replace").splitlines()
                for k in range(0, len(lines), 10_000):
                    part = lines[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part, pa.string())], names=["file", "value"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(each, "file string, value string")


def event_windows(texts: DataFrame, text: str = "value") -> DataFrame:
    """(event, symbol, start, end, onset) of a JSON document with an ``events`` array of ISO times."""
    kind = "events array<struct<id:string,name:string,symbol:string,start:string,end:string,onset:string,cls:string>>"
    rows = texts.select(F.explode(F.from_json(F.col(text), kind)["events"]).alias("e"))
    ms = lambda c: F.unix_millis(F.try_to_timestamp(c))
    return rows.select(F.coalesce("e.id", "e.name").alias("event"), "e.symbol", ms("e.start").alias("start"), ms("e.end").alias("end"), ms("e.onset").alias("onset"), "e.cls")


def kline_months(spark: SparkSession, folder: str, symbol: str, first: date, last: date, interval: str = "1d") -> tuple[DataFrame, list[tuple[int, int]]]:
    """(file, value) lines of a symbol's monthly archives, and the months that the folder does not hold."""
    wanted = {f"{symbol}-{interval}-{y}-{m:02d}.zip": (y, m) for y, m in months(first, last)}
    found = [r["name"] for r in spark.read.format("binaryFile").option("pathGlobFilter", f"{symbol}-{interval}-*.zip").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name")).collect()]
    names = sorted(set(found) & set(wanted))
    lines = zip_lines(spark, folder).where(F.element_at(F.split("file", "/"), -1).isin(names)) if names else spark.createDataFrame([], "file string, value string")
    return lines, [wanted[n] for n in sorted(set(wanted) - set(found))]


def mask_days(texts: DataFrame, text: str = "value") -> DataFrame:
    """(symbol, day) of the map of masked days in an events document."""
    m = F.from_json(F.col(text), "_meta struct<maskDays:map<string,array<string>>>")["_meta"]["maskDays"]
    return texts.select(F.explode(m).alias("symbol", "days")).select("symbol", F.explode("days").alias("day"))


def config(texts: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """A configuration document's fields and the SHA-256 of its text."""
    return texts.select(F.from_json(F.col(text), schema).alias("config"), F.sha2(F.col(text), 256).alias("sha256"))


def months(first: date, last: date) -> list[tuple[int, int]]:
    return [(k // 12, k % 12 + 1) for k in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def days(first: date, last: date) -> list[date]:
    return [first + timedelta(k) for k in range((last - first).days + 1)]


def get(url: str, timeout: float = 8.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


def download(urls: dict[str, Path], fetch: Callable[[str], bytes] = get, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Fetch files that are not there yet: ``kept``, ``fetched``, ``missing`` (404) or ``failed`` after the tries."""
    out = {}
    for url, path in urls.items():
        if path.exists():
            out[url] = "kept"
            continue
        out[url] = "failed"
        for k in range(1, tries + 1):
            try:
                data = fetch(url)
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(data)
                out[url] = "fetched"
                break
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    out[url] = "missing"
                    break
            except OSError:
                pass
            if k < tries:
                wait(float(k))
    return out
