"""Exchange messages and REST pages to rows. Junk gives no row, or null where a column is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, whole

MATCH = "type string, trade_id string, product_id string, size string, price string, time string"


def imbalance(bids: Column, asks: Column, levels: int = 10) -> Column:
    """(bid quantity - ask quantity) over their sum in the first levels; null if the sum is not positive or a quantity is no number."""
    side = lambda a: F.aggregate(F.slice(F.coalesce(a, F.array()), 1, levels), F.lit(0.0), lambda s, x: s + number(F.get(x, F.lit(1))))
    b, a = side(bids), side(asks)
    return F.when(b + a > 0, (b - a) / (b + a))


def combined_stream(raw: DataFrame, venue: str = "binance", body: str = "value") -> DataFrame:
    """Trades and book imbalances of combined-stream messages: (kind, symbol, t, price, qty, id, obi)."""
    # By path, as the message has fields that differ in case alone.
    at = lambda path: F.get_json_object(F.col(body), f"$.{path}")
    levels = lambda side: F.from_json(at(f"data.{side}"), "array<array<string>>")
    keep = [c for c in raw.columns if c != body]
    name = F.split(at("stream"), "@")
    channel = F.coalesce(F.get(name, F.lit(1)), F.lit(""))
    kind = F.when(channel.startswith("trade"), "trade").when(channel.startswith("depth"), "obi")
    symbol = F.concat(F.lit(f"{venue}:"), F.upper(F.get(name, F.lit(0))))
    trade, book = F.col("kind") == "trade", F.col("kind") == "obi"
    rows = raw.where(at("stream").isNotNull() & at("data").isNotNull()).select(*keep, body, kind.alias("kind"), symbol.alias("symbol"))
    out = rows.select(
        *keep, "kind", "symbol", F.when(trade, whole(number(at("data.T")))).alias("t"), F.when(trade, number(at("data.p"))).alias("price"),
        F.when(trade, number(at("data.q"))).alias("qty"), F.when(trade, at("data.t")).alias("id"), F.when(book, imbalance(levels("bids"), levels("asks"))).alias("obi"),
    )
    trade = (F.col("kind") == "trade") & F.col("price").isNotNull() & F.col("qty").isNotNull() & F.col("t").isNotNull()
    return out.where(trade | (F.col("kind") == "obi") & F.col("obi").isNotNull())


def matches(raw: DataFrame, venue: str = "coinbase", body: str = "value") -> DataFrame:
    """Trades of match messages with ISO times: (kind, symbol, t, price, qty, id)."""
    rows = raw.select(F.from_json(F.col(body), MATCH).alias("m"), *[c for c in raw.columns if c != body]).where(F.col("m.type").isin("match", "last_match"))
    at = F.unix_millis(F.try_to_timestamp("m.time"))
    out = rows.select(*[c for c in raw.columns if c != body], F.lit("trade").alias("kind"), F.concat(F.lit(f"{venue}:"), F.col("m.product_id")).alias("symbol"), at.alias("t"), number(F.col("m.price")).alias("price"), number(F.col("m.size")).alias("qty"), F.col("m.trade_id").alias("id"))
    return out.where("t is not null and price is not null and qty is not null and symbol is not null")


def klines_url(host: str, symbol: str, limit: int = 1000) -> str:
    return f"{host}/api/v3/klines?symbol={symbol}&interval=1m&limit={limit}"


def candles_url(host: str, product: str, start: str | None = None, end: str | None = None) -> str:
    span = f"&start={start}&end={end}" if start and end else ""
    return f"{host}/products/{product}/candles?granularity=60{span}"


def klines_page(pages: DataFrame, now_ms: int, width: int = 60_000, body: str = "value") -> DataFrame:
    """Bars of a page of [open time, open, high, low, close, volume, ...]; the bar still open is left out."""
    r = F.explode(F.from_json(F.col(body), "array<array<string>>")).alias("r")
    rows = pages.select(r).select(whole(number(F.get("r", F.lit(0)))).alias("t"), number(F.get("r", F.lit(4))).alias("close"), number(F.get("r", F.lit(5))).alias("volume"))
    return rows.where((F.col("t") + width <= now_ms) & F.col("close").isNotNull() & F.col("volume").isNotNull())


def candles_page(pages: DataFrame, now_ms: int, width: int = 60_000, body: str = "value") -> DataFrame:
    """Bars of a page of [seconds, low, high, open, close, volume], newest first."""
    r = F.explode(F.from_json(F.col(body), "array<array<string>>")).alias("r")
    rows = pages.select(r).select(whole(number(F.get("r", F.lit(0))) * 1000).alias("t"), number(F.get("r", F.lit(4))).alias("close"), number(F.get("r", F.lit(5))).alias("volume"))
    return rows.where((F.col("t") + width <= now_ms) & F.col("close").isNotNull() & F.col("volume").isNotNull())


def merged_history(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Two pages as one series; where both have a time the newer page counts."""
    both = older.withColumn("page", F.lit(0)).unionByName(newer.withColumn("page", F.lit(1)))
    return both.groupBy("t").agg(F.max_by(F.struct("close", "volume"), "page").alias("b")).select("t", "b.close", "b.volume")
