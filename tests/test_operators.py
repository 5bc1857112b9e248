"""Operators on small fixtures, and batch against stream."""

import json

import numpy as np
from pyspark.sql import functions as F

from tickweave.functions.columns import DAY
from tickweave.operators import alerts, events, windows
from tickweave.sources import files, messages, sinks


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")
from tickweave.operators.steps import Engine, EngineParams


def test_messages(spark):
    trade = json.dumps({"stream": "btcusdt@trade", "data": {"t": 12345, "p": "64000.10", "q": "0.5", "T": 1700000000000}})
    depth = json.dumps({"stream": "btcusdt@depth10@100ms", "data": {"bids": [["1", "3"]], "asks": [["2", "1"]]}})
    got = messages.combined_stream(lines(spark, trade, depth, "{", "[]", '{"stream":"x@trade","data":{"p":"z"}}')).orderBy("kind").collect()
    assert [(r.kind, r.symbol) for r in got] == [("obi", "binance:BTCUSDT"), ("trade", "binance:BTCUSDT")]
    assert got[0].obi == 0.5 and (got[1].price, got[1].qty, got[1].t, got[1].id) == (64000.1, 0.5, 1700000000000, "12345")
    match = {"type": "match", "trade_id": 1, "product_id": "BTC-USD", "size": "1", "price": "5", "time": "2024-01-01T00:00:00Z"}
    got = messages.matches(lines(spark, json.dumps(match), json.dumps(match | {"type": "last_match"}), json.dumps(match | {"type": "done"}), json.dumps(match | {"time": "junk"}))).collect()
    assert [r.symbol for r in got] == ["coinbase:BTC-USD"] * 2 and got[0].t == 1704067200000
    page = json.dumps([[9 * 60000, "1", "1", "1", "9", "1"], [8 * 60000, "1", "1", "1", "8", "1"], [10 * 60000, "1", "1", "1", "10", "1"]])
    rows = [r.close for r in messages.klines_page(lines(spark, page), 10 * 60000 + 5000).orderBy("t").collect()]
    assert rows == [8, 9]


def test_klines(spark):
    got = files.minute_klines(lines(spark, "open_time,o,h,l,c,v", "1700000000000000,1,2,0,1.5,9", "1700000060000,1,2,0,0,9", "1,2", "x,1,1,1,1,1")).collect()
    assert [(r.t, r.close) for r in got] == [(1700000000000, 1.5)]
    got = files.daily_klines(lines(spark, "open_time,open", "1583971200000,2,3,1,2,1", "1735689600000000,2,3,1,2,1", "1583971200000,2,1,3,2,1"))
    assert sorted(r.day for r in got.collect()) == ["2020-03-12", "2025-01-01"]


def test_event_documents(spark):
    doc = json.dumps({"_meta": {"maskDays": {"A": ["2024-01-01"], "B": ["2024-01-02", "2024-01-03"]}}, "events": [{"name": "e", "symbol": "A", "start": "2024-01-01T00:00:00Z", "end": "2024-01-02T00:00:00Z"}]})
    e = files.event_windows(lines(spark, doc)).first()
    assert (e.event, e.symbol, e.end - e.start, e.onset) == ("e", "A", DAY, None)
    assert files.mask_days(lines(spark, doc)).count() == 3


def test_greedy_days(spark):
    days = [(18333, 50.0), (18334, 43.0), (18341, 38.0), (18766, 21.0), (18767, 2.0)]
    rows = spark.createDataFrame([("a", d, 100.0, 100.0 + r, 100.0) for d, r in days], "symbol string, day long, open double, high double, low double")
    assert [r.day for r in events.greedy(events.ranked(rows), 10, 3).orderBy("pick").collect()] == [18333, 18341, 18766]


def test_alert_payload(spark):
    good = {"symbol": "binance:BTCUSDT", "t": 1790856180000, "price": 1.0, "score": 91.5, "threshold": 0.5, "top": [{"name": "bocpd", "contribution": 2.1}, {"name": "robust_z", "contribution": -0.4}]}
    bad = [good | {"symbol": "binance:BTC\nX"}, good | {"top": [{"name": "<script>", "contribution": 1}]}, good | {"price": "1"}, good | {"top": good["top"] * 4}, None]
    rows = lines(spark, *(json.dumps(x) for x in [good, *bad]))
    assert [r.ok for r in rows.select(alerts.valid(F.col("value")).alias("ok")).collect()] == [True] + [False] * 5
    text = rows.limit(1).select(alerts.text(alerts.parsed(F.col("value"))).alias("x")).first().x
    assert "bocpd +2.10, robust_z -0.40" in text and "2026-10-01 12:03 UTC" in text


def test_planted_lead(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=260)
    rows = [("a", i, float(x[i + 3])) for i in range(250)] + [("b", i, float(x[i])) for i in range(250)]
    df = windows.aligned(spark.createDataFrame(rows, "symbol string, t long, v double"), "v", 2)
    got = windows.lead_lag(df).first()
    assert (got.leader, got.follower, got.lag) == ("a", "b", 3)


def test_markdown():
    text = sinks.markdown([{"a": 1.234, "b": None}], ["a", "b"], "t")
    assert "| 1.23 | n/a |" in text and sinks.interval(float("nan"), 0, 0) == "n/a"


def test_stream_equals_batch(spark, sf_dir):
    from tickweave.plans import catalog
    from tickweave.operators import engine

    rows = catalog.B.valid(catalog.ticks(spark, sf_dir)).where("seq < 1500").select("symbol", F.col("seq").alias("t"), F.col("price").alias("close"), F.col("qty").alias("volume"))
    batch = {(r.symbol, r.t): (r.ready, r.score, r.alert) for r in engine.engine(rows, per_day=20.0).collect()}
    stream = {(r.symbol, r.t): (r.ready, r.score, r.alert) for r in catalog.stream_engine(spark, sf_dir).where("t < 1500").collect()}
    assert batch and batch == stream


def test_chunks_equal_one_window(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=700)
    rows = [(s, int(t) * 7, float(v)) for s, n in (("a", 500), ("b", 3), ("c", 197)) for t, v in enumerate(x[:n])]
    df = spark.createDataFrame(rows, "symbol string, t long, x double")
    column = lambda by: windows.robust_z("x", 20, 5, by)
    want = df.withColumn("z", column(("symbol",)))
    for size, cell in ((20, 50), (64, 1000), (10_000, 10)):
        got = windows.in_chunks(df, 20, column, "z", size, cell)
        assert sorted(got.select("symbol", "t", "z").collect(), key=str) == sorted(want.select("symbol", "t", "z").collect(), key=str)
    assert windows.in_chunks(df.limit(0), 20, column, "z").count() == 0


def test_zones_and_first_alerts(spark):
    from tickweave.operators import evaluate

    m = 60_000
    events = spark.createDataFrame([("e", "a", 100 * m, 200 * m), ("e2", "a", 150 * m, 260 * m)], "event string, symbol string, start long, end long")
    rows = spark.createDataFrame([("p", s, t * m, True) for s in "ab" for t in (30, 40, 100, 260, 620, 621)] + [("q", "a", 0, False)], "method string, symbol string, t long, alert boolean")
    got = {(r.symbol, r.t // m): r.zone for r in evaluate.zones(rows.where("alert"), events).collect()}
    assert [got["a", t] for t in (30, 40, 100, 260, 620, 621)] == ["quiet", "guard", "event", "event", "guard", "quiet"] and got["b", 100] == "quiet"
    onsets = events.select("event", "symbol", F.col("start").alias("onset"))
    found = {(r.method, r.event): (r.detected, r.latency_min) for r in evaluate.first_alerts(onsets, rows).collect()}
    assert found == {("p", "e"): (True, 0.0), ("p", "e2"): (True, 110.0), ("q", "e"): (False, None), ("q", "e2"): (False, None)}


def test_resamples(spark):
    from tickweave.operators import evaluate

    days = spark.createDataFrame([(d,) for d in (5, 12, 12, 16, 20, 24, 29, 31)], "cluster long")
    reps = {}
    for r in evaluate.resamples(days, 300).collect():
        reps.setdefault(r.rep, {})[r.cluster] = r.times
    assert len(reps) == 300 and all(sum(x.values()) == 7 for x in reps.values())
    assert len({tuple(sorted(x.items())) for x in reps.values()}) > 200
    alike = sum(x.get(12, 0) == x.get(16, 0) for x in reps.values())
    assert alike < 250


def test_streams_of_several_batches(spark, tmp_path):
    """State is carried from batch to batch and over a restart; history seeds it; the clock finishes idle symbols."""
    from tickweave.streaming import aggregator as S

    schema = "symbol string, t long, price double, qty double, id string, seq long"
    rng = np.random.default_rng(4)
    ticks = [(s, int(t), float(100 + rng.normal()), 1.0, f"{s}{k}", k) for s in ("a", "b") for k, t in enumerate(np.sort(rng.integers(0, 40 * 60_000, 300)))]
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, kind)
    try:
        def put(part, n):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")

        def run(make, out):
            raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            return S.drained(make(raw), f"{tmp_path}/{out}")

        bars = lambda raw: S.stream_bars(raw, 60_000)
        scores = lambda raw: S.stream_scores(raw.select("symbol", F.col("seq").alias("t"), F.col("price").alias("close"), F.col("qty").alias("volume")), detectors=("volume_spike", "robust_z"), ecdf_least=20, least=20)
        for n in range(3):
            put([r for r in ticks if r[5] // 100 == n], n)
            if n == 1:  # two batches, then a restart for the third
                run(bars, "bars"), run(scores, "scores")
        made, scored = run(bars, "bars"), run(scores, "scores")
        assert scored.count() == len(ticks)
        for s in ("a", "b"):
            whole = S.Aggregator(60_000)
            want = [b for r in ticks if r[0] == s for b in whole.push(r[1], r[2], r[3], r[4])]
            got = made.where(F.col("symbol") == s).orderBy("t").collect()
            assert [(r.t, r.close, r.volume) for r in got] == [(b["t"], b["close"], b["volume"]) for b in want]
            engine = Engine(EngineParams(detectors=("volume_spike", "robust_z"), ecdf_least=20, least=20))
            told = [engine.update({"t": r[5], "close": r[2], "volume": r[3]}) for r in ticks if r[0] == s]
            assert [(r.t, r.score, r.alert) for r in scored.where(F.col("symbol") == s).orderBy("t").collect()] == [(x["t"], x["score"], x["alert"]) for x in told]
        history = spark.createDataFrame([("a", 20 * 60_000, 99.0)], "symbol string, t long, close double")
        seeded = run(lambda raw: S.stream_bars(raw, 60_000, history=history), "seeded")
        assert seeded.where("symbol = 'a'").agg(F.min("t")).first()[0] == 21 * 60_000 and seeded.where("symbol = 'b'").agg(F.min("t")).first()[0] < 5 * 60_000
    finally:
        spark.conf.set(key, before)


def test_an_idle_symbol_is_finished_by_the_clock(spark, tmp_path):
    import time

    from tickweave.streaming import aggregator as S

    schema = "symbol string, t long, price double, qty double, id string, seq long"
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, kind)
    try:
        now = int(time.time() * 1000)
        start = (now - 120_000) // 1000 * 1000
        spark.createDataFrame([("a", start, 10.0, 1.0, "1", 1), ("a", start + 1500, 11.0, 1.0, "2", 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
        raw = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        running = S.pumped(S.stream_bars(raw, 1_000, grace=2_000, most_fill=1_000, idle=200), f"{tmp_path}/out", "200 milliseconds")
        try:
            end, got = time.time() + 60, []
            while time.time() < end and len(got) < 50:
                time.sleep(1)
                if any(p.suffix == ".parquet" for p in (tmp_path / "out/rows").glob("*.parquet")):
                    got = spark.read.schema(S.BARS).parquet(f"{tmp_path}/out/rows").orderBy("t").collect()
            assert running.exception() is None
            assert [(r.t, r.close, r.volume) for r in got[:3]] == [(start, 10.0, 1.0), (start + 1000, 11.0, 1.0), (start + 2000, 11.0, 0.0)]
        finally:
            running.stop()
    finally:
        spark.conf.set(key, before)


def test_weights_and_score_series(spark):
    from tickweave.operators import engine as E
    from tickweave.sources.simulated import simulated

    bars = simulated(spark, [1, 2], 500)
    w = E.weight_series(bars, every=50)
    assert w.count() == 20 and all(len(r.w) == len(r.names) == 6 and min(r.w) >= 0 for r in w.collect())
    scored = E.score_series(bars, ["zscore_fixed"])
    assert scored.groupBy("symbol").agg(F.min("idx").alias("lo"), F.count(F.lit(1)).alias("n")).select("lo", "n").distinct().collect() == [(310, 190)]


def test_monthly_archives(spark, tmp_path):
    import zipfile
    from datetime import date

    from tickweave.sources import files

    for m in (1, 3):
        with zipfile.ZipFile(tmp_path / f"AB-1d-2024-{m:02d}.zip", "w") as z:
            z.writestr("x.csv", f"open_time,open,high,low,close,volume\n{1704067200000 + m * 86400000},1,2,0.5,1,9\n")
    lines, missing = files.kline_months(spark, str(tmp_path), "AB", date(2024, 1, 1), date(2024, 3, 31))
    assert missing == [(2024, 2)] and files.daily_klines(lines).count() == 2


def test_configuration_document(spark):
    from tickweave.sources import files

    text = '{"seed": 3, "budgets": [1.0, 2.0]}'
    row = files.config(spark.createDataFrame([(text,)], "value string"), "seed int, budgets array<double>").first()
    import hashlib

    assert row.config.budgets == [1.0, 2.0] and row.sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_summary_and_fan_out(spark, tmp_path):
    from tickweave.sources import sinks

    rows = spark.createDataFrame([("bar", 1), ("alert", 2), ("bar", 3)], "kind string, x int")
    sinks.fan_out(["bar", "alert"], str(tmp_path / "m"))(rows, 0)
    sinks.fan_out(["bar", "alert"], str(tmp_path / "m"))(rows, 0)
    assert spark.read.parquet(str(tmp_path / "m/bar")).count() == 2
    sinks.write_summary(rows, {"a": 1}, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("config = '{\"a\": 1}'").count() == 3
    sent = []
    sinks.notify(sent.append)(spark.createDataFrame([("hi",)], "message string"), 0)
    assert sent == ["hi"]
