"""Exact values and properties of the state machines, without Spark."""

import io
import math
import zipfile

import numpy as np
import pytest

from tickweave.functions import stats
from tickweave.functions.rng import Uniform32
from tickweave.operators import alerts
from tickweave.operators.steps import Alignment, Baseline, Bocpd, Cusum, Engine, EngineParams, Ensemble, Policies, Policy, RobustZ, VolatilityRatio, VolumeSpike, Window
from tickweave.sources.files import days, download, first_entry, months
from tickweave.sources.simulated import simulate
from tickweave.sources.socket import Reconnect
from tickweave.sources.sinks import replay_report, study_report, subset_report
from tickweave.sources.subscriptions import subscriptions
from tickweave.streaming.aggregator import Aggregator, BoundedQueue, metrics

M = 60_000


def test_generator_sequence():
    u = Uniform32(1)
    assert [u() for _ in range(3)] == pytest.approx([0.6270739405881613, 0.002735721180215478, 0.5274470399599522], abs=0)
    u = Uniform32(20261001)
    assert [u() for _ in range(3)] == pytest.approx([0.3198020576965064, 0.15813920553773642, 0.06423161458224058], abs=0)


def push(a, rows):
    return [b for r in rows for b in a.push(*r)]


def test_close_by_event_time():
    a = Aggregator()
    made = push(a, [(1000, 10, 1), (30000, 11, 2), (20000, 99, 1), (61000, 12, 1), (62500, 13, 1)])
    assert [(b["t"], b["close"], b["volume"]) for b in made] == [(0, 11, 4)]


def test_late_repeated_invalid():
    a = Aggregator()
    push(a, [(1000, 10, 1, "1"), (62500, 12, 1, "2"), (2000, 10, 1, "3"), (63000, 12, 5, "2"), (64000, math.nan, 1)])
    assert (a.counts["late"], a.counts["dupes"], a.counts["invalid"]) == (1, 1, 1)


def test_gaps():
    a = Aggregator()
    made = push(a, [(1000, 10, 1), (62500, 12, 1), (4 * M + 5000, 14, 1)])
    assert [b["t"] for b in made] == [0, M, 2 * M, 3 * M] and [(b["volume"], b["close"]) for b in made[2:]] == [(0, 12)] * 2 and a.counts["filled"] == 2
    a = Aggregator(most_fill=2)
    assert [b["t"] for b in push(a, [(1000, 10, 1), (10 * M + 5000, 14, 1)])] == [0] and a.counts["skipped"] == 1


def test_idle_seed_book_and_state():
    a = Aggregator()
    push(a, [(1000, 10, 1), (62500, 12, 1)])
    assert [(b["t"], b["volume"]) for b in a.advance(3 * M + 2001)] == [(M, 1), (2 * M, 0)]
    a = Aggregator()
    a.book(30000, 0.5)
    a.book(40000, -0.2)
    assert push(a, [(1000, 10, 1), (62500, 12, 1)])[0]["obi"] == -0.2
    a = Aggregator()
    a.seed(5 * M, 100)
    push(a, [(5 * M + 10, 1, 1)])
    assert a.counts["late"] == 1 and Aggregator().load(a.dump()).dump() == a.dump()


def test_queue():
    q = BoundedQueue(3)
    for x in range(1, 6):
        q.push(x)
    assert q.dropped == 2 and q.drain(10) == [3, 4, 5]


def test_window():
    rng, w, seen = np.random.default_rng(0), Window(50), []
    for x in rng.normal(size=200):
        if len(w) > 1:
            tail = np.array(seen[-50:])
            assert w.quantile(0.9) == pytest.approx(np.quantile(tail, 0.9))
            assert w.mid_rank(x) == pytest.approx(((tail < x).sum() + 0.5 * (tail == x).sum()) / (len(tail) + 1))
        w.push(x)
        seen.append(x)
    w.push(math.nan)
    assert len(w) == 50


def returns(seed, n, scale=0.001):
    return np.random.default_rng(seed).normal(scale=scale, size=n).tolist()


def test_detectors():
    z = RobustZ()
    for r in returns(1, 300):
        z.update({}, r)
    assert z.update({}, 0.02) > 5
    v = VolatilityRatio()
    calm = [v.update({}, r) for r in returns(2, 500)][-1]
    assert 0.6 < calm < 1.5 and [v.update({}, r) for r in returns(3, 30, 0.005)][-1] > 1.5
    c = Cusum()
    out = [c.update({}, r) for r in returns(4, 500)]
    assert out[98] is None and out[99] is not None and max(x for x in out if x is not None) <= 10
    assert any(c.update({}, r + 0.002) > 10 for r in returns(5, 15))
    b = Bocpd()
    steady = [b.update({}, r) for r in returns(6, 600)]
    assert np.mean([x for x in steady[200:]]) < 0.15
    assert max(b.update({}, r) for r in returns(7, 20, 0.01)) > 0.5 and len(b.log) <= 151
    s = VolumeSpike()
    for _ in range(100):
        s.update({"volume": 10.0}, 0)
    assert s.update({"volume": 50.0}, 0) == 5


def test_ensemble():
    e = Ensemble(6)
    assert e.predict([1] * 6)[0] == pytest.approx(1 / (1 + math.exp(3))) and e.predict([3] * 6)[0] == pytest.approx(0.5)
    e.learn([1] * 6, 1.0)
    assert e.w == [0.25] * 6
    e = Ensemble(2, rate=0.05)
    for k in range(4000):
        e.learn([3.0, 0.5] if k % 2 else [0.5, 0.5], float(k % 2))
    assert e.predict([3.0, 0.5])[0] > 0.6 > 0.4 > e.predict([0.5, 0.5])[0] and min(e.w) >= 0


def test_policy():
    p, u = Policy(864, 1, cooldown=1), Uniform32(3)
    assert 0.006 < sum(p.update(u())[0] for _ in range(20000)) / 20000 < 0.015
    p, u = Policy(8640, 1, cooldown=10, escalate=1e12), Uniform32(4)
    at = [i for i in range(5000) if p.update(u())[0]]
    assert min(b - a for a, b in zip(at, at[1:])) >= 10


def bars(n, seed=7, **k):
    return simulate(n, seed, **k)[0]


def test_engine_properties():
    engine = Engine()
    out = [engine.update(b) for b in bars(700)]
    first = next(i for i, o in enumerate(out) if o["ready"])
    assert first == 300 and all(0 <= o["score"] <= 100 for o in out)
    last = out[-1]
    logit = -4.5 + sum(d["contribution"] for d in last["detectors"])
    assert 1 / (1 + math.exp(-logit)) == pytest.approx(last["p"], abs=1e-9)


@pytest.mark.parametrize("learn", [False, True])
def test_no_look_ahead(learn):
    a, b = bars(900, 5), bars(900, 5)
    for k in range(600, 900):
        b[k] = {**b[k], "close": b[k]["close"] * 1.5}
    one, two = Engine(EngineParams(learn=learn)), Engine(EngineParams(learn=learn))
    assert [one.update(x) for x in a[:600]] == [two.update(x) for x in b[:600]]


def test_break_is_found():
    series = bars(4100, 21, events=[{"type": "vol", "at": 4000, "len": 60, "mag": 6.0}])
    engine = Engine()
    assert any(o["alert"] for o in [engine.update(b) for b in series][4000:4031])


def test_baseline_ready():
    base = Baseline()
    out = [base.update(b) for b in bars(400)]
    assert next(i for i, o in enumerate(out) if o["ready"]) == 310 and out[50]["score"] == 0


def test_statistics():
    assert stats.median([3, 1, 2]) == 2 and stats.median([1, 2, 3, 4]) == 2.5 and math.isnan(stats.median([])) and stats.percentile([0, 10], 0.5) == 5
    points = [(1, 0.2), (3, 0.6), (9, 0.8)]
    assert stats.recall_at(points, 2) == pytest.approx(0.4) and stats.recall_at(points, 6) == pytest.approx(0.7)
    assert math.isnan(stats.recall_at(points, 0.5)) and math.isnan(stats.recall_at(points, 10)) and math.isnan(stats.recall_at(points[:1], 1))
    x = returns(8, 60, 1.0)
    one, two = (stats.cluster_bootstrap([i // 3 for i in range(60)], lambda ix: float(np.mean([x[i] for i in ix])), 300, 5) for _ in range(2))
    assert one == two and one["lo"] < one["est"] < one["hi"] and one["n"] == 20
    chance = stats.chance_recall([(4000, 1500 + k, 1650 + k) for k in range(50)], 6, 15, 400, 1)
    assert 0.38 < chance["mean"] < 0.55 and stats.chance_recall([(100, 1, 2)], 0, 15, 10, 1)["mean"] == 0
    assert [stats.verdict(*x) for x in ((0.1, 0.2), (-2, -1), (-1, 1), (math.nan, 1))] == ["higher", "lower", "no clear difference", "n/a"]


def test_alert_service():
    gate = alerts.Limiter(2, 1000)
    assert [gate(t) for t in (0, 10, 20, 1500)] == [True, True, False, True]
    assert [alerts.key_matches(*x) for x in (("abc", None), (None, "abc"), ("abd", "abc"), ("abc", "abc"))] == [False, False, False, True]
    sent = lambda url, body: url == "a"
    assert alerts.dispatch("x", {"one": "a", "two": "b"}, sent) == {"one": True, "two": False}
    assert alerts.dispatch("x", {"one": None, "two": None}, sent) == {"one": None, "two": None}
    assert alerts.dispatch("x", {"one": None, "two": "b"}, lambda *a: 1 / 0) == {"one": None, "two": False}
    throttle = alerts.Throttle(least=80)
    assert [throttle("a", 0, 90), throttle("a", 30_000, 95), throttle("b", 30_000, 79), throttle("a", 60_000, 90)] == [True, False, False, True]


def test_reconnect():
    r = Reconnect(base=1000, rand=lambda: 0.0)
    assert [r.wait(), r.wait()] == [500, 1000]
    token = r.opened(0)
    assert r.wait() == 2000 and r.message(token, 10) and r.wait() == 500
    assert r.is_stale(31_000) and not r.message(token - 1, 20)
    r.stop()
    assert not r.message(token, 30)


def test_zip_and_download(tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "1,2,3")
    assert first_entry(buffer.getvalue()) == b"1,2,3"
    with pytest.raises(ValueError):
        first_entry(b"garbage")
    tries = []

    def fetch(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError
        return b"x"

    target = {"u": tmp_path / "f"}
    assert download(target, fetch, wait=lambda s: None) == {"u": "fetched"} and len(tries) == 3 and download(target, fetch) == {"u": "kept"}
    from datetime import date

    assert months(date(2024, 11, 1), date(2025, 1, 1)) == [(2024, 11), (2024, 12), (2025, 1)] and len(days(date(2024, 1, 1), date(2024, 1, 3))) == 3


def test_a_clock_ahead_is_not_kept():
    a = Aggregator()
    push(a, [(1000, 10, 1), (62500, 12, 1)])
    a.advance(3 * M + 2001)
    assert a.seen == 62500
    assert push(a, [(3 * M + 10, 13, 1)]) == [] and a.counts["late"] == 0


def test_change_points_begin_after_the_warm_up():
    part, rng = Bocpd(), np.random.default_rng(1)
    out = [part.update({}, x) for x in rng.normal(0, 0.001, 400)]
    assert out[:99] == [None] * 99 and out[99:103] == pytest.approx([1.0] * 4) and out[110] < 1
    assert len(part.log) == 151


def test_student_density_sums_to_one():
    grid = np.linspace(-60, 60, 20001)
    assert np.exp([stats.student_t_log_pdf(x, 0.5, 2.0, 3.0, 1.5) for x in grid]).sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-3)
    assert stats.student_t_log_pdf(0.0, 0.0, 1.0, 1.0, 1.0) == pytest.approx(math.lgamma(1.5) - 0.5 * math.log(4 * math.pi))


def test_a_flat_series_teaches_nothing_but_calm():
    engine, told = Engine(EngineParams(learn=True, ecdf_least=20, least=20, detectors=("volume_spike",))), []
    engine.ensemble.learn = lambda x, y: told.append(y)
    for i in range(400):
        engine.update({"t": i * M, "close": 100.0, "volume": float(i % 7)})
    assert told and set(told) == {0.0}


def test_budgets_of_one_window():
    rng = np.random.default_rng(5)
    values = rng.random(4000)
    apart, shared = [Policy(b, 60) for b in (2, 6, 12, 24)], Policies([2, 6, 12, 24], 60)
    assert all([p.update(v) for p in apart] == shared.update(v) for v in values)


def test_own_detectors():
    class Move:
        def update(self, bar, ret):
            return abs(ret)

    run = Engine(EngineParams(detectors=("move",), custom={"move": Move}, ecdf_least=20))
    rng = np.random.default_rng(2)
    out = [run.update({"t": i * M, "close": 100 * math.exp(rng.normal(0, 0.01)), "volume": 1.0}) for i in range(60)]
    assert not out[10]["ready"] and out[50]["ready"] and [x["name"] for x in out[50]["detectors"]] == ["move"]
    assert run.weights()["names"] == ["move"]


def test_alignment_forgets_times_that_lag():
    a = Alignment(["x", "y"], M, every=2)
    assert a.push("x", 0, 1) is None and a.push("z", 0, 1) is None
    assert a.push("y", 0, 2) == ({"x": 1, "y": 2}, False)
    assert a.push("x", M, 3) is None and a.push("x", 7 * M, 4) is None  # M is more than five bars behind
    assert a.push("y", M, 5) is None
    assert a.push("y", 7 * M, 6) == ({"x": 4, "y": 6}, True)


def test_simulated_events():
    calm, busy = (simulate(400, 3, e)[0] for e in ([], [{"type": "vol", "at": 100, "len": 50, "mag": 4.0}]))
    assert [b["close"] for b in calm[:100]] == [b["close"] for b in busy[:100]]
    move = lambda bars, a, z: np.std(np.diff(np.log([b["close"] for b in bars[a:z]])))
    assert move(busy, 100, 150) == pytest.approx(4 * move(calm, 100, 150), rel=0.15)
    _, spans = simulate(20, 3, [{"type": "drift", "at": 5, "len": 3, "mag": 2.0}])
    assert (spans[0]["start"], spans[0]["end"], spans[0]["onset"]) == (5 * M, 8 * M, 5 * M)
    up = simulate(20, 3, [{"type": "jump", "at": 5, "len": 2, "mag": 40.0}], with_book=True)[0]
    flat = simulate(20, 3, [], with_book=True)[0]
    assert up[5]["obi"] == pytest.approx(flat[5]["obi"] + 0.4) and math.log(up[5]["close"] / flat[5]["close"]) == pytest.approx(0.02)


def test_subscriptions():
    found = subscriptions(["binance:BTCUSDT", "coinbase:BTC-USD", "binance:ETHUSDT", "odd"], host="us")
    assert found[0]["url"].endswith("/stream?streams=btcusdt@trade/btcusdt@depth10@100ms/ethusdt@trade/ethusdt@depth10@100ms") and ".us:" in found[0]["url"] and found[0]["send"] == []
    import json

    assert json.loads(found[1]["send"][0]) == {"type": "subscribe", "product_ids": ["BTC-USD"], "channels": ["matches"]}
    assert subscriptions([]) == []


def test_reports():
    row = {"method": "a", "verdict": "higher", "recall": 0.5, "recall_lo": 0.4, "recall_hi": None, "chance": 0.2, "skill": 0.3, "target": 3.0, "subset": "all", "diff": 0.1, "diff_lo": 0.05, "diff_hi": 0.2}
    text = study_report([row], [{"event": "e", "onset": "2024-01-01"}], [{"event": "f", "reason": "no data"}], "0123456789abcdef")
    assert "0.50 [0.40, n/a]" in text and "no data" in text and "0123456789ab`" in text
    assert "0.10 [0.05, 0.20] (higher)" in subset_report([row], {"selected": 2}, "0" * 64)
    assert "| a |" in replay_report([{"method": "a", "alerts": 1}])


def test_live_metrics():
    q = BoundedQueue(1)
    q.push(1), q.push(2)
    m = metrics({"processedRowsPerSecond": 9.6, "numInputRows": 4}, {"late": 2, "skipped": 1}, q, 7, 12.4, [5.0, 1.0, 3.0])
    assert (m["rows_per_second"], m["queued"], m["dropped"], m["p50_us"], m["p95_us"], m["late"], m["lag_ms"], m["bars"]) == (10, 1, 1, 3, 5, 2, 12, 7)
