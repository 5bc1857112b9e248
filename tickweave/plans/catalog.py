"""The library's queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY, HOUR, epoch_ms, sigmoid
from ..operators import alerts as A
from ..operators import bars as B
from ..operators import engine as E
from ..operators import evaluate as V
from ..operators import events as X
from ..operators import windows as R
from ..operators.steps import Bocpd, Cusum, Ewma, Policies, VolatilityRatio
from ..sources import files, messages, simulated, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MONDAY = 1704067200000  # 2024-01-01

#: What the SQL texts share: ticks, hourly bars, returns, event windows.
BASE = """WITH RECURSIVE ticks AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS t, value AS price, 1.0::DOUBLE AS qty, event_id AS seq FROM events),
bars AS (SELECT symbol, t - t % 3600000 AS t, arg_max(price, (t, seq)) AS close, sum(qty) AS volume FROM ticks WHERE price > 0
GROUP BY symbol, t - t % 3600000),
rets AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS ret FROM bars),
r AS (SELECT * FROM rets WHERE ret IS NOT NULL),
z AS (SELECT symbol, t, close, volume, ret, CASE WHEN count(*) OVER w >= 60 THEN abs(ret - quantile_cont(ret, 0.5) OVER w) / greatest(1.4826 * mad(ret) OVER w, 1e-6) END AS z FROM r WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)),
ev AS (SELECT s.symbol || '-' || d.day AS event, s.symbol, 1704067200000 + d.day * 86400000 + 21600000 AS start, 1704067200000 + d.day * 86400000 + 43200000 AS "end", d.day FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT unnest([5, 12, 16, 20, 24]) AS day) d)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"{BASE}{sql}" if sql.lstrip().startswith((",", "SELECT")) and "FROM lineitem" not in sql else sql
        return f

    return register


def ticks(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), epoch_ms("ts").alias("t"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.col("event_id").alias("seq"), F.col("event_id").alias("id"))


def hourly(spark, d) -> DataFrame:
    return B.bars(ticks(spark, d), HOUR)


def returns(spark, d) -> DataFrame:
    return B.log_returns(hourly(spark, d)).where("ret is not null")


def zscores(spark, d) -> DataFrame:
    return returns(spark, d).withColumn("z", R.robust_z("ret"))


def windows(spark, d) -> DataFrame:
    """Event windows: six hours of five days for each symbol."""
    day = F.explode(F.array(*map(F.lit, (5, 12, 16, 20, 24)))).alias("day")
    s = hourly(spark, d).select("symbol").distinct().select("symbol", day)
    start = F.lit(MONDAY) + F.col("day") * DAY + 6 * HOUR
    return s.select(F.concat_ws("-", "symbol", F.col("day").cast("string")).alias("event"), "symbol", start.cast("long").alias("start"), (start + 6 * HOUR).cast("long").alias("end"), "day")


def r6(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


@query(" SELECT symbol, t, close, volume FROM bars")
def bars_hourly(spark, d):
    return hourly(spark, d)


@query(""", g AS (SELECT *, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS nt FROM bars),
x AS (SELECT *, unnest(CASE WHEN (nt - t) // 3600000 - 1 BETWEEN 1 AND 10 THEN range(0, (nt - t) // 3600000) ELSE [0::BIGINT] END) AS k FROM g)
SELECT symbol, t + k * 3600000 AS t, close, CASE WHEN k > 0 THEN 0.0 ELSE volume END AS volume, k > 0 AS filled FROM x""")
def bars_gap_filled(spark, d):
    return B.fill_gaps(hourly(spark, d), HOUR)


@query(""", a AS (SELECT *, CASE WHEN seq % 7 = 0 THEN (seq + 40) * 2 + 1 ELSE seq * 2 END AS arrival FROM ticks WHERE price > 0),
s AS (SELECT *, max(t) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE t - t % 60000 + 60000 + 2000 <= seen) AS late FROM s GROUP BY symbol""")
def late_trade_flags(spark, d):
    arrival = F.when(F.col("seq") % 7 == 0, (F.col("seq") + 40) * 2 + 1).otherwise(F.col("seq") * 2)
    rows = B.lateness(ticks(spark, d).withColumn("seq", arrival), 60_000, 2_000, 5_000)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


@query(" SELECT count(*) AS n, count(*) FILTER (WHERE NOT (price > 0)) AS invalid, count(DISTINCT symbol) AS symbols FROM ticks")
def trade_counters(spark, d):
    return ticks(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(~(F.col("price") > 0)).alias("invalid"), F.countDistinct("symbol").alias("symbols"))


@query(" SELECT symbol, seq AS id, CASE WHEN seq % 5 = 0 THEN price * 2 ELSE price END AS price FROM ticks")
def dedupe_keep_last(spark, d):
    t = ticks(spark, d).select("symbol", "id", "price", "seq")
    again = t.where(F.col("id") % 5 == 0).withColumn("price", F.col("price") * 2).withColumn("seq", F.col("seq") + 1_000_000_000)
    return B.last_per_key(t.unionByName(again), ["symbol", "id"], ["seq"]).select("symbol", "id", "price")


@query(" SELECT symbol, t, round(ret, 6) AS ret FROM rets")
def log_returns(spark, d):
    return B.log_returns(hourly(spark, d)).select("symbol", "t", r6("ret"))


@query(" SELECT symbol, t, round(z, 6) AS z FROM z")
def robust_z(spark, d):
    return zscores(spark, d).select("symbol", "t", r6("z"))


@query(""" SELECT symbol, seq, CASE WHEN count(*) OVER w >= 60 THEN round(abs(price - quantile_cont(price, 0.5) OVER w) / greatest(1.4826 * mad(price) OVER w, 1e-6), 6) END AS z FROM ticks WHERE price > 0 WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)""")
def tick_robust_z(spark, d):
    """Each event's value against the 240 before it; a symbol's events are dealt out in chunks that overlap."""
    rows = B.valid(ticks(spark, d)).select("symbol", F.col("seq").alias("t"), "price")
    out = R.in_chunks(rows, 240, lambda by: R.robust_z("price", by=by), "z", cell=20_000)
    return out.select("symbol", F.col("t").alias("seq"), r6("z"))


@query(" SELECT symbol, t, round(z, 6) AS z FROM z WHERE z IS NOT NULL ORDER BY round(z, 6) DESC, symbol, t LIMIT 20")
def top_robust_z(spark, d):
    return zscores(spark, d).select("symbol", "t", r6("z")).where("z is not null").orderBy(F.desc("z"), "symbol", "t").limit(20)


@query(""", a AS (SELECT symbol, t, abs(ret) AS x, list(abs(ret)) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS l FROM r)
SELECT symbol, t, CASE WHEN len(l) >= 60 THEN round(-ln(1 - (len(list_filter(l, lambda y: y < x)) + 0.5 * len(list_filter(l, lambda y: y = x))) / (len(l) + 1)), 6) END AS feature FROM a""")
def ecdf_feature(spark, d):
    return returns(spark, d).withColumn("x", F.abs("ret")).select("symbol", "t", r6(R.mid_rank("x", 200, 60), "feature"))


@query(""", q AS (SELECT symbol, t, count(*) OVER w AS n, quantile_cont(abs(ret), 0.75) OVER w AS a, quantile_cont(abs(ret), 0.9) OVER w AS b, quantile_cont(abs(ret), 0.99) OVER w AS c FROM r WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING))
SELECT symbol, t, CASE WHEN n >= 100 THEN round(a, 6) END AS q75, CASE WHEN n >= 100 THEN round(b, 6) END AS q90, CASE WHEN n >= 100 THEN round(c, 6) END AS q99 FROM q""")
def adaptive_quantile(spark, d):
    q = returns(spark, d).withColumn("x", F.abs("ret")).withColumn("q", R.quantiles("x", [0.75, 0.9, 0.99], 240, 100))
    return q.select("symbol", "t", *(r6(F.get("q", F.lit(k)), n) for k, n in enumerate(("q75", "q90", "q99"))))


@query(""" SELECT symbol, t, CASE WHEN count(*) OVER w >= 60 THEN round(volume / greatest(quantile_cont(volume, 0.5) OVER w, 1e-9), 6) END AS spike
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)""")
def volume_spike(spark, d):
    return hourly(spark, d).select("symbol", "t", r6(R.volume_spike(), "spike"))


@query(""" SELECT symbol, t, CASE WHEN count(*) OVER w = 100 AND stddev_samp(ret) OVER w > 0 THEN round(abs(ret - avg(ret) OVER w) / stddev_samp(ret) OVER w, 6) ELSE 0.0 END AS z,
row_number() OVER (PARTITION BY symbol ORDER BY t) >= 310 AS ready FROM r WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)""")
def zscore_baseline(spark, d):
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("t"))
    return returns(spark, d).select("symbol", "t", r6(R.plain_z(), "z"), (n >= 310).alias("ready"))


EWMA_SQL = """, n AS (SELECT symbol, t, ret, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM r),
e AS (SELECT symbol, i, t, ret, {first} FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.t, n.ret, {next} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


@query(EWMA_SQL.format(first="ret * ret AS f, ret * ret AS s", next="CASE WHEN e.f <= 0 THEN n.ret * n.ret ELSE 0.94 * e.f + 0.06 * n.ret * n.ret END, CASE WHEN e.s <= 0 THEN n.ret * n.ret ELSE 0.995 * e.s + 0.005 * n.ret * n.ret END")
       + " SELECT symbol, t, CASE WHEN i >= 100 THEN round(sqrt(f) / greatest(sqrt(s), 1e-9), 6) END AS ratio FROM e")
def ewma_vol_ratio(spark, d):
    def make():
        part = VolatilityRatio()
        return lambda r: {"ratio": part.update(r, r["ret"])}

    return E.fold(returns(spark, d), make, "symbol string, t long, ratio double").select("symbol", "t", r6("ratio"))


def _clipped(v: str, clip: float) -> str:
    return f"CASE WHEN e.{v} <= 0 THEN n.ret * n.ret ELSE 0.99 * e.{v} + 0.01 * pow(greatest(-{clip} * sqrt(e.{v}), least({clip} * sqrt(e.{v}), n.ret)), 2) END"


@query(EWMA_SQL.format(first="ret * ret AS v", next=_clipped("v", 6)) + """, m AS (SELECT symbol, t, max(abs(ret)) OVER w AS m, count(*) OVER w AS k FROM r WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING))
SELECT e.symbol, e.t, round(sqrt(v), 6) AS sigma, CASE WHEN k = 30 THEN round(m, 6) END AS move, CASE WHEN k = 30 THEN m >= 2 * sqrt(v) END AS label FROM e JOIN m USING (symbol, t)""")
def delayed_label(spark, d):
    def make():
        part = Ewma(0.99)
        return lambda r: {"sigma": part.update(r["ret"], 6.0)}

    rows = returns(spark, d).withColumn("move", R.largest_move(30))
    out = E.fold(rows, make, "symbol string, t long, move double, sigma double")
    return out.select("symbol", "t", r6("sigma"), r6("move"), (F.col("move") >= 2 * F.col("sigma")).alias("label"))


_UP = "greatest(0, e.u * (CASE WHEN e.o > 3 THEN 0 ELSE 1 END) + n.ret / greatest(sqrt(e.v), 1e-9) - 0.5)"
_DOWN = "greatest(0, e.w * (CASE WHEN e.o > 3 THEN 0 ELSE 1 END) - n.ret / greatest(sqrt(e.v), 1e-9) - 0.5)"


@query(EWMA_SQL.format(first="ret * ret AS v, 0.0::DOUBLE AS u, 0.0::DOUBLE AS w, 0.0::DOUBLE AS o", next=f"{_clipped('v', 5)}, CASE WHEN n.i < 100 THEN 0 ELSE {_UP} END, CASE WHEN n.i < 100 THEN 0 ELSE {_DOWN} END, CASE WHEN n.i < 100 THEN 0 ELSE greatest({_UP}, {_DOWN}) END")
       + " SELECT symbol, t, CASE WHEN i >= 100 THEN round(o, 6) END AS cusum FROM e")
def cusum(spark, d):
    def make():
        part = Cusum(limit=3.0)
        return lambda r: {"cusum": part.update(r, r["ret"])}

    return E.fold(returns(spark, d), make, "symbol string, t long, cusum double").select("symbol", "t", r6("cusum"))


POLICY_SQL = """, s AS (SELECT symbol, t, round(z, 6) AS v FROM z WHERE z IS NOT NULL),
b AS (SELECT unnest({rates}) AS rate),
q AS (SELECT symbol, t, v, list_sort(list(v) OVER w) AS l, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM s
WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1440 PRECEDING AND 1 PRECEDING)),
k AS (SELECT symbol, t, v, i, rate, CASE WHEN len(l) >= 100 THEN greatest(0, (l[floor(((1 - rate) * (len(l) - 1)))::INT + 1] + (l[least(len(l),
floor(((1 - rate) * (len(l) - 1)))::INT + 2)] - l[floor(((1 - rate) * (len(l) - 1)))::INT + 1]) * (((1 - rate) * (len(l) - 1)) - floor(((1 - rate) * (len(l) - 1)))))) ELSE 1e300 END AS thr, CASE WHEN len(l) >= 100 THEN (l[floor(((1 - rate / 10) * (len(l) - 1)))::INT + 1] + (l[least(len(l), floor(((1 - rate / 10) * (len(l) - 1)))::INT + 2)] - l[floor(((1 - rate / 10) * (len(l) - 1)))::INT + 1]) * (((1 - rate / 10) * (len(l) - 1)) - floor(((1 - rate / 10) * (len(l) - 1))))) ELSE 1e300 END AS ext FROM q, b),
p AS (SELECT symbol, rate, i, t, v, 16 AS since, false AS alert, -1e300 AS last FROM k WHERE i = 1
 UNION ALL SELECT k.symbol, k.rate, k.i, k.t, k.v, CASE WHEN a THEN 0 ELSE p.since + 1 END, a, CASE WHEN a THEN k.v ELSE p.last END
 FROM p JOIN (SELECT * FROM k) k ON k.symbol = p.symbol AND k.rate = p.rate AND k.i = p.i + 1, LATERAL (SELECT k.v > k.thr AND (p.since + 1 >= 15 OR (k.v > k.ext AND k.v > p.last)) AS a))"""


def _policy(rows: DataFrame, rates: list[float]) -> DataFrame:
    """Alerts for several budgets; the policy's rate is set as alarms a day of one-day bars."""

    def make():
        runs = Policies(rates, 86400, least=100)
        return lambda r: {"alerts": [alert for alert, _ in runs.update(r["v"])]}

    out = E.fold(rows, make, "symbol string, t long, v double, alerts array<boolean>")
    return out.select("symbol", "t", "v", F.posexplode("alerts").alias("k", "alert")).withColumn("rate", F.element_at(F.array(*map(F.lit, rates)), F.col("k") + 1)).drop("k")


@query(POLICY_SQL.format(rates="[0.1]") + " SELECT symbol, t, v, alert FROM p")
def alert_policy(spark, d):
    rows = zscores(spark, d).where("z is not null").select("symbol", "t", r6("z", "v"))
    return _policy(rows, [0.1]).select("symbol", "t", "v", "alert")


@query(POLICY_SQL.format(rates="[0.02, 0.05, 0.1, 0.2]") + " SELECT symbol, rate::DOUBLE AS rate, count(*) AS bars, count(*) FILTER (WHERE alert) AS alerts FROM p GROUP BY symbol, rate")
def alert_budget_sweep(spark, d):
    rows = zscores(spark, d).where("z is not null").select("symbol", "t", r6("z", "v"))
    return _policy(rows, [0.02, 0.05, 0.1, 0.2]).groupBy("symbol", "rate").agg(F.count(F.lit(1)).alias("bars"), F.count_if("alert").alias("alerts"))


#: One step of the change points, as nested selects: what each run length says of x, the grown lists, at most 151 of them, their norm.
_GROWN = {"mu": "[0.0::DOUBLE] || list_transform(js, lambda j: (ka[j] * mu[j] + x) / (ka[j] + 1))", "ka": "[1.0::DOUBLE] || list_transform(ka, lambda y: y + 1)",
          "al": "[1.0::DOUBLE] || list_transform(al, lambda y: y + 0.5)", "be": "[1.0::DOUBLE] || list_transform(js, lambda j: be[j] + ka[j] * pow(x - mu[j], 2) / (2 * (ka[j] + 1)))"}


def _run_lengths(source: str) -> str:
    density = "lg[j] + lgamma(al[j] + 0.5) - lgamma(al[j]) - 0.5 * ln(2 * al[j] * pi() * sc[j]) - (al[j] + 0.5) * ln(1 + pow(x - mu[j], 2) / (2 * al[j] * sc[j]))"
    norm = lambda a, m: f"{m} + ln(list_sum(list_transform({a}, lambda y: exp(y - {m}))))"
    levels = [
        "range(1, len(lg) + 1) AS js", "list_transform(js, lambda j: be[j] * (ka[j] + 1) / (al[j] * ka[j])) AS sc", f"list_transform(js, lambda j: {density}) AS jt", "list_max(jt) AS jm", f"{norm('jt', 'jm')} AS tot",
        "[tot + ln(1 / 200.0)] || list_transform(jt, lambda y: y + ln(1 - 1 / 200.0)) AS nl, " + ", ".join(f"{v} AS n_{k}" for k, v in _GROWN.items()),
        "CASE WHEN len(nl) > 151 THEN nl[1:150] || [greatest(nl[151], nl[152]) + ln(1 + exp(-abs(nl[151] - nl[152])))] ELSE nl END AS cl, " + ", ".join(f"CASE WHEN len(nl) > 151 THEN n_{k}[1:150] || [n_{k}[152]] ELSE n_{k} END AS c_{k}" for k in _GROWN),
        "list_max(cl) AS cm", f"{norm('cl', 'cm')} AS z", "list_transform(cl, lambda y: y - z) AS fl",
    ]
    for level in levels:
        source = f"SELECT *, {level} FROM ({source})"
    return source


_EMPTY_RUNS = "[0.0::DOUBLE] AS lg, [0.0::DOUBLE] AS mu, [1.0::DOUBLE] AS ka, [1.0::DOUBLE] AS al, [1.0::DOUBLE] AS be, NULL::DOUBLE AS mass"
_NEXT_RUNS = "CASE WHEN i < 100 THEN lg ELSE fl END, " + ", ".join(f"CASE WHEN i < 100 THEN {k} ELSE c_{k} END" for k in _GROWN) + ", CASE WHEN i >= 100 THEN list_sum(list_transform(fl[1:5], lambda y: exp(y))) END"
_JOIN_RUNS = "e.lg, e.mu, e.ka, e.al, e.be, greatest(-15.0, least(15.0, n.ret / greatest(sqrt(e.v), 1e-9))) AS x"


@query(f""", n AS (SELECT symbol, t, ret, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM r),
e AS (SELECT symbol, i, t, ret * ret AS v, {_EMPTY_RUNS} FROM n WHERE i = 1
UNION ALL SELECT symbol, i, t, nv, {_NEXT_RUNS} FROM ({_run_lengths(f"SELECT n.symbol, n.i, n.t, {_clipped('v', 6)} AS nv, {_JOIN_RUNS} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1")}))
SELECT symbol, t, round(mass, 6) AS mass FROM e""")
def bocpd_short_run_mass(spark, d):
    def make():
        part = Bocpd()
        return lambda r: {"mass": part.update(r, r["ret"])}

    return E.fold(returns(spark, d), make, "symbol string, t long, mass double").select("symbol", "t", r6("mass"))


SETTINGS = {"bar_seconds": 3600.0, "per_day": 0.5, "ecdf": 400, "ecdf_least": 60, "window": 300, "least": 60}


FILLED = """, g AS (SELECT *, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS nt FROM bars),
fb AS (SELECT symbol, t + k * 3600000 AS t, close, CASE WHEN k > 0 THEN 0.0 ELSE volume END AS volume
FROM (SELECT *, unnest(CASE WHEN (nt - t) // 3600000 - 1 BETWEEN 1 AND 10 THEN range(0, (nt - t) // 3600000) ELSE [0::BIGINT] END) AS k FROM g)),
fr AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS ret FROM fb),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM fr WHERE ret IS NOT NULL),
zs AS (SELECT symbol, i, CASE WHEN count(*) OVER w >= 60 THEN abs(ret - quantile_cont(ret, 0.5) OVER w) / greatest(1.4826 * mad(ret) OVER w, 1e-6) END AS rz,
CASE WHEN count(*) OVER w >= 60 THEN volume / greatest(quantile_cont(volume, 0.5) OVER w, 1e-9) END AS vs FROM n WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)),"""
_SUM = "greatest(0, e.{s} * (CASE WHEN e.o > 10 THEN 0 ELSE 1 END) {sign} n.ret / greatest(sqrt(e.cv), 1e-9) - 0.5)"
_SUMS = [_SUM.format(s="su", sign="+"), _SUM.format(s="sd", sign="-")]
#: Every detector's reading, the mid-rank of each among its last 400, the score by the prior, and the policy over the last 300 scores.
ENGINE = f"""{FILLED}
e AS (SELECT symbol, i, t, ret * ret AS v, ret * ret AS vf, ret * ret AS vl, ret * ret AS cv, 0.0::DOUBLE AS su, 0.0::DOUBLE AS sd, 0.0::DOUBLE AS o, {_EMPTY_RUNS} FROM n WHERE i = 1
UNION ALL SELECT symbol, i, t, nv, nf, nsl, ncv, nu, nd, greatest(nu, nd), {_NEXT_RUNS} FROM ({_run_lengths(f"""SELECT n.symbol, n.i, n.t, {_clipped('v', 6)} AS nv,
CASE WHEN e.vf <= 0 THEN n.ret * n.ret ELSE 0.94 * e.vf + 0.06 * n.ret * n.ret END AS nf, CASE WHEN e.vl <= 0 THEN n.ret * n.ret ELSE 0.995 * e.vl + 0.005 * n.ret * n.ret END AS nsl, {_clipped('cv', 5)} AS ncv,
CASE WHEN n.i < 100 THEN 0 ELSE {_SUMS[0]} END AS nu, CASE WHEN n.i < 100 THEN 0 ELSE {_SUMS[1]} END AS nd, {_JOIN_RUNS} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1""")})),
rw AS (SELECT e.symbol, e.i, e.t, rz AS c1, CASE WHEN e.i >= 100 THEN sqrt(vf) / greatest(sqrt(vl), 1e-9) END AS c2,
CASE WHEN e.i >= 100 THEN o END AS c3, mass AS c4, vs AS c5 FROM e JOIN zs USING (symbol, i)),
ls AS (SELECT *, {", ".join(f"list(c{k}) FILTER (WHERE c{k} IS NOT NULL) OVER w AS l{k}" for k in range(1, 6))} FROM rw WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING)),
ft AS (SELECT symbol, i, t, {", ".join(f"CASE WHEN len(l{k}) >= 60 THEN -ln(1 - (len(list_filter(l{k}, lambda y: y < c{k})) + 0.5 * len(list_filter(l{k}, lambda y: y = c{k}))) / (len(l{k}) + 1)) END AS f{k}" for k in range(1, 6))} FROM ls),
ps AS (SELECT *, 1 / (1 + exp(4.5 - 0.25 * (f1 + f2 + f3 + f4 + f5) * 1.2)) AS p, row_number() OVER (PARTITION BY symbol ORDER BY i) AS j FROM ft
WHERE f1 + f2 + f3 + f4 + f5 IS NOT NULL),
lm AS (SELECT *, count(*) OVER w >= 60 AS enough, quantile_cont(p, 1 - 0.5 / 24) OVER w AS a, quantile_cont(p, 1 - 0.05 / 24) OVER w AS b FROM ps
WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING)),
po AS (SELECT symbol, i, t, j, 16 AS since, false AS alert, -1e300 AS last FROM lm WHERE j = 1
UNION ALL SELECT symbol, i, t, j, CASE WHEN hit THEN 0 ELSE since + 1 END, hit, CASE WHEN hit THEN p ELSE last END FROM
(SELECT lm.symbol, lm.i, lm.t, lm.j, lm.p, po.since, po.last, lm.enough AND lm.p > greatest(0, lm.a) AND (po.since + 1 >= 15 OR (lm.p > lm.b AND lm.p > po.last)) AS hit FROM po JOIN lm ON lm.symbol = po.symbol AND lm.j = po.j + 1))"""


@query(ENGINE + """ SELECT fb.symbol, fb.t, lm.p IS NOT NULL AS ready, round(coalesce(lm.p, 0), 6) AS p, coalesce(floor(1000 * lm.p + 0.5) / 10, 0) AS score, round(CASE WHEN enough THEN least(1, greatest(0, a)) ELSE 1 END, 6)::DOUBLE AS threshold,
coalesce(alert, false) AS alert, round(f1, 6) AS robust_z, round(f2, 6) AS ewma_vol, round(f3, 6) AS cusum, round(f4, 6) AS bocpd, round(f5, 6) AS volume_spike FROM fb LEFT JOIN lm USING (symbol, t) LEFT JOIN po USING (symbol, t)""")
def engine_fixed(spark, d):
    """The engine with fixed weights: its score, threshold and alerts, and the detectors' features."""
    out = E.engine(B.fill_gaps(hourly(spark, d), HOUR), **SETTINGS)
    feature = lambda n: r6(F.get(F.filter("detectors", lambda x: x["name"] == n), F.lit(0))["feature"], n)
    return out.select("symbol", "t", "ready", r6("p"), "score", r6("threshold"), "alert", *(feature(n) for n in ("robust_z", "ewma_vol", "cusum", "bocpd", "volume_spike")))


def _methods(names):
    def run(spark, d):
        return E.run_methods(B.fill_gaps(hourly(spark, d), HOUR), names, **SETTINGS)

    return run


for _name, _list in {
    "engine_learned": ["engine_learned"],
    "engine_ablation": [f"without_{x}" for x in ("robust_z", "ewma_vol", "cusum", "bocpd", "volume_spike")],
    "engine_solo": [f"only_{x}" for x in ("robust_z", "ewma_vol", "cusum", "bocpd", "volume_spike")],
}.items():
    QUERIES[_name] = _methods(_list)


@query(FILLED.rsplit("zs AS", 1)[0] + """zz AS (SELECT symbol, i, t, CASE WHEN count(*) OVER w = 100 AND stddev_samp(ret) OVER w > 0 THEN abs(ret - avg(ret) OVER w) / stddev_samp(ret) OVER w ELSE 0 END AS v
FROM n WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
lm AS (SELECT *, count(*) OVER w >= 300 AS enough, quantile_cont(v, 1 - 1 / 240.0) OVER w AS a, quantile_cont(v, 1 - 1 / 2400.0) OVER w AS b FROM zz
WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1440 PRECEDING AND 1 PRECEDING)),
po AS (SELECT symbol, i, t, v, v > 3 AS hit1, CASE WHEN v > 3 THEN 0 ELSE 16 END AS s1, false AS hit2, 16 AS s2, -1e300 AS last FROM lm WHERE i = 1
UNION ALL SELECT symbol, i, t, v, h1, CASE WHEN h1 THEN 0 ELSE s1 + 1 END, h2, CASE WHEN h2 THEN 0 ELSE s2 + 1 END, CASE WHEN h2 THEN v ELSE last END
FROM
(SELECT lm.symbol, lm.i, lm.t, lm.v, po.s1, po.s2, po.last, lm.v > 3 AND po.s1 + 1 >= 15 AS h1, lm.enough AND lm.v > greatest(0,
lm.a) AND (po.s2 + 1 >= 15 OR (lm.v > lm.b AND lm.v > po.last)) AS h2 FROM po JOIN lm ON lm.symbol = po.symbol AND lm.i = po.i + 1))
SELECT fb.symbol, m.method, fb.t, coalesce(po.i >= 310, false) AS ready, round(coalesce(po.v, 0), 6)::DOUBLE AS score,
coalesce(po.i >= 310 AND CASE WHEN m.method = 'zscore_fixed' THEN hit1 ELSE hit2 END, false) AS alert
FROM fb, (SELECT unnest(['zscore_fixed', 'zscore_matched']) AS method) m LEFT JOIN po ON po.symbol = fb.symbol AND po.t = fb.t""")
def engine_baselines(spark, d):
    out = E.run_methods(B.fill_gaps(hourly(spark, d), HOUR), ["zscore_fixed", "zscore_matched"], **SETTINGS)
    return out.select("symbol", "method", "t", "ready", r6("score"), "alert")


@query()
def engine_tick_bars(spark, d):
    """Every event a bar of its own."""
    rows = B.valid(ticks(spark, d)).select("symbol", F.col("seq").alias("t"), F.col("price").alias("close"), F.col("qty").alias("volume"))
    return E.engine(rows, per_day=20.0)


@query(""", f AS (SELECT symbol, t, CASE WHEN z IS NOT NULL THEN least(z, 8.0) END AS a, least(volume, 30.0) / 10 AS b, CASE WHEN t % 7200000 = 0 THEN abs(ret) END AS c FROM z),
m AS (SELECT *, (coalesce(a, 0) + b + coalesce(c, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN c IS NULL THEN 0 ELSE 1 END) AS mean
FROM f)
SELECT symbol, t, round(1 / (1 + exp(-(-4.5 + 0.5 * coalesce(a, mean) + 0.5 * b + 0.5 * coalesce(c, mean)))), 6) AS p, round(0.5 * coalesce(a, mean), 6) AS first_part, a IS NULL AS imputed FROM m""")
def logistic_prior(spark, d):
    rows = zscores(spark, d).select("symbol", "t", F.least("z", F.when(F.col("z").isNotNull(), 8.0)).alias("a"), (F.least("volume", F.lit(30.0)) / 10).alias("b"), F.when(F.col("t") % 7_200_000 == 0, F.abs("ret")).alias("c"))
    known = F.filter(F.array("a", "b", "c"), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    full = F.transform(F.array("a", "b", "c"), lambda x: 0.5 * F.coalesce(x, F.col("mean")))
    out = rows.withColumn("mean", mean).withColumn("parts", full)
    return out.select("symbol", "t", r6(sigmoid(F.aggregate("parts", F.lit(-4.5), lambda s, x: s + x)), "p"), r6(F.get("parts", F.lit(0)), "first_part"), F.col("a").isNull().alias("imputed"))


ALIGNED = """, al AS (SELECT t FROM r GROUP BY t HAVING count(*) = (SELECT count(DISTINCT symbol) FROM r)),
x AS (SELECT symbol, t, {value} AS x, ret, row_number() OVER (PARTITION BY symbol ORDER BY t) AS idx FROM r JOIN al USING (t))"""
CORR = "CASE WHEN n < 3 OR n * xx - sx * sx <= 1e-12 * n * xx OR n * yy - sy * sy <= 1e-12 * n * yy THEN 0 ELSE (n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)) END"


def _aligned(spark, d, value="ret"):
    rows = returns(spark, d).withColumn("v", F.expr(value))
    return R.aligned(rows, "v", rows.select("symbol").distinct().count())


@query(ALIGNED.format(value="ret") + f""", j AS (SELECT a.symbol AS a, b.symbol AS b, a.t, count(*) OVER w AS n, sum(a.x) OVER w AS sx, sum(b.x) OVER w AS sy, sum(a.x * a.x) OVER w AS xx, sum(b.x * b.x) OVER w AS yy, sum(a.x * b.x) OVER w AS xy
FROM x a JOIN x b ON a.t = b.t AND a.symbol < b.symbol
WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.t ROWS BETWEEN 239 PRECEDING AND CURRENT ROW))
SELECT a, b, t, round({CORR}, 6)::DOUBLE AS corr FROM j""")
def pair_correlation(spark, d):
    return R.rolling_corr(_aligned(spark, d)).select("a", "b", "t", r6("corr"))


LEADS = ALIGNED.format(value="abs(ret)") + f""", w AS (SELECT * FROM x WHERE idx > (SELECT max(idx) FROM x) - 240), l AS (SELECT unnest(range(-6, 7)) AS lag),
s AS (SELECT a.symbol AS a, b.symbol AS b, l.lag, count(*) AS n, sum(a.x) AS sx, sum(b.x) AS sy, sum(a.x * a.x) AS xx, sum(b.x * b.x) AS yy,
sum(a.x * b.x) AS xy, corr(a.ret, b.ret) AS rc FROM w a, l, w b WHERE a.symbol < b.symbol AND b.idx = a.idx + l.lag
GROUP BY a.symbol, b.symbol, l.lag),
c AS (SELECT a, b, lag, n, {CORR} AS corr, rc FROM s),
g AS (SELECT a, b, arg_max(lag, (corr, -lag)) AS lag, max(corr) AS lag_corr, max(corr) FILTER (WHERE lag = 0) AS zero, max(rc) FILTER (WHERE lag = 0) AS corr FROM c GROUP BY a, b)"""


@query(LEADS + """ SELECT a, b, round(corr, 6) AS corr, lag, round(lag_corr, 6) AS lag_corr, CASE WHEN lag <> 0 AND lag_corr >= 0.05 AND lag_corr > zero + 0.05 THEN CASE WHEN lag > 0 THEN a ELSE b END END AS leader FROM g""")
def lead_lag_best(spark, d):
    out = R.lead_lag(_aligned(spark, d, "abs(ret)"), least_corr=0.05)
    return out.select("a", "b", r6("corr"), F.col("lag").cast("long").alias("lag"), r6("lag_corr"), "leader")


@query(LEADS + """, k AS (SELECT abs(lag) AS lag_bars, lag_corr, CASE WHEN lag > 0 THEN a ELSE b END AS leader, CASE WHEN lag > 0 THEN b ELSE a END AS follower FROM g WHERE lag <> 0 AND lag_corr >= 0.05 AND lag_corr > zero + 0.05),
n AS (SELECT symbol, arg_max(x, t) AS score FROM x GROUP BY symbol)
SELECT leader, follower, lag_bars, round(lag_corr, 6) AS lag_corr, round(score, 6) AS score FROM k JOIN n ON n.symbol = k.leader WHERE score >= 0.1""")
def lead_lag_warnings(spark, d):
    """The followers whose leader's latest score reaches the threshold."""
    rows = _aligned(spark, d, "abs(ret)")
    out = R.warnings(R.lead_lag(rows, least_corr=0.05), rows, 0.1)
    return out.select("leader", "follower", F.col("lag_bars").cast("long").alias("lag_bars"), r6("lag_corr"), r6("score"))


@query(LEADS + " SELECT a, b, lag, round(lag_corr, 6) AS lag_corr FROM g ORDER BY g.lag_corr DESC, a, b LIMIT 5")
def strongest_links(spark, d):
    return R.strongest(R.lead_lag(_aligned(spark, d, "abs(ret)"))).select("a", "b", F.col("lag").cast("long").alias("lag"), r6("lag_corr"))


@query(ALIGNED.format(value="abs(ret)") + " SELECT t, max(idx) AS idx, round(max(x), 6) AS top FROM x GROUP BY t HAVING max(idx) % 5 = 0")
def aligned_emit(spark, d):
    """Times that all symbols have, every fifth."""
    return _aligned(spark, d, "abs(ret)").groupBy("t").agg(F.max("idx").cast("long").alias("idx"), r6(F.max("x"), "top")).where("idx % 5 = 0")


@query(""", o AS (SELECT symbol, t - t % 3600000 AS t, greatest(-1, least(1, arg_max((seq % 200 - 100) / 80.0, seq))) AS obi FROM ticks GROUP BY symbol, t - t % 3600000)
SELECT b.symbol, b.t, b.close, round(o.obi, 6)::DOUBLE AS obi FROM bars b LEFT JOIN o USING (symbol, t)""")
def obi_attach(spark, d):
    samples = ticks(spark, d).select("symbol", "t", ((F.col("seq") % 200 - 100) / 80.0).alias("value"), "seq")
    return B.attach_imbalance(hourly(spark, d), samples, HOUR).select("symbol", "t", "close", r6("obi"))


@query(" SELECT a.symbol, a.t, round(ln(a.close / b.close), 6) AS lag_ret FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.t = a.t - 21600000")
def exact_lag_return(spark, d):
    return X.exact_lag(hourly(spark, d), 6 * HOUR).select("symbol", "t", r6("lag_ret"))


@query(""", s AS (SELECT ev.event, ev.symbol, count(bars.t) AS bars, (max("end") + 43200000 - (max(start) - 86400000)) // 3600000 + 1 AS expected FROM ev LEFT JOIN bars ON bars.symbol = ev.symbol AND bars.t BETWEEN start - 86400000 AND "end" + 43200000 GROUP BY ev.event, ev.symbol)
SELECT event, symbol, bars, expected, CASE WHEN bars = 0 THEN 'no data' WHEN bars < 0.95 * expected THEN 'insufficient data' END AS reason FROM s""")
def event_sufficiency(spark, d):
    e = windows(spark, d)
    return V.sufficiency(V.slices(hourly(spark, d), e, DAY, 12 * HOUR), e, HOUR)


ZONES = """, zo AS (SELECT r.symbol, r.t, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.symbol = r.symbol AND r.t BETWEEN start AND "end") THEN 'event'
WHEN EXISTS (SELECT 1 FROM ev WHERE ev.symbol = r.symbol AND r.t BETWEEN start - 3600000 AND "end" + 21600000) THEN 'guard' ELSE 'quiet' END AS zone FROM r)"""


@query(ZONES + " SELECT symbol, zone, count(*) AS n FROM zo GROUP BY symbol, zone")
def guard_zones(spark, d):
    return V.zones(returns(spark, d), windows(spark, d)).groupBy("symbol", "zone").agg(F.count(F.lit(1)).alias("n"))


@query(""" SELECT symbol, t FROM bars b WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.symbol = b.symbol AND b.t BETWEEN start - 3600000 AND "end" + 43200000)""")
def quiet_bars(spark, d):
    made = hourly(spark, d)
    masked = V.in_any(made, windows(spark, d), F.col("start") - HOUR, F.col("end") + 12 * HOUR)
    return made.join(masked.select("symbol", "t"), ["symbol", "t"], "left_anti").select("symbol", "t")


SCORED = """, sc AS (SELECT 'z2' AS method, symbol, t, z IS NOT NULL AS ready, coalesce(z > 2, false) AS alert FROM z UNION ALL SELECT 'z3', symbol, t, z IS NOT NULL, coalesce(z > 3, false) FROM z)"""
FIRST = """, fa AS (SELECT m.method, ev.event, ev.symbol, min(sc.t) AS hit, any_value(ev.start) AS onset FROM ev CROSS JOIN (SELECT DISTINCT method FROM sc) m LEFT JOIN sc ON sc.method = m.method AND sc.symbol = ev.symbol AND sc.alert AND sc.t BETWEEN ev.start - 10800000 AND ev.start + 43200000 GROUP BY m.method, ev.event, ev.symbol)"""


def scored(spark, d) -> DataFrame:
    z = zscores(spark, d)
    both = F.explode(F.array(F.struct(F.lit("z2").alias("method"), F.lit(2.0).alias("limit")), F.struct(F.lit("z3").alias("method"), F.lit(3.0).alias("limit")))).alias("m")
    return z.select("symbol", "t", "z", both).select("m.method", "symbol", "t", F.col("z").isNotNull().alias("ready"), F.coalesce(F.col("z") > F.col("m.limit"), F.lit(False)).alias("alert"))


def outcomes(spark, d) -> DataFrame:
    onsets = windows(spark, d).select("event", "symbol", F.col("start").alias("onset"))
    return V.first_alerts(onsets, scored(spark, d), 3 * HOUR, 12 * HOUR, ["z2", "z3"])


@query(SCORED + FIRST + " SELECT method, event, symbol, hit IS NOT NULL AS detected, (hit - onset) / 60000.0::DOUBLE AS latency_min FROM fa")
def first_alert_in_window(spark, d):
    return outcomes(spark, d)


@query(ZONES + SCORED + """, rt AS (SELECT method, count(*) FILTER (WHERE alert) AS alerts, count(*) FILTER (WHERE alert AND zone = 'event') AS in_window, count(*) FILTER (WHERE alert AND zone = 'quiet') AS false_alarms, count(*) FILTER (WHERE ready AND zone = 'quiet') AS quiet_bars FROM sc JOIN zo USING (symbol, t) GROUP BY method),
h AS (SELECT method, event, min(t - start) AS delay FROM sc JOIN ev ON ev.symbol = sc.symbol AND sc.t BETWEEN start AND "end" WHERE alert
GROUP BY method, event), hh AS (SELECT method, count(*) AS detected, quantile_disc(delay, 0.5) AS dl, list_sort(list(delay)) AS l FROM h
GROUP BY method)
SELECT method, alerts, in_window, false_alarms, quiet_bars, coalesce(detected, 0) AS detected, round(coalesce(detected, 0) / (SELECT count(*) FROM ev), 6) AS recall, CASE WHEN in_window + false_alarms > 0 THEN round(in_window / (in_window + false_alarms), 3) END AS precision, l[(len(l) - 1) // 2 + 1] / 60000.0::DOUBLE AS median_delay_min FROM rt LEFT JOIN hh USING (method)""")
def replay_summary(spark, d):
    return V.replay(scored(spark, d), windows(spark, d))


POINTS = """, lim AS (SELECT unnest([1.5, 2.0, 2.5, 3.0, 4.0]) AS budget), ms AS (SELECT 'z' AS method, symbol, t, z AS v FROM z WHERE z IS NOT NULL UNION ALL SELECT 'volume', symbol, t, volume / 4 FROM z WHERE z IS NOT NULL),
oc AS (SELECT m.method, lim.budget, ev.event, bool_or(m.v > budget AND m.t BETWEEN start - 10800000 AND start + 43200000) AS detected,
count(*) FILTER (WHERE m.v > budget AND zo.zone = 'quiet') AS fa, count(*) FILTER (WHERE zo.zone = 'quiet') / 24.0 AS quiet_days
FROM ms m CROSS JOIN lim JOIN ev ON ev.symbol = m.symbol AND m.t BETWEEN start - 86400000 AND "end" + 86400000
JOIN zo ON zo.symbol = m.symbol AND zo.t = m.t GROUP BY m.method, lim.budget, ev.event),
pt AS (SELECT method, budget::DOUBLE AS budget, sum(fa) / sum(quiet_days) AS rate, avg(detected::INT) AS recall FROM oc GROUP BY method, budget)"""


def budget_outcomes(spark, d) -> DataFrame:
    """Outcomes of two scores at five limits over each event's slice."""
    z = zscores(spark, d).where("z is not null")
    kinds = F.explode(F.array(F.named_struct(F.lit("method"), F.lit("z"), F.lit("v"), F.col("z")), F.named_struct(F.lit("method"), F.lit("volume"), F.lit("v"), F.col("volume") / 4))).alias("m")
    zoned = V.zones(z.select("symbol", "t", "z", "volume"), windows(spark, d))
    rows = V.slices(zoned, windows(spark, d), DAY, DAY).join(windows(spark, d).select("event", "start"), "event")
    rows = rows.select("event", "t", "start", "zone", kinds, F.explode(F.array(*map(F.lit, (1.5, 2.0, 2.5, 3.0, 4.0)))).alias("budget"))
    over, quiet = F.col("m.v") > F.col("budget"), F.col("zone") == "quiet"
    near = F.col("t").between(F.col("start") - 3 * HOUR, F.col("start") + 12 * HOUR)
    return rows.groupBy("m.method", "budget", "event").agg(F.bool_or(over & near).alias("detected"), F.count_if(over & quiet).alias("fa"), (F.count_if(quiet) / 24.0).alias("quiet_days"))


@query(ZONES + POINTS + " SELECT method, budget, round(rate, 6) AS rate, round(recall, 6) AS recall FROM pt")
def rate_recall_curve(spark, d):
    return V.rate_points(budget_outcomes(spark, d)).select("method", "budget", r6("rate"), r6("recall"))


@query(ZONES + POINTS + """, tr AS (SELECT 3.0 AS target UNION ALL SELECT 5.0), n AS (SELECT *, lead(rate) OVER w AS r2, lead(recall) OVER w AS y2 FROM pt WINDOW w AS (PARTITION BY method ORDER BY rate, budget)),
f AS (SELECT method, target, arg_min(CASE WHEN r2 = rate THEN y2 ELSE recall + (y2 - recall) * (target - rate) / (r2 - rate) END, rate) AS y
FROM n, tr WHERE rate <= target AND r2 >= target GROUP BY method, target)
SELECT m.method, tr.target::DOUBLE AS target, round(f.y, 6) AS recall FROM (SELECT DISTINCT method FROM pt) m CROSS JOIN tr LEFT JOIN f ON f.method = m.method AND f.target = tr.target""")
def matched_recall(spark, d):
    return V.recall_at(V.rate_points(budget_outcomes(spark, d)), [3.0, 5.0]).select("method", "target", r6("recall"))


STUDY_OUTCOMES = """, so AS (SELECT sc.method, ev.event, any_value(ev.day) AS cluster, count(*) FILTER (WHERE sc.alert AND zo.zone = 'quiet') AS fa, count(*) FILTER (WHERE sc.ready AND zo.zone = 'quiet') / 24.0::DOUBLE AS quiet_days
FROM sc JOIN ev ON ev.symbol = sc.symbol AND sc.t BETWEEN start - 86400000 AND "end" + 86400000 JOIN zo ON zo.symbol = sc.symbol AND zo.t = sc.t
GROUP BY sc.method, ev.event),
oc AS (SELECT so.*, fa.hit IS NOT NULL AS detected, (fa.hit - fa.onset) / 60000.0::DOUBLE AS lat FROM so JOIN fa USING (method, event)),
"""
STUDY_POINTS = """ex AS (SELECT a.*, b.detected AS rd, b.lat AS rl, b.fa AS rf, b.quiet_days AS rq, rep, unnest(range(0, times)) AS u FROM oc a JOIN oc b ON b.event = a.event AND b.method = 'z2' JOIN dr ON dr.cluster = a.cluster),
pp AS (SELECT method, rep, count(DISTINCT event) AS n, avg(detected::INT) AS recall, sum(fa) / nullif(sum(quiet_days), 0) AS rate, quantile_cont(lat, 0.5) AS latency, avg(detected::INT) - avg(rd::INT) AS d_recall, sum(fa) / nullif(sum(quiet_days), 0) - sum(rf) / nullif(sum(rq), 0) AS d_rate, quantile_cont(lat - rl, 0.5) AS d_latency FROM ex GROUP BY method, rep)"""
#: Resamples with replacement of the clusters in {rows}: as many draws as clusters, each by a hash of (rep, draw).
DRAWN = """, k AS (SELECT {by}cluster, row_number() OVER ({part}ORDER BY cluster) - 1 AS i, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {by}cluster FROM {rows})),
d AS (SELECT {by}rep, ('0x' || substr(md5(rep || '|' || i), 1, 12))::BIGINT % n AS i FROM k, (SELECT unnest(range(0, {reps})) AS rep))"""
MEASURES = ("recall", "rate", "latency", "d_recall", "d_rate", "d_latency")
_BOUNDS = ", ".join(f"round(max({x}) FILTER (WHERE rep < 0), 6)::DOUBLE AS {x}, " + ", ".join(f"CASE WHEN count({x}) FILTER (WHERE rep >= 0) >= 20 THEN round(quantile_cont({x}, {q}) FILTER (WHERE rep >= 0), 6)::DOUBLE END AS {x}_{e}" for e, q in (("lo", 0.025), ("hi", 0.975))) for x in MEASURES)


def drawn(rows: str, reps: int = 2000, by: str = "") -> str:
    return DRAWN.format(rows=rows, reps=reps, by=f"{by}, " if by else "", part=f"PARTITION BY {by} " if by else "")


_SUMMARY = f""", sm AS (SELECT *, CASE WHEN method = 'z2' THEN 'reference' WHEN d_recall_lo IS NULL THEN 'n/a' WHEN d_recall_lo > 0 THEN 'higher' WHEN d_recall_hi < 0 THEN 'lower' ELSE 'no clear difference' END AS verdict
FROM (SELECT method, max(n) FILTER (WHERE rep < 0) AS n, {_BOUNDS} FROM pp GROUP BY method))"""
_REPS = drawn("oc") + """, dr AS (SELECT cluster, -1 AS rep, 1 AS times FROM k UNION ALL SELECT cluster, rep, count(*) FROM d JOIN k USING (i) GROUP BY cluster, rep),
"""
#: A random alerter at each method's rate over the events' windows, in hourly bars from a day before the event; 200 trials.
CHANCE = """, cw AS (SELECT event, (start - 10800000 - (start - 86400000)) // 3600000 AS w1, (start + 43200000 - (start - 86400000)) // 3600000 AS w2 FROM ev),
cr AS (SELECT method, sum(fa) / sum(quiet_days) AS rate FROM oc GROUP BY method HAVING sum(fa) / sum(quiet_days) > 0),
ct AS (SELECT event, w1, w2, method, rate, rep, 0 AS k, 6 + floor(('0x' || substr(md5(event || '|' || rep || '|0'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * (24 / rate)) AS pos FROM cw, cr, (SELECT unnest(range(0, 200)) AS rep)
UNION ALL SELECT event, w1, w2, method, rate, rep, k + 1, pos + 2 + ceil(-ln(1 - ('0x' || substr(md5(event || '|' || rep || '|' || (k + 1)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE) * greatest(1.0, 24 / rate - 2)) FROM ct WHERE pos < w1),
ch AS (SELECT method, rate, avg(r) AS mean, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi
FROM (SELECT method, rate, rep, avg(CASE WHEN pos <= w2 THEN 1.0::DOUBLE ELSE 0 END) AS r FROM ct WHERE pos >= w1 GROUP BY method, rate, rep) GROUP BY method, rate)"""


def study_rows(spark, d) -> DataFrame:
    """Outcomes of both limits with the events' days as clusters, false alarms and quiet days of their slices."""
    e = windows(spark, d)
    zoned = V.slices(V.zones(scored(spark, d), e), e, DAY, DAY)
    quiet = F.col("zone") == "quiet"
    fa = zoned.groupBy("method", "event").agg(F.count_if(F.col("alert") & quiet).alias("fa"), (F.count_if(F.col("ready") & quiet) / 24.0).alias("quiet_days"))
    return outcomes(spark, d).join(fa, ["method", "event"]).join(e.select("event", F.col("day").alias("cluster")), "event")


def chances(spark, d, rows: DataFrame) -> DataFrame:
    rates = rows.groupBy("method").agg((F.sum("fa") / F.sum("quiet_days")).alias("rate")).where("rate > 0")
    spans = windows(spark, d).select("event", F.lit(21).alias("first"), F.lit(36).alias("last"))
    return V.chance(spans, rates, 200, 24, 2, 6)


@query(ZONES + SCORED + FIRST + STUDY_OUTCOMES.rstrip(",\n") + _REPS + STUDY_POINTS + _SUMMARY + CHANCE + """
SELECT sm.*, round(ch.mean, 6) AS chance, round(ch.lo, 6) AS chance_lo, round(ch.hi, 6) AS chance_hi, round(sm.recall - ch.mean, 6) AS skill FROM sm LEFT JOIN ch USING (method)""")
def study_summary(spark, d):
    """Per method, with 95 % bounds from 2000 resamples of the days, and the recall of chance at its rate."""
    rows = study_rows(spark, d)
    out = V.study_summary(rows, V.resamples(rows.select("cluster"), 2000), "z2").select("method", "n", *(r6(f"{x}{end}") for x in MEASURES for end in ("", "_lo", "_hi")), "verdict")
    by_chance = chances(spark, d, rows).select("method", r6("mean", "chance"), r6("lo", "chance_lo"), r6("hi", "chance_hi"), F.col("mean").alias("m"))
    return out.join(by_chance, "method", "left").withColumn("skill", F.round(F.col("recall") - F.col("m"), 6)).drop("m")


@query(ZONES + SCORED + FIRST + STUDY_OUTCOMES.rstrip(",\n") + drawn("oc") + """, p AS (SELECT a.event, a.cluster, a.detected::INT - b.detected::INT AS gap, a.lat - b.lat AS late FROM oc a JOIN oc b USING (event) WHERE a.method = 'z3' AND b.method = 'z2'),
q AS (SELECT rep, avg(gap) AS m FROM d JOIN k USING (i) JOIN p USING (cluster)
GROUP BY rep), b AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM q)
SELECT 'z3' AS method, count(*) AS n, round(avg(gap), 6) AS diff, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi,
quantile_cont(late, 0.5)::DOUBLE AS median_gap_min,
CASE WHEN any_value(lo) > 0 THEN 'higher' WHEN any_value(hi) < 0 THEN 'lower' ELSE 'no clear difference' END AS verdict FROM p, b""")
def paired_difference(spark, d):
    """Difference of recall to the reference over the same events, with 95 % bounds from 2000 resamples of the days."""
    rows = study_rows(spark, d)
    out = V.study_summary(rows, V.resamples(rows.select("cluster"), 2000), "z2").where("method <> 'z2'")
    return out.select("method", "n", r6("d_recall", "diff"), r6("d_recall_lo", "lo"), r6("d_recall_hi", "hi"), F.col("d_latency").alias("median_gap_min"), "verdict")


@query(""", v AS (SELECT (t // 86400000) AS cluster, abs(ret) AS x FROM r), c AS (SELECT cluster, sum(x) AS s, count(*) AS m FROM v GROUP BY cluster)""" + drawn("v") + """, p AS (SELECT rep, sum(s) / sum(m) AS mean FROM d JOIN k USING (i) JOIN c USING (cluster) GROUP BY rep)
SELECT round((SELECT avg(x) FROM v), 6) AS est, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM p""")
def bootstrap_ci(spark, d):
    """The mean absolute return, with 2000 resamples of the days."""
    values = returns(spark, d).select(F.floor(F.col("t") / DAY).cast("long").alias("cluster"), F.abs("ret").alias("x"))
    return V.bootstrap(values, V.resamples(values, 2000)).select(r6("est"), r6("lo"), r6("hi"))


TAGS = "CASE WHEN day % 8 = 0 THEN ['all', 'late', 'early8'] WHEN day > 14 THEN ['all', 'late'] ELSE ['all'] END"


def tags() -> Column:
    return F.when(F.col("day") % 8 == 0, F.array(*map(F.lit, ("all", "late", "early8")))).when(F.col("day") > 14, F.array(F.lit("all"), F.lit("late"))).otherwise(F.array(F.lit("all")))


@query(f", tg AS (SELECT event, unnest({TAGS}) AS tag FROM ev) SELECT tag, count(*) AS n FROM tg GROUP BY tag HAVING count(*) >= 5")
def overlapping_subsets(spark, d):
    return windows(spark, d).select("event", F.explode(tags()).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(ZONES + POINTS + f""", so AS (SELECT unnest({TAGS}) AS subset, oc.*, ev.day AS cluster FROM oc JOIN ev USING (event)), sn AS (SELECT subset, count(DISTINCT event) AS n FROM so GROUP BY subset HAVING count(DISTINCT event) >= 5)""" + drawn("so", 200, "subset") + """,
dr AS (SELECT subset, cluster, -1 AS rep, 1 AS times FROM k UNION ALL SELECT subset, cluster, rep, count(*) FROM d JOIN k USING (subset, i)
GROUP BY subset, cluster, rep),
sp AS (SELECT subset, rep, method, budget, sum(times * fa) / nullif(sum(times * quiet_days), 0) AS rate,
sum(times * detected::INT) / sum(times)::DOUBLE AS recall FROM so JOIN sn USING (subset) JOIN dr USING (subset, cluster) GROUP BY ALL),
sl AS (SELECT *, lead(rate) OVER w AS r2, lead(recall) OVER w AS y2 FROM sp WHERE rate IS NOT NULL
WINDOW w AS (PARTITION BY subset, rep, method ORDER BY rate, budget)),
sf AS (SELECT subset, rep, method, target::DOUBLE AS target, arg_min(CASE WHEN r2 = rate THEN y2 ELSE recall + (y2 - recall) * (target - rate) / (r2 - rate) END, rate) FILTER (WHERE rate <= target AND r2 >= target) AS recall FROM sl, (SELECT unnest([3.0, 5.0]) AS target) GROUP BY ALL),
sd AS (SELECT a.*, a.recall - b.recall AS diff FROM sf a LEFT
JOIN sf b ON b.subset = a.subset AND b.rep = a.rep AND b.target = a.target AND b.method = 'z'),
sb AS (SELECT subset, method, target, """ + ", ".join(f"max({x}) FILTER (WHERE rep < 0) AS {x}, " + ", ".join(f"CASE WHEN count({x}) FILTER (WHERE rep >= 0) >= 20 THEN quantile_cont({x}, {q}) FILTER (WHERE rep >= 0) END AS {x}_{e}" for e, q in (("lo", 0.025), ("hi", 0.975))) for x in ("recall", "diff")) + """ FROM sd GROUP BY subset, method, target)
SELECT subset, n, method, target, round(recall, 6) AS recall, round(recall_lo, 6) AS recall_lo, round(recall_hi, 6) AS recall_hi,
round(diff, 6) AS diff, round(diff_lo, 6) AS diff_lo, round(diff_hi, 6) AS diff_hi,
CASE WHEN method = 'z' THEN 'reference' WHEN diff_lo IS NULL THEN 'n/a' WHEN diff_lo > 0 THEN 'higher' WHEN diff_hi < 0 THEN 'lower' ELSE 'no clear difference' END AS verdict FROM sb JOIN sn USING (subset)""")
def subset_summary(spark, d):
    """Recall at matched rates per subset of the events, with 95 % bounds from 200 resamples of a subset's days."""
    e = windows(spark, d).select("event", F.col("day").alias("cluster"), F.explode(tags()).alias("subset"))
    rows = budget_outcomes(spark, d).join(e, "event")
    out = V.subset_summary(rows, V.resamples(rows.select("subset", "cluster"), 200, ("subset",)), "z", [3.0, 5.0])
    return out.select("subset", "n", "method", "target", *(r6(f"{x}{end}") for x in ("recall", "diff") for end in ("", "_lo", "_hi")), "verdict")


@query(ZONES + SCORED + FIRST + f""" SELECT * FROM (SELECT 'selected' AS name, count(*) AS n FROM ev UNION ALL SELECT 'tag ' || tag, count(*) FROM (SELECT unnest({TAGS}) AS tag FROM ev) GROUP BY tag
UNION ALL SELECT 'detected by ' || method, count(hit) FROM fa GROUP BY method)""")
def event_counts(spark, d):
    """How many events there are, in each subset, and found by each method."""
    e = windows(spark, d)
    rows = e.select(F.explode(F.concat(F.array(F.lit("selected")), F.transform(tags(), lambda x: F.concat(F.lit("tag "), x)))).alias("name"), F.lit(1).alias("one"))
    found = outcomes(spark, d).select(F.concat(F.lit("detected by "), "method").alias("name"), F.col("detected").cast("int").alias("one"))
    return rows.unionByName(found).groupBy("name").agg(F.sum("one").alias("n"))


@query(ZONES + SCORED + FIRST + STUDY_OUTCOMES.rstrip(",\n") + CHANCE + " SELECT method, round(rate, 6) AS rate, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ch")
def chance_recall(spark, d):
    """What a random alerter at each method's rate of false alarms would find of the events."""
    return chances(spark, d, study_rows(spark, d)).select("method", r6("rate"), r6("mean"), r6("lo"), r6("hi"))


@query(SCORED + FIRST + """ SELECT event, max(CASE WHEN method = 'z2' THEN (hit - onset) / 60000.0::DOUBLE END) AS z2, max(CASE WHEN method = 'z3' THEN (hit - onset) / 60000.0::DOUBLE END) AS z3 FROM fa GROUP BY event""")
def event_method_pivot(spark, d):
    return sinks.event_matrix(outcomes(spark, d), ["z2", "z3"])


@query(" SELECT symbol, t, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS rn FROM bars) WHERE rn <= 90")
def latest_n_per_symbol(spark, d):
    return sinks.latest(hourly(spark, d).select("symbol", "t", "close"), 90)


@query(""", f AS (SELECT symbol, t, [{'c': z, 'n': 'robust_z'}, {'c': volume / 10, 'n': 'volume_spike'}, {'c': abs(ret) * 3, 'n': 'move'}, {'c': 0.5, 'n': 'flat'}] AS p FROM z WHERE z IS NOT NULL)
SELECT symbol, t, array_to_string(list_transform(list_reverse_sort(p)[1:3], lambda x: x.n), ',') AS drivers FROM f""")
def top_drivers(spark, d):
    z = zscores(spark, d).where("z is not null")
    part = lambda c, n: F.struct(c.alias("c"), F.lit(n).alias("n"))
    parts = F.array(part(F.col("z"), "robust_z"), part(F.col("volume") / 10, "volume_spike"), part(F.abs("ret") * 3, "move"), part(F.lit(0.5), "flat"))
    return z.select("symbol", "t", F.array_join(F.transform(F.slice(F.sort_array(parts, False), 1, 3), lambda x: x["n"]), ",").alias("drivers"))


@query(""", s AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM z WHERE z > 1.5),
p AS (SELECT symbol, i, t, t AS last, true AS sent FROM s WHERE i = 1
UNION ALL SELECT s.symbol, s.i, s.t, CASE WHEN s.t - p.last >= 36000000 THEN s.t ELSE p.last END, s.t - p.last >= 36000000 FROM p
JOIN s ON s.symbol = p.symbol AND s.i = p.i + 1)
SELECT symbol, t, sent FROM p""")
def notification_throttle(spark, d):
    def make():
        gate = A.Throttle(least=1.5, pause=10 * HOUR)
        return lambda r: {"sent": gate(r["symbol"], r["t"], r["z"])}

    return E.fold(zscores(spark, d).where("z > 1.5").select("symbol", "t", "z"), make, "symbol string, t long, sent boolean")


@query(""", s AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM z WHERE z > 1.5),
p AS (SELECT symbol, i, t, [t] AS times, true AS sent FROM s WHERE i = 1
UNION ALL SELECT s.symbol, s.i, s.t, CASE WHEN len(list_filter(p.times, lambda x: x > s.t - 86400000)) < 3 THEN list_append(list_filter(p.times,
lambda x: x > s.t - 86400000), s.t) ELSE list_filter(p.times, lambda x: x > s.t - 86400000) END, len(list_filter(p.times,
lambda x: x > s.t - 86400000)) < 3 FROM p JOIN s ON s.symbol = p.symbol AND s.i = p.i + 1)
SELECT symbol, t, sent FROM p""")
def rate_limit(spark, d):
    def make():
        gate = A.Limiter(3, DAY)
        return lambda r: {"sent": gate(r["t"])}

    return E.fold(zscores(spark, d).where("z > 1.5").select("symbol", "t"), make, "symbol string, t long, sent boolean")


@query(""", s AS (SELECT symbol, seq, t % 1000 + 1 AS x, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i FROM ticks),
p AS (SELECT symbol, i, seq, x::DOUBLE AS lag FROM s WHERE i = 1 UNION ALL SELECT s.symbol, s.i, s.seq, 0.98 * p.lag + 0.02 * s.x FROM p JOIN s ON s.symbol = p.symbol AND s.i = p.i + 1) SELECT symbol, seq, round(lag, 6) AS lag FROM p""")
def feed_lag(spark, d):
    def make():
        held = {"v": 0.0}

        def step(r):
            held["v"] = 0.98 * held["v"] + 0.02 * r["x"] if held["v"] else float(r["x"])
            return {"lag": held["v"]}

        return step

    rows = ticks(spark, d).select("symbol", "seq", (F.col("t") % 1000 + 1).alias("x"))
    return E.fold(rows, make, "symbol string, seq long, lag double", order="seq").select("symbol", "seq", r6("lag"))


def _raw(spark, d):
    t = ticks(spark, d)
    price = F.when(F.col("id") % 11 == 0, "oops").otherwise(F.col("price").cast("string"))
    price = F.when(F.col("id") % 17 == 0, F.element_at(F.array(*map(F.lit, ("NaN", "Infinity", "1d", "2f", "1e999", ""))), (F.col("id") % 6 + 1).cast("int"))).otherwise(price)
    at = F.when(F.col("id") % 19 == 0, F.element_at(F.array(*map(F.lit, ('"NaN"', '"1e30"', '""', "null"))), (F.col("id") % 4 + 1).cast("int"))).otherwise(F.col("t").cast("string"))
    body = F.format_string('{"stream":"%s@trade","data":{"t":%d,"p":"%s","q":"1.0","T":%s}}', F.lower("symbol"), F.col("id"), price, at)
    return t.select("id", F.when(F.col("id") % 13 == 0, F.lit("{broken")).otherwise(body).alias("value"))


@query(" SELECT 'binance:' || upper(symbol) AS symbol, t, price, qty, seq::VARCHAR AS id FROM ticks WHERE seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0")
def json_trade_parse(spark, d):
    return messages.combined_stream(_raw(spark, d).select("value")).select("symbol", "t", "price", "qty", "id")


@query(" SELECT 'coinbase:' || upper(symbol) AS symbol, t - t % 1000 AS t, price, qty, seq::VARCHAR AS id FROM ticks WHERE seq % 3 < 2 AND seq % 17 <> 0")
def match_message_parse(spark, d):
    kind = F.element_at(F.array(F.lit("match"), F.lit("last_match"), F.lit("heartbeat")), (F.col("id") % 3 + 1).cast("int"))
    at = F.when(F.col("id") % 17 == 0, "not a time").otherwise(F.concat(F.date_format(F.timestamp_seconds(F.floor(F.col("t") / 1000)).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")))
    body = F.format_string('{"type":"%s","trade_id":%d,"product_id":"%s","size":"1.0","price":"%s","time":"%s"}', kind, F.col("id"), F.upper("symbol"), F.col("price").cast("string"), at)
    return messages.matches(ticks(spark, d).select(body.alias("value"))).select("symbol", "t", "price", "qty", "id")


@query(" SELECT seq, CASE WHEN seq % 10 = 0 OR seq % 7 = 3 THEN NULL ELSE round(((seq % 7) + 1 - (seq % 5)) / ((seq % 7) + 1 + (seq % 5))::DOUBLE, 6) END AS obi FROM ticks")
def book_imbalance(spark, d):
    t = ticks(spark, d)
    quantity = lambda c: F.array(F.array(F.lit("1"), c.cast("string")))
    empty = F.array().cast("array<array<string>>")
    junk = F.element_at(F.array(*map(F.lit, ("NaN", "Infinity", "1d", "x"))), (F.col("seq") % 4 + 1).cast("int"))
    bids = F.when(F.col("seq") % 10 == 0, empty).when(F.col("seq") % 7 == 3, quantity(junk)).otherwise(quantity(F.col("seq") % 7 + 1))
    asks = F.when(F.col("seq") % 10 == 0, empty).otherwise(quantity(F.col("seq") % 5))
    return t.select("seq", r6(messages.imbalance(bids, asks), "obi"))


@query(" SELECT t, count(*) AS n, max(price) AS high, min(price) AS low, sum(qty) AS volume FROM ticks WHERE price > 0 AND seq % 9 <> 0 AND seq % 8 <> 0 GROUP BY t")
def kline_lines(spark, d):
    """Kline lines with headers, junk and microseconds among them."""
    t = ticks(spark, d)
    at = F.when(F.col("seq") % 2 == 0, F.col("t") * 1000).otherwise(F.col("t"))
    line = F.when(F.col("seq") % 9 == 0, "open_time,open,high,low,close,volume").otherwise(F.concat_ws(",", at.cast("string"), "price", "price", "price", "price", "qty"))
    junk = F.element_at(F.array(*map(F.lit, ("NaN", "Infinity", "1d", "2f", "1e999"))), (F.col("seq") % 5 + 1).cast("int"))
    line = F.when(F.col("seq") % 16 == 0, F.concat_ws(",", at.cast("string"), "price", "price", "price", junk, "qty")).when(F.col("seq") % 16 == 8, F.concat_ws(",", F.when(F.col("seq") % 3 == 0, "1e30").otherwise("NaN"), "price", "price", "price", "price", "qty")).otherwise(line)
    rows = files.minute_klines(t.select(line.alias("value")))
    return rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("high"), F.min("open").alias("low"), F.sum("volume").alias("volume"))


@query(""" SELECT strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS day, count(*) AS n, max(price) AS high FROM ticks WHERE price > 0 AND seq % 9 <> 0 AND seq % 8 <> 0 GROUP BY 1""")
def daily_kline_lines(spark, d):
    t = ticks(spark, d)
    line = F.when(F.col("seq") % 9 == 0, "junk,1,2").when(F.col("seq") % 8 == 0, F.concat_ws(",", F.col("t").cast("string"), "price", F.lit("NaN"), "price", "price", "qty")).otherwise(F.concat_ws(",", F.col("t").cast("string"), "price", "price", "price", "price", "qty"))
    utc = t.select(line.alias("value"), "t")
    made = files.daily_klines(utc)
    return made.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("high"))


@query(" SELECT t, price AS close, qty AS volume FROM ticks WHERE t + 60000 <= 1705276800000")
def klines_page(spark, d):
    """Pages of REST klines, a row each, the bars still open left out."""
    page = F.format_string('[[%d,"1","2","0.5","%s","%s",0,"x"]]', F.col("t"), F.col("price").cast("string"), F.col("qty").cast("string"))
    return messages.klines_page(ticks(spark, d).select(page.alias("value")), 1705276800000)


@query(""", c AS (SELECT t - t % 1000 AS t, max(price) AS close FROM ticks WHERE seq % 5 <> 0 GROUP BY 1), o AS (SELECT t - t % 1000 AS t, min(price) AS close FROM ticks WHERE seq % 3 = 0 GROUP BY 1)
SELECT coalesce(c.t, o.t) AS t, coalesce(c.close, o.close) AS close, 1.0::DOUBLE AS volume FROM c FULL JOIN o ON o.t = c.t WHERE coalesce(c.t, o.t) + 60000 <= 1705276800000""")
def merged_history(spark, d):
    """Two pages of candles as one series; the newer page counts where both have a time. Candles of junk are left out."""
    rows = ticks(spark, d).withColumn("s", F.floor(F.col("t") / 1000))

    def page(rows, price):
        one = rows.groupBy("s").agg(price.alias("p"))
        return messages.candles_page(one.select(F.format_string('[[%d,1,2,0.5,%s,1.0],["NaN",1,1,1,1,1],[%d,1,1,1,"1d",1]]', F.col("s"), F.col("p").cast("string"), F.col("s")).alias("value")), 1705276800000)

    return messages.merged_history(page(rows.where("seq % 3 = 0"), F.min("price")), page(rows.where("seq % 5 <> 0"), F.max("price")))


@query(" SELECT 'binance:' || upper(symbol) AS symbol, seq, round((seq % 7 + 1 - seq % 5) / (seq % 7 + 1 + seq % 5)::DOUBLE, 6) AS obi FROM ticks")
def depth_parse(spark, d):
    """Book messages of two levels a side to imbalances."""
    body = F.format_string('{"stream":"%s@depth10@100ms","data":{"bids":[["1","%d"],["2","1"]],"asks":[["3","%d"]]}}', F.lower("symbol"), F.col("seq") % 7, F.col("seq") % 5)
    return messages.combined_stream(ticks(spark, d).select("seq", body.alias("value"))).where("kind = 'obi'").select("symbol", "seq", r6("obi"))


@query(" SELECT symbol, count(*) AS n, sum(price) AS total FROM ticks WHERE symbol IN (SELECT symbol FROM ticks GROUP BY symbol ORDER BY symbol LIMIT 2) GROUP BY symbol")
def known_symbols(spark, d):
    """Ticks of the two configured symbols alone."""
    t = ticks(spark, d)
    return B.known(t, t.select("symbol").distinct().orderBy("symbol").limit(2)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query(""" SELECT b.symbol, b.t FROM bars b WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.symbol = b.symbol AND b.t BETWEEN start - 3600000 AND "end" + 21600000)
AND NOT (b.symbol = (SELECT min(symbol) FROM bars) AND (b.t BETWEEN 1704067200000 + 8 * 86400000::BIGINT - 3600000 AND 1704067200000 + 9 * 86400000::BIGINT + 21600000 OR b.t BETWEEN 1704067200000 + 27 * 86400000::BIGINT - 3600000 AND 1704067200000 + 28 * 86400000::BIGINT + 21600000))""")
def quiet_with_mask_days(spark, d):
    """Bars far from the symbol's own events and from days masked besides."""
    made = hourly(spark, d)
    days = made.agg(F.min("symbol").alias("symbol")).select("symbol", F.explode(F.array(F.lit(MONDAY // DAY + 8), F.lit(MONDAY // DAY + 27))).alias("day"))
    spans = V.masks(windows(spark, d), days)
    return made.join(V.in_any(made, spans, F.col("from"), F.col("to")).select("symbol", "t"), ["symbol", "t"], "left_anti").select("symbol", "t")


@query(" SELECT event, symbol, start, \"end\", start + 3600000 AS onset FROM ev")
def event_windows_json(spark, d):
    iso = lambda c: F.concat(F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    item = F.struct(F.col("event").alias("name"), "symbol", iso(F.col("start")).alias("start"), iso(F.col("end")).alias("end"), iso(F.col("start") + HOUR).alias("onset"))
    text = windows(spark, d).agg(F.to_json(F.struct(F.collect_list(item).alias("events"))).alias("value"))
    return files.event_windows(text).select("event", "symbol", "start", "end", "onset")


@query(" SELECT symbol, sha256(symbol || '{}') AS sha256 FROM bars GROUP BY symbol")
def config_hash(spark, d):
    return hourly(spark, d).select("symbol").distinct().select("symbol", F.sha2(F.concat("symbol", F.lit("{}")), 256).alias("sha256"))


def _payloads(spark, d):
    t = ticks(spark, d)
    symbol = F.when(F.col("id") % 5 == 0, "BAD symbol").otherwise(F.concat(F.lit("binance:"), F.upper(F.regexp_replace("symbol", "[^a-z]", ""))))
    name = F.when(F.col("id") % 7 == 0, "<script>").otherwise("robust_z")
    price = F.when(F.col("id") % 11 == 0, F.lit('"1.0"')).otherwise("1.0")
    body = F.format_string('{"symbol":"%s","t":%d,"price":%s,"score":91.5,"threshold":0.5,"top":[{"name":"%s","contribution":1.5}]}', symbol, F.col("t"), price, name)
    return t.select("id", "symbol", "t", body.alias("body"))


@query(" SELECT seq AS id, seq % 5 <> 0 AND seq % 7 <> 0 AND seq % 11 <> 0 AND length(regexp_replace(symbol, '[^a-z]', '', 'g')) BETWEEN 3 AND 20 AS ok FROM ticks")
def payload_validation(spark, d):
    return _payloads(spark, d).select("id", A.valid(F.col("body")).alias("ok"))


@query(" SELECT seq AS id, CASE WHEN seq % 6 = 0 THEN 503 WHEN seq % 6 = 1 THEN 401 WHEN seq % 6 = 2 THEN 429 WHEN seq % 5 <> 0 AND seq % 7 <> 0 AND seq % 11 <> 0 AND length(regexp_replace(symbol, '[^a-z]', '', 'g')) BETWEEN 3 AND 20 THEN 200 ELSE 400 END AS status FROM ticks")
def request_status(spark, d):
    k = F.col("id") % 6
    return _payloads(spark, d).select("id", A.status(k != 0, k != 1, k == 2, F.col("body")).alias("status"))


@query(""" SELECT symbol, l[least(len(l) - 1, floor(0.5 * len(l))::INT) + 1] AS p50, l[least(len(l) - 1, floor(0.95 * len(l))::INT) + 1] AS p95 FROM
(SELECT symbol, list_sort(list(price)) AS l FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM ticks) WHERE rn <= 512 GROUP BY symbol)""")
def latency_percentiles(spark, d):
    last = sinks.latest(ticks(spark, d), 512, order="seq").groupBy("symbol").agg(F.sort_array(F.collect_list("price")).alias("l"))
    at = lambda f: F.element_at("l", (F.least(F.size("l") - 1, F.floor(f * F.size("l"))) + 1).cast("int"))
    return last.select("symbol", at(0.5).alias("p50"), at(0.95).alias("p95"))


DAILY = """WITH RECURSIVE lt AS (SELECT l_returnflag AS symbol, epoch_us(l_shipdate) // 1000 AS t, l_extendedprice AS price, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
dy AS (SELECT symbol, t // 86400000 AS day, arg_min(price, (t, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, seq)) AS close
FROM lt WHERE price > 0 GROUP BY symbol, t // 86400000),
rg AS (SELECT *, 100 * (high - low) / open AS range_pct FROM dy WHERE open > 0 AND high >= low AND low > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY range_pct DESC, day) AS rank FROM rg)"""
GREEDY = """, gr AS (SELECT DISTINCT symbol, 0::BIGINT AS rank, []::BIGINT[] AS p FROM rk UNION ALL SELECT gr.symbol, rk.rank, CASE WHEN len(p) < {k} AND len(list_filter(p, lambda x: abs(x - rk.day) < {apart})) = 0 THEN list_append(p, rk.day) ELSE p END FROM gr JOIN rk ON rk.symbol = gr.symbol AND rk.rank = gr.rank + 1 WHERE rk.rank <= {most}),
gp AS (SELECT symbol, unnest(arg_max(p, rank)) AS day, unnest(range(1, len(arg_max(p, rank)) + 1)) AS pick FROM gr GROUP BY symbol)"""


def daily(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return X.daily(li.select(F.col("l_returnflag").alias("symbol"), epoch_ms("l_shipdate").alias("t"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))


@query(DAILY + " SELECT symbol, day, open, high, low, close FROM dy")
def daily_ohlc(spark, d):
    return daily(spark, d)


@query(DAILY + " SELECT symbol, day, round(range_pct, 6) AS range_pct, rank FROM rk WHERE rank <= 20")
def top_range_days(spark, d):
    return X.ranked(daily(spark, d)).where("rank <= 20").select("symbol", "day", r6("range_pct"), F.col("rank").cast("long").alias("rank"))


@query(DAILY + GREEDY.format(k=20, apart=30, most=1180) + " SELECT symbol, day, pick FROM gp")
def greedy_days(spark, d):
    return X.greedy(X.ranked(daily(spark, d)), 20, 30).select("symbol", "day", F.col("pick").cast("long").alias("pick"))


@query(DAILY + GREEDY.format(k=20, apart=30, most=1180) + " SELECT symbol, day, pick, CASE WHEN pick <= 8 THEN 'chosen' ELSE 'held' END AS part FROM gp")
def split_picks(spark, d):
    out = X.split_picks(X.greedy(X.ranked(daily(spark, d)), 20, 30), 8)
    return out.select("symbol", "day", F.col("pick").cast("long").alias("pick"), "part")


@query(DAILY + GREEDY.format(k=6, apart=30, most=354) + """ SELECT symbol || '-' || strftime(make_timestamp(gp.day * 86400000000), '%Y-%m-%d') AS event, symbol, gp.day * 86400000 AS start, (gp.day + 1) * 86400000 AS "end" FROM gp""")
def events_document(spark, d):
    """The chosen days written as a document of events, and read from it again."""
    picks = X.greedy(X.ranked(daily(spark, d)), 6, 30)
    return files.event_windows(sinks.events_document(picks)).select("event", "symbol", "start", "end")


REGIME = """, us AS (SELECT *, quantile_cont(range_pct, 0.5) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS usual, lag(day, 7) OVER (PARTITION BY symbol ORDER BY day) = day - 7 AS whole FROM rg),
rx AS (SELECT symbol, day, range_pct / usual AS ratio FROM us WHERE whole AND usual > 0 AND range_pct >= 4 AND NOT EXISTS (SELECT 1 FROM gp
WHERE gp.symbol = us.symbol AND abs(gp.day - us.day) <= 1)),
rr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ratio DESC, day) AS rank FROM rx)"""


@query(DAILY + GREEDY.format(k=10, apart=30, most=590) + REGIME + """, r2 AS (SELECT DISTINCT symbol, 0::BIGINT AS rank, []::BIGINT[] AS p FROM rr UNION ALL SELECT r2.symbol, rr.rank, CASE WHEN len(p) < 6 AND len(list_filter(p, lambda x: abs(x - rr.day) < 20)) = 0 THEN list_append(p, rr.day) ELSE p END FROM r2 JOIN rr ON rr.symbol = r2.symbol AND rr.rank = r2.rank + 1 WHERE rr.rank <= 234)
SELECT symbol, unnest(arg_max(p, rank)) AS day, unnest(range(1, len(arg_max(p, rank)) + 1)) AS pick FROM r2 GROUP BY symbol""")
def regime_picks(spark, d):
    """Days of the largest ratio to the week before, apart from each other and from the shock days."""
    days = X.ranked(daily(spark, d))
    out = X.greedy(X.regime(days.drop("rank"), X.greedy(days, 10, 30)), 6, 20, value="ratio")
    return out.select("symbol", "day", F.col("pick").cast("long").alias("pick"))


@query(DAILY + GREEDY.format(k=10, apart=30, most=590) + """, us AS (SELECT *, quantile_cont(range_pct, 0.5) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS usual, lag(day, 7) OVER (PARTITION BY symbol ORDER BY day) = day - 7 AS whole FROM rk),
rx AS (SELECT symbol, day, range_pct / usual AS ratio FROM us WHERE whole AND usual > 0 AND range_pct >= 4 AND NOT EXISTS (SELECT 1 FROM gp
WHERE gp.symbol = us.symbol AND abs(gp.day - us.day) <= 1))
SELECT symbol, day, round(ratio, 6) AS ratio, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ratio DESC, day) AS rank FROM rx) WHERE rank <= 20""")
def regime_days(spark, d):
    days = X.ranked(daily(spark, d))
    out = X.regime(days.drop("rank"), X.greedy(days, 10, 30))
    return out.where("rank <= 20").select("symbol", "day", r6("ratio"), F.col("rank").cast("long").alias("rank"))


@query(""", dd AS (SELECT symbol, start // 86400000 AS day FROM ev), b AS (SELECT bars.*, dd.day FROM bars JOIN dd ON bars.symbol = dd.symbol AND bars.t // 86400000 = dd.day),
o AS (SELECT symbol, day, arg_min(close, t) AS open, count(*) AS n FROM b GROUP BY symbol, day)
SELECT o.symbol, o.day, o.n, CASE WHEN o.n >= 12 THEN (SELECT min(t) FROM b WHERE b.symbol = o.symbol AND b.day = o.day AND abs(b.close / o.open - 1) * 100 >= 50) END AS onset FROM o""")
def onset_pct(spark, d):
    days = windows(spark, d).select("symbol", F.floor(F.col("start") / DAY).cast("long").alias("day"))
    return X.onset_by_open(hourly(spark, d), days, 50.0, 12)


@query(""", dd AS (SELECT symbol, start // 86400000 AS day FROM ev), m AS (SELECT a.symbol, a.t, abs(ln(a.close / b.close)) AS m FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.t = a.t - 21600000),
th AS (SELECT dd.symbol, dd.day, CASE WHEN count(*) >= 0.8 * 5 * 24 THEN 2 * quantile_cont(m, 0.5) END AS theta FROM dd
JOIN m ON m.symbol = dd.symbol AND m.t // 86400000 BETWEEN dd.day - 5 AND dd.day - 1 GROUP BY dd.symbol, dd.day)
SELECT th.symbol, th.day, round(theta, 6) AS theta, min(m.t) FILTER (WHERE m.m >= theta) AS onset, coalesce(min(m.t) FILTER (WHERE m.m >= theta) = min(m.t), false) AS in_progress FROM th LEFT JOIN m ON m.symbol = th.symbol AND m.t // 86400000 = th.day GROUP BY th.symbol, th.day, theta""")
def onset_trailing(spark, d):
    days = windows(spark, d).select("symbol", F.floor(F.col("start") / DAY).cast("long").alias("day"))
    out = X.onset_by_past(X.exact_lag(hourly(spark, d), 6 * HOUR), days, back=5, multiple=2.0, per_day=24)
    return out.select("symbol", "day", r6("theta"), "onset", "in_progress")


@query(" SELECT symbol, t FROM r WHERE symbol <> (SELECT min(symbol) FROM r) AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.symbol = r.symbol AND ev.start = r.t)")
def set_operations(spark, d):
    """Two slices in one, distinct, without the event starts and without one symbol."""
    r = returns(spark, d).select("symbol", "t")
    starts = windows(spark, d).select("symbol", F.col("start").alias("t"))
    first = r.agg(F.min("symbol").alias("symbol"))
    return r.unionByName(r.where("t % 2 = 0")).distinct().join(starts, ["symbol", "t"], "left_anti").join(F.broadcast(first), "symbol", "left_anti")


@query()
def simulated_engine(spark, d):
    shocks = [{"type": "vol", "at": 900, "len": 60, "mag": 5.0}, {"type": "jump", "at": 1300, "len": 1, "mag": 40.0}]
    return E.run_methods(simulated.simulated(spark, [1, 2, 3, 4], 1500, shocks), ["engine_fixed", "zscore_matched"])


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.col("event_type").alias("symbol"), epoch_ms("ts").alias("t"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq"))


def _checkpoint(spark) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp() if spark.sparkContext.master.startswith("local[") else None)
    if base is None:
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _drain(spark, make) -> DataFrame:
    from ..streaming.aggregator import drained

    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, kind)
    try:
        return drained(make(), _checkpoint(spark))
    finally:
        spark.conf.set(key, before)


@query(""", g AS (SELECT *, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS nt FROM bars), x AS (SELECT *, unnest(CASE WHEN (nt - t) // 3600000 - 1 BETWEEN 1 AND 10 THEN range(0, (nt - t) // 3600000) ELSE [0::BIGINT] END) AS k FROM g), m AS (SELECT symbol, max(t) AS seen FROM ticks WHERE price > 0 GROUP BY symbol)
SELECT symbol, t + k * 3600000 AS t, close, CASE WHEN k > 0 THEN 0.0 ELSE volume END AS volume FROM x JOIN m USING (symbol) WHERE t + k * 3600000 + 3602000 <= seen""")
def stream_bars(spark, d):
    from ..streaming.aggregator import stream_bars as made

    return _drain(spark, lambda: made(_stream(spark, d), HOUR)).select("symbol", "t", "close", "volume")


@query()
def stream_engine(spark, d):
    from ..streaming.aggregator import stream_scores

    def make():
        s = _stream(spark, d).where("price > 0").select("symbol", F.col("seq").alias("t"), F.col("price").alias("close"), F.col("qty").alias("volume"))
        return stream_scores(s, per_day=20.0)

    return _drain(spark, make)


@query(""" SELECT symbol, t - t % 3600000 AS t, count(*) AS n, max(price) AS high FROM ticks GROUP BY 1, 2 HAVING t - t % 3600000 + 3600000 <= (SELECT max(t) - 2000 FROM ticks)""")
def stream_windows(spark, d):
    """Tumbling event-time windows by the built-in operators, duplicates dropped; windows that the watermark has passed."""

    def make():
        rows = _stream(spark, d).withColumn("at", F.timestamp_millis(F.col("t"))).withWatermark("at", "2 seconds").dropDuplicatesWithinWatermark(["symbol", "id"])
        made = rows.groupBy("symbol", F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high"))
        return made.select("symbol", F.unix_millis("w.start").alias("t"), "n", "high")

    return _drain(spark, make)
