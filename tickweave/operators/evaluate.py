"""Alert replay against event windows, outcome tables, matched rates and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY, MINUTE


def met(rows: DataFrame, spans: DataFrame, low: Column, high: Column, how: str = "inner", width: int = DAY) -> DataFrame:
    """Rows and the spans of their symbol with ``lo`` <= t <= ``hi``: an equi-join on the days that a span touches, then the exact test."""
    cells = spans.withColumn("lo", low).withColumn("hi", high).withColumnRenamed("symbol", "s").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return rows.withColumn("c", F.floor(F.col("t") / width)).join(cells, (F.col("symbol") == F.col("s")) & (F.col("c") == F.col("cell")) & F.col("t").between(F.col("lo"), F.col("hi")), how).drop("c", "cell", "s")


def in_any(rows: DataFrame, spans: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows with a span of their symbol around them."""
    return met(rows, spans.select("symbol", low.alias("l"), high.alias("h")), F.col("l"), F.col("h"), "left_semi")


def zones(rows: DataFrame, events: DataFrame, ahead: int = 60 * MINUTE, behind: int = 360 * MINUTE) -> DataFrame:
    """``zone`` of each row: event inside a window, guard just before or after one, else quiet.

    The windows of a symbol and day become one array, so rows meet them in a single join that never repeats a row.
    """
    first, last = F.col("start") - ahead, F.col("end") + behind
    cells = events.select(F.col("symbol").alias("s"), F.struct(F.col("start").alias("a"), F.col("end").alias("b")).alias("w"), F.explode(F.sequence(F.floor(first / DAY), F.floor(last / DAY))).alias("cell"))
    packed = cells.groupBy("s", "cell").agg(F.collect_set("w").alias("near"))
    out = rows.withColumn("c", F.floor(F.col("t") / DAY)).join(packed, (F.col("symbol") == F.col("s")) & (F.col("c") == F.col("cell")), "left")
    inside = F.exists("near", lambda w: F.col("t").between(w["a"], w["b"]))
    around = F.exists("near", lambda w: F.col("t").between(w["a"] - ahead, w["b"] + behind))
    return out.withColumn("zone", F.when(inside, "event").when(around, "guard").otherwise("quiet")).drop("c", "cell", "s", "near")


def slices(bars: DataFrame, events: DataFrame, warmup: int, tail: int) -> DataFrame:
    """Bars of each event from ``warmup`` before its start to ``tail`` after its end, both included."""
    spans = events.select("event", "symbol", (F.col("start") - warmup).alias("first"), (F.col("end") + tail).alias("last"))
    return met(bars, spans, F.col("first"), F.col("last")).drop("first", "last")


def sufficiency(sliced: DataFrame, events: DataFrame, width: int, share: float = 0.95) -> DataFrame:
    """Events with their bars, expected bars and the reason to leave them out, if any."""
    n = sliced.groupBy("event").agg(F.count(F.lit(1)).alias("bars"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    out = events.select("event", "symbol").join(n, "event", "left").withColumn("bars", F.coalesce("bars", F.lit(0)).cast("long"))
    want = F.floor((F.col("hi") - F.col("lo")) / width) + 1
    return out.withColumn("expected", want.cast("long")).withColumn("reason", F.when(F.col("bars") == 0, "no data").when(F.col("bars") < share * want, "insufficient data")).drop("lo", "hi")


def masks(events: DataFrame, mask_days: DataFrame, ahead: int = 60 * MINUTE, behind: int = 360 * MINUTE) -> DataFrame:
    """(symbol, from, to): the spans that are not quiet, around events and around whole masked days (symbol, day), both ends included."""
    day = F.col("day").cast("long")
    days = mask_days.select("symbol", (day * DAY).alias("start"), ((day + 1) * DAY).alias("end"))
    both = events.select("symbol", "start", "end").unionByName(days)
    return both.select("symbol", (F.col("start") - ahead).alias("from"), (F.col("end") + behind).alias("to")).distinct()


def first_alerts(onsets: DataFrame, scored: DataFrame, lead: int = 30 * MINUTE, lag: int = 120 * MINUTE, methods: list[str] | None = None) -> DataFrame:
    """Per event and method whether an alert falls into [onset - lead, onset + lag], and its delay in minutes.

    A method that never alerts has its rows too. The methods' names are few; those not given are looked up.
    """
    names = methods if methods is not None else sorted(r["method"] for r in scored.select("method").distinct().collect())
    alerts = scored.where("alert").select("method", "symbol", F.col("t"))
    found = met(alerts, onsets, F.col("onset") - lead, F.col("onset") + lag).groupBy("method", "event").agg(F.min("t").alias("at"))
    every = onsets.withColumn("method", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    return every.join(found, ["method", "event"], "left").select("method", "event", "symbol", F.col("at").isNotNull().alias("detected"), ((F.col("at") - F.col("onset")) / MINUTE).alias("latency_min"))


def replay(scored: DataFrame, events: DataFrame) -> DataFrame:
    """Per method: alerts, alerts in windows, false alarms, quiet bars, detections and the lower median delay."""
    z = zones(scored, events)
    alert = F.col("alert")
    rates = z.groupBy("method").agg(
        F.count_if(alert).alias("alerts"), F.count_if(alert & (F.col("zone") == "event")).alias("in_window"),
        F.count_if(alert & (F.col("zone") == "quiet")).alias("false_alarms"), F.count_if(F.col("ready") & (F.col("zone") == "quiet")).alias("quiet_bars"),
    )
    hits = met(scored.where("alert").select("method", "symbol", "t"), events.select("event", "symbol", "start", "end"), F.col("start"), F.col("end"))
    first = hits.groupBy("method", "event").agg(F.min(F.col("t") - F.col("start")).alias("delay"))
    found = first.groupBy("method").agg(F.count(F.lit(1)).alias("detected"), F.sort_array(F.collect_list("delay")).alias("d"))
    n = events.count()
    out = rates.join(found, "method", "left").withColumn("detected", F.coalesce("detected", F.lit(0)).cast("long"))
    lower = F.element_at("d", (F.floor((F.size("d") - 1) / 2) + 1).cast("int")) / MINUTE
    judged = F.col("in_window") + F.col("false_alarms")
    return out.select("method", "alerts", "in_window", "false_alarms", "quiet_bars", "detected", F.round(F.col("detected") / max(1, n), 6).alias("recall"), F.when(judged > 0, F.round(F.col("in_window") / judged, 3)).alias("precision"), lower.alias("median_delay_min"))


def rate_points(outcomes: DataFrame, by: tuple[str, ...] = ("method",), weight: str | None = None) -> DataFrame:
    """(*by, budget, rate, recall): false alarms a quiet day, and the share of events detected; events count ``weight`` times."""
    w = F.col(weight) if weight else F.lit(1)
    rate = F.try_divide(F.sum(w * F.col("fa")), F.sum(w * F.col("quiet_days")))
    return outcomes.groupBy(*by, "budget").agg(rate.alias("rate"), (F.sum(w * F.col("detected").cast("double")) / F.sum(w)).alias("recall"))


def recall_at(points: DataFrame, rates: list[float], by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(*by, target, recall): recall at each rate on the line between the points around it; null outside them. Points without a rate don't count."""
    w = Window.partitionBy(*by).orderBy("rate", "budget")
    rows = points.where("rate is not null and recall is not null").withColumn("r2", F.lead("rate").over(w)).withColumn("y2", F.lead("recall").over(w))
    targets = F.explode(F.array(*map(F.lit, rates))).alias("target")
    level = F.col("r2") == F.col("rate")
    at = F.when(level, F.col("y2")).otherwise(F.col("recall") + (F.col("y2") - F.col("recall")) * (F.col("target") - F.col("rate")) / F.nullif(F.col("r2") - F.col("rate"), F.lit(0.0)))
    each = rows.select("*", targets)
    around = (F.col("rate") <= F.col("target")) & (F.col("r2") >= F.col("target"))
    return each.groupBy(*by, "target").agg(F.min(F.when(around, F.struct("rate", at.alias("y")))).alias("p")).select(*by, "target", F.col("p.y").alias("recall"))


def subset_summary(outcomes: DataFrame, replicates: DataFrame, reference: str, rates: list[float], least: int = 20, smallest: int = 5) -> DataFrame:
    """Per subset, method and rate: recall at the rate and its difference to the reference method, each with 95 % bounds.

    ``outcomes`` has subset, method, budget, event, cluster, detected, fa and quiet_days, an event once for each of its subsets;
    ``replicates`` (subset, rep, cluster, times) says how often each cluster counts. Subsets with fewer than ``smallest`` events
    are left out. Replicates without a value are passed over; fewer than ``least`` give no bounds.
    """
    n = outcomes.groupBy("subset").agg(F.countDistinct("event").alias("n")).where(F.col("n") >= smallest)
    once = outcomes.select("subset", "cluster").distinct().select("subset", F.lit(-1).cast("long").alias("rep"), "cluster", F.lit(1).cast("long").alias("times"))
    drawn = replicates.select("subset", F.col("rep").cast("long").alias("rep"), "cluster", F.col("times").cast("long").alias("times")).where("times > 0").unionByName(once)
    by = ("subset", "rep", "method")
    found = recall_at(rate_points(outcomes.join(n, "subset").join(drawn, ["subset", "cluster"]), by, "times"), rates, by)
    theirs = found.where(F.col("method") == reference).select("subset", "rep", "target", F.col("recall").alias("theirs"))
    points = found.join(theirs, ["subset", "rep", "target"], "left").withColumn("diff", F.col("recall") - F.col("theirs"))
    out = []
    for x in ("recall", "diff"):
        drew = F.when(F.col("rep") >= 0, F.col(x))
        out.append(F.max(F.when(F.col("rep") < 0, F.col(x))).alias(x))
        out += [F.when(F.count(drew) >= least, F.percentile(drew, q)).alias(f"{x}_{end}") for end, q in (("lo", 0.025), ("hi", 0.975))]
    made = points.groupBy("subset", "method", "target").agg(*out).join(n, "subset")
    return made.withColumn("verdict", F.when(F.col("method") == reference, "reference").otherwise(verdict(F.col("diff_lo"), F.col("diff_hi"))))


def chance(windows: DataFrame, rates: DataFrame, reps: int, bars_per_day: int = 1440, cooldown: int = 15, ready: int = 310) -> DataFrame:
    """(method, rate, mean, lo, hi): recall of a random alerter at each method's rate of alerts, and the 95 % range over ``reps`` trials.

    ``windows`` has event, first and last, in bars from the start of an event's slice; ``rates`` method and rate. An alerter starts
    at bar ``ready`` plus a random part of the mean gap and waits ``cooldown`` bars and an exponential time more after each alert.
    Trial r of an event takes its k-th number from a hash of (event, r, k), so a method's trials don't depend on the others. Every
    trial is a row; what it goes through is bounded by the bars of a window. Without a positive rate recall is 0.
    """
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", "event", F.col("rep").cast("string"), k.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    gap = bars_per_day / F.col("rate")
    extra = F.greatest(F.lit(1.0), gap - cooldown)
    # Names are few: the rates become an array that each window meets.
    listed = [(r["method"], r["rate"]) for r in rates.select("method", F.col("rate").cast("double").alias("rate")).collect()]
    if not listed:
        return windows.sparkSession.createDataFrame([], "method string, rate double, mean double, lo double, hi double")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(r).cast("double").alias("rate")) for m, r in listed))).alias("m")
    trials = windows.select("event", "first", "last", each, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select("event", "first", "last", "m.method", "m.rate", "rep")
    begin = F.lit(ready) + F.floor(draw(F.lit(0)) * gap)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.col("last") - ready) / (cooldown + 1)) + 2).cast("int"))
    walk = F.aggregate(steps, begin.cast("double"), lambda at, k: F.when(at >= F.col("first"), at).otherwise(at + cooldown + F.ceil(-F.log(1 - draw(k)) * extra)))
    hit = F.when(F.col("rate") > 0, (walk >= F.col("first")) & (walk <= F.col("last"))).otherwise(F.lit(False))
    by_rep = trials.withColumn("hit", hit).groupBy("method", "rate", "rep").agg(F.avg(F.coalesce(F.col("hit"), F.lit(False)).cast("double")).alias("recall"))
    return by_rep.groupBy("method", "rate").agg(F.avg("recall").alias("mean"), F.percentile("recall", 0.025).alias("lo"), F.percentile("recall", 0.975).alias("hi"))


def paired(outcomes: DataFrame, reference: str) -> DataFrame:
    """Difference of recall and of delay to a reference method over the same events."""
    ref = outcomes.where(F.col("method") == reference).select("event", F.col("detected").alias("rd"), F.col("latency_min").alias("rl"))
    both = outcomes.where(F.col("method") != reference).join(ref, "event")
    gap = F.when(F.col("detected") & F.col("rd"), F.col("latency_min") - F.col("rl"))
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("detected").cast("double") - F.col("rd").cast("double")).alias("diff"), F.percentile(gap, 0.5).alias("median_gap_min"))


def bootstrap(values: DataFrame, replicates: DataFrame) -> DataFrame:
    """(est, lo, hi): 2.5 and 97.5 per cent quantiles of the mean over resamples; a table of (rep, cluster, times) says how often each cluster counts."""
    sums = values.groupBy("cluster").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    reps = replicates.join(sums, "cluster").groupBy("rep").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("m"))
    return reps.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")).join(F.broadcast(values.agg(F.avg("x").alias("est"))))


def resamples(clusters: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, rep, cluster, times) of n resamples with replacement, as many draws each as there are clusters (of each ``by``).

    Draw i of a replicate takes the cluster whose place, in order, is a hash of (rep, i) modulo their number. Clusters not drawn
    have no row.
    """
    placed = clusters.select(*by, "cluster").distinct().select(*by, "cluster", (F.row_number().over(Window.partitionBy(*by).orderBy("cluster")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("k"))
    draws = placed.select(*by, "i", "k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    value = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 12), 16, 10).cast("long")
    times = draws.select(*by, "rep", (value % F.col("k")).cast("int").alias("i")).groupBy(*by, "rep", "i").agg(F.count(F.lit(1)).alias("times"))
    return times.join(placed, [*by, "i"]).select(*by, "rep", "cluster", "times")


def study_summary(outcomes: DataFrame, replicates: DataFrame, reference: str, least: int = 20) -> DataFrame:
    """Per method: recall, false alarms a quiet day, median delay, and their differences to the reference, each with 95 % bounds.

    ``outcomes`` has method, event, cluster, detected, latency_min, fa and quiet_days; ``replicates`` (rep, cluster, times) says how
    often each cluster counts. The estimate is a replicate of its own in which each counts once. Delays are compared over the
    events that both methods detect. Replicates without a value are passed over; fewer than ``least`` give no bounds.
    """
    names = ["recall", "rate", "latency", "d_recall", "d_rate", "d_latency"]
    theirs = outcomes.where(F.col("method") == reference).select("event", F.col("detected").cast("double").alias("rd"), F.col("latency_min").alias("rl"), F.col("fa").alias("rf"), F.col("quiet_days").alias("rq"))
    once = outcomes.select("cluster").distinct().select(F.lit(-1).cast("long").alias("rep"), "cluster", F.lit(1).cast("long").alias("times"))
    drawn = replicates.select(F.col("rep").cast("long").alias("rep"), "cluster", F.col("times").cast("long").alias("times")).where("times > 0").unionByName(once)
    rows = outcomes.withColumn("d", F.col("detected").cast("double")).join(theirs, "event").join(drawn, "cluster")
    mean = lambda x: F.sum(F.col("times") * F.col(x)) / F.sum("times")
    ratio = lambda x, y: F.try_divide(F.sum(F.col("times") * F.col(x)), F.sum(F.col("times") * F.col(y)))
    middle = lambda x: F.percentile(x, 0.5, F.col("times"))
    values = [mean("d"), ratio("fa", "quiet_days"), middle(F.col("latency_min")), mean("d") - mean("rd"), ratio("fa", "quiet_days") - ratio("rf", "rq"), middle(F.col("latency_min") - F.col("rl"))]
    points = rows.groupBy("method", "rep").agg(F.count(F.lit(1)).alias("n"), *(v.alias(x) for v, x in zip(values, names)))
    out = []
    for x in names:
        drew = F.when(F.col("rep") >= 0, F.col(x))
        out.append(F.max(F.when(F.col("rep") < 0, F.col(x))).alias(x))
        out += [F.when(F.count(drew) >= least, F.percentile(drew, q)).alias(f"{x}_{end}") for end, q in (("lo", 0.025), ("hi", 0.975))]
    made = points.groupBy("method").agg(F.max(F.when(F.col("rep") < 0, F.col("n"))).alias("n"), *out)
    return made.withColumn("verdict", F.when(F.col("method") == reference, "reference").otherwise(verdict(F.col("d_recall_lo"), F.col("d_recall_hi"))))


def verdict(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high), "n/a").when(low > 0, "higher").when(high < 0, "lower").otherwise("no clear difference")
