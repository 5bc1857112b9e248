"""Results out: JSON, Markdown, message tables, alert channels."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGES = ("status", "bar", "forming", "backfill", "alert", "contagion", "weights", "metrics", "error")


def write_summary(rows: DataFrame, config: dict, path: str) -> None:
    """One JSON object a row, with the configuration beside it."""
    rows.withColumn("config", F.lit(json.dumps(config, sort_keys=True))).write.mode("overwrite").json(path)


def number(x: float | None, digits: int = 2) -> str:
    return "n/a" if x is None or math.isnan(x) else f"{x:.{digits}f}"


def interval(est: float | None, low: float | None, high: float | None, digits: int = 2) -> str:
    return "n/a" if est is None or math.isnan(est) else f"{number(est, digits)} [{number(low, digits)}, {number(high, digits)}]"


def markdown(rows: list[dict], columns: list[str], title: str = "") -> str:
    """A table of a small result."""
    show = lambda v: number(v) if isinstance(v, float) else "n/a" if v is None else str(v)
    lines = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *(f"| {' | '.join(show(r.get(c)) for c in columns)} |" for r in rows)]
    return "\n".join(([f"# {title}", ""] if title else []) + lines) + "\n"


def events_document(picks: DataFrame, value: str = "range_pct") -> DataFrame:
    """(value): one JSON document of chosen days: an event for each, with its window, and how many days each symbol has.

    ``picks`` has symbol, day (since 1970) and the number it was chosen by. A document is small: a choice of days, not the days.
    """
    stamp = lambda day: F.date_format(F.timestamp_millis(day * 86_400_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")), "yyyy-MM-dd")
    name = F.concat_ws("-", "symbol", date)
    item = F.struct(name.alias("id"), name.alias("name"), "symbol", date.alias("date"), stamp(F.col("day")).alias("start"), stamp(F.col("day") + 1).alias("end"), F.round(value, 2).alias("rangePct"))
    by_symbol = picks.groupBy("symbol").agg(F.sort_array(F.collect_list(item)).alias("e"), F.count(F.lit(1)).alias("n"))
    meta = F.struct(F.lit("largest daily ranges, apart from each other").alias("rule"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "n")))).alias("selected"))
    return by_symbol.agg(F.to_json(F.struct(meta.alias("_meta"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("symbol", "e"))), lambda x: x["e"])).alias("events"))).alias("value"))


def write_events(picks: DataFrame, path: str) -> None:
    """The document of ``events_document`` as a text file."""
    events_document(picks).coalesce(1).write.mode("overwrite").text(path)


def replay_report(rows: list[dict], title: str = "Replay") -> str:
    """Markdown of ``evaluate.replay``: a row per method."""
    names = ["method", "alerts", "in_window", "false_alarms", "detected", "recall", "precision", "median_delay_min"]
    return markdown(sorted(rows, key=lambda r: r["method"]), names, title)


def _with_bounds(r: dict, x: str, digits: int = 2) -> str:
    return interval(r.get(x), r.get(f"{x}_lo"), r.get(f"{x}_hi"), digits)


def study_report(rows: list[dict], events: list[dict], excluded: list[dict], config_hash: str, title: str = "Study") -> str:
    """Markdown of ``evaluate.study_summary`` with chance and skill, of the events used and of those left out with their reasons."""
    rows = sorted(rows, key=lambda r: r["method"])
    own = [{"method": r["method"], "recall": _with_bounds(r, "recall"), "chance": interval(r.get("chance"), r.get("chance_lo"), r.get("chance_hi")), "skill": number(r.get("skill")), "false alarms a day": _with_bounds(r, "rate"), "median delay (min)": _with_bounds(r, "latency", 0)} for r in rows]
    gaps = [{"method": r["method"], "recall": f"{_with_bounds(r, 'd_recall')} ({r['verdict']})", "false alarms a day": _with_bounds(r, "d_rate"), "delay (min)": _with_bounds(r, "d_latency", 0)} for r in rows if r["verdict"] != "reference"]
    parts = [f"# {title}\n\nConfiguration `{config_hash[:12]}`; {len(events)} events used, {len(excluded)} left out.\n", "## Methods\n", markdown(own, list(own[0]) if own else ["method"])]
    parts += ["## Differences to the reference\n", markdown(gaps, list(gaps[0]) if gaps else ["method"]), "## Events\n", markdown(events, ["event", "onset"])]
    return "\n".join([*parts, *(["## Left out\n", markdown(excluded, ["event", "reason"])] if excluded else [])])


def subset_report(rows: list[dict], counts: dict[str, int], config_hash: str, title: str = "Subsets") -> str:
    """Markdown of ``evaluate.subset_summary``: a table per subset, after the counts of events."""
    parts = [f"# {title}\n\nConfiguration `{config_hash[:12]}`.\n", markdown([{"count": k, "n": v} for k, v in counts.items()], ["count", "n"])]
    for name in sorted({r["subset"] for r in rows}):
        mine = [{"method": r["method"], "alerts a day": r["target"], "recall": _with_bounds(r, "recall"), "difference": f"{_with_bounds(r, 'diff')} ({r['verdict']})"} for r in sorted(rows, key=lambda r: (r["method"], r["target"])) if r["subset"] == name]
        parts += [f"## {name}\n", markdown(mine, list(mine[0]))]
    return "\n".join(parts)


def event_matrix(outcomes: DataFrame, methods: list[str]) -> DataFrame:
    """A row per event, a column per method: the delay, or null if it was not detected."""
    return outcomes.groupBy("event").pivot("method", methods).agg(F.max(F.when(F.col("detected"), F.col("latency_min"))))


def fan_out(kinds: list[str], base: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each kind of message to a folder of its own; a batch that is repeated overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind in kinds:
            batch.where(F.col("kind") == kind).write.mode("overwrite").parquet(f"{base}/{kind}/batch={number}")
        batch.unpersist()

    return write


def notify(send: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a message per alert row, sent from the executors' results one by one."""

    def write(batch: DataFrame, number: int) -> None:
        for r in batch.select("message").toLocalIterator():
            send(r["message"])

    return write


def latest(rows: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",), order: str = "t") -> DataFrame:
    """The n newest rows of each key."""
    from pyspark.sql import Window

    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("rn") <= n).drop("rn")
