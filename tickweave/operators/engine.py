"""Spark wrappers that run a state machine over each symbol's bars in time order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .._ship import ship
from .steps import methods
from .windows import numbered

SCORES = "symbol string, method string, t long, ready boolean, score double, alert boolean"
OUTPUT = "symbol string, t long, ready boolean, p double, score double, threshold double, alert boolean, detectors array<struct<name:string,raw:double,feature:double,contribution:double,imputed:boolean>>"


def fold(rows: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, keys: tuple[str, ...] = ("symbol",), order: str = "t") -> DataFrame:
    """For each key, ``make()`` gives a function that takes the rows one by one in order and returns each row's output.

    Rows stream through in Arrow batches of sorted partitions, so a key's rows are never held together. The number of partitions
    is stated, as keys cost far more time than their bytes show, by which small partitions would be put into one task.
    """
    ship(rows.sparkSession)
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def plain(column: pa.Array) -> pa.Array:
        return pc.if_else(pc.is_nan(column), None, column) if pa.types.is_floating(column.type) else column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            out = []
            for r in pa.RecordBatch.from_arrays([plain(c) for c in batch.columns], names=batch.schema.names).to_pylist():
                own = tuple(r[k] for k in keys)
                if own != key or step is None:
                    key, step = own, make()
                out.append({**r, **step(r)})
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *map(F.col, keys)).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def engine(bars: DataFrame, **settings) -> DataFrame:
    """Full output of the fixed engine for every bar."""
    from .steps import Engine, EngineParams

    return fold(bars, lambda: Engine(EngineParams(**settings)).update, OUTPUT)


def weight_series(bars: DataFrame, every: int = 10, **settings) -> DataFrame:
    """(symbol, t, names, w, b): the learning engine's weights after each ``every``-th bar of a symbol."""
    from .steps import Engine, EngineParams

    def make():
        run, seen = Engine(EngineParams(**{"learn": True, **settings})), [0]

        def step(bar: dict) -> dict:
            run.update(bar)
            seen[0] += 1
            return {"told": seen[0] % every == 0, **run.weights()}

        return step

    return fold(bars, make, "symbol string, t long, told boolean, names array<string>, w array<double>, b double").where("told").drop("told")


def score_series(bars: DataFrame, names: list[str], **settings) -> DataFrame:
    """(symbol, method, idx, t, score) of the bars at which a method is ready; ``idx`` numbers a symbol's bars from 0."""
    return run_methods(numbered(bars), names, keep=("idx",), **settings).where("ready").select("symbol", "method", "idx", "t", "score")


def run_methods(bars: DataFrame, names: list[str], keep: tuple[str, ...] = (), custom: dict | None = None, **settings) -> DataFrame:
    """Scores and alerts of several methods: bars meet the list of names, and each (symbol, method) is a run of its own.

    ``custom`` adds methods of the caller's own by name: anything that makes an object with update(bar). ``keep`` names long
    columns that come along.
    """
    made = bars.withColumn("method", F.explode(F.array(*map(F.lit, names))))
    ship(bars.sparkSession)

    def make():
        held = {}

        def step(r: dict) -> dict:
            if "run" not in held:
                held["run"] = (methods(**settings) | (custom or {}))[r["method"]]()
            return held["run"].update(r)

        return step

    return fold(made, make, ", ".join((SCORES, *(f"{c} long" for c in keep))), ("symbol", "method"))
