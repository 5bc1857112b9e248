"""Makes the package importable in Python workers that were started without it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the session's workers, once a session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    # Workers on this machine, those of streaming queries' planners among them, take it from here.
    paths = [str(top.parent), *context.environment.get("PYTHONPATH", "").split(":")]
    context.environment["PYTHONPATH"] = ":".join(dict.fromkeys(p for p in paths if p))
    target = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
