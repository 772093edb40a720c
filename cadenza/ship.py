"""Sends this package to the executors, so that Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()
#: Rows of an Arrow batch: documents are long rows, and a batch is held several times over.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2048")


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip to the session's context, once for each context; an Arrow batch size
    that is still the default becomes one for long rows."""
    sc = spark.sparkContext
    name, default, better = _BATCH
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, better)
    if sc.applicationId not in _DONE:
        home = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="cadenza-ship-"), "cadenza.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(home.rglob("*.py")):
                out.write(source, source.relative_to(home.parent))
        sc.addPyFile(target)
        _DONE.add(sc.applicationId)
    return spark
