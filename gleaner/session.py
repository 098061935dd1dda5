"""Session defaults, and shipping the package to executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch that goes to a Python worker: rows of long texts must not be counted, but weighed.
BATCH_BYTES = 8 << 20
_BYTES_KEY, _BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def session(name: str = "gleaner", **conf: str) -> SparkSession:
    """A session with the defaults the operators are written for: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python functions run there
    wherever the driver found it. Arrow batches are bounded in bytes, unless the session says how."""
    if spark.conf.get(_BYTES_KEY, _BYTES_DEFAULT) in (None, _BYTES_DEFAULT):
        spark.conf.set(_BYTES_KEY, f"{BATCH_BYTES}b")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gleaner-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    clean = Path(folder) / "src" / package.name
    shutil.copytree(package, clean, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder) / "gleaner"), "zip", clean.parent))
    _shipped.add(context.applicationId)
