"""Sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What queries rely on: UTC, errors instead of silent nulls, maps in which the last of equal keys wins, and JSON
#: objects that may repeat a key.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
#: What large inputs rely on: plans adapt to the sizes that stages turn out to have, skewed joins are split.
SCALE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """The running session with the engine's settings, or a new one. ``conf`` uses __ for dots and wins."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTICS, **SCALE, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Set the engine's semantics on a session that someone else built."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession | None = None) -> None:
    """Send this package's sources to the executors, once for a context, so that workers can import it anywhere."""
    spark = spark or SparkSession.active()
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root).as_posix()}")
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / f"{root.name}.zip"
    target.write_bytes(body.getvalue())
    sc.addPyFile(str(target))
    sc._millrace_shipped = True
