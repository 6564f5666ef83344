"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str | None = None, name: str = "lakescope", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_scopes: list[str] = []


def is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "local").startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), f"lakescope-{os.getpid()}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the folder of the innermost scope."""
    base = _scopes[-1] if _scopes else shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Survives lost executors, and unlike a checkpoint the result carries its true
    size, so later joins are planned well even in loops. What the write shuffled is
    deleted at its end, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    with conf_set(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Rows go to Python workers in batches of about ``most`` bytes, unless the session names a bound itself.

    Spark's own bound is 64 MB, in buffers that double as they fill, for each task and
    worker; what whole texts take of it stays with the executor's processes. The bound is
    read when a result is computed, so it stays set for results that are computed later.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)


@contextmanager
def conf_set(spark: SparkSession, **settings: str):
    """Temporarily change runtime SQL settings (keys with ``__`` for dots)."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch_scope(spark: SparkSession):
    """A folder of its own below the shared one for all intermediate tables written inside.

    It is deleted at the end, so results must be written or collected before.
    """
    path = scratch_path(spark, "scope")
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
