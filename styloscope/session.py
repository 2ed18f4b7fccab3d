"""Spark session and shared-storage helpers.

Every job reads its scratch location from ``spark.checkpoint.dir`` (the shared folder a cluster
names); a local default is set only on a local master whose session has none, as in tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    # Recording a call site for every Column operation walks the Python stack and calls the JVM four times, which for a
    # generated projection of some hundred columns takes longer than the query. The setting is static: only who builds a
    # session can give it, and queries run with either value.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Make sure that a shared checkpoint folder is known; the caller's SQL settings stay as they are."""
    ensure_checkpoint_dir(spark)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A SQL setting for the jobs run inside the block; the caller's value is restored after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For tables that several branches of a query read: they are computed once, lineage is cut, and a lost executor
    costs a re-read. Constraint propagation is off meanwhile, as it explodes on wide generated projections.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, "spark.sql.constraintPropagation.enabled", "false"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "styloscope") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. A local one is set only on a local master that has none (tests, bench);
    on a cluster a missing setting is an error, since executors do not share the driver's folders."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current and not spark.conf.get("spark.master", "unknown").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="styloscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 -- no SparkContext (e.g. a remote session): the SQL conf is enough
        pass
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
