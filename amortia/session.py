"""Session construction and shared-folder handling.

On a cluster the session already exists and names its shared checkpoint folder in
``spark.checkpoint.dir``; we only read it. A folder of our own is set only when the
setting is absent (local tests and benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces shuffle output at
# run time, splits skewed join partitions, and converts a sort-merge join to a
# broadcast only when the measured size is under the threshold.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    # Split a hot join partition even where an aggregate above then needs its own exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "amortia", extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("AMORTIA_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _ensure_checkpoint_dir(spark)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    # A folder of this machine serves local runs only; on a cluster the session must name a shared one.
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="amortia-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    return _ensure_checkpoint_dir(spark)


def work_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def durable(df, name: str = "durable"):
    """Cut lineage for a table read several times: write it as Parquet under the shared folder and
    read it back, so later passes prune columns and retries after executor loss start from the
    written copy instead of replaying the plan."""
    spark = df.sparkSession
    path = work_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs that run inside; put back behind them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def open_writers(spark: SparkSession):
    """For writes partitioned by a column of few values: a task keeps a file per value open instead of sorting all its rows by the
    value first (it still sorts from the seventeenth value on)."""
    return settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "16"})


def sized_shuffles(spark: SparkSession, rows: int, task_rows: int = 500_000, task_bytes: str = "16m"):
    """For jobs on whole rows: shuffles of a partition per ``task_rows`` rows (at least the session's number), joined
    up to ``task_bytes`` only, so that a task's memory does not grow with the table."""
    values = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": task_bytes}
    for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"):
        now = spark.conf.get(k, None)
        if now is not None:
            values[k] = str(max(int(now), -(-rows // task_rows)))
    return settings(spark, values)


def ship_package(spark: SparkSession) -> None:
    """Hand this package's code to the executors (once per application), as ``--py-files`` does: tasks that grow or
    walk trees import it."""
    sc = spark.sparkContext
    if getattr(sc, "_amortia_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="amortia-code-"), "amortia_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._amortia_shipped = True
