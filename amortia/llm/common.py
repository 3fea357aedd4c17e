"""Helpers shared by the operators: input tables, written intermediate tables, row keys."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amortia.session import work_path

#: A side is broadcast by hint only when it was counted first and has at most this many rows
#: (narrow rows of fixed width, or words of benchmark items).
BROADCAST_ROWS = 500_000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bounds of what one Arrow batch brings into a Python worker (texts and sets vary much in length).
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
ARROW_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}


def ship(spark: SparkSession) -> None:
    """Prepare Python tasks: bound Arrow batches (where the session has not set them) and hand this package's code to
    the executors (once per application), as ``--py-files`` does."""
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) in (None, ARROW_DEFAULTS.get(key), str((1 << 31) - 1), str((1 << 63) - 1)):
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if getattr(sc, "_amortia_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="amortia-code-"), "amortia_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._amortia_shipped = True


def give_back() -> None:
    """Return freed memory to the system (inside tasks): an idle Python worker keeps it for a minute otherwise, beside the
    next stage's. Where the C library has no ``malloc_trim``, Arrow's part only."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: later passes and
    retries after a lost executor start from the written copy."""
    spark = df.sparkSession
    path = work_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a written table whose counted size is bounded; otherwise left to the
    planner (shuffled join, split by AQE when skewed)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text):
    """64-bit content key (null text has its own)."""
    return F.xxhash64(text)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c
                                       for c, t in zip(columns, schema.types)], schema=schema)
