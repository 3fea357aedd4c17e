"""Sinks and state tables.

* Prepared loan table: Parquet partitioned by quarter (later reads prune partitions).
* Train / val / test: one table partitioned by ``split`` instead of three files.
* Predictions: CSV with header ``loan_sequence_number,target`` in a time-stamped folder.
* Evaluation document: one JSON row.
* Encoder categories and scaler bounds: small Parquet state tables, read back by batch
  scoring and by the stream.

Writes go to paths under the shared folder the session names (``spark.checkpoint.dir``)
unless a path is given; a job that is re-run after executor loss overwrites its own output.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amortia.schemas import SOURCE_NAMES
from amortia.session import open_writers, work_path


def fresh_path(spark: SparkSession, name: str) -> str:
    return work_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def write_prepared(df: DataFrame, path: str) -> str:
    """A10: prepared loan table partitioned by quarter."""
    with open_writers(df.sparkSession):
        df.write.mode("overwrite").partitionBy("quarter").parquet(path)
    return path


def write_splits(df: DataFrame, path: str) -> str:
    """A11: one table with a ``split`` column, partitioned by it."""
    with open_writers(df.sparkSession):
        df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A9: Parquet scan (filters and projections reach the files)."""
    return spark.read.parquet(path)


def write_predictions_csv(pred: DataFrame, out_root: str, when: dt.datetime | None = None,
                          id_col: str = "loan_sequence_num", target_col: str = "target") -> str:
    """A12: ``loan_sequence_number,target`` with a header, folder named with a timestamp.
    Written in parallel: every part file carries the header (read back with
    ``header=true``); nothing is funnelled through a single task."""
    when = when or dt.datetime.utcnow()
    path = f"{out_root.rstrip('/')}/predictions_{when:%Y%m%d_%H%M%S}"
    (pred.select(F.col(id_col).alias("loan_sequence_number"), F.col(target_col).alias("target"))
         .write.mode("overwrite").option("header", "true").csv(path))
    return path


def write_json_document(doc: DataFrame, out_root: str, when: dt.datetime | None = None) -> str:
    """A13: evaluation document as ``evaluation-YYYYMMDD`` JSON (one row)."""
    when = when or dt.datetime.utcnow()
    path = f"{out_root.rstrip('/')}/evaluation-{when:%Y%m%d}"
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def save_state(df: DataFrame, path: str) -> str:
    """A14 / A15: persist a small state table (categories or bounds)."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_source_names(df: DataFrame) -> DataFrame:
    """Rename columns back to the published layout's names (``MI(%)`` etc.) for sinks."""
    return df.select(*[F.col(c).alias(SOURCE_NAMES.get(c, c)) for c in df.columns])
