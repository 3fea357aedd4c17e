"""Loan tables written once in buckets of (loan, quarter), so that later joins and keep-first need no shuffle.

Performance and origination rows are hashed to the same number of buckets and sorted inside; Spark then joins
bucket with bucket, and aggregates by the keys, without an exchange. One shuffle is paid when the tables are
written, none by the queries on them.

A bucket is one task, so a loan with very many rows must not sit in one: loans with more than ``1 / HOT_LOANS``
of all performance rows (there are fewer than ``HOT_LOANS`` of these) are written to a side table without buckets.
Its rows are spread over as many tasks as its size asks for, and its origination rows (at most those few loans
times four quarters, when a loan has one row a quarter; their number is checked) are broadcast to them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amortia.operators import clean
from amortia.session import work_path

HOT_LOANS = 1000
KEYS = ("loan_sequence_num", "quarter")


def _write(df: DataFrame, name: str, buckets: int) -> None:
    spark = df.sparkSession
    # the writer's hash is the shuffle's: one file per bucket
    (df.repartition(buckets, *KEYS).write.mode("overwrite").option("path", work_path(spark, name)).bucketBy(buckets, *KEYS).sortBy(*KEYS)
       .format("parquet").saveAsTable(name))


@dataclass
class LoanTables:
    """Written loan tables: ``name``_performance and ``name``_origination in buckets, ``name``_hot beside them."""
    spark: SparkSession
    name: str

    @classmethod
    def write(cls, performance: DataFrame, origination: DataFrame, buckets: int, name: str | None = None) -> "LoanTables":
        spark = performance.sparkSession
        name = name or f"loans_{uuid.uuid4().hex[:12]}"
        per_loan = performance.groupBy("loan_sequence_num").agg(F.count(F.lit(1)).alias("n"))
        total = performance.count()
        hot = per_loan.filter((F.col("n") * HOT_LOANS > total) & (F.col("n") > 10_000)).select("loan_sequence_num")
        hot_path = work_path(spark, f"{name}_hot_loans")
        hot.write.mode("overwrite").parquet(hot_path)
        few = F.broadcast(spark.read.parquet(hot_path))  # fewer than HOT_LOANS rows by the filter
        performance.join(few, "loan_sequence_num", "left_semi").write.mode("overwrite").option(
            "path", work_path(spark, f"{name}_hot")).format("parquet").saveAsTable(f"{name}_hot")
        _write(performance.join(few, "loan_sequence_num", "left_anti"), f"{name}_performance", buckets)
        _write(origination, f"{name}_origination", buckets)
        return cls(spark, name)

    @property
    def performance(self) -> DataFrame:
        return self.spark.table(f"{self.name}_performance")

    @property
    def hot(self) -> DataFrame:
        return self.spark.table(f"{self.name}_hot")

    @property
    def origination(self) -> DataFrame:
        return self.spark.table(f"{self.name}_origination")

    def _hot_origination(self) -> DataFrame:
        loans = self.spark.read.parquet(work_path(self.spark, f"{self.name}_hot_loans"))
        rows = self.origination.join(F.broadcast(loans), "loan_sequence_num", "left_semi")
        return F.broadcast(rows) if rows.count() <= 4 * HOT_LOANS else rows

    def joined(self) -> DataFrame:
        """Performance with its origination on (loan, quarter)."""
        main = clean.join_loans(self.performance, self.origination)
        if self.hot.isEmpty():
            return main
        return main.unionByName(clean.join_loans(self.hot, self._hot_origination()))

    def first_months(self, columns: list[str]) -> DataFrame:
        """The first month of each loan and quarter (``clean.dedup_first`` over ``columns``), with its origination."""
        cols = [*KEYS, *[c for c in columns if c not in KEYS]]
        main = clean.join_loans(clean.dedup_first(self.performance.select(*cols)), self.origination)
        if self.hot.isEmpty():
            return main
        return main.unionByName(clean.join_loans(clean.dedup_first(self.hot.select(*cols)), self._hot_origination()))
