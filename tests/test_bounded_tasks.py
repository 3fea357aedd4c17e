"""Tasks whose memory, files and rankings do not grow with the table."""

import hashlib
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from amortia.operators import clean, profile
from amortia.session import sized_shuffles
from amortia.sources import archives, sinks, text_drops

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def slow_samples(rows, columns, n):
    out = []
    for c in columns:
        found = sorted((hashlib.md5("|".join(x for x in ("42", c, r["row_key"]) if x is not None).encode()).hexdigest(), str(r[c]))
                       for r in rows if r[c] is not None)
        out += [(c, i + 1, v) for i, (_, v) in enumerate(found[:n])]
    return sorted(out)


def test_column_samples_rank_few_rows(spark, monkeypatch):
    df = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("row_key"), F.col("id").cast("string").alias("a"),
                                  F.when(F.col("id") % 1999 == 0, F.col("id").cast("string")).alias("b"), F.lit(None).cast("string").alias("c"))
    ranked, real = [], profile.top_k_per_group
    monkeypatch.setattr(profile, "top_k_per_group", lambda d, *a: ranked.append(d.count()) or real(d, *a))
    got = sorted(tuple(r) for r in profile.column_samples(df, ["a", "b", "c"], "row_key", 5).collect())
    assert got == slow_samples(df.collect(), ["a", "b", "c"], 5)
    assert ranked[0] < 1000  # of 6,004 values


def test_column_samples_of_repeated_row_ids(spark):
    # one id for nearly all rows: its hash may be above the bound, then all rows are ranked
    ids = F.when(F.col("id") < 3, F.concat(F.lit("k"), "id")).when(F.col("id") < 2000, F.lit("same"))
    df = spark.range(3000).select(ids.alias("row_key"), F.lit("x").alias("a"), F.lit("y").alias("b"), F.lit("z").alias("row"))
    got = sorted(tuple(r) for r in profile.column_samples(df, ["a", "b", "row"], "row_key", 5).collect())
    assert got == slow_samples(df.collect(), ["a", "b", "row"], 5)


def test_one_archive_per_task_and_quarter(spark):
    base = tempfile.mkdtemp(prefix="zips-")
    df = spark.range(0, 100, 1, 1).select(F.concat(F.lit("line "), "id").alias("value"), (F.col("id") % 2 + 1).cast("string").alias("quarter"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        written = archives.write_zip_drops(df, base, "drop_2020", 20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(r["rows"] for r in written) == [50, 50]
    assert [len(zipfile.ZipFile(r["path"]).namelist()) for r in written] == [3, 3]
    got = archives.archive_lines(spark, base).select("line", F.regexp_extract("entry", "Q([1-4])", 1).alias("q"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_rows_without_quarter_are_not_published(spark):
    df = spark.createDataFrame([("a", "1"), ("b", None)], "value string, quarter string")
    with pytest.raises(Exception, match="rows without a quarter"):
        archives.write_zip_drops(df, tempfile.mkdtemp(prefix="zips-"), "drop_2020").collect()


class Probe:
    """Stands for a table: notes the setting at the time of its write."""

    def __init__(self, spark):
        self.sparkSession, self.columns, self.seen = spark, [], None

    def __getattr__(self, name):
        if name in ("parquet", "text"):
            return lambda path: setattr(self, "seen", self.sparkSession.conf.get(WRITERS))
        return self if name == "write" else lambda *a: self


@pytest.mark.parametrize("write", [sinks.write_prepared, sinks.write_splits, lambda df, path: text_drops.write_text_drop(df, path, "performance")])
def test_partitioned_writes_do_not_sort_a_task(spark, write):
    before, df = spark.conf.get(WRITERS), Probe(spark)
    write(df, "/nowhere")
    assert int(df.seen) >= 4 and spark.conf.get(WRITERS) == before


@pytest.mark.parametrize("work", [clean.dedup_rows, profile.duplicate_count])
def test_whole_rows_are_shuffled_in_bounded_parts(spark, monkeypatch, work):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a"), (2, "a")], "a int, b string")
    seen = []
    for m in (clean, profile):
        monkeypatch.setattr(m, "durable", lambda d, name, real=m.durable: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or real(d, name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert sorted(map(str, work(df, 60_000_000).collect())) == sorted(map(str, work(df).collect()))
    assert seen == [120] and spark.conf.get("spark.sql.shuffle.partitions") == before
    with sized_shuffles(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
