"""Corpus pipeline over ``documents``: quality rules, line de-duplication, near-duplicates, benchmark decontamination,
byte-level BPE.

STAGES holds ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and reread as the next one's ``docs``. All but the last return the columns of ``documents``. Rules and
de-duplication come before decontamination and encoding, so the dearer stages see fewer rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amortia.llm import bpe, decontam, line_templates, near_dup, quality
from amortia.llm.common import table
from amortia.llm.queries import vocabulary_path
from amortia.session import work_path

# Near-duplicate components and BPE ids are not expressible in SQL; tests compare run() with a plain-Python version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside their source's thresholds go."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut out of the texts; ``n_chars`` follows the text."""
    out = line_templates.drop_recurring_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8) stays."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter one) go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text that is left, with digests of ids and decoded text."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("bpe_encode_decode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
