"""Sinks: predictions CSV layout, evaluation JSON, state tables, partitioned Parquet."""

import datetime as dt
import glob
import os
import tempfile

from pyspark.sql import functions as F

from amortia.schemas import SOURCE_NAMES
from amortia.sources import sinks


def test_predictions_csv_header_and_name(spark):
    root = tempfile.mkdtemp(prefix="pred-")
    df = spark.createDataFrame([("L1", True), ("L2", False)], "loan_sequence_num string, target boolean")
    path = sinks.write_predictions_csv(df, root, dt.datetime(2025, 7, 1, 16, 30, 15))
    assert path.endswith("predictions_20250701_163015")
    rows = []
    for f in sorted(glob.glob(os.path.join(path, "part-*.csv"))):
        lines = open(f).read().splitlines()
        assert lines[0] == "loan_sequence_number,target"   # every part file carries the header
        rows += lines[1:]
    assert sorted(rows) == ["L1,true", "L2,false"]


def test_json_document_and_state_round_trip(spark):
    root = tempfile.mkdtemp(prefix="doc-")
    doc = spark.range(1).select(F.struct(F.lit("m").alias("model_name"), F.lit(False).alias("should_update_model"))
                                .alias("metadata"))
    path = sinks.write_json_document(doc, root, dt.datetime(2025, 6, 13))
    assert path.endswith("evaluation-20250613")
    back = spark.read.json(path).first()
    assert back.metadata.model_name == "m" and back.metadata.should_update_model is False
    st = spark.createDataFrame([("ELTV", 1.0, 998.0)], "column_name string, min double, max double")
    sinks.save_state(st, f"{root}/scaling_state")
    assert sinks.load_state(spark, f"{root}/scaling_state").collect() == st.collect()


def test_partitioned_prepared_table_and_source_names(spark):
    root = tempfile.mkdtemp(prefix="prep-")
    df = spark.createDataFrame([("1", 700.0, 5.0), ("2", 710.0, 0.0)], "quarter string, credit_score double, mi_pct double")
    sinks.write_prepared(df, f"{root}/prepared")
    assert sorted(os.listdir(f"{root}/prepared"))[:2] == ["_SUCCESS", "quarter=1"] or \
        "quarter=1" in os.listdir(f"{root}/prepared")
    back = sinks.read_table(spark, f"{root}/prepared").filter(F.col("quarter") == 2)
    assert back.count() == 1
    renamed = sinks.with_source_names(df)
    assert SOURCE_NAMES["mi_pct"] in renamed.columns
