"""Text drops, archives and missing-value handling."""

import os
import tempfile
import zipfile

import pytest

from amortia.operators import clean
from amortia.sources import archives, text_drops


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_two_files_with_quarter_and_left_join(spark):
    base = tempfile.mkdtemp(prefix="drops-")
    _write(f"{base}/sub/historical_data_time_2020Q1.txt", "L1|202001|1000.5| 0\nL2|202001|2000|RA\nL3|202002||1\n")
    _write(f"{base}/historical_data_2020Q1.TXT", "700||Y\n")  # short line: remaining columns null
    _write(f"{base}/notes.csv", "ignored")
    listing = text_drops.list_text_files(spark, base)
    kinds = sorted((r.kind, r.quarter) for r in listing.collect())
    assert kinds == [("origination", "1"), ("performance", "1")]
    perf, orig = text_drops.load_drop(spark, base)
    rows = {r.loan_sequence_num: r for r in perf.collect()}
    assert rows["L1"].cur_LDS == "0" and rows["L1"].quarter == "1"   # leading blank skipped
    assert rows["L3"].cur_actual_UPB is None
    j = clean.join_loans(perf, orig)
    assert j.count() == 3


def test_missing_kind_and_missing_quarter_fail(spark):
    base = tempfile.mkdtemp(prefix="drops-")
    _write(f"{base}/historical_data_time_2020Q2.txt", "L1|202001\n")
    with pytest.raises(ValueError, match="both"):
        text_drops.load_drop(spark, base)
    _write(f"{base}/historical_data_2020.txt", "700\n")
    with pytest.raises(ValueError, match="Q1"):
        text_drops.load_drop(spark, base)


def test_missing_markers_and_nan_become_null(spark):
    df = spark.createDataFrame([("NA", float("nan")), ("x", 1.0), ("null", 2.0)], "s string, d double")
    rows = text_drops.normalize_missing(df).collect()
    assert [r.s for r in rows] == [None, "x", None]
    assert rows[0].d is None


def test_zip_archive_entries(spark):
    base = tempfile.mkdtemp(prefix="zips-")
    with zipfile.ZipFile(f"{base}/drop.zip", "w") as zf:
        zf.writestr("Q1_data.txt", "12345|100000|3.5\n")
        zf.writestr("inner/historical_data_time_2021Q3.txt", "A|202101|10\nB|202101|20\n")
    lines = archives.archive_lines(spark, base)
    schema = "loan_sequence_num string, monthly_reporting_period double, cur_actual_UPB double"
    from pyspark.sql.types import _parse_datatype_string
    parsed = archives.parse_archive_entries(lines, _parse_datatype_string(schema))
    got = sorted((r.loan_sequence_num, r.quarter, r.cur_actual_UPB) for r in parsed.collect())
    assert got == [("12345", "1", 3.5), ("A", "3", 10.0), ("B", "3", 20.0)]


def test_dedup_first_is_keyed_and_deterministic(spark):
    df = spark.createDataFrame([("L", "1", 202003.0, "k3", 3.0), ("L", "1", 202001.0, "k9", 1.0),
                                ("L", "1", 202001.0, "k2", 2.0), ("M", "2", None, "k1", 4.0)],
                               "loan_sequence_num string, quarter string, monthly_reporting_period double, "
                               "row_key string, v double")
    got = {r.loan_sequence_num: r.v for r in clean.dedup_first(df).collect()}
    assert got == {"L": 2.0, "M": 4.0}


def test_sentinel_filter_keeps_null_and_drops_codes(spark):
    df = spark.createDataFrame([(9999.0, 20.0, 1.0, "R"), (None, 20.0, None, "R"), (700.0, 20.0, 9.0, "R"),
                                (700.0, 20.0, 1.0, "9")],
                               "credit_score double, ori_DTI double, property_valuation_method double, channel string")
    assert clean.sentinel_filter(df).count() == 1
    assert clean.sentinel_filter(df, strict_reference=True).count() == 2


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="required"):
        clean.require_columns(df, ["a", "c"])


def test_ledger_open_close_and_state(spark):
    import datetime as dt
    from amortia.operators import ledger
    root = tempfile.mkdtemp(prefix="ledger-")
    t0 = dt.datetime(2025, 7, 1, 16, 30, 15)
    v = ledger.open_run(spark, root, 1, "drop.zip", t0)
    assert v.startswith("20250701_163015_")
    ledger.close_run(spark, root, v, False, "evaluation-20250701.json", t0 + dt.timedelta(minutes=5))
    ledger.record_scoring(spark, root, 1, "predictions.csv", t0)
    ev = ledger.read_events(spark, root)
    runs = ledger.runs_view(ev).collect()
    assert len(runs) == 1
    r = runs[0]
    assert (r.model_status, r.run_status, r.file_name) == ("failed", "completed", "evaluation-20250701.json")
    # a run that ended in an error is closed as failed
    v2 = ledger.open_run(spark, root, 1, "drop2.zip", t0 + dt.timedelta(hours=1))
    ledger.close_run(spark, root, v2, None, None, t0 + dt.timedelta(hours=2))
    st = {x.version: x.run_status for x in ledger.runs_view(ledger.read_events(spark, root)).collect()}
    assert st[v2] == "failed"


def test_malformed_lines_are_quarantined(spark):
    base = tempfile.mkdtemp(prefix="bad-")
    pad = "|" * 29   # 32 fields per line, as in the published layout
    _write(f"{base}/historical_data_time_2020Q1.txt", f"L1|202001|1000{pad}\nL2|notanumber|5{pad}\n")
    from amortia.schemas import PERFORMANCE_SCHEMA
    df = text_drops.scan_pipe(spark, [f"{base}/historical_data_time_2020Q1.txt"], PERFORMANCE_SCHEMA, base,
                              keep_corrupt=True)
    good, bad = text_drops.split_corrupt(df.cache())
    assert [r.loan_sequence_num for r in good.collect()] == ["L1"]
    assert [r.loan_sequence_num for r in bad.collect()] == ["L2"]


def test_dedup_first_without_row_id_is_deterministic(spark):
    rows = [("L", "1", 202001.0, 5.0, "b"), ("L", "1", 202001.0, 3.0, "a"), ("L", "1", 202002.0, 1.0, "c")]
    df = spark.createDataFrame(rows, "loan_sequence_num string, quarter string, monthly_reporting_period double, "
                                     "v double, w string")
    a = clean.dedup_first(df).collect()
    b = clean.dedup_first(df.repartition(3)).collect()
    assert a == b and (a[0].v, a[0].w) == (3.0, "a")   # earliest period, then smallest remaining values


def test_model_contract_requires_features(spark):
    from amortia.plans.scoring import LoanModel
    df = spark.createDataFrame([("L1", "1")], "loan_sequence_num string, quarter string")
    with pytest.raises(ValueError, match="required"):
        LoanModel(spark, "/nonexistent").infer(df)
