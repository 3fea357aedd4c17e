"""Queries: profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from amortia.operators import clean, profile
from amortia.plans.catalog import JOINED_CTE, region_case_sql, register, standin, with_views
from amortia.plans.q_core import joined
from amortia.schemas import LABELS_OCCUPANCY

PO = ["performance", "origination"]

# Columns of the joined stand-in with the Spark type names they carry.
JOINED_TYPES = [
    ("loan_sequence_num", "string"), ("quarter", "string"), ("monthly_reporting_period", "int"),
    ("row_key", "string"), ("cur_actual_UPB", "double"), ("cur_LDS", "string"), ("loan_age", "double"),
    ("cur_int_rate", "double"), ("cur_deferred_UPB", "double"), ("ELTV", "double"),
    ("credit_score", "double"), ("first_time_homebuyer", "string"), ("mi_pct", "double"),
    ("num_of_units", "double"), ("occupancy_status", "string"), ("ori_DTI", "double"), ("ori_UPB", "double"),
    ("channel", "string"), ("property_state", "string"), ("property_type", "string"),
    ("loan_purpose", "string"), ("num_borrowers", "double"), ("property_valuation_method", "double"),
]
NUMERIC = [c for c, t in JOINED_TYPES if t in ("int", "double")]
TEXT = [c for c, t in JOINED_TYPES if t == "string"]
SHARE_COLS = ["first_time_homebuyer", "occupancy_status", "channel", "property_state", "property_type",
              "loan_purpose", "quarter", "property_valuation_method"]
SAMPLE_COLS = ["quarter", "cur_LDS", "first_time_homebuyer", "occupancy_status", "channel",
               "property_state", "property_type", "loan_purpose"]
LDS_ORDER = ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "RA"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _coverage_rows() -> str:
    return _union([f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS total_rows, "
                   f"round(count({c}) / count(*), 6) AS coverage_ratio, count(DISTINCT {c}) AS num_unique_values "
                   f"FROM joined" for c, t in JOINED_TYPES])


@register("coverage_profile", with_views(PO, JOINED_CTE, f"""
SELECT * FROM ({_coverage_rows()}) t WHERE coverage_ratio >= 0.7"""))
def coverage_profile(spark, sf_dir):
    return profile.coverage_profile(joined(spark, sf_dir), 0.7)


def _sample_rows() -> str:
    return _union([f"""SELECT '{c}' AS column_name, list(v ORDER BY h, v) AS samples FROM (SELECT {f"printf('%.6f', {c})" if t == 'double' else f'CAST({c} AS VARCHAR)'} AS v,
        md5('42|' || coalesce(row_key, '')) AS h FROM joined WHERE {c} IS NOT NULL ORDER BY h, v LIMIT 5) s""" for c, t in JOINED_TYPES])


@register("coverage_samples", with_views(PO, JOINED_CTE, f"""
SELECT c.*, array_to_string(s.samples, '|') AS samples FROM ({_coverage_rows()}) c JOIN ({_sample_rows()}) s USING (column_name) WHERE coverage_ratio >= 0.7"""))
def coverage_samples(spark, sf_dir):
    """The whole profile: coverage, distinct values and five samples of every column."""
    out = profile.coverage_profile(joined(spark, sf_dir), 0.7, row_id="row_key")
    return out.withColumn("samples", F.array_join("samples", "|"))


@register("coverage_prune", with_views(PO, JOINED_CTE, f"""
SELECT column_name, coverage_ratio, coverage_ratio >= 0.7 AS kept FROM ({_coverage_rows()}) t"""))
def coverage_prune(spark, sf_dir):
    return profile.coverage_decision(joined(spark, sf_dir), 0.7)


@register("value_share", with_views(PO, JOINED_CTE, _union([
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count, "
    f"round(count(*) * 100.0 / (SELECT count(*) FROM joined), 4) AS share_pct FROM joined GROUP BY {c}"
    for c in SHARE_COLS])))
def value_share(spark, sf_dir):
    return profile.value_share(joined(spark, sf_dir), SHARE_COLS)


@register("group_mean_ordered", with_views(PO, JOINED_CTE + """,
m AS (SELECT cur_LDS, avg(cur_actual_UPB) AS mean_cur_upb, avg(ori_UPB) AS mean_ori_upb
      FROM joined WHERE cur_LDS IS NOT NULL GROUP BY cur_LDS),
o AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{v}')" for i, v in enumerate(LDS_ORDER)) + """) v(position, cur_LDS))""", """
SELECT o.position, o.cur_LDS, round(m.mean_cur_upb, 6) AS mean_cur_upb, round(m.mean_ori_upb, 6) AS mean_ori_upb
FROM o LEFT JOIN m ON o.cur_LDS = m.cur_LDS"""))
def group_mean_ordered(spark, sf_dir):
    df = joined(spark, sf_dir).filter(F.col("cur_LDS").isNotNull())
    m = df.groupBy("cur_LDS").agg(F.round(F.avg("cur_actual_UPB"), 6).alias("mean_cur_upb"),
                                  F.round(F.avg("ori_UPB"), 6).alias("mean_ori_upb"))
    return profile.in_fixed_order(m, "cur_LDS", LDS_ORDER)


@register("avg_score_purpose_region", with_views(PO, JOINED_CTE, f"""
SELECT loan_purpose, {region_case_sql()} AS region, round(avg(credit_score), 6) AS avg_credit_score
FROM joined WHERE credit_score BETWEEN 300 AND 850 GROUP BY 1, 2"""))
def avg_score_purpose_region(spark, sf_dir):
    df = clean.valid_score_filter(clean.with_region(joined(spark, sf_dir)))
    return df.groupBy("loan_purpose", "region").agg(F.round(F.avg("credit_score"), 6).alias("avg_credit_score"))


@register("label_lookup", with_views(PO, JOINED_CTE + """,
labels AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in LABELS_OCCUPANCY.items()) + """) v(code, label))""", """
SELECT occupancy_status, coalesce(l.label, occupancy_status) AS occupancy_label, count(*) AS count_case
FROM joined LEFT JOIN labels l ON occupancy_status = l.code GROUP BY 1, 2"""))
def label_lookup(spark, sf_dir):
    counts = joined(spark, sf_dir).groupBy("occupancy_status").agg(F.count(F.lit(1)).alias("count_case"))
    return profile.with_labels(counts, "occupancy_status", LABELS_OCCUPANCY, "occupancy_label")


@register("quarter_target_counts", with_views(PO, JOINED_CTE, """
SELECT quarter, coalesce(replace(cur_LDS, ' ', ''), 'nan') IN ('0', '1') AS target, count(*) AS count
FROM joined GROUP BY 1, 2"""))
def quarter_target_counts(spark, sf_dir):
    return clean.with_target(joined(spark, sf_dir)).groupBy("quarter", "target").agg(F.count(F.lit(1)).alias("count"))


@register("numeric_summary", with_views(PO, JOINED_CTE, _union([
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM joined" for c in NUMERIC])))
def numeric_summary(spark, sf_dir):
    s = profile.numeric_summary(joined(spark, sf_dir), NUMERIC)
    return s.select("column_name", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75")],
                    "min", "max")


@register("text_summary", with_views(PO, JOINED_CTE + ",\n" + "counts AS (" + _union([
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM joined WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in TEXT]) + ")", """
SELECT column_name, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS "unique", max(cnt) AS freq,
       arg_min(value, (-cnt, value)) AS top
FROM counts GROUP BY column_name"""))
def text_summary(spark, sf_dir):
    return profile.text_summary(joined(spark, sf_dir), TEXT).withColumn("count", F.col("count").cast("long"))


@register("null_counts", with_views(PO, JOINED_CTE, _union([
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) - count({c}) AS null_count, count({c}) AS non_null FROM joined"
    for c, t in JOINED_TYPES])))
def null_counts(spark, sf_dir):
    return profile.null_counts(joined(spark, sf_dir))


@register("duplicate_count", with_views(PO, JOINED_CTE, """
SELECT (SELECT count(*) FROM joined) AS rows_before, count(*) AS rows_after,
       (SELECT count(*) FROM joined) - count(*) AS duplicated_rows
FROM (SELECT DISTINCT * EXCLUDE (row_key) FROM joined) d"""))
def duplicate_count(spark, sf_dir):
    return profile.duplicate_count(joined(spark, sf_dir).drop("row_key"), standin(spark, sf_dir).performance.count())


@register("distinct_values", with_views(["performance"], "", """
SELECT DISTINCT coalesce(replace(cur_LDS, ' ', ''), 'nan') AS cur_LDS FROM performance"""))
def distinct_values(spark, sf_dir):
    from amortia.plans.catalog import standin
    return clean.with_target(standin(spark, sf_dir).performance).select("cur_LDS").distinct()


BOX_SQL = """
q AS (SELECT {keys}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
             quantile_cont({v}, 0.75) AS q3
      FROM {src} WHERE {v} IS NOT NULL AND {notnull} GROUP BY {keys}),
j AS (SELECT s.{v}, q.*, q.q3 - q.q1 AS iqr FROM {src} s JOIN q USING ({keys}) WHERE s.{v} IS NOT NULL)"""
BOX_BODY = """
SELECT {keys}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       count(*) AS n,
       min(CASE WHEN {v} BETWEEN q1 - 1.5 * iqr AND q3 + 1.5 * iqr THEN {v} END) AS whisker_low,
       max(CASE WHEN {v} BETWEEN q1 - 1.5 * iqr AND q3 + 1.5 * iqr THEN {v} END) AS whisker_high,
       count(CASE WHEN NOT ({v} BETWEEN q1 - 1.5 * iqr AND q3 + 1.5 * iqr) THEN 1 END) AS n_outliers
FROM j GROUP BY {keys}, q1, median, q3, iqr"""


def _round_box(df, keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr")],
                     "n", "whisker_low", "whisker_high", "n_outliers")


_BK = dict(keys="occupancy_status, first_time_homebuyer", v="cur_actual_UPB", src="joined",
           notnull="occupancy_status IS NOT NULL AND first_time_homebuyer IS NOT NULL")


@register("box_stats", with_views(PO, JOINED_CTE + "," + BOX_SQL.format(**_BK), BOX_BODY.format(**_BK)))
def box_stats(spark, sf_dir):
    keys = ["occupancy_status", "first_time_homebuyer"]
    return _round_box(profile.box_stats(joined(spark, sf_dir), "cur_actual_UPB", keys), keys)


_BC = dict(keys="column_name", v="value", src="longv", notnull="TRUE")


@register("box_stats_columns", with_views(PO, JOINED_CTE + ",\nlongv AS (" + _union([
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM joined" for c in NUMERIC]) + ")," +
    BOX_SQL.format(**_BC), BOX_BODY.format(**_BC)))
def box_stats_columns(spark, sf_dir):
    long = profile.to_long(joined(spark, sf_dir), NUMERIC, "double")
    return _round_box(profile.box_stats(long, "value", ["column_name"]), ["column_name"])


@register("histogram30", with_views(PO, JOINED_CTE + ",\nlongv AS (" + _union([
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM joined WHERE {c} IS NOT NULL" for c in NUMERIC]) + """),
b AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM longv GROUP BY column_name),
binned AS (SELECT l.column_name, lo, hi,
                  CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((value - lo) / (hi - lo) * 30) AS INT) + 1, 30) END AS bin
           FROM longv l JOIN b USING (column_name))""", """
SELECT column_name, bin, round(lo + (bin - 1) * (hi - lo) / 30, 6) AS bin_low, round(lo + bin * (hi - lo) / 30, 6) AS bin_high,
       count(*) AS count
FROM binned GROUP BY column_name, bin, lo, hi"""))
def histogram30(spark, sf_dir):
    h = profile.histogram(joined(spark, sf_dir), NUMERIC, 30)
    return h.select("column_name", "bin", F.round("bin_low", 6).alias("bin_low"),
                    F.round("bin_high", 6).alias("bin_high"), "count")


@register("class_balance", with_views(PO, JOINED_CTE, """
SELECT coalesce(replace(cur_LDS, ' ', ''), 'nan') IN ('0', '1') AS target, count(*) AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM joined), 4) AS share_pct
FROM joined GROUP BY 1"""))
def class_balance(spark, sf_dir):
    return profile.value_share_of(clean.with_target(joined(spark, sf_dir)), "target")


HT_COLS = ["loan_sequence_num", "monthly_reporting_period", "row_key", "cur_actual_UPB", "credit_score"]


@register("head_tail", with_views(PO, JOINED_CTE, f"""
(SELECT {', '.join(HT_COLS)}, 'head' AS part FROM joined
 ORDER BY loan_sequence_num NULLS FIRST, monthly_reporting_period NULLS FIRST, row_key NULLS FIRST LIMIT 5)
UNION ALL
(SELECT {', '.join(HT_COLS)}, 'tail' AS part FROM joined
 ORDER BY loan_sequence_num DESC NULLS LAST, monthly_reporting_period DESC NULLS LAST, row_key DESC NULLS LAST LIMIT 5)"""))
def head_tail(spark, sf_dir):
    return profile.head_tail(joined(spark, sf_dir).select(*HT_COLS),
                             ["loan_sequence_num", "monthly_reporting_period", "row_key"], 5)


@register("column_samples", with_views(PO, JOINED_CTE + ",\nlongv AS (" + _union([
    f"SELECT '{c}' AS column_name, row_key, {c} AS value FROM joined WHERE {c} IS NOT NULL" for c in SAMPLE_COLS]) + ")", """
SELECT column_name, CAST(rank AS INTEGER) AS rank, value FROM (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name
                                                ORDER BY md5(concat_ws('|', '42', column_name, row_key))) AS rank
  FROM longv) t WHERE rank <= 5"""))
def column_samples(spark, sf_dir):
    return profile.column_samples(joined(spark, sf_dir), SAMPLE_COLS, "row_key", 5)


LEAKAGE = ["cur_LDS", "ori_UPB"]


@register("numeric_projection", with_views(PO, JOINED_CTE, "SELECT " + ", ".join(
    c for c in NUMERIC if c not in LEAKAGE) + ", row_key FROM joined"))
def numeric_projection(spark, sf_dir):
    """B2-B4: drop the leakage columns, then keep the numeric columns (chosen from the schema),
    plus the row key."""
    df = joined(spark, sf_dir).drop(*LEAKAGE)
    return df.select(*profile.numeric_columns(df), "row_key")
