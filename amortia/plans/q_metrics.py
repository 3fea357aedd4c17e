"""Queries: evaluation and fairness on the deterministic scored stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from amortia.operators import fairness, metrics
from amortia.plans.catalog import register, standin, with_views
from amortia.session import durable

S = ["scored"]
COUNTS = """counts AS (SELECT split,
  count(CASE WHEN NOT target AND NOT prediction THEN 1 END) AS tn, count(CASE WHEN NOT target AND prediction THEN 1 END) AS fp,
  count(CASE WHEN target AND NOT prediction THEN 1 END) AS fn, count(CASE WHEN target AND prediction THEN 1 END) AS tp
  FROM scored GROUP BY split)"""


def _r(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def scored(spark, sf_dir):
    return standin(spark, sf_dir).scored


@register("confusion", with_views(S, COUNTS, """
SELECT split, false AS actual, false AS predicted, tn AS count FROM counts UNION ALL
SELECT split, false, true, fp FROM counts UNION ALL
SELECT split, true, false, fn FROM counts UNION ALL
SELECT split, true, true, tp FROM counts"""))
def confusion(spark, sf_dir):
    return metrics.confusion_long(metrics.confusion_counts(scored(spark, sf_dir)))


BIN_COLS = ["accuracy", "precision", "recall", "specificity", "f1_score", "g_mean"]


@register("binary_metrics", with_views(S, COUNTS + """,
m AS (SELECT split, tn + fp + fn + tp AS n,
             CAST(tp + tn AS DOUBLE) / nullif(tn + fp + fn + tp, 0) AS accuracy,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
             CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity FROM counts)""", """
SELECT split, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(specificity, 6) AS specificity,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1_score,
       round(sqrt(recall * coalesce(specificity, 0)), 6) AS g_mean
FROM m"""))
def binary_metrics(spark, sf_dir):
    return _r(metrics.binary_metrics(metrics.confusion_counts(scored(spark, sf_dir))), BIN_COLS)


@register("classification_report", with_views(S, COUNTS + """,
pr AS (SELECT split, tn, fp, fn, tp,
  coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0) AS p0, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS r0,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p1, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r1,
  tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS n FROM counts),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM pr)""", """
SELECT split, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support
FROM (
  SELECT split, 'False' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM f UNION ALL
  SELECT split, 'True', p1, r1, f1, s1 FROM f UNION ALL
  SELECT split, 'accuracy', NULL, NULL, coalesce(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 0), n FROM f UNION ALL
  SELECT split, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f UNION ALL
  SELECT split, 'weighted avg', coalesce((p0 * s0 + p1 * s1) / nullif(n, 0), 0), coalesce((r0 * s0 + r1 * s1) / nullif(n, 0), 0),
         coalesce((f0 * s0 + f1 * s1) / nullif(n, 0), 0), n FROM f) t"""))
def classification_report(spark, sf_dir):
    rep = metrics.classification_report(metrics.confusion_counts(scored(spark, sf_dir)))
    return _r(rep, ["precision", "recall", "f1_score"])


AUC_CTES = """
per AS (SELECT split, score, count(*) AS cnt, count(CASE WHEN target THEN 1 END) AS pos FROM scored GROUP BY split, score),
rk AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + (cnt + 1) / 2.0 AS avg_rank FROM per),
auc AS (SELECT split, (sum(pos * avg_rank) - sum(pos) * (sum(pos) + 1) / 2.0)
                      / nullif(sum(pos) * (sum(cnt) - sum(pos)), 0) AS auc FROM rk GROUP BY split)"""


@register("roc_auc", with_views(S, AUC_CTES, "SELECT split, round(auc, 6) AS auc FROM auc"))
def roc_auc(spark, sf_dir):
    return _r(metrics.roc_auc(scored(spark, sf_dir)), ["auc"])


@register("demographic_parity", with_views(S, """
r AS (SELECT split, region, avg(CAST(prediction AS DOUBLE)) AS rate FROM scored GROUP BY split, region)""", """
SELECT split, round(max(rate) - min(rate), 6) AS demographic_parity_difference FROM r GROUP BY split"""))
def demographic_parity(spark, sf_dir):
    return _r(fairness.demographic_parity(scored(spark, sf_dir)), ["demographic_parity_difference"])


@register("equalized_odds", with_views(S, """
r AS (SELECT split, target, region, avg(CAST(prediction AS DOUBLE)) AS rate FROM scored GROUP BY split, target, region),
g AS (SELECT split, target, max(rate) - min(rate) AS gap FROM r GROUP BY split, target)""", """
SELECT split, round(max(gap), 6) AS equalized_odds_difference FROM g GROUP BY split"""))
def equalized_odds(spark, sf_dir):
    return _r(fairness.equalized_odds(scored(spark, sf_dir)), ["equalized_odds_difference"])


def _di_sql() -> str:
    parts = []
    for a in ("Northeast", "South", "West", "Other"):
        parts.append(f"""SELECT split, 'region_{a}' AS attribute,
  CASE WHEN avg(CASE WHEN region = '{a}' THEN CAST(prediction AS DOUBLE) END) > 0
       THEN avg(CASE WHEN region <> '{a}' THEN CAST(prediction AS DOUBLE) END)
            / avg(CASE WHEN region = '{a}' THEN CAST(prediction AS DOUBLE) END) END AS disparate_impact
FROM scored GROUP BY split""")
    return "di AS (" + " UNION ALL ".join(parts) + ")"


@register("disparate_impact", with_views(S, _di_sql(), """
SELECT split, attribute, round(disparate_impact, 6) AS disparate_impact FROM di
UNION ALL
SELECT split, 'mean' AS attribute, round(avg(disparate_impact), 6) FROM di GROUP BY split"""))
def disparate_impact(spark, sf_dir):
    per = fairness.disparate_impact(scored(spark, sf_dir))
    mean = fairness.mean_disparate_impact(per).withColumn("attribute", F.lit("mean"))
    return _r(per.unionByName(mean), ["disparate_impact"])


@register("quality_gate", with_views(S, COUNTS + "," + AUC_CTES + """,
m AS (SELECT split, CAST(tp + tn AS DOUBLE) / nullif(tn + fp + fn + tp, 0) AS accuracy,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r
      FROM counts),
dp AS (SELECT split, max(rate) - min(rate) AS dpd FROM (SELECT split, region, avg(CAST(prediction AS DOUBLE)) AS rate
       FROM scored GROUP BY split, region) x GROUP BY split),
eo AS (SELECT split, max(gap) AS eod FROM (SELECT split, target, max(rate) - min(rate) AS gap FROM (
         SELECT split, target, region, avg(CAST(prediction AS DOUBLE)) AS rate FROM scored GROUP BY split, target, region) y
       GROUP BY split, target) z GROUP BY split),
gate AS (SELECT m.split, accuracy >= 0.8 AND auc >= 0.85 AND coalesce(2 * p * r / nullif(p + r, 0), 0) >= 0.85 AS metrics_ok,
               abs(dpd) <= 0.2 AND abs(eod) <= 0.2 AS fairness_ok
        FROM m JOIN auc USING (split) JOIN dp USING (split) JOIN eo USING (split) WHERE m.split IN ('val', 'test'))""", """
SELECT bool_and(metrics_ok) AS passed_metrics, bool_and(fairness_ok) AS passed_fairness,
       bool_and(metrics_ok) AND bool_and(fairness_ok) AND count(*) = 2 AS passed,
       CASE WHEN bool_and(metrics_ok) AND bool_and(fairness_ok) AND count(*) = 2 THEN 'PASS' ELSE 'FAIL' END AS status
FROM gate"""))
def quality_gate(spark, sf_dir):
    # Confusion counts, AUC and three fairness measures all read the scored rows: one copy.
    df = durable(scored(spark, sf_dir))
    m = metrics.binary_metrics(metrics.confusion_counts(df))
    return fairness.quality_gate(m, metrics.roc_auc(df), fairness.fairness_table(df))
