"""Queries: associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from amortia.operators import association
from amortia.plans.catalog import JOINED_CTE, register, standin, with_views
from amortia.plans.q_core import joined
from amortia.plans.q_profile import NUMERIC

PO = ["performance", "origination"]
ASSOC_JOINED = ["cur_LDS", "first_time_homebuyer", "occupancy_status", "channel", "property_state",
                "property_type", "loan_purpose"]
ASSOC_ORIG = ["first_time_homebuyer", "num_borrowers", "occupancy_status", "channel", "loan_purpose",
              "property_type"]


def _pearson_sql() -> str:
    parts = []
    for i, a in enumerate(NUMERIC):
        for j, b in enumerate(NUMERIC):
            if i == j:
                r = f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END"
            else:
                r = (f"covar_samp({a}, {b}) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
                     f"stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({r}, 6) AS r, {i} AS pos_a, {j} AS pos_b "
                         f"FROM joined")
    return "pearson AS (" + "\nUNION ALL\n".join(parts) + ")"


@register("pearson_matrix", with_views(PO, JOINED_CTE + ",\n" + _pearson_sql(), "SELECT * FROM pearson"))
def pearson_matrix(spark, sf_dir):
    return association.pearson_long(joined(spark, sf_dir), NUMERIC)


@register("pearson_prune", with_views(PO, JOINED_CTE + ",\n" + _pearson_sql(), """
SELECT col_a AS column_name, max(abs(r)) AS max_abs_r FROM pearson
WHERE pos_b < pos_a AND abs(r) > 0.7 GROUP BY col_a"""))
def pearson_prune(spark, sf_dir):
    return association.prune_walk(association.pearson_long(joined(spark, sf_dir), NUMERIC), "r", 0.7)


@register("contingency", with_views(PO, JOINED_CTE, """
SELECT occupancy_status AS x, loan_purpose AS y, count(*) AS count FROM joined
WHERE occupancy_status IS NOT NULL AND loan_purpose IS NOT NULL GROUP BY 1, 2"""))
def contingency(spark, sf_dir):
    return association.crosstab_long(joined(spark, sf_dir), "occupancy_status", "loan_purpose")


def _chi_sql(src: str, cols: list[str]) -> str:
    """Oracle CTEs: full r x k grid per pair (zero cells included), Yates on 2x2 tables,
    restricted to columns with more than one non-null level."""
    levels = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col, {p} AS pos0, count(DISTINCT {c}) AS nd FROM {src}" for p, c in enumerate(cols))
    cells = []
    for a in cols:
        for b in cols:
            if cols.index(a) < cols.index(b):
                cells.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, coalesce(CAST({a} AS VARCHAR), 'NULL') AS x, "
                             f"coalesce(CAST({b} AS VARCHAR), 'NULL') AS y, count(*) AS o FROM {src} GROUP BY 3, 4")
    return f"""
levels AS ({levels}),
kept AS (SELECT col, CAST(row_number() OVER (ORDER BY pos0) - 1 AS INT) AS pos FROM levels WHERE nd > 1),
obs AS ({' UNION ALL '.join(cells)}),
obs_k AS (SELECT ka.pos AS i, kb.pos AS j, obs.* FROM obs JOIN kept ka ON obs.col_a = ka.col JOIN kept kb ON obs.col_b = kb.col),
rx AS (SELECT i, j, col_a, col_b, x, sum(o) AS rx FROM obs_k GROUP BY ALL),
cy AS (SELECT i, j, col_a, col_b, y, sum(o) AS cy FROM obs_k GROUP BY ALL),
nn AS (SELECT i, j, col_a, col_b, sum(o) AS n FROM obs_k GROUP BY ALL),
shape AS (SELECT nn.*, (SELECT count(*) FROM rx WHERE rx.i = nn.i AND rx.j = nn.j) AS r,
                 (SELECT count(*) FROM cy WHERE cy.i = nn.i AND cy.j = nn.j) AS k FROM nn),
grid AS (SELECT s.i, s.j, s.col_a, s.col_b, s.n, s.r, s.k, rx.x, cy.y, CAST(rx.rx AS DOUBLE) * cy.cy / s.n AS e,
                coalesce(o.o, 0) AS o
         FROM shape s JOIN rx USING (i, j, col_a, col_b) JOIN cy USING (i, j, col_a, col_b)
         LEFT JOIN obs_k o ON o.i = s.i AND o.j = s.j AND o.x = rx.x AND o.y = cy.y),
chi AS (SELECT i, j, col_a, col_b, n, r, k, (r - 1) * (k - 1) AS dof,
               sum(CASE WHEN r = 2 AND k = 2 THEN power(greatest(abs(o - e) - 0.5, 0), 2) / e
                        ELSE power(o - e, 2) / e END) AS chi2
        FROM grid GROUP BY i, j, col_a, col_b, n, r, k)"""


@register("chi_square", with_views(["origination"], _chi_sql("origination", ASSOC_ORIG), """
SELECT i, j, col_a, col_b, CAST(n AS BIGINT) AS n, r, k, dof, round(chi2, 6) AS chi2 FROM chi"""))
def chi_square(spark, sf_dir):
    orig = standin(spark, sf_dir).origination
    cols = association.multi_level_columns(orig, ASSOC_ORIG)
    chi = association.chi_square(association.contingency_cells(orig, cols))
    return chi.withColumn("chi2", F.round("chi2", 6)).withColumn("n", F.col("n").cast("long"))


CRAMERS_BODY = """
v AS (SELECT i, j, col_a, col_b, CASE WHEN least(r, k) > 1 THEN sqrt(chi2 / n / (least(r, k) - 1)) END AS v FROM chi),
m AS (SELECT col_a, col_b, v, i AS pos_a, j AS pos_b FROM v
      UNION ALL SELECT col_b, col_a, v, j, i FROM v
      UNION ALL SELECT col, col, 1.0, pos, pos FROM kept),
cv AS (SELECT col_a, col_b, round(coalesce(v, 0), 6) AS v, pos_a, pos_b FROM m)"""


@register("cramers_v", with_views(PO, JOINED_CTE + "," + _chi_sql("joined", ASSOC_JOINED) + "," + CRAMERS_BODY,
                                  "SELECT * FROM cv"))
def cramers_v(spark, sf_dir):
    return association.cramers_v_long(joined(spark, sf_dir), ASSOC_JOINED)


@register("cramers_prune", with_views(PO, JOINED_CTE + "," + _chi_sql("joined", ASSOC_JOINED) + "," + CRAMERS_BODY, """
SELECT col_a AS column_name, max(abs(v)) AS max_abs_v FROM cv WHERE pos_b < pos_a AND abs(v) > 0.7 GROUP BY col_a"""))
def cramers_prune(spark, sf_dir):
    return association.prune_walk(association.cramers_v_long(joined(spark, sf_dir), ASSOC_JOINED), "v", 0.7)
