"""Associations between columns: Pearson correlation of numeric pairs, chi-square and
Cramér's V of categorical pairs, and the greedy pruning walk over either matrix.

Scale notes
-----------
* Pearson: each task folds its rows into pairwise-complete counts and centred sums with
  matrix products (X'X, X'M, ...) and ships p x p partial rows; a grouped sum combines
  them. Centring on the column means keeps the sums well conditioned.
* Cramér's V: each task folds its rows into the contingency cells of all column pairs (products
  of one-hot blocks, counted from level numbers), and a grouped sum combines the cells. So the
  shuffle has category-pair size, also with many columns, whose combinations would grow to the
  row count. Cells, margins and per-pair sums are all small grouped aggregates; no zero cell is
  ever materialised:
  chi2 = sum_obs (O-E)^2/E + (n - sum_obs E), and for 2x2 tables with Yates' correction
  every cell has the same |O-E|, so chi2 = max(|O-E| - 0.5, 0)^2 * n * sum(1/r_i) * sum(1/c_j).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amortia.session import durable


def _gram_partials(columns: list[str], shift: list[float]):
    """Per Arrow batch: pairwise-complete counts and centred sums as one small table
    (p x p rows), computed with matrix products instead of per-pair row loops."""
    import numpy as np
    import pandas as pd

    p = len(columns)
    ia, ib = np.divmod(np.arange(p * p), p)

    def fn(batches):
        acc = None
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(x)
            x0 = np.where(m, x - np.asarray(shift), 0.0)
            mf = m.astype("float64")
            part = (mf.T @ mf, x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0)
            acc = part if acc is None else tuple(a + b for a, b in zip(acc, part))
        if acc is None:
            return
        n, s, q, pr = (a.reshape(-1) for a in acc)
        # s[a, b] = sum of x_a over rows where a and b are both present; q likewise for x_a^2.
        yield pd.DataFrame({"pos_a": ia.astype("int32"), "pos_b": ib.astype("int32"), "n": n,
                            "sa": s, "sb": s.reshape(p, p).T.reshape(-1), "qa": q,
                            "qb": q.reshape(p, p).T.reshape(-1), "sab": pr})
    return fn


def pearson_long(df: DataFrame, columns: Sequence[str], decimals: int = 6) -> DataFrame:
    """Long correlation matrix (col_a, col_b, r, pos_a, pos_b) over all ordered pairs,
    pairwise-complete; a zero-variance pair gives null.

    One cheap aggregate gives a per-column centre; then every task folds its rows into
    pairwise counts and centred sums with matrix products (numpy on Arrow batches) and
    emits p x p partial rows, which a grouped sum combines. Only p x p rows per task are
    shuffled, whatever the row count."""
    cols = list(columns)
    spark = df.sparkSession
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    centre = num.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = [float(centre[c]) if centre[c] is not None else 0.0 for c in cols]
    schema = "pos_a int, pos_b int, n double, sa double, sb double, qa double, qb double, sab double"
    parts = num.mapInPandas(_gram_partials(cols, shift), schema)
    tot = parts.groupBy("pos_a", "pos_b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "sab")])
    n = F.col("n")
    cov = (F.col("sab") - F.col("sa") * F.col("sb") / n) / (n - 1)
    va = (F.col("qa") - F.col("sa") * F.col("sa") / n) / (n - 1)
    vb = (F.col("qb") - F.col("sb") * F.col("sb") / n) / (n - 1)
    # Relative tolerance: a column that is constant over the pair's rows has zero variance.
    tiny = 1e-12
    ok = (n > 1) & (va > tiny * (F.col("qa") / n + 1e-300)) & (vb > tiny * (F.col("qb") / n + 1e-300))
    r = F.when(F.col("pos_a") == F.col("pos_b"), F.when(ok, F.lit(1.0))).otherwise(
        F.when(ok, F.least(F.greatest(cov / F.sqrt(va * vb), F.lit(-1.0)), F.lit(1.0))))
    stats = tot.select("pos_a", "pos_b", F.round(r, decimals).alias("r"))
    grid = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)],
                                 "pos_a int, pos_b int, col_a string, col_b string")
    # Every task emits all p x p pairs (n = 0 where a pair has no complete rows, r null), so an
    # inner join with the broadcast name grid (p x p rows, fixed by the schema) keeps them all.
    return (stats.join(F.broadcast(grid), ["pos_a", "pos_b"])
            .select("col_a", "col_b", "r", "pos_a", "pos_b"))


def prune_walk(matrix: DataFrame, value: str, cutoff: float = 0.7) -> DataFrame:
    """Greedy pruning as published: walking the lower triangle in column order, a column is
    dropped when its |value| with any earlier column exceeds ``cutoff`` (using the full,
    un-pruned matrix)."""
    hit = matrix.filter((F.col("pos_b") < F.col("pos_a")) & (F.abs(F.col(value)) > cutoff))
    return hit.groupBy("col_a").agg(F.max(F.abs(F.col(value))).alias(f"max_abs_{value}")) \
              .withColumnRenamed("col_a", "column_name")


MAX_CELLS = 500_000  # cells that a task holds before it hands them on


def _pair_partials(columns: list[str], max_cells: int):
    """Per task: cells of all column pairs (and of each column with itself) as products of the columns' one-hot blocks.
    The product of two one-hot blocks has one entry per pair of levels that meet; it is counted from level numbers."""
    import numpy as np
    import pyarrow as pa

    p = len(columns)

    def handed(cells):
        rows = [(i, j, x, y, n) for (i, j), found in cells.items() for (x, y), n in found.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()))],
                                          names=["i", "j", "x", "y", "o"])

    def fn(batches):
        cells, held = {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            coded = [b.column(k).dictionary_encode(null_encoding="encode") for k in range(p)]
            levels = [c.dictionary.to_pylist() for c in coded]
            codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
            for i in range(p):
                for j in range(i, p):
                    width = len(levels[j])
                    found, n = np.unique(codes[i] * width + codes[j], return_counts=True)
                    into = cells.setdefault((i, j), {})
                    held -= len(into)
                    for at, k in zip(found.tolist(), n.tolist()):
                        key = (levels[i][at // width], levels[j][at % width])
                        into[key] = into.get(key, 0) + k
                    held += len(into)
            if held > max_cells:
                yield handed(cells)
                cells, held = {}, 0
        yield handed(cells)
    return fn


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, x, y, o): rows per pair of levels of every column pair i <= j, nulls kept as null. Tasks fold their rows into
    cells, so the shuffle carries cells (category-pair size), whatever the number of columns and of their combinations."""
    cols = list(columns)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    parts = text.mapInArrow(_pair_partials(cols, MAX_CELLS), "i int, j int, x string, y string, o long")
    return parts.groupBy("i", "j", "x", "y").agg(F.sum("o").alias("o"))


def multi_level_columns(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> list[str]:
    """Columns with more than one distinct non-null value (schema-sized list to the driver), from the written pair
    counts when they are given."""
    cols = list(columns)
    if counts is None:
        row = df.agg(*[F.countDistinct(F.col(c)).alias(c) for c in cols]).first()
        return [c for c in cols if row[c] > 1]
    many = counts.filter((F.col("i") == F.col("j")) & F.col("x").isNotNull()).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return [cols[i] for i in sorted(r["i"] for r in many.filter("n > 1").collect())]


def contingency_cells(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None,
                      counted: Sequence[str] | None = None) -> DataFrame:
    """Counts per (pair, x, y) for every column pair i < j; nulls read as 'NULL'. ``counts``: pair counts of the columns
    ``counted``, if there are any already."""
    cols = list(columns)
    counted = list(counted or cols)
    counts = pair_counts(df, counted) if counts is None else counts
    # one row per column, fixed by the schema
    place = F.create_map(*[F.lit(x) for c in cols for x in (counted.index(c), cols.index(c))]) if cols else F.create_map()
    name = F.array(*[F.lit(c) for c in cols])
    null = lambda c: F.coalesce(F.col(c), F.lit("NULL"))
    cells = counts.filter(F.col("i") < F.col("j")).select(place[F.col("i")].alias("i"), place[F.col("j")].alias("j"), null("x").alias("x"),
                                                          null("y").alias("y"), "o").filter("i is not null and j is not null")
    return cells.groupBy("i", "j", "x", "y").agg(F.sum("o").alias("o")).select(
        "i", "j", name[F.col("i")].alias("col_a"), name[F.col("j")].alias("col_b"), "x", "y", "o")


def crosstab_long(df: DataFrame, x: str, y: str) -> DataFrame:
    """``crosstab``: counts of (x, y) with rows holding a null in either dropped."""
    return (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
              .groupBy(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y"))
              .agg(F.count(F.lit(1)).alias("count")))


def chi_square(cells: DataFrame, pair_cols: Sequence[str] = ("i", "j", "col_a", "col_b"),
               yates: bool = True) -> DataFrame:
    """Chi-square of independence per pair from observed cells (x, y, o).
    Yates' continuity correction applies when the table is 2x2 (one degree of freedom)."""
    keys = list(pair_cols)
    rows = cells.groupBy(*keys, "x").agg(F.sum("o").alias("rx"))
    colsum = cells.groupBy(*keys, "y").agg(F.sum("o").alias("cy"))
    shape = cells.groupBy(*keys).agg(F.sum("o").alias("n"))
    rshape = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("r"), F.sum(1.0 / F.col("rx")).alias("inv_r"))
    cshape = colsum.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(1.0 / F.col("cy")).alias("inv_c"))
    e = (cells.join(rows, keys + ["x"]).join(colsum, keys + ["y"]).join(shape, keys)
              .withColumn("e", F.col("rx").cast("double") * F.col("cy") / F.col("n")))
    per_pair = e.groupBy(*keys, "n").agg(
        F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("obs_part"),
        F.sum("e").alias("obs_e"),
        F.max(F.abs(F.col("o") - F.col("e"))).alias("d"))
    out = per_pair.join(rshape, keys).join(cshape, keys)
    plain = F.col("obs_part") + (F.col("n") - F.col("obs_e"))
    corrected = (F.greatest(F.col("d") - 0.5, F.lit(0.0)) ** 2) * F.col("n") * F.col("inv_r") * F.col("inv_c")
    is_2x2 = (F.col("r") == 2) & (F.col("k") == 2)
    chi2 = F.when(F.lit(yates) & is_2x2, corrected).otherwise(plain)
    return out.select(*keys, "n", "r", "k", ((F.col("r") - 1) * (F.col("k") - 1)).alias("dof"), chi2.alias("chi2"))


def cramers_v(chi: DataFrame) -> DataFrame:
    """V = sqrt(chi2 / n / min(r-1, k-1)); a one-level side gives null."""
    m = F.least(F.col("r"), F.col("k")) - 1
    v = F.when(m > 0, F.sqrt(F.col("chi2") / F.col("n") / m))
    return chi.withColumn("v", v)


def cramers_v_long(df: DataFrame, columns: Sequence[str], decimals: int = 6) -> DataFrame:
    """Cramér's V matrix in long form over the columns with more than one level: diagonal 1,
    mirrored halves, null -> 0. Columns: (col_a, col_b, v, pos_a, pos_b)."""
    # The table is scanned once: its pair counts are written to the shared folder, and both the level check and the
    # contingency cells read them.
    counts = durable(pair_counts(df, columns))
    cols = multi_level_columns(df, columns, counts)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, v double, pos_a int, pos_b int")
    v = cramers_v(chi_square(contingency_cells(df, cols, counts, columns))).select("i", "j", "col_a", "col_b", "v")
    upper = v.select(F.col("i").alias("pos_a"), F.col("j").alias("pos_b"), "col_a", "col_b", "v")
    lower = v.select(F.col("j").alias("pos_a"), F.col("i").alias("pos_b"),
                     F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "v")
    spark = df.sparkSession
    diag = spark.createDataFrame([(i, i, c, c, 1.0) for i, c in enumerate(cols)],
                                 "pos_a int, pos_b int, col_a string, col_b string, v double")
    allv = upper.unionByName(lower).unionByName(diag)
    return allv.select("col_a", "col_b", F.round(F.coalesce(F.col("v"), F.lit(0.0)), decimals).alias("v"),
                       "pos_a", "pos_b")
