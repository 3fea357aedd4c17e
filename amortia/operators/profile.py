"""Column profiles and grouped statistics.

Scale notes
-----------
* Wide profiles are one pass: either one ``agg`` with an expression per column, or an
  ``unpivot`` to (column_name, value) followed by a grouped aggregate. The unpivot and the
  partial aggregate run in the same stage, so the shuffle carries one partial row per
  (column, value) and map task, never the unpivoted rows.
* Exact quantiles never hold a group in one task: rows collapse to (group, value, count)
  and each needed rank is found by rounds of bucketed counts that shrink a value range,
  finished by a running sum over at most ``finish_at`` distinct values (see
  ``exact_quantiles``). ``exact=False`` uses ``percentile_approx`` in a single pass.
* Per-column statistics tables joined back to rows have one row per column or group and
  are broadcast only when their bound is the schema width (fixed) — otherwise AQE decides.
* Top-k per group (samples, top value) uses ``row_number() <= k``; Spark inserts a partial
  window-group limit before the shuffle, so a hot group ships k rows per map task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amortia.session import durable, sized_shuffles

SAMPLE_MARGIN = 40        # hashes ranked per sample that is asked for

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """``select_dtypes``: 'number' or 'text'."""
    cols = numeric_columns(df) if kind == "number" else text_columns(df)
    return df.select(*cols)


def to_long(df: DataFrame, columns: Sequence[str], value_type: str = "string",
            ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``columns`` into (ids..., column_name, value) with a common value type."""
    cast = df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), "column_name", "value")


# --- coverage (D1, B11, D10, D26) ------------------------------------------------------

def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: total rows, non-null rows, distinct non-null values — exact, one scan.

    Columns are unpivoted per data type (values keep their own type, so distinct counts are
    exact), folded into (column, value) counts by a partial aggregate in the scan stage, and
    reduced per column. Much cheaper than one ``countDistinct`` per column, which makes
    Spark expand every row once per column before the shuffle. The type groups hold
    disjoint columns, so on a columnar table every column is read once in total; for an
    expensive lazy input, pass a ``durable()`` copy so the groups do not each recompute it
    (measured: this beats a single wide explode with typed value slots)."""
    columns = list(columns or df.columns)
    by_type: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name in columns:
            by_type.setdefault(f.dataType.simpleString(), []).append(f.name)
    parts = []
    for cols in by_type.values():
        long = df.select(*[F.col(f"`{c}`") for c in cols]).unpivot([], cols, "column_name", "value")
        counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
        parts.append(counts.groupBy("column_name").agg(
            F.sum("c").alias("total_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))), F.lit(0)).cast("long").alias("non_null"),
            F.count("value").alias("num_unique_values")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage_profile(df: DataFrame, threshold: float | None = 0.7, exact_distinct: bool = True, row_id: str | None = None) -> DataFrame:
    """Per column: type, non-null rows, total rows, coverage ratio, distinct non-null values, and with ``row_id`` five
    ``samples`` (``row_samples``). Rows below ``threshold`` are dropped (``None`` keeps all). Sorted by coverage desc.
    ``exact_distinct=False`` uses HyperLogLog sketches instead of exact distinct counts."""
    cols = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    spark = df.sparkSession
    dtypes = spark.createDataFrame([(c, types[c]) for c in cols], "column_name string, dtype string")
    if exact_distinct:
        stats = column_stats(df, cols)
    else:
        aggs = [F.count(F.lit(1)).alias("__n")]
        for i, c in enumerate(cols):
            aggs += [F.count(F.col(f"`{c}`")).alias(f"nn{i}"), F.approx_count_distinct(F.col(f"`{c}`")).alias(f"nd{i}")]
        rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"nn{i}").alias("non_null"),
                         F.col(f"nd{i}").alias("num_unique_values")) for i, c in enumerate(cols)]
        stats = (df.agg(*aggs).select(F.col("__n").alias("total_rows"), F.explode(F.array(*rows)).alias("p"))
                   .select("p.column_name", "total_rows", "p.non_null", "p.num_unique_values"))
    # One row per column: bounded by the schema width.
    out = (stats.join(F.broadcast(dtypes), "column_name")
                .select("column_name", "dtype", "non_null", "total_rows",
                        F.round(F.col("non_null") / F.col("total_rows"), 6).alias("coverage_ratio"),
                        "num_unique_values"))
    if threshold is not None:
        out = out.filter(F.col("coverage_ratio") >= threshold)
    if row_id is not None:  # one row per column
        out = (out.join(F.broadcast(row_samples(df, row_id)), "column_name", "left")
                  .withColumn("samples", F.coalesce("samples", F.array().cast("array<string>"))))
    return out.orderBy(F.desc("coverage_ratio"), "column_name")


def coverage_decision(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(column_name, coverage_ratio, kept) for every column."""
    prof = coverage_profile(df, None)
    return prof.select("column_name", "coverage_ratio", (F.col("coverage_ratio") >= threshold).alias("kept"))


def prune_low_coverage(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Project to the columns whose coverage is at least ``threshold``. Only the column
    list (schema-sized) reaches the driver."""
    kept = [r.column_name for r in coverage_decision(df, threshold).filter("kept").collect()]
    return df.select(*[c for c in df.columns if c in kept])


def null_counts(df: DataFrame) -> DataFrame:
    """Per column: type, null count, non-null count (``isnull().sum()`` and ``info()``)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(c)).alias(f"nn{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                     F.col(f"nn{i}").alias("non_null")) for i, c in enumerate(df.columns)]
    return (wide.select("__n", F.explode(F.array(*rows)).alias("p"))
                .select("p.column_name", "p.dtype", (F.col("__n") - F.col("p.non_null")).alias("null_count"),
                        "p.non_null"))


# --- value counts (D2, D3, D6, D12, D25, C5) -----------------------------------------------

def value_share(df: DataFrame, columns: Sequence[str], decimals: int = 4) -> DataFrame:
    """Per column and value (null included): count and share of all rows in percent.

    One scan: value counts come from a partial aggregate over the unpivoted columns, and each
    column's row total is the sum of its counts — a second small aggregate (one row per
    column, so its broadcast is bounded by the schema), not a window that would put all of a
    column's distinct values in one task."""
    long = to_long(df, columns)
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("column_name").agg(F.sum("count").alias("__total"))
    return (counts.join(F.broadcast(totals), "column_name")
                  .withColumn("share_pct", F.round(F.col("count") * 100.0 / F.col("__total"), decimals))
                  .drop("__total")
                  .orderBy("column_name", F.desc("share_pct"), "value"))


def value_share_of(df: DataFrame, column: str, decimals: int = 4) -> DataFrame:
    """Value counts of one column (null included) with their share in percent, one scan."""
    share = value_share(df, [column], decimals)
    kind = dict(df.dtypes)[column]
    return share.select(F.col("value").cast(kind).alias(column), "count", "share_pct")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def with_labels(df: DataFrame, column: str, labels: dict[str, str], label_col: str | None = None) -> DataFrame:
    """Code -> label with fall-through to the code. The label table is a fixed literal
    (a handful of rows), so broadcasting it is bounded."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(labels.items()), f"__code string, __label string")
    out = df.join(F.broadcast(table), F.col(column) == F.col("__code"), "left")
    return (out.withColumn(label_col or f"{column}_label", F.coalesce(F.col("__label"), F.col(column)))
               .drop("__code", "__label"))


def in_fixed_order(agg: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Re-index an aggregate to a fixed category order; categories without rows get nulls."""
    spark = agg.sparkSession
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(order)], f"position int, {key} string")
    # The fixed order is the preserved side, so it cannot be the broadcast side of this outer
    # join; the aggregate (one row per category) is small and AQE broadcasts it.
    return frame.join(agg, key, "left").orderBy("position")


# --- numeric summaries (D8, D13, D14, D23) -------------------------------------------------

def quantiles(df: DataFrame, value: str, groups: Sequence[str], probs: Sequence[float],
              exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Per group: array ``q`` of quantiles with linear interpolation (pandas / numpy default).
    ``exact=False`` uses ``percentile_approx`` (bounded sketch, one pass)."""
    if exact:
        return exact_quantiles(df, value, groups, probs)
    probs_col = F.array(*[F.lit(float(p)) for p in probs])
    base = df.filter(F.col(value).isNotNull())
    return base.groupBy(*groups).agg(F.percentile_approx(F.col(value), probs_col, accuracy).alias("q"))


def exact_quantiles(df: DataFrame, value: str, groups: Sequence[str], probs: Sequence[float],
                    partitions: int | None = None) -> DataFrame:
    """Exact quantiles without holding a group in one task.

    Rows collapse to distinct (group, value, count) by partial aggregation and are range-partitioned on
    (group, value), so partitions hold equal numbers of distinct values however they are spread. The
    partition that holds a needed rank (floor and ceil of p * (n - 1)) follows from one total per
    group and partition; the value follows from a running sum inside that partition."""
    from amortia.session import durable

    g = list(groups)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*g, F.col(value).cast("double").alias("__v"))
                .agg(F.count(F.lit(1)).alias("__c")))
    # Written once: the totals and the running sums must see the same partitions.
    per = durable(counts.repartitionByRange(n, *g, "__v").withColumn("__part", F.spark_partition_id()), "quantiles")
    whole = Window.partitionBy(*g)  # one row per partition
    up_to = F.sum("__t").over(whole.orderBy("__part"))
    totals = per.groupBy(*g, "__part").agg(F.sum("__c").alias("__t")).withColumns(
        {"__before": up_to - F.col("__t"), "__n": F.sum("__t").over(whole)})
    need = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        need.append(F.struct(F.lit(i).alias("pi"), pos.alias("pos"), F.floor(pos).cast("long").alias("k0"),
                             F.ceil(pos).cast("long").alias("k1")))
    # Every (rank, partition that holds it): partitions of a group cover its ranks exactly once.
    at = totals.select(*g, "__part", "__before", "__t", F.explode(F.array(*need)).alias("w")).select(*g, "__part", "__before", "__t", "w.*")
    at = at.select("*", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("k0").alias("k")),
                                          F.struct(F.lit(1).alias("end"), F.col("k1").alias("k")))).alias("e"))
    at = (at.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], F.col("__part").alias("__p"), "__before", "__t", "pi", "pos", "k0", "e.*")
            .filter((F.col("k") >= F.col("__before")) & (F.col("k") < F.col("__before") + F.col("__t"))))
    inside = Window.partitionBy(*g, "__part").orderBy("__v")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    # only partitions that hold a needed rank are summed up
    run = per.join(at, same, "left_semi").withColumn("__upto", F.sum("__c").over(inside))
    rank = F.col("k") - F.col("__before")
    hit = run.join(at, same & (rank >= F.col("__upto") - F.col("__c")) & (rank < F.col("__upto")))
    value_at = lambda end: F.max(F.when(F.col("end") == end, F.col("__v")))
    one = hit.groupBy(*g, "pi", "pos", "k0").agg(value_at(0).alias("x0"), value_at(1).alias("x1"))
    x = F.col("x0") + (F.col("pos") - F.col("k0")) * (F.col("x1") - F.col("x0"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct(F.col("pi"), x.alias("x")))), lambda e: e["x"])
    return one.groupBy(*g).agg(arr.alias("q"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``describe()``: count, mean, std (n-1), min, 25/50/75 %, max per numeric column."""
    columns = list(columns or numeric_columns(df))
    long = to_long(df, columns, "double").filter(F.col("value").isNotNull())
    moments = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(long, "value", ["column_name"], [0.25, 0.5, 0.75], exact)
    return (moments.join(q, "column_name")
                   .select("column_name", "count", "mean", "std", "min",
                           F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"),
                           "max"))


def box_stats(df: DataFrame, value: str, groups: Sequence[str], exact: bool = True) -> DataFrame:
    """Box-plot numbers per group: quartiles, 1.5 IQR fences, whiskers at the most extreme
    values inside the fences, and the number of values outside them."""
    groups = list(groups)
    q = quantiles(df, value, groups, [0.25, 0.5, 0.75], exact).select(
        *groups, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    # Rows collapse to (group, value, count) in the scan stage, so values and not rows meet the quartiles.
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c"))
    # Group stats have one row per group; null group keys must match as in pandas groupby
    # they are dropped, so an equi join is right.
    j = counts.join(q, groups)
    inside = F.col(value).between(lo, hi)
    return j.groupBy(*groups, "q1", "median", "q3", "iqr").agg(
        F.sum("__c").alias("n"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("__c"))).alias("n_outliers"))


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width histogram per numeric column between its min and max; the top edge
    belongs to the last bin. A constant column puts everything in bin 1."""
    columns = list(columns or numeric_columns(df))
    long = to_long(df, columns, "double").filter(F.col("value").isNotNull())
    bounds = long.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row per profiled column: bounded by the schema width.
    j = long.join(F.broadcast(bounds), "column_name")
    pos = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(pos.cast("int"), F.lit(bins)))
    width = (F.col("hi") - F.col("lo")) / bins
    return (j.withColumn("bin", b)
             .groupBy("column_name", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
             .select("column_name", "bin",
                     (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_low"),
                     (F.col("lo") + F.col("bin") * width).alias("bin_high"), "count"))


def min_max_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """State table (column, min, max) in one pass."""
    wide = df.agg(*[x for c in columns for x in (F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}"))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"mn_{c}").cast("double").alias("min"),
                     F.col(f"mx_{c}").cast("double").alias("max")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


# --- text summary (D9, E2) and duplicates (D11) ---------------------------------------------

def text_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``describe(include='O')``: count, unique, top (most frequent; ties -> smallest value), freq."""
    columns = list(columns or text_columns(df))
    long = to_long(df, columns).filter(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.groupBy("column_name").agg(
        F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top"),
        F.max("cnt").alias("freq"))


def duplicate_count(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows before, rows after full-row de-duplication, and duplicated rows — one grouped
    pass (the distinct rows with their multiplicities). With the number of ``rows`` the one result row is written, by shuffles whose
    tasks hold a bounded number of rows; else it is lazy, with the session's partitions."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__m"))
    out = groups.agg(F.sum("__m").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("duplicated_rows"))
    if rows is None:
        return out
    with sized_shuffles(df.sparkSession, rows):
        return durable(out, "duplicate-count")


# --- ordering, head / tail, samples (F1-F4) ----------------------------------------------------

def head_tail(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First and last ``n`` rows in a total order (a top-k on each end)."""
    asc = [F.col(c).asc_nulls_first() for c in order]
    desc = [F.col(c).desc_nulls_last() for c in order]
    head = df.orderBy(*asc).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(*desc).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def column_samples(df: DataFrame, columns: Sequence[str], row_id: str, n: int = 5,
                   seed: int = 42) -> DataFrame:
    """Up to ``n`` non-null values per column, picked by a seeded md5 of (seed, column, row id),
    so the same rows come back on any partitioning and in any engine.

    Only hashes below a bound per column are ranked, ``SAMPLE_MARGIN`` times as many as are asked for if hashes are even. If
    fewer than ``n`` are found (row ids that repeat), the column is ranked whole. The rows are written once, as they are read
    to count the values and to hash them."""
    names = list(dict.fromkeys([row_id, *columns]))
    rows = durable(df.select(*names), "sampled-rows")
    filled = rows.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first().asDict()
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("column_name"), F.col(row_id)))

    def hashed(cols: list[str]) -> DataFrame:
        ids = rows.select(F.col(row_id).alias("__id"), *cols)
        long = to_long(ids, cols, ids=["__id"]).filter(F.col("value").isNotNull()).withColumnRenamed("__id", row_id)
        return long.select("column_name", key.alias("__h"), "value")

    few = {c: SAMPLE_MARGIN * n for c in columns if filled[c] > SAMPLE_MARGIN * n}
    bound = F.lit(None).cast("string")
    for c, m in few.items():
        bound = F.when(F.col("column_name") == c, f"{m * 16 ** 15 // filled[c]:015x}").otherwise(bound)
    low = hashed(list(columns)).filter(F.coalesce(F.col("__h") < bound, F.lit(True)))
    low = durable(low, "low-hashes")
    found = {r["column_name"]: r["count"] for r in low.groupBy("column_name").count().collect()}
    short = [c for c in few if found.get(c, 0) < n]
    if short:
        low = low.filter(~F.col("column_name").isin(short)).unionByName(hashed(short))
    return top_k_per_group(low, ["column_name"], [F.col("__h")], n).select("column_name", "rank", "value")


def _smallest_rows(columns: list[str], n: int):
    """Per task: for every column the ``n`` non-null values of the rows of smallest hash (closure over pyarrow only)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def fn(batches):
        kept = {c: [] for c in columns}
        for b in batches:
            order = pc.sort_indices(b.column("__h"))
            for c in columns:
                values, hashes = b.column(c).take(order), b.column("__h").take(order)
                first = pc.indices_nonzero(pc.is_valid(values)).slice(0, n)
                found = zip(hashes.take(first).to_pylist(), values.take(first).to_pylist())
                kept[c] = sorted([*kept[c], *found])[:n]
        rows = [(c, h, v) for c, found in kept.items() for h, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["column_name", "h", "value"])
    return fn


def row_samples(df: DataFrame, row_id: str, n: int = 5, seed: int = 42, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, samples): per column the values of the ``n`` rows of smallest md5(seed | row id) among those where it is
    not null, in that order, as text (doubles with six decimals). One scan and one hash a row for all columns; a task
    hands on at most ``n`` values per column, whatever its rows."""
    cols = list(columns or df.columns)
    kinds = dict(df.dtypes)
    text = [F.format_string("%.6f", F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in cols]
    text = [F.when(F.col(c).isNotNull(), t).alias(c) for c, t in zip(cols, text)]
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))
    small = df.select(h.alias("__h"), *text).mapInArrow(_smallest_rows(cols, n), "column_name string, h string, value string")
    top = top_k_per_group(small, ["column_name"], [F.col("h"), F.col("value")], n)
    return top.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))


def group_mean(df: DataFrame, keys: Iterable[str], value: str, alias: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(alias or f"mean_{value}"))
