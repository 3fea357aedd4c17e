"""Feature state: one-hot categories, min-max bounds, a stable hash split and
class under-sampling, plus the end-to-end training and scoring preparations.

State is kept as small tables — (column, category, position) and (column, min, max) —
that are written once and read back by batch scoring and by the stream.

Scale notes
-----------
* Fitting the encoder is one unpivot + distinct over the categorical columns; the state
  has one row per category, so the transform's column list is category-sized.
* The split is a pure function of a row key (md5), so it is the same on any partitioning,
  on a re-run after executor loss, and in any engine.
* Under-sampling keeps the ``m`` rows of the majority class with the smallest key hash
  without a window over the class: a histogram of the hash's top 16 bits (partial
  aggregate, 65536 rows at most) locates the cut bucket, a second histogram of the low
  16 bits inside that bucket locates the cut hash, and only rows sharing that exact hash
  are ranked by row key. Every step is bounded; no class ever lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amortia.functions import expressions as X
from amortia.operators import clean, profile
from amortia.schemas import FEATURES_RETRAIN, RANDOM_STATE, SCALED_COLUMNS
from amortia.session import durable

CATEGORICAL = ["first_time_homebuyer", "occupancy_status", "channel", "property_type", "loan_purpose",
               "property_valuation_method", "quarter", "region"]


# --- one-hot (I1, I2, A14) ------------------------------------------------------------

def _as_category(c: str) -> Column:
    return F.col(c).cast("string")


def fit_one_hot(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """State table (column_name, category, position, feature_name): categories sorted per
    column with a missing value last (named 'nan'); position 0 is the dropped base level."""
    long = df.select(*[_as_category(c).alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "category")
    cats = long.distinct()
    w = Window.partitionBy("column_name").orderBy(F.col("category").asc_nulls_last())
    return (cats.withColumn("position", (F.row_number().over(w) - 1).cast("int"))
                .withColumn("feature_name",
                            F.concat_ws("_", F.col("column_name"), F.coalesce(F.col("category"), F.lit("nan")))))


def one_hot_transform(df: DataFrame, state: DataFrame | list, on_unknown: str = "error",
                      keep_source: bool = False) -> DataFrame:
    """Replace each categorical column by 0/1 double columns for its non-base categories.

    ``state`` is the fitted table (or its collected rows — category-sized). Unknown
    categories raise (``on_unknown='error'``, as the fitted encoder does), or encode to all
    zeros (``'ignore'``)."""
    rows = state.collect() if isinstance(state, DataFrame) else state
    by_col: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["column_name"], r["position"])):
        by_col.setdefault(r["column_name"], []).append(r)
    out_cols = []
    for c, cats in by_col.items():
        v = _as_category(c)
        guard = None
        if on_unknown == "error":
            known = [r["category"] for r in cats if r["category"] is not None]
            has_null = any(r["category"] is None for r in cats)
            ok = v.isin(*known) if known else F.lit(False)
            ok = (ok | v.isNull()) if has_null else ok
            guard = ~F.coalesce(ok, F.lit(False))
            err = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.coalesce(v, F.lit("null"))))
        for r in cats:
            if r["position"] == 0:
                continue
            hit = v.isNull() if r["category"] is None else (v == F.lit(r["category"]))
            value = F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)
            if guard is not None:
                # The check lives inside every output column, so pruning cannot drop it.
                value = F.when(guard, err).otherwise(value)
            out_cols.append(value.alias(r["feature_name"]))
    encoded = df.select("*", *out_cols)
    return encoded if keep_source else encoded.drop(*by_col)


def split_unknown_categories(df: DataFrame, state: DataFrame | list) -> tuple[DataFrame, DataFrame]:
    """Quarantine policy for unseen categories: (rows whose categories are all known,
    rows with at least one unknown category plus an ``unknown_in`` array naming the columns).
    A pure filter on literal category sets, so it streams and partitions like any filter."""
    rows = state.collect() if isinstance(state, DataFrame) else state
    by_col: dict[str, list] = {}
    for r in rows:
        by_col.setdefault(r["column_name"], []).append(r["category"])
    flags = []
    for c, cats in by_col.items():
        known = [x for x in cats if x is not None]
        v = _as_category(c)
        ok = v.isin(*known) if known else F.lit(False)
        if any(x is None for x in cats):
            ok = ok | v.isNull()
        flags.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)))
    marked = df.withColumn("unknown_in", F.filter(F.array(*flags), lambda x: x.isNotNull()))
    bad = F.size("unknown_in") > 0
    return marked.filter(~bad).drop("unknown_in"), marked.filter(bad)


def encoded_feature_names(state_rows: list) -> list[str]:
    return [r["feature_name"] for r in sorted(state_rows, key=lambda r: (r["column_name"], r["position"]))
            if r["position"] > 0]


# --- min-max (I3, D23, H19, A15) ---------------------------------------------------------

def fit_min_max(df: DataFrame, columns: Sequence[str] = SCALED_COLUMNS) -> DataFrame:
    return profile.min_max_table(df, columns)


def min_max_transform(df: DataFrame, bounds: DataFrame | list, fitting: bool = False) -> DataFrame:
    """Scale with stored bounds, no clipping. ``fitting=True`` maps a constant column to 0
    (the fitted scaler); otherwise equal bounds give null. The bounds table has one row per
    scaled column; its values enter as literals."""
    rows = bounds.collect() if isinstance(bounds, DataFrame) else bounds
    fn = X.min_max if fitting else X.scale_with_bounds
    return df.withColumns({r["column_name"]: fn(r["column_name"], F.lit(r["min"]), F.lit(r["max"]))
                           for r in rows})


# --- split (I4) and under-sampling (I6, E3) ---------------------------------------------

def hash_bucket(key, seed: int = RANDOM_STATE, buckets: int = 10) -> Column:
    """Stable bucket 0..buckets-1 from md5 of 'seed|key' (first 32 bits)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10)
    return (h.cast("bigint") % buckets).cast("int")


def with_split(df: DataFrame, key: str, seed: int = RANDOM_STATE) -> DataFrame:
    """60 / 20 / 20 train / val / test split by a stable hash of the row key."""
    b = hash_bucket(key, seed)
    return (df.withColumn("bucket", b)
              .withColumn("split", F.when(F.col("bucket") < 6, "train").when(F.col("bucket") < 8, "val")
                          .otherwise("test")))


def key_hash32(key: str, seed: int = RANDOM_STATE) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|s|"), F.col(key).cast("string"))), 1, 8),
                  16, 10).cast("bigint")


def smallest_by_hash(df: DataFrame, key: str, m: int, seed: int = RANDOM_STATE) -> DataFrame:
    """The ``m`` rows with the smallest (hash(key), key), found with two bounded histograms
    instead of a global sort. Only a handful of numbers reach the driver."""
    if m <= 0:
        return df.limit(0)
    h = df.withColumn("__h", key_hash32(key, seed))
    hi = h.groupBy((F.col("__h") / 65536).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cut = hi.withColumn("cum", F.sum("n").over(w)).filter(F.col("cum") >= m).orderBy("b").first()
    if cut is None:  # fewer than m rows: keep all
        return h.drop("__h")
    b, before_b = cut["b"], cut["cum"] - cut["n"]
    lo = (h.filter((F.col("__h") / 65536).cast("long") == b)
           .groupBy("__h").agg(F.count(F.lit(1)).alias("n")))
    w2 = Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)
    cut2 = lo.withColumn("cum", F.sum("n").over(w2)).filter(F.col("cum") + before_b >= m).orderBy("__h").first()
    hv, before_h = cut2["__h"], before_b + cut2["cum"] - cut2["n"]
    need = m - before_h
    below = h.filter(F.col("__h") < hv)
    tied = h.filter(F.col("__h") == hv)
    tw = Window.orderBy(F.col(key))
    tied_kept = tied.withColumn("__r", F.row_number().over(tw)).filter(F.col("__r") <= need).drop("__r")
    return below.unionByName(tied_kept).drop("__h")


def undersample(df: DataFrame, label: str, key: str, seed: int = RANDOM_STATE) -> DataFrame:
    """Random under-sampling to the minority class size: every class keeps its ``m`` rows
    with the smallest key hash, ``m`` being the smallest class count."""
    df = durable(df)  # read once per class and per histogram pass
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return df
    m = min(counts.values())
    parts = []
    for cls, n in counts.items():
        sub = df.filter(F.col(label).isNull() if cls is None else F.col(label) == F.lit(cls))
        parts.append(sub if n == m else smallest_by_hash(sub, key, m, seed))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- end-to-end preparations (I13, I14) ----------------------------------------------------

def feature_row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """Key of a feature row from its published columns alone (null is its own value; numbers in
    millionths, so any engine makes the same text), for the split and the sampling of drops,
    which carry no row id."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        x = F.round(F.col(c) * 1_000_000).cast("bigint") if kinds[c] == "double" else F.col(c)
        return F.coalesce(x.cast("string"), F.lit("-"))

    return F.sha2(F.concat_ws("|", *[text(c) for c in columns]), 256)


def training_rows(joined: DataFrame, strict_reference: bool = False, id_col: str = "row_key") -> DataFrame:
    """Label -> feature-row dedup -> region -> sentinels, written once to the shared folder (the
    imputation mean and the cleaned rows both read it). The sentinel tests look only at dedup
    keys, so they go under the dedup. Duplicate feature rows collapse to one; the key is the
    smallest row id, or the hash of the feature row where the input has no id."""
    has_id = id_col in joined.columns
    df = clean.with_target(joined.select(*FEATURES_RETRAIN, *([id_col] if has_id else [])))
    df = clean.sentinel_filter(df, strict_reference)
    feats = [c for c in df.columns if c != id_col]
    if has_id:
        df = df.groupBy(*feats).agg(F.min(id_col).alias(id_col))
    else:
        df = df.dropDuplicates()
        df = df.withColumn(id_col, feature_row_key(df, feats))
    return durable(clean.with_region(df, drop_state=True).drop("cur_LDS"), "training-rows")


def prepare_training(joined: DataFrame, strict_reference: bool = False,
                     id_col: str = "row_key") -> DataFrame:
    """Label -> feature-row dedup -> region -> sentinels -> imputation -> ranges, before encoding."""
    return prepare_training_with_mean(joined, strict_reference, id_col)[0]


def prepare_training_with_mean(joined: DataFrame, strict_reference: bool = False,
                               id_col: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """The prepared rows, and the one-row table of the imputation mean that they were filled with
    (kept with the model: streams impute with it)."""
    rows = training_rows(joined, strict_reference, id_col)
    return clean.range_filter(clean.impute_sentinel(rows)), clean.sentinel_mean(rows)


def prepare_scoring(joined: DataFrame, bounds: DataFrame | list, state: DataFrame | list | None = None,
                    eltv_mean: Column | float | None = None, strict_reference: bool = False,
                    on_unknown: str = "error") -> DataFrame:
    """Keyed keep-first dedup per (loan, quarter) -> region -> sentinels -> imputation (batch
    mean unless a stored mean is given) -> ranges -> encode (optional) -> scale. The quarter
    travels with the row, so no re-attach join is needed."""
    df = clean.sentinel_filter(clean.with_region(clean.dedup_first(joined), drop_state=True), strict_reference)
    if eltv_mean is None:
        # Batch mean: two passes over the de-duplicated rows, so read them from one written copy.
        df = durable(df, "scoring-rows")
    df = clean.range_filter(clean.impute_sentinel(df, mean=eltv_mean))
    if state is not None:
        df = one_hot_transform(df, state, on_unknown, keep_source=True)
    return min_max_transform(df, bounds)
