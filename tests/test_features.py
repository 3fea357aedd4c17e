"""Feature state, split and sampling."""

import pytest
from pyspark.sql import functions as F

from amortia.operators import features


def test_one_hot_sorted_first_dropped_null_last(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "channel string")
    state = features.fit_one_hot(df, ["channel"]).collect()
    order = [(r.category, r.position, r.feature_name) for r in sorted(state, key=lambda r: r.position)]
    assert order == [("a", 0, "channel_a"), ("b", 1, "channel_b"), ("c", 2, "channel_c"), (None, 3, "channel_nan")]
    enc = features.one_hot_transform(df, state).collect()
    assert [(r.channel_b, r.channel_c, r.channel_nan) for r in enc] == [
        (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0)]


def test_one_hot_unknown_category_raises(spark):
    fit = spark.createDataFrame([("a",), ("b",)], "channel string")
    state = features.fit_one_hot(fit, ["channel"]).collect()
    new = spark.createDataFrame([("z",)], "channel string")
    with pytest.raises(Exception, match="unknown category"):
        features.one_hot_transform(new, state).collect()
    ok = features.one_hot_transform(new, state, on_unknown="ignore").first()
    assert ok.channel_b == 0.0


def test_min_max_constant_column_and_no_clipping(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    bounds = features.fit_min_max(df, ["a", "b"]).collect()
    fitted = features.min_max_transform(df, bounds, fitting=True).collect()
    assert [(r.a, r.b) for r in fitted] == [(0.0, 0.0), (1.0, 0.0)]
    new = spark.createDataFrame([(5.0, 5.0)], "a double, b double")
    scaled = features.min_max_transform(new, bounds).first()
    assert scaled.a == 2.0 and scaled.b is None


def test_hash_split_is_stable_and_roughly_60_20_20(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    a = features.with_split(df, "k").groupBy("split").count().collect()
    b = features.with_split(df.repartition(7), "k").groupBy("split").count().collect()
    assert sorted(a) == sorted(b)
    share = {r.split: r["count"] / 20000 for r in a}
    assert abs(share["train"] - 0.6) < 0.02 and abs(share["val"] - 0.2) < 0.02


def test_undersample_keeps_exactly_the_smallest_hashes(spark):
    rows = [(str(i), i % 5 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_key string, target boolean")
    got = features.undersample(df, "target", "row_key")
    counts = {r.target: r["count"] for r in got.groupBy("target").count().collect()}
    assert counts[True] == counts[False] == 600
    # brute force: the 600 majority rows with the smallest (hash, key)
    h = features.key_hash32("row_key")
    brute = (df.filter(~F.col("target")).withColumn("h", h).orderBy("h", "row_key").limit(600)
               .select("row_key").collect())
    picked = got.filter(~F.col("target")).select("row_key").collect()
    assert sorted(r.row_key for r in brute) == sorted(r.row_key for r in picked)


def test_exact_quantiles_match_numpy_with_forced_refinement(spark):
    import numpy as np
    from amortia.operators import profile
    rng = np.random.default_rng(5)
    vals = {"a": rng.lognormal(3, 2, 4000), "b": np.round(rng.normal(0, 1, 3000), 2), "c": np.array([7.0])}
    rows = [(g, float(x)) for g, xs in vals.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.25, 0.5, 0.75]
    got = {r.g: r.q for r in profile.exact_quantiles(df, "x", ["g"], probs, partitions=5).collect()}
    for g, xs in vals.items():
        assert got[g] == pytest.approx(list(np.quantile(xs, probs)), rel=1e-12, abs=1e-12), g


def test_box_stats_and_histogram_against_numpy(spark):
    import numpy as np
    from amortia.operators import profile
    rng = np.random.default_rng(9)
    xs = np.concatenate([rng.normal(100, 10, 500), [10.0, 250.0, 260.0]])
    df = spark.createDataFrame([("g", float(x)) for x in xs], "g string, x double")
    b = profile.box_stats(df, "x", ["g"]).first()
    q1, med, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
    iqr = q3 - q1
    inside = xs[(xs >= q1 - 1.5 * iqr) & (xs <= q3 + 1.5 * iqr)]
    assert (b.q1, b.median, b.q3) == pytest.approx((q1, med, q3))
    assert (b.whisker_low, b.whisker_high) == (inside.min(), inside.max())
    assert b.n_outliers == len(xs) - len(inside)
    h = {r.bin: r["count"] for r in profile.histogram(df.select("x"), ["x"], 30).collect()}
    counts, _ = np.histogram(xs, bins=30)
    assert [h.get(i + 1, 0) for i in range(30)] == list(counts)


def test_text_summary_ties_and_coverage_with_nulls(spark):
    from amortia.operators import profile
    df = spark.createDataFrame([("b", None), ("a", 1.0), ("b", 1.0), ("a", None), (None, 2.0)], "t string, x double")
    ts = profile.text_summary(df, ["t"]).first()
    assert (ts["count"], ts["unique"], ts["top"], ts["freq"]) == (4, 2, "a", 2)   # tie -> smallest value
    cov = {r.column_name: r for r in profile.coverage_profile(df, None).collect()}
    assert cov["t"].non_null == 4 and cov["t"].num_unique_values == 2 and cov["t"].coverage_ratio == 0.8
    assert cov["x"].non_null == 3 and cov["x"].num_unique_values == 2 and cov["x"].dtype == "double"
    assert [r.column_name for r in profile.coverage_profile(df, 0.7).collect()] == ["t"]


def test_unknown_categories_quarantined(spark):
    fit = spark.createDataFrame([("a", "x"), ("b", None)], "channel string, region string")
    state = features.fit_one_hot(fit, ["channel", "region"]).collect()
    new = spark.createDataFrame([("a", "x"), ("z", "x"), ("b", "q"), ("a", None)], "channel string, region string")
    good, bad = features.split_unknown_categories(new, state)
    assert sorted(((r.channel, r.region) for r in good.collect()), key=repr) == [("a", "x"), ("a", None)]
    assert sorted((r.channel, list(r.unknown_in)) for r in bad.collect()) == [("b", ["region"]), ("z", ["channel"])]
