"""Chi-square (with Yates on 2x2), Cramér's V and Pearson against brute force."""

import math
import random

import pytest

from amortia.operators import association


def brute_chi2(xs, ys):
    rx = sorted(set(xs))
    cy = sorted(set(ys))
    n = len(xs)
    obs = {(a, b): 0 for a in rx for b in cy}
    for a, b in zip(xs, ys):
        obs[(a, b)] += 1
    rs = {a: sum(obs[(a, b)] for b in cy) for a in rx}
    cs = {b: sum(obs[(a, b)] for a in rx) for b in cy}
    yates = len(rx) == 2 and len(cy) == 2
    chi = 0.0
    for a, b in obs:
        e = rs[a] * cs[b] / n
        d = abs(obs[(a, b)] - e)
        if yates:
            d = max(d - 0.5, 0.0)
        chi += d * d / e
    return chi, len(rx), len(cy)


@pytest.mark.parametrize("levels", [(2, 2), (3, 4)])
def test_chi_square_and_cramers_v(spark, levels):
    rng = random.Random(3)
    xs = [f"x{rng.randrange(levels[0])}" for _ in range(500)]
    ys = [f"y{rng.randrange(levels[1])}" if rng.random() < 0.7 else xs[i].replace("x", "y")
          for i in range(500)]
    df = spark.createDataFrame(list(zip(xs, ys)), "a string, b string")
    chi = association.chi_square(association.contingency_cells(df, ["a", "b"])).first()
    exp, r, k = brute_chi2(xs, ys)
    assert (chi.r, chi.k) == (r, k)
    assert chi.chi2 == pytest.approx(exp, rel=1e-9)
    v = association.cramers_v_long(df, ["a", "b"]).collect()
    vab = [x.v for x in v if x.col_a == "a" and x.col_b == "b"][0]
    assert vab == pytest.approx(round(math.sqrt(exp / 500 / (min(r, k) - 1)), 6), abs=1e-6)


def test_pearson_pairwise_complete_and_constant(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0), (4.0, 8.0, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    m = {(r.col_a, r.col_b): r.r for r in association.pearson_long(df, ["a", "b", "c"]).collect()}
    pa = [(a, b) for a, b, _ in rows if a is not None and b is not None]
    xa, xb = zip(*pa)
    ma, mb = sum(xa) / 3, sum(xb) / 3
    cov = sum((p - ma) * (q - mb) for p, q in pa)
    r = cov / math.sqrt(sum((p - ma) ** 2 for p in xa) * sum((q - mb) ** 2 for q in xb))
    assert m[("a", "b")] == pytest.approx(round(r, 6)) and m[("b", "a")] == m[("a", "b")]
    assert m[("a", "c")] is None and m[("c", "c")] is None and m[("a", "a")] == 1.0


def test_prune_walk_drops_later_column(spark):
    rows = [(float(i), float(i) * 2 + 1, float((i * 7) % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    dropped = [r.column_name for r in association.prune_walk(association.pearson_long(df, ["a", "b", "c"]),
                                                             "r").collect()]
    assert dropped == ["b"]
