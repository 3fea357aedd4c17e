import re
from itertools import permutations

from amortia.llm import filter_audit

from .helpers import documents, odd_texts

COUNTS = filter_audit.COUNTS


def brute(texts, labels, source=lambda i: "s" if (i or 0) % 5 else ""):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, t in texts:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            f.add("C")
        if re.search("[#$%&*|]", t):
            f.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u in texts):
            f.add("E")
        failed.append((source(i), i, f))
    out = {}
    for part in {p for p, _, _ in failed}:
        shap = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in failed if p == part]
            every, gone = list(left), []
            for step, x in enumerate(order, 1):
                hit = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shap[x] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), sum(x in f for _, f in gone), sum(f == {x} for _, f in every),
                                                   sum(i in good for i, _ in hit), sum(i in bad for i, _ in hit), x]
                gone += hit
        for k, v in out.items():
            if k[0] == part:
                v[6] = shap[v[6]]
    return out


def check(spark, texts, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, mask int, text string") if labels else \
        spark.createDataFrame([], "doc_id long, quality int, toxic int, mask int, text string")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in filter_audit.audit(documents(spark, texts), lab).collect()}
    assert got == brute(texts, [x[:3] for x in labels])
    return got


def test_all_orders_and_counts_equal_brute_force(spark):
    say = " ".join(f"w{i}" for i in range(70))
    texts = odd_texts() + [(20, say), (21, say), (22, say), (23, say.upper()), (24, say + " # x"), (25, say + " # x"), (30, "A# " * 60), (31, "one $"), (35, say), (40, "")]
    labels = [(4, 1, 0, 0, "x"), (20, 1, 0, 0, "x"), (22, 1, 1, 0, None), (23, 0, 1, 0, None), (21, 1, 0, 0, None), (21, 0, 1, 0, None), (99, 1, 1, 0, None), (None, 1, 1, 0, None)]
    got = check(spark, texts, labels)
    assert len(got) == 600 * 2


def test_one_clean_part_has_all_rows_with_zeros(spark):
    say = " ".join(f"w{i}" for i in range(70))
    got = check(spark, [(5, say)], [])
    assert len(got) == 600 and all(v == [1, 0, 0, 0, 0, 0, 0] for v in got.values())


def test_copies_and_repeated_rows(spark):
    say = " ".join(f"w{i}" for i in range(70))
    check(spark, [(i, say) for i in (9, 7, 7, 8, 8, None, 3, 3)], [(7, 1, 0, 0, None), (3, 0, 1, 0, None)])


def test_an_empty_table(spark):
    assert check(spark, [], []) == {}
