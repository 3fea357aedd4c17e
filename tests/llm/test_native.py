"""Quality rules, line templates and decontamination: odd rows, skew, brute force. (Their queries also have SQL oracles.)"""

import hashlib
import random
import re
from collections import Counter

from amortia.llm import decontam, line_templates, quality

from .helpers import COLUMNS, documents, odd_texts, rows


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def base(text):
    w = words_of(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    texts = odd_texts() + [(50, "a b c a b c d a b c"), (51, "x y x y x y x"), (52, "p q r s p q r s"), (53, "#a\n#a\n \n \nb|")]
    got = quality.score(documents(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = sorted(((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in texts for b in [base(t)]), key=repr)
    assert rows(got) == expected
    assert quality.score(spark.createDataFrame([], COLUMNS)).count() == 0


def test_thresholds_follow_the_source(spark):
    rng = random.Random(1)
    say = lambda mark: " ".join(f"w{rng.randrange(5000)}{mark if rng.random() < 0.5 else ''}" for _ in range(120))
    # source "code" is full of symbols: normal there, junk in "prose"
    rows_ = [(i, say("#") if i % 2 else say(""), "en", "code" if i % 2 else "prose") for i in range(600)]
    rows_ += [(1000, say("#"), "en", "prose"), (1001, say("#"), "en", "code"), (1002, say(""), None, "prose"), (1003, say("#"), None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows_], "doc_id long, text string, lang string, source string, w int, kept int")
    kept = {r.doc_id: r.kept for r in quality.score(df).collect()}
    assert not kept[1000] and kept[1001] and kept[1002]
    assert sum(kept.values()) >= 600
    out = quality.filter_documents(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i, k in kept.items() if k}


def test_sketches_merge_and_bound_the_error(spark):
    values = [0, 1, 31, 32, 63, 64, 65, 127, 128, 1000, 12345, 999_999]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", quality.bucket_floor(quality.bucket_of(df.v)).alias("f")).collect()
    assert all(r.f <= r.v and (r.v - r.f) * 32 <= r.v for r in got)
    parts = [(s, "x", "r", b, 1) for s in "ab" for b in range(10)]
    sketch = spark.createDataFrame(parts, "source string, lang string, rate string, bucket long, n long")
    assert quality.merge(sketch, "lang").agg({"n": "sum"}).first()[0] == 20
    assert quality.merge(sketch, "lang").count() == 10


def test_lines_recur_across_documents(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    body = {i: [say(30), say(30)] for i in range(8)}
    texts = [(i, "\n".join([f"Posted by user{i} on 2024-01-0{i + 1}", *body[i], "All rights reserved worldwide"])) for i in range(8)]
    copy = "\n".join(say(20) for _ in range(4))
    texts += [(20 + i, copy) for i in range(5)] + [(40, "alone\n\nline"), (41, None), (42, ""), (43, " \n\t")]
    docs = documents(spark, texts)
    out = line_templates.drop_recurring_lines(docs)
    assert out.columns[:len(docs.columns) - 1] == [c for c in docs.columns if c != "n_dropped"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    for i in range(8):
        assert got[i] == ("\n".join(body[i]), 4, 2)
    for i in range(5):
        assert got[20 + i] == (copy, 4, 0)  # copies are left to document-level de-duplication
    assert got[40] == ("alone\n\nline", 2, 0) and got[41] == (None, 0, 0) and got[42] == ("", 0, 0) and got[43] == (" \n\t", 0, 0)
    assert line_templates.drop_recurring_lines(spark.createDataFrame([], COLUMNS)).count() == 0


def test_variable_field_meets_in_a_template(spark):
    texts = [(i, f"Read more about the {name} story in our great archive today\n" + " ".join(f"x{i}y{j}" for j in range(30)))
             for i, name in enumerate(["red", "blue", "green"])]
    # masked words share the prose; give each its own letters instead
    texts = [(i, t.split("\n")[0] + "\n" + " ".join(chr(97 + i) * (j + 2) for j in range(40))) for i, t in texts]
    got = line_templates.drop_recurring_lines(documents(spark, texts)).collect()
    assert [r.n_dropped for r in got] == [1, 1, 1]


def test_odd_rows_through_lines(spark):
    docs = documents(spark, odd_texts())
    out = line_templates.drop_recurring_lines(docs)
    assert out.count() == docs.count()


def brute_hits(texts, items, window):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    out = []
    for i, t in texts:
        w, hit, ids = cut(t), set(), set()
        for item, it in items:
            q = cut(it)
            n = min(window, len(q))
            grams = {tuple(q[p:p + n]) for p in range(len(q) - n + 1)} if q else set()
            for p in range(len(w) - n + 1 if q else 0):
                if tuple(w[p:p + n]) in grams:
                    hit |= set(range(p, p + n))
                    ids.add(item)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, items):
    return spark.createDataFrame([(i, t, 5, 6) for i, t in items], "item_id long, text string, d int, term int")


def test_phrases_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"t{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 4, 6, 9]))) for i in range(12)] + [(50, ""), (51, None), (52, "?!"), (53, "É x"), (11, say(5))]
    texts = [(i, say(rng.randint(0, 60))) for i in range(80)] + [(90, None), (91, ""), (92, "--T1,T2;t3"), (93, "é X É x"), (94, items[3][1])]
    texts += [(200 + i, items[5][1] + " and " + items[5][1]) for i in range(40)]  # a hot passage
    out = decontam.contamination(documents(spark, texts), bench(spark, items), window=4).drop("k")
    assert rows(out) == brute_hits(texts, items, 4)
    kept = decontam.drop_contaminated(documents(spark, texts), bench(spark, items), window=4)
    assert kept.columns == documents(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute_hits(texts, items, 4) if not r[5]}


def test_decontamination_of_odd_rows(spark):
    docs = documents(spark, odd_texts())
    items = [(1, "alpha"), (2, "12 34"), (None, "one")]
    out = decontam.contamination(docs, bench(spark, items))
    assert out.count() == len(odd_texts())
    got = {r.doc_id: r for r in out.collect()}
    assert got[8].contaminated and got[8].n_items == 0 and got[12].n_items == 1 and not got[0].contaminated
    empty = spark.createDataFrame([], COLUMNS)
    assert decontam.contamination(empty, bench(spark, items)).count() == 0
    none = decontam.contamination(docs, bench(spark, [])).collect() if False else decontam.contamination(
        docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(odd_texts()) and not any(r.contaminated for r in none)


def test_proximity(spark):
    texts = [(1, "x needle a b haystack y"), (2, "x needle a a a a a a a a a a a a b haystack"), (3, "haystack needle"), (4, "needle a haystack")]
    items = [(7, "needle a b haystack")]
    got = decontam.proximity_matches(documents(spark, texts), bench(spark, items), slop=3)
    keyed = {r.d for r in got.collect()}
    assert 1 in keyed and 2 not in keyed


def test_lines_without_a_digit_skip_the_generalisation(spark):
    # the words of a line are the same either way: also where the text itself holds the mark of a variable word
    lines = ["plain words only here", "order 17 of 20 items shipped", "<*> <*> <*> x", "A9 B8 C7 x", "\tTABS and café ", "", "x٣y arabic digit"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    parsed = line_templates.parsed_lines(docs)
    got = [(x["place"], x["n"], x["templates"][0]) for x in parsed.first()["lines"]]
    words = [["plain", "words", "only", "here"], ["order", "<*>", "of", "<*>", "items", "shipped"], ["<*>", "<*>", "<*>", "x"], ["a9", "b8", "c7", "x"],
             ["tabs and", "café"], [], ["x٣y", "arabic", "digit"]]
    want = spark.createDataFrame([(i, w) for i, w in enumerate(words) if w], "place int, w array<string>")
    assert got == [tuple(r) for r in want.orderBy("place").selectExpr("place", "size(w)", "xxhash64(-1, w)").collect()]
    assert "RLIKE" in parsed._jdf.queryExecution().toString().upper()
