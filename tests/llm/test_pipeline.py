import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline

from .helpers import documents, vocabulary
from .test_near_dup import brute
from .test_native import base, brute_hits


def test_stages_on_the_smallest_tables(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    columns, seen = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    start, rows = dict(seen), [(r.doc_id, r.text or "", r.lang, r.source) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small).cache()
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "bpe_encode_decode":
            assert docs.columns == columns
        if name == "quality_rules":
            assert {i for i, _ in after} == kept_by_quality(rows)
        elif name == "line_dedup":
            assert sorted(after) == sorted(without_recurring_lines(seen)) != sorted(seen)
        elif name == "near_dedup":
            assert sorted(after) == sorted(x for x, (_, c) in zip(seen, brute(seen, 5)) if x[0] == c)
        elif name == "decontaminate":
            assert {i for i, _ in after} == {r[0] for r in brute_hits(seen, items, 10) if not r[5]}
        else:
            assert sorted(after) == sorted(seen) and all(r.round_trip and r.n_tokens == len(r.ids) for r in docs.collect())
        seen = after
    assert 0 < len(seen) < len(start)


RATES = {"symbol_rate": 100, "upper_rate": 300, "dup_line_rate": 400, "word_length": 300}


def kept_by_quality(rows):
    """Rows (doc_id, text, lang, source) that the adaptive thresholds keep, by sorted lists instead of sketches."""
    found = []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, repeat = base(t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rates = {"symbol_rate": 1000 * symbols // n if n else 0, "upper_rate": 1000 * len(re.findall("[A-Z]", t)) // chars if chars else 0,
                 "dup_line_rate": 1000 * dup // len(lines) if lines else 0, "word_length": 100 * chars // n if n else 0}
        found.append((i, lang, source, n < 50 or 100 * repeat > 50 * n, rates))

    def floor(v):  # least value of the log-linear bucket of v
        e = max(v.bit_length() - 6, 0)
        return v >> e << e

    def limits(values, least):
        values = sorted(map(floor, values))
        q25, q50, q75 = (next(v for k, v in enumerate(values, 1) if 100 * k >= p * len(values)) for p in (25, 50, 75))
        room = max(4 * (q75 - q25), least)
        return q50 - room, q50 + room

    good = [x for x in found if not x[3]]
    out = set()
    for i, lang, source, failed, rates in good:
        own = [x for x in good if x[1:3] == (lang, source)]
        language = [x for x in good if x[1] == lang]
        judge = own if len(own) >= 100 else language if len(language) >= 100 else good
        if all(lo <= rates[r] <= hi for r, least in RATES.items() for lo, hi in [limits([x[4][r] for x in judge], least)]):
            out.add(i)
    return out


def without_recurring_lines(texts):
    """(doc_id, text) less the lines of templates that three rows or more share, unless they are most of the text."""
    def templates(line):
        low = [w for w in re.split(r"[\x09-\x0D\x20]+", line.lower()) if w]
        w = ["<*>" if re.search("[0-9]", x) else x for x in low]
        w = w if 2 * w.count("<*>") <= len(w) else low
        n, out = len(w), {(-1, tuple(w))} if w else set()
        for k in range(3):
            a, b = (n - 2) * k // 3, (n - 2) * (k + 1) // 3
            if w and b > a and n - (b - a) >= 4:
                out.add((k, n, tuple(w[:a + 2]), tuple(w[b + 2:])))
        return n, out

    parsed = [(i, t, [(line, *templates(line)) for line in t.split("\n")]) for i, t in texts]
    rows = Counter(x for _, _, lines in parsed for x in {y for _, _, t in lines for y in t})
    out = []
    for i, t, lines in parsed:
        hit = [any(rows[x] >= 3 for x in found) for _, _, found in lines]
        cut = 2 * sum(n for (_, n, _), h in zip(lines, hit) if h) <= sum(n for _, n, _ in lines)
        out.append((i, "\n".join(line for (line, _, _), h in zip(lines, hit) if not (h and cut)) if any(hit) and cut else t))
    return out


def test_run_equals_a_plain_version_row_by_row(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    kept = kept_by_quality([(r.doc_id, r.text or "", r.lang, r.source) for r in docs])
    seen = without_recurring_lines([(r.doc_id, r.text) for r in docs if r.doc_id in kept])
    cut = {i for (i, t), r in zip(seen, (r for r in docs if r.doc_id in kept)) if t != r.text}
    seen = [x for x, (_, c) in zip(seen, brute(seen, 5)) if x[0] == c]
    gone = {r[0] for r in brute_hits(seen, items, 10) if r[5]}
    seen = [x for x in seen if x[0] not in gone]
    assert 0 < len(kept) < len(docs) and cut and len(seen) < len(kept)
    lib = Tokenizer.from_file(vocabulary())
    by_id = {r.doc_id: r for r in docs}
    want = sorted((i, t, by_id[i].lang, by_id[i].source, len(t) if i in cut else by_id[i].n_chars, lib.encode(t, add_special_tokens=False).ids) for i, t in seen)
    out = corpus_pipeline.run(spark, sf_small)
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.ids) for r in out.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "bpe_encode_decode"]


def test_stages_take_odd_rows(spark, sf_small):
    rng_words = " ".join(f"w{i}" for i in range(80))
    docs = documents(spark, [(1, rng_words), (None, rng_words), (2, None), (2, None), (3, ""), (4, rng_words + " x"), (4, rng_words)])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert [r.doc_id for r in docs.collect()] == [1]
    assert not re.search("n_lines", " ".join(docs.columns))
