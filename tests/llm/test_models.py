import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from amortia.llm import bloom_lm, langid

from .helpers import COLUMNS, documents, odd_texts


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def held(i, mod):
    return i is not None and zlib.crc32(str(i).encode()) % mod == 2


def check_base(out, texts):
    counts = Counter()
    for i, t in texts:
        if not held(i, 7):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((repr(i), held(i, 7), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
                       for i, t in texts for w in [tokens(t)]))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected


def test_scores(spark):
    out = bloom_lm.score_documents(documents(spark, odd_texts())).collect()
    check_base(out, odd_texts())
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert bloom_lm.score_documents(spark.createDataFrame([], COLUMNS)).count() == 0


def test_bigrams_help_on_held_out_text(spark):
    rng = random.Random(9)
    follow = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(3)] for i in range(200)}

    def walk(n):
        w = [f"w{rng.randrange(200)}"]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    texts = [(i, walk(150)) for i in range(150)]
    out = bloom_lm.score_documents(documents(spark, texts)).collect()
    check_base(out, texts)
    gain = [r.score - r.base_score for r in out if r.held_out]
    assert gain and min(gain) > 0
    # a filter of 1 KB cannot hold all levels: the cutoff rises, results stay defined
    small = bloom_lm.score_documents(documents(spark, texts), max_filter_bytes=1024).collect()
    check_base(small, texts)
    assert all(math.isfinite(r.score) for r in small)


def test_filter_reads_back_levels(spark):
    texts = [(i, "common " * 40 + f"rare{i} twice{i // 2}") for i in range(60)]
    rows = bloom_lm._rows(documents(spark, texts), "text")
    table, bits, least, _ = bloom_lm.build_filter(rows, 4)
    counts = Counter(x for i, t in texts if not held(i, 7) for x in tokens(t))
    import pyarrow as pa

    words = ["common", *(f"rare{i}" for i in range(60)), "absent1", "absent2"]
    got = []
    for _, bounds, toks in bloom_lm.token_blocks(pa.array(words)):
        one, _ = bloom_lm.ngram_places(bounds, toks, 4)
        got += bloom_lm.probe_counts(table, bits, least, one)[bounds[:-1]].tolist()
    c = counts[b"common"]
    assert 0.5 * c <= got[0] <= 3 * c  # one-sided: a false positive can only raise it
    assert sum(x > 0 for x in got[1:]) <= 12  # seen once or never


def test_languages(spark):
    rng = random.Random(3)
    kinds = {"en": ["the", "thing", "with", "ation"], "de": ["und", "schei", "ung", "über"], "fr": ["eau", "être", "oux", "ç"]}
    rows, truth = [], {}
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        noisy = lang if i % 29 else "en"
        rows.append((i, text, noisy))
        truth[i] = lang
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (None, "the thing with", None), (1003, "the " * 30_000, None)]
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred int, score string")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(out) == len(rows)
    test = [i for i in truth if held(i, 4)]
    assert all(out[i].held_out for i in test)
    assert np.mean([out[i].lang_pred == truth[i] for i in test]) >= 0.95
    for i in (1000, 1001, 1002):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out[None].lang_pred == out[1003].lang_pred == "en" and 0 <= out[None].score <= 1
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und"
    assert langid.identify(spark.createDataFrame([], COLUMNS)).count() == 0


def test_small_filter_pieces_lose_no_level(spark):
    texts = [(i, " ".join(f"p{j}" for j in range(i % 50, i % 50 + 60))) for i in range(200)]
    whole = {r.doc_id: r.score for r in bloom_lm.score_documents(documents(spark, texts)).collect()}
    small = {r.doc_id: r.score for r in bloom_lm.score_documents(documents(spark, texts), max_filter_bytes=64).collect()}
    # every n-gram is frequent: with levels left out its count would be read as 0 and the score fall to smoothing
    assert all(abs(whole[i] - small[i]) < 0.05 * abs(whole[i]) for i in whole)


def test_ngrams_seen_once_are_known(spark):
    # two held-out texts of words that training holds once each or never
    held_ids = [i for i in range(2000) if held(i, 7)][:2]
    free = [i for i in range(2000) if not held(i, 7)][:60]
    once = " ".join(f"solo{j}" for j in range(40))
    texts = [(free[0], once), (held_ids[0], once), (held_ids[1], " ".join(f"never{j}" for j in range(40)))]
    texts += [(i, " ".join(f"pad{i}x{j}" for j in range(40))) for i in free[1:]]
    got = {r.doc_id: r.score for r in bloom_lm.score_documents(documents(spark, texts)).collect()}
    assert got[held_ids[0]] > got[held_ids[1]] + 40
    rows = bloom_lm._rows(documents(spark, texts), "text")
    table, bits, least, _ = bloom_lm.build_filter(rows, 4, bloom_lm.LEAST)
    places = bloom_lm.place_of(np.concatenate([t for _, _, t in bloom_lm.token_blocks(pa.array([once]))])[:-1], 4, 1)
    counts = bloom_lm.probe_counts(table, bits, least, places)
    assert (counts >= 1).all() and np.median(counts) == 1
