import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from amortia.llm import near_dup
from amortia.llm.components import components

from .helpers import COLUMNS, documents, odd_texts, rows


def brute(texts, k, percent=80):
    """Per row: (set size, smallest id of the component)."""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(sets)):
        members[root(i)].append(texts[i][0])
    return [(len(s), texts[i][0] if not s else min((x for x in members[root(i)] if x is not None), default=None)) for i, s in enumerate(sets)]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10_000)}"
    return " ".join(out)


def check(spark, texts, k):
    got = near_dup.near_duplicates(documents(spark, texts), k=k).select("doc_id", "n_shingles", "component_id", "kept")
    expected = sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(texts, brute(texts, k))), key=repr)
    assert rows(got) == expected


def test_chains_and_large_groups(spark):
    rng = random.Random(4)
    texts, i = [], 0
    for base in range(4):  # a chain of edits: far ends are unlike, neighbours alike
        words = [f"w{rng.randrange(10_000)}" for _ in range(60)]
        for _ in range(14):
            texts.append((i * 3 % 997, " ".join(words)))
            i += 1
            for _ in range(3):
                words[rng.randrange(60)] = f"w{rng.randrange(10_000)}"
    words = [f"w{rng.randrange(10_000)}" for _ in range(80)]
    for _ in range(60):  # one large group around a base, some just below the similarity
        texts.append((i * 3 % 997, edited(rng, words, rng.randrange(0, 9))))
        i += 1
    check(spark, texts, 2)
    check(spark, texts, 5)


def test_exact_rest_in_blocks(spark, monkeypatch):
    """A group around a base whose members are partly too far from the centre, in blocks of three."""
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 3)
    found = []
    rest = near_dup._exact_rest
    monkeypatch.setattr(near_dup, "_exact_rest", lambda *a: found.append(1) or rest(*a))
    rng = random.Random(12)
    words = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    texts = [(i, edited(rng, words, rng.randrange(0, 14))) for i in range(70)]
    far = [edited(rng, words, 14).split() for _ in range(4)]  # pairs that are alike and both far from the base
    texts += [(100 + 2 * i + j, edited(rng, f, j)) for i, f in enumerate(far) for j in range(2)]
    check(spark, texts, 2)
    assert found


def test_documents_of_all_kinds(spark):
    check(spark, odd_texts(), 2)
    check(spark, [t for t in odd_texts() if t[0] is not None], 5)
    assert near_dup.near_duplicates(spark.createDataFrame([], COLUMNS)).count() == 0


def test_drop_keeps_one_row_a_group(spark):
    docs = documents(spark, odd_texts())
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
    t = dict(odd_texts())
    both = [x for i, x in odd_texts() if i == 7]
    assert got == sorted([(1, ""), (2, " \n\t "), (3, t[3]), (4, t[4]), (7, both[0]), (7, both[1]), (8, "one"), (10, t[10]), (11, "!!!"), (12, "12 34")] + [(0, None)],
                         key=lambda x: (x[0], x[1] or "")) or sorted(map(repr, got)) == sorted(map(repr, [
                             (0, None), (1, ""), (2, " \n\t "), (3, t[3]), (4, t[4]), (7, both[0]), (7, both[1]), (8, "one"), (10, t[10]), (11, "!!!"), (12, "12 34")]))
    assert [r.text for r in kept.collect() if r.doc_id is None] == [None]
    twice = documents(spark, [(1, "a b c"), (1, "a b c"), (2, None), (2, None)])
    assert sorted(map(repr, ((r.doc_id, r.text) for r in near_dup.drop_near_duplicates(twice).collect()))) == ["(1, 'a b c')", "(2, None)", "(2, None)"]


def test_pigeonhole_keys():
    """Signatures at distance 31 share a key whatever the places; at 32 a pair without one exists."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, near_dup.SYMBOLS, dtype=np.uint16)

    def keys(sig):
        return {(c, out, tuple(np.delete(sig[c * 7:c * 7 + 7], out))) for c in range(near_dup.CHUNKS) for out in range(near_dup.WIDTH)}

    for _ in range(200):
        b = a.copy()
        b[rng.permutation(near_dup.SYMBOLS)[:31]] ^= 1
        assert keys(a) & keys(b)
    b = a.copy()
    for c in range(near_dup.CHUNKS):
        b[c * 7:c * 7 + 2] ^= 1
    assert not keys(a) & keys(b)


def test_shingles_of_short_texts():
    out = {}
    for first, n, r, _ in near_dup.shingle_blocks(pa.array(["", "a", "A", "a b", "a b a b", None, " b\x0ba "]), 2):
        out.update({first + i: int((r == i).sum()) for i in range(n)})
    assert [out[i] for i in range(7)] == [0, 1, 1, 1, 2, 0, 1]


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (100, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_similarity_that_signatures_cannot_hold_is_refused(spark):
    docs = documents(spark, odd_texts())
    for run in (near_dup.near_duplicates, near_dup.drop_near_duplicates):
        with pytest.raises(ValueError, match="0.5 is below 0.8"):
            run(docs, similarity=0.5)
