import hashlib
import random

import numpy as np
import pytest

from amortia.llm import suffix_dedup as sd

from .helpers import COLUMNS, documents, odd_texts, rows


def brute(texts, span):
    seen, out = set(), []
    for i, t in sorted(texts, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            if raw[p:p + span] in seen:
                gone[p:p + span] = b"\1" * span
            else:
                seen.add(raw[p:p + span])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [sd.GROUP_LIMIT, 1])
def test_against_every_window(spark, limit):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) * rng.randint(1, 3)) for i in range(120)]
    texts += [(200, "é" * 90), (201, "a" * 400), (202, None), (203, "a" * 300), (204, "")]
    assert rows(sd.remove_repeats(documents(spark, texts), span=12, group_limit=limit)) == brute(texts, 12)


def test_passages_between_documents(spark):
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = say(150), say(400)
    texts = [(i, say(80) + passage + say(90) + (other[i:i + 130] if i % 2 else "")) for i in range(25)]
    texts += [(100, texts[3][1]), (101, say(99)), (102, texts[4][1][:100])]
    assert rows(sd.remove_repeats(documents(spark, texts))) == brute(texts, 100)


def test_rows_of_all_kinds(spark):
    out = sd.remove_repeats(documents(spark, odd_texts()), with_bytes=True)
    assert out.count() == len(odd_texts())
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id not in (5, 7)}
    assert by_id[0].n_bytes == 0 and by_id[8].n_removed == 0
    text = dict(odd_texts())
    # the null id comes first, so its copy stays whole and the others go
    assert by_id[4].n_removed == by_id[4].n_bytes and by_id[4].kept == b""
    assert by_id[6].kept == b"end"[-0:] if by_id[6].n_removed == by_id[6].n_bytes else by_id[6].n_removed >= len(text[4].encode())
    twice = [r for r in out.collect() if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert sd.remove_repeats(spark.createDataFrame([], COLUMNS)).count() == 0


def test_suffix_sort_is_lexicographic():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    anchor = np.sort(rng.integers(100, 3900, 200))
    group = np.sort(rng.integers(0, 5, 200))
    for backward in (False, True):
        side = sd._Side(data, anchor, np.full(200, 60), backward)
        order, ext = sd.suffix_sort(side, group)
        expected = sorted(range(200), key=lambda i: (group[i], side.raw(i)))
        assert [(group[i], side.raw(i)) for i in order] == [(group[i], side.raw(i)) for i in expected]
        for r in range(1, 200):
            if group[order[r]] == group[order[r - 1]]:
                a, b = side.raw(order[r - 1]), side.raw(order[r])
                assert ext[r] == next((n for n in range(60) if a[n] != b[n]), 60)


def test_hash_collisions_are_verified():
    """With a hash that says equal for everything, the byte check still gives the right order."""
    class Blind(sd._Side):
        def _hash(self, i, n):
            return np.zeros(len(i), np.uint64)

    data = np.frombuffer(b"banana-bandana-cabana-banana", np.uint8)
    anchor = np.array([0, 7, 15, 22])
    side = Blind(data, anchor, np.full(4, 6), False)
    order, ext = sd.suffix_sort(side, np.zeros(4, np.int64))
    assert [side.raw(i) for i in order] == sorted(side.raw(i) for i in range(4))
    assert ext.tolist() == [0, 6, 3, 0]
