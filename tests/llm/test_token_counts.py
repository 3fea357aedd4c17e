import random

import numpy as np
import pytest
import sentencepiece

from amortia.llm import token_counts
from amortia.llm.queries import PIECES, vocabulary_path

from .helpers import documents, odd_texts, rows

MODEL = vocabulary_path(PIECES)
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(texts):
    out = []
    for i, t in texts:
        n = len(LIB.encode(t or ""))
        out.append((i, len((t or "").encode()), n, n > 4096))
    return sorted(out, key=repr)


def test_counts_equal_the_library(spark):
    rng = random.Random(5)
    bits = [*"ab c  \n\t.▁<s>éà漢字🙂1:0x\r{}", "</s>", "<unk>", "  ", "the", "ing", "   ", "\x00", "<0x0A>"]
    texts = odd_texts() + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    texts += [(600, "x" * 30_000), (601, "word " * 9_000), (602, "▁"), (603, " "), (604, "漢" * 700)]
    got = rows(token_counts.count_tokens(documents(spark, texts), MODEL))
    assert got == expected(texts)


def test_counts_do_not_depend_on_the_table(spark, monkeypatch):
    texts = [(i, t) for i, (_, t) in enumerate(odd_texts())]
    docs = documents(spark, texts)
    for size in (0, 1, 3):
        monkeypatch.setattr(token_counts, "TABLE", size)
        assert rows(token_counts.count_tokens(docs, MODEL)) == expected(texts)


def test_an_empty_table(spark):
    assert token_counts.count_tokens(documents(spark, []), MODEL).count() == 0


def test_slots_hold_every_key_and_no_other():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(1, 1 << 63, 3000, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFF000F))  # crowded slots
    size, n = rng.integers(1, 60, len(h)), rng.integers(0, 40, len(h))
    table = token_counts._slots(h, size, n)
    assert (token_counts._look_up(table, h, size) == n).all()
    assert (token_counts._look_up(table, h, size + 1) == -1).all()
    assert (token_counts._look_up(table, h ^ np.uint64(1 << 40), size) == -1).all()


def test_summary_is_bounded_and_keeps_the_frequent():
    kept = token_counts.Summary(50)
    rng = random.Random(1)
    for _ in range(200):
        words = [b"often%d" % (i % 20) for i in range(100)] + [b"rare%d" % rng.randrange(10**6) for _ in range(60)]
        kept.add(words, [1] * len(words))
        assert len(kept._counts) <= 4 * 50 + len(words)
    found = dict(kept.rows())
    assert len(found) <= 50 and all(b"often%d" % i in found for i in range(20))


def test_the_whole_smallest_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert rows(token_counts.count_tokens(docs, MODEL)) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_a_vocabulary_that_normalises_is_refused(tmp_path):
    with pytest.raises(Exception):
        token_counts.Pieces(b"not a model")
