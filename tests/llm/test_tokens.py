import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from amortia.llm import bpe, near_dup, pretok, wavelet
from amortia.llm.bytesvec import SMALL_BLOCK, text_blocks

from .helpers import COLUMNS, documents, odd_texts, vocabulary

LIB = Tokenizer.from_file(vocabulary())
PIECES = st.lists(st.sampled_from(["a", "b", "s", "t", "'", " ", "  ", "\n", "\t", "1", "²", "é", "ß", "漢", "!", "-", "😀", "re", "ll", "ve", "\x85", "Ⅷ",
                                   "\x1c", "<|endoftext|>", "<|", "hello", "the", "ing", "aaaaaaa", "----"]), max_size=40).map("".join)


def encoded(texts):
    out = []
    table = bpe.load(vocabulary())
    for _, ids, bounds in bpe.tokenised_blocks(pa.array(texts, pa.string()), table.special, table.cache):
        out += [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(PIECES | st.text(max_size=30).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)), min_size=1, max_size=20))
def test_encoding_equals_the_library(texts):
    assert encoded(texts) == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_split_equals_the_public_pattern():
    import public_tokenizers

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(2)
    alphabet = ["a", "s", "'", " ", " ", "\n", "1", "é", "漢", "!", "😀", "re", "ll", "ve", "m", "d", " ", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for first, offsets, data in text_blocks(pa.array(texts), 5000):
        starts = pretok.word_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        got = [[] for _ in range(len(offsets) - 1)]
        for r, s, e in zip(np.searchsorted(offsets, starts, side="right") - 1, starts, ends):
            got[r].append(data[s:e].tobytes().decode())
        assert got == [pattern.findall(t) for t in texts[first:first + len(got)]]


def test_compatible_pairs_are_those_that_bpe_leaves_alone():
    table = bpe.load(vocabulary())
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    ok = table.compatible(a, b)
    joined = [table.token_bytes[x] + table.token_bytes[y] for x, y in zip(a, b)]
    at, token = table.exact(joined)
    for i in range(len(a)):
        assert ok[i] == (token[at == i].tolist() == [a[i], b[i]])


def test_word_cache_starts_over():
    table = bpe.load(vocabulary())
    cache = pretok.WordCache(table.encode_words, limit=5)
    texts = [f"word{i} other{i * 7} the" for i in range(50)]
    out = []
    for text in texts:
        for _, ids, _ in bpe.tokenised_blocks(pa.array([text]), table.special, cache):
            out.append(ids.tolist())
    assert out == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_of_all_kinds(spark):
    docs = documents(spark, odd_texts())
    out = bpe.encode_documents(docs, vocabulary())
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    for r in out.collect():
        ids = LIB.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.token_digests(spark.createDataFrame([], COLUMNS), vocabulary()).count() == 0


def test_wavelet_answers_match_a_list():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 512, 513, 2000):
        ids = rng.integers(0, 40, n).astype(np.uint16)
        s = wavelet.Shard(wavelet.pack(np.array([4]), np.array([False]), np.array([0, n]), ids, 6))
        assert s.decode().tolist() == ids.tolist()
        for i in rng.integers(0, n, 40) if n else []:
            assert s.access(int(i)) == ids[i]
        for v in (0, 3, 39, 63, 64, -1):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            places = np.flatnonzero(ids == v) if v >= 0 else []
            assert s.rank(v, n) == len(places) and s.rank(v, b, a) == (int((ids[a:b] == v).sum()) if v >= 0 else 0)
            for k in range(0, len(places), 7):
                assert s.select(v, k) == places[k]
            assert s.select(v, len(places)) == -1
    with pytest.raises(ValueError):
        wavelet.Shard(b"nope" + bytes(30))


def test_shards_read_back(spark, tmp_path):
    texts = odd_texts()
    path = str(tmp_path / "shards")
    wavelet.write_shards(documents(spark, texts), path, vocabulary(), shards=3)
    got = wavelet.read_documents(spark, path).orderBy("start").collect()
    assert len(got) == len(texts)
    assert [r.doc_id for r in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = lambda t: LIB.encode(t or "", add_special_tokens=False).ids + [0]
    expected = sorted((repr(i), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in texts)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == expected
    empty = str(tmp_path / "none")
    wavelet.write_shards(spark.createDataFrame([], COLUMNS), empty, vocabulary())
    assert wavelet.read_documents(spark, empty).count() == 0


def test_new_words_go_to_the_library_together():
    # a call on each word alone was most of op10's time
    sent = []

    def single(texts):
        sent.append(len(texts))
        ids = [LIB.encode(t, add_special_tokens=False).ids for t in texts]
        return np.array([i for x in ids for i in x], np.uint16), np.array([len(x) for x in ids], np.int64)

    words = ["a", " b", " the", "\n", " ", "  ", " 's", "'s", " \x1cx", " ᠎x", " é漢😀", "ß", " 12", " !?", "<|endoftext|>", " <|endoftext|>", " a b", " x\x85"]
    words += [f" word{i}"[:2 + i % 9] for i in range(300)] + [" " + chr(c) for c in range(0x21, 0x3100, 7)]
    size = np.array([len(w.encode()) for w in words], np.int64)
    length = wavelet._token_bytes(LIB)
    for at_once in (1, 7, 512):
        sent.clear()
        ids, counts = wavelet.encode_joined(words, size, single, length, at_once)
        each = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in each] == [LIB.encode(w, add_special_tokens=False).ids for w in words]
    assert sum(sent) < 0.3 * len(words)
    wrong, _ = wavelet.encode_joined(words, size, single, length + 1, 7), sent.clear()  # lengths that do not add up: each word alone
    assert wrong[0].tolist() == ids.tolist() and wrong[1].tolist() == counts.tolist()
    assert wavelet.encode_joined(words, size, single, None)[0].tolist() == ids.tolist() and sent == [len(words)]
    assert wavelet.encode_joined([], size[:0], single, length)[1].tolist() == []


def peak_mb(work):
    tracemalloc.start()
    try:
        kept = work()
        return [n / 1e6 for n in tracemalloc.get_traced_memory()], kept
    finally:
        tracemalloc.stop()


def test_a_table_keeps_arrays_only():
    (held, _), _ = peak_mb(lambda: bpe.BytePairTable(vocabulary()))
    assert held < 15  # with the dictionary of merges it was 19


def test_small_blocks_hold_little_at_a_time():
    rng = random.Random(5)
    words = ["w" + str(rng.randint(0, 3000)) for _ in range(400_000)]
    texts = pa.array([" ".join(words[i:i + 200]) for i in range(0, len(words), 200)])
    table = bpe.load(vocabulary())
    for _ in near_dup.shingle_blocks(texts, 5):  # tables of hashes are kept from here on
        pass
    (_, most), _ = peak_mb(lambda: [0 for _ in near_dup.shingle_blocks(texts, 5)])
    assert most < 20
    (_, most), _ = peak_mb(lambda: [0 for _ in bpe.tokenised_blocks(texts, table.special, table.cache, SMALL_BLOCK)])
    assert most < 30
    assert encoded(texts[:300].to_pylist()) == [LIB.encode(t, add_special_tokens=False).ids for t in texts[:300].to_pylist()]
