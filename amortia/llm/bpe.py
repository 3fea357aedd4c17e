"""Byte-level BPE encoding by speculation and verification, and decoding.

For each distinct word of a task: (1) *speculate*: a vectorised trie walk proposes the greedy longest
tokens; (2) *verify*: every adjacent pair of proposed tokens is tested at once. A pair is compatible
when BPE run over its joined bytes never merges across the border, which is decided by undoing the
merges of both tokens from the latest back and looking up the pair that faces each other at each
step. A sequence of tokens whose adjacent pairs are all compatible is the BPE result; (3) only words
with an incompatible pair go through exact merging. Decoding concatenates token bytes.

Cases: null or empty text has no tokens; the added special tokens of the vocabulary file are found in
the text first, as the library does; repeated rows give repeated results; extra columns are kept by
``encode_documents`` unless named like its own.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from amortia.llm import pretok
from amortia.llm.bytesvec import BLOCK_BYTES, SMALL_BLOCK, text_blocks
from amortia.llm.common import give_back, ship

_loaded: dict[str, "BytePairTable"] = {}
NO_RANK = np.int64(1 << 40)


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stand for
    themselves, the others count up from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairTable:
    """Vocabulary and merges of one byte-level BPE file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_alphabet()
        vocab = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for word, i in [*vocab.items(), *self.special.items()]:
            self.token_bytes[i] = word
        self.byte_id = np.full(256, -1, np.int64)
        for b in range(256):
            self.byte_id[b] = vocab[bytes([b])]
        # rank of the merge that makes a token (-1: a byte), and its two parts
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        merge: dict[tuple[int, int], tuple[int, int]] = {}  # not kept: the sorted arrays below hold the same
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (vocab[bytes(letters[c] for c in x)] for x in (a, b))
            ab = vocab[self.token_bytes[a] + self.token_bytes[b]]
            if (a, b) in merge:
                continue
            merge[a, b] = (r, ab)
            if self.rank[ab] < 0:
                self.rank[ab], self.left[ab], self.right[ab] = r, a, b
        keys = np.array([a << 32 | b for a, b in merge], np.int64)
        order = np.argsort(keys)
        self._pair_keys = keys[order]
        self._pair_ranks = np.array([r for r, _ in merge.values()], np.int64)[order]
        self._merged = np.zeros(len(spec["model"]["merges"]), np.int64)
        for r, ab in merge.values():
            self._merged[r] = ab
        known = list(vocab)
        at, token = self.exact(known)
        whole = np.bincount(at, minlength=len(known)) == 1
        first = token[np.searchsorted(at, np.arange(len(known)))]
        self._build_trie({w: vocab[w] for w, one, t in zip(known, whole, first) if one and t == vocab[w]})
        # flat token bytes, for decoding
        self._lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self._offsets = np.cumsum(self._lengths) - self._lengths
        self._flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def _build_trie(self, reachable: dict[bytes, int]) -> None:
        """Trie of the tokens that BPE can produce: sorted (state, byte) keys -> next state."""
        states: dict[bytes, int] = {b"": 0}
        for w in sorted(reachable):
            for n in range(1, len(w) + 1):
                states.setdefault(w[:n], len(states))
        keys = np.array([states[p[:-1]] << 8 | p[-1] for p in states if p], np.int64)
        to = np.array([s for p, s in states.items() if p], np.int64)
        order = np.argsort(keys)
        self._trie_keys, self._trie_to = keys[order], to[order]
        self._trie_token = np.full(len(states), -1, np.int64)
        for w, i in reachable.items():
            self._trie_token[states[w]] = i

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == key, self._pair_ranks[at], NO_RANK)

    def exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """BPE by its definition, for many words at once: ``(word, token)``. In each round every word
        merges all occurrences, from the left, of its pair of lowest rank; words without a pair
        left are done."""
        lengths = np.array([len(w) for w in words], np.int64)
        token = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            rank = np.full(len(token), NO_RANK)
            if len(token) > 1:
                rank[:-1] = np.where(word[1:] == word[:-1], self.pair_rank(token[:-1], token[1:]), NO_RANK)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, begin), size)
            open_ = least < NO_RANK
            if not open_.all():
                done.append((word[~open_], token[~open_]))
                token, word, rank, least = token[open_], word[open_], rank[open_], least[open_]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == least)
            # of overlapping occurrences (a run of neighbours) every second one, from the left
            fresh = np.concatenate([[True], (np.diff(hit) > 1) | (word[hit[1:]] != word[hit[:-1]])])
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            token[hit] = self._merged[rank[hit]]
            stay = np.ones(len(token), bool)
            stay[hit + 1] = False
            token, word = token[stay], word[stay]
        if not done:
            z = np.zeros(0, np.int64)
            return z, z
        word, token = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Greedy longest tokens of all words at once: ``(word, token)`` in order of words."""
        at = starts.copy()
        alive = np.flatnonzero(at < ends)
        words, tokens, steps = [], [], []
        step = 0
        while len(alive):
            state = np.zeros(len(alive), np.int64)
            pos = at[alive].copy()
            best = np.full(len(alive), -1, np.int64)
            best_end = pos.copy()
            going = np.arange(len(alive))
            while len(going):
                key = state[going] << 8 | data[pos[going]]
                i = np.minimum(np.searchsorted(self._trie_keys, key), len(self._trie_keys) - 1)
                hit = self._trie_keys[i] == key
                going, i = going[hit], i[hit]
                state[going] = self._trie_to[i]
                pos[going] += 1
                tok = self._trie_token[state[going]]
                full = going[tok >= 0]
                best[full] = tok[tok >= 0]
                best_end[full] = pos[full]
                going = going[pos[going] < ends[alive[going]]]
            words.append(alive)
            tokens.append(best)
            steps.append(np.full(len(alive), step))
            at[alive] = best_end
            alive = alive[best_end < ends[alive]]
            step += 1
        if not words:
            z = np.zeros(0, np.int64)
            return z, z
        w, t, s = (np.concatenate(x) for x in (words, tokens, steps))
        order = np.lexsort((s, w))
        return w[order], t[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: does BPE over the joined bytes of a and b leave the border unmerged?"""
        ok = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), NO_RANK)
        todo = np.arange(len(a))
        while len(todo):
            crossing = self.pair_rank(x[todo], y[todo])
            bad = crossing < limit[todo]
            ok[todo[bad]] = False
            todo = todo[~bad]
            rx, ry = self.rank[x[todo]], self.rank[y[todo]]
            todo, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (todo, rx, ry))
            undo_x = rx > ry            # the later merge is undone first; of equal ones the right
            i, j = todo[undo_x], todo[~undo_x]
            limit[i] = rx[undo_x]
            x[i] = self.right[x[i]]
            limit[j] = ry[~undo_x] + 1  # on equal rank the leftmost pair merges first
            y[j] = self.left[y[j]]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of words, by propose, verify, and exact merging of the failures."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        word, token = self.propose(data, ends - lengths, ends)
        inside = word[1:] == word[:-1]
        good = np.ones(len(words), bool)
        pair = np.flatnonzero(inside)
        good[word[pair[~self.compatible(token[pair], token[pair + 1])]]] = False
        special = np.array([i for i, w in enumerate(words) if w in self.special], np.int64)
        good[special] = False
        if good.all():
            return token.astype(np.uint16), np.bincount(word, minlength=len(words))
        redo = np.setdiff1d(np.flatnonzero(~good), special)
        at, fixed = self.exact([words[i] for i in redo.tolist()])
        keep = good[word]
        all_word = np.concatenate([word[keep], redo[at], special])
        all_token = np.concatenate([token[keep], fixed, np.array([self.special[words[i]] for i in special.tolist()], np.int64)])
        order = np.argsort(all_word, kind="stable")
        return all_token[order].astype(np.uint16), np.bincount(all_word, minlength=len(words))

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated token bytes, and the number of bytes of each id."""
        n = self._lengths[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return np.zeros(0, np.uint8), n
        src = np.arange(ends[-1], dtype=np.int64) + np.repeat(self._offsets[ids] - (ends - n), n)
        return self._flat[src], n


def load(path: str) -> BytePairTable:
    """Table and word cache live as long as the Python worker, across tasks."""
    if path not in _loaded:
        _loaded[path] = BytePairTable(path)
        _loaded[path].cache = pretok.WordCache(_loaded[path].encode_words)
        give_back()
    return _loaded[path]


def special_spans(data: np.ndarray, offsets: np.ndarray, special) -> np.ndarray:
    """Starts and ends (two rows) of the special tokens that lie inside one text."""
    raw, spans = data.tobytes(), []
    for word in special:
        at = raw.find(word)
        while at >= 0:
            if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + len(word), side="left"):
                spans.append((at, at + len(word)))
            at = raw.find(word, at + len(word))
    return np.array(sorted(spans), np.int64).reshape(-1, 2).T


def tokenised_blocks(texts: pa.Array, special, cache: pretok.WordCache, block_bytes: int = BLOCK_BYTES):
    """Yield ``(first_row, ids, bounds)`` per block: text i of the block has ``ids[bounds[i]:bounds[i+1]]``."""
    for first, offsets, data in text_blocks(texts, block_bytes):
        begin, end = special_spans(data, offsets, special)
        starts = pretok.word_starts(data, np.unique(np.concatenate([offsets, begin, end])) if len(begin) else offsets)
        if len(begin):  # a special token is one word
            which = np.searchsorted(begin, starts, side="right") - 1
            starts = starts[(which < 0) | (starts == begin[which]) | (starts >= end[which])]
        ids, counts = cache.ids(data, starts)
        per_word = np.concatenate([[0], np.cumsum(counts)])
        yield first, ids, per_word[np.searchsorted(starts, offsets)]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>), ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``round_trip`` (the
    decoded text equals the input) to every row. Columns of these names are replaced. No shuffle."""
    own = ["ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    return _encode(docs, vocabulary, text, [c for c in docs.columns if c not in own], own)


def token_digests(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The same without the id arrays: ``keep`` columns, n_tokens, digests."""
    return _encode(docs, vocabulary, text, list(keep), ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])


_TYPES = {"ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "n_tokens": (T.LongType(), pa.int64()),
          "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string()),
          "round_trip": (T.BooleanType(), pa.bool_())}


def _encode(docs: DataFrame, vocabulary: str, text: str, keep: list[str], own: list[str]) -> DataFrame:
    ship(docs.sparkSession)
    types = dict(zip(docs.columns, docs.schema.fields))
    schema = T.StructType([T.StructField(c, types[c].dataType) for c in keep]
                          + [T.StructField(c, _TYPES[c][0]) for c in own])
    selected = docs.select(*keep, docs[text].alias("__text"))

    def run(batches):
        table = load(vocabulary)
        for b in batches:
            for first, ids, bounds in tokenised_blocks(b.column("__text"), table.special, table.cache, SMALL_BLOCK):
                yield block(table, b.slice(first, len(bounds) - 1), ids, bounds)
        give_back()

    def block(table, rows, ids, bounds):
        """The result rows of one block of texts: only a block's ids and decoded bytes are held."""
        flat, n_bytes = table.decode_bytes(ids)
        byte_at = np.concatenate([[0], np.cumsum(n_bytes)])[bounds]
        offsets, source = next((o, d) for _, o, d in text_blocks(rows.column("__text"), 1 << 62))
        # alike as a whole, or else text by text
        alike = len(flat) == len(source) and (byte_at == offsets).all() and bool((flat == source).all())
        wide, raw, at, ends = ids.astype("<u4"), flat.tobytes(), bounds.tolist(), byte_at.tolist()
        cols = {}
        for c in own:
            if c == "ids":
                cols[c] = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(ids.astype(np.int32)))
            elif c == "n_tokens":
                cols[c] = pa.array(np.diff(bounds), pa.int64())
            elif c == "ids_sha256":
                cols[c] = pa.array([hashlib.sha256(wide[i:j]).hexdigest() for i, j in zip(at, at[1:])], pa.string())
            elif c == "decoded_sha256":
                cols[c] = pa.array([hashlib.sha256(raw[i:j].decode("utf-8", "replace").encode()).hexdigest() for i, j in zip(ends, ends[1:])], pa.string())
            else:
                cols[c] = pa.array([True] * len(rows) if alike else [
                    raw[i:j] == source[k:m].tobytes() for i, j, k, m in zip(ends, ends[1:], offsets.tolist(), offsets[1:].tolist())], pa.bool_())
        return pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [cols[c] for c in own], names=[*keep, *own])

    return selected.mapInArrow(run, schema)
