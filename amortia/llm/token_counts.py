"""Token counts by a map-side lookup in two tiers, without shuffling pre-tokens.

The text (blanks as the vocabulary's word mark, one put in front) is cut between two characters wherever
no piece of the vocabulary holds them side by side. No merge can cross such a cut, so the counts of the
parts, the pre-tokens, add up to the count of the text.

1. *Frequent pre-tokens.* Every task folds its rows into a bounded summary (``SUMMARY`` pre-tokens, each
   with a count that is too low by at most the rows dropped to make room: the usual heavy-hitter
   summary). The summaries are merged and the ``TABLE`` best get their token counts. Only these
   summaries are shuffled, never the pre-tokens of the corpus.
2. *Lookup.* The table is broadcast as two arrays (64-bit hash with open addressing, and the count; at
   most 2 * ``TABLE`` slots of 10 bytes). A task hashes all pre-tokens of a block at once and looks them
   up. Misses are looked up by their bytes in the worker's own cache (at most ``CACHE_BYTES``) and only
   new ones are encoded by the library.

What the table holds changes the speed, not the counts. A table entry is taken for a pre-token whose
64-bit hash and byte length agree (chance of a mix-up below 1e-8 for a billion different pre-tokens).

Cases: a null text is empty and has 0 bytes and 0 tokens; very long texts make a block of their own;
repeated rows give repeated results; an empty table gives an empty result; further columns are not read,
whatever their names. Control pieces written out in a text are ordinary text, as the library has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amortia.llm.bytesvec import Spans, mix, text_blocks
from amortia.llm.common import ship

TABLE = 65_536            # entries of the broadcast table
SUMMARY = 8_192           # pre-tokens that a task's summary keeps
KEY_BYTES = 64            # longest pre-token of the table
CACHE_BYTES = 24 << 20    # of a worker's cache
CACHE_KEY_BYTES = 512     # longer pre-tokens are encoded each time
LIMIT = 4096

MARK = "▁"           # fixed value: the word mark of the vocabulary
APART = "\n"              # a character that no piece of several characters holds

_loaded: dict[int, "Pieces"] = {}


class Pieces:
    """A piece vocabulary: where texts may be cut, and token counts of pre-tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self._sp
        # together[x, y]: some piece holds a character that ends in byte x before one that starts with byte y
        self.together = np.zeros((256, 256), bool)
        inside = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if len(piece) < 2 or sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i):
                continue
            chars = [c.encode() for c in piece.replace(MARK, " ")]
            inside.update(piece)
            for a, b in zip(chars, chars[1:]):
                self.together[a[-1], b[0]] = True
        if APART in inside:
            raise ValueError("the vocabulary has pieces that hold a line break: another separator is needed")
        if sp.encode("a  b" + APART, out_type=str) != sp.encode("a  b", out_type=str) + sp.encode("a" + APART, out_type=str)[1:] \
                or sp.normalize("ﬁ  x ") != MARK + "ﬁ  x ".replace(" ", MARK):
            raise ValueError("only vocabularies without text normalisation and with a word mark in front are handled")
        self._apart = len(sp.encode(APART))

    def lengths(self, words: list[bytes]) -> list[int]:
        """Token counts of pre-tokens, each encoded behind a separator that merges with nothing."""
        ids = self._sp.encode([APART + w.decode() for w in words], num_threads=1)
        return [len(x) - self._apart for x in ids]


def _pieces(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def _pretokens(texts: pa.Array, together: np.ndarray):
    """Per block ``(first_row, rows, found)`` with ``found`` = (row of each pre-token, start, end, hash, data), None in a
    block without text. The blank in front of every text is part of the data."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    none, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    texts = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(none, texts, blank))
    for first, offsets, data in text_blocks(texts):
        if not len(data):
            yield first, len(offsets) - 1, None
            continue
        begin = np.zeros(len(data), bool)
        begin[1:] = ~together[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        at = offsets[:-1]
        begin[at[at < len(data)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(offsets, start, side="right") - 1
        h = mix(Spans(data).hash(start, end) + (end - start).astype(np.uint64))
        yield first, len(offsets) - 1, (row, start, end, h, data)


class Summary:
    """Heavy hitters of a stream of counted keys in bounded memory: when full, the count of the first key that does not
    fit is taken from all that stay."""

    def __init__(self, size: int = SUMMARY):
        self._size = size
        self._counts: dict[bytes, int] = {}

    def add(self, keys: list[bytes], counts: list[int]) -> None:
        have = self._counts
        for k, n in zip(keys, counts):
            have[k] = have.get(k, 0) + n
        if len(have) > 4 * self._size:
            self._shrink()

    def _shrink(self) -> None:
        keys, counts = list(self._counts), np.fromiter(self._counts.values(), np.int64, len(self._counts))
        order = np.argsort(-counts, kind="stable")
        cut = counts[order[self._size]] if len(order) > self._size else 0
        self._counts = {keys[i]: int(counts[i] - cut) for i in order[:self._size].tolist() if counts[i] > cut}

    def rows(self) -> list[tuple[bytes, int]]:
        if len(self._counts) > self._size:
            self._shrink()
        return list(self._counts.items())


def frequent_pretokens(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """(word, n) summaries of all tasks, merged: candidates of the table. ``model`` is the broadcast vocabulary file."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def fold(batches):
        together = _pieces(model.value).together
        kept = Summary()
        for b in batches:
            for _, _, found in _pretokens(b.column(0), together):
                if found is None:
                    continue
                _, start, end, h, data = found
                short = np.flatnonzero(end - start <= KEY_BYTES)
                _, at, n = np.unique(h[short], return_index=True, return_counts=True)
                many = n > 1  # once in a block of a megabyte is not frequent
                at, n = short[at[many]], n[many]
                raw = data.tobytes()
                kept.add([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())], n.tolist())
        rows = kept.rows()
        yield pa.record_batch([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], schema=schema)

    return docs.select(F.col(text).cast("string")).mapInArrow(fold, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _slots(hashes: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
    """Open-addressing table: key (0: free) and byte length * 65536 + token count per slot."""
    size = 1 << max(4, int(2 * max(1, len(hashes)) - 1).bit_length())
    keys, values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
    slot = (hashes & np.uint64(size - 1)).astype(np.int64)
    value = (lengths.astype(np.int64) << 16 | counts).astype(np.int32)
    left = np.arange(len(hashes))
    while len(left):
        free = keys[slot[left]] == 0
        keys[slot[left[free]]] = hashes[left[free]]
        mine = keys[slot[left]] == hashes[left]
        values[slot[left[mine]]] = value[left[mine]]
        left = left[~mine]
        slot[left] = (slot[left] + 1) & (size - 1)
    return keys, values


def _look_up(table, h: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Token count of each pre-token, -1 where the table has none."""
    keys, values = table
    out = np.full(len(h), -1, np.int64)
    slot = (h & np.uint64(len(keys) - 1)).astype(np.int64)
    left = np.arange(len(h))
    while len(left):
        key = keys[slot[left]]
        hit = key == h[left]
        at = left[hit]
        v = values[slot[at]]
        out[at] = np.where(v >> 16 == length[at], v & 0xFFFF, -1)
        left = left[~hit & (key != 0)]
        slot[left] = (slot[left] + 1) & (len(keys) - 1)
    return out


class WorkerCache:
    """Token counts by the pre-token's bytes, encoded once per worker; starts over at ``CACHE_BYTES``."""

    def __init__(self, pieces: Pieces):
        self._pieces, self._have, self._size = pieces, {}, 0

    def lengths(self, words: list[bytes]) -> np.ndarray:
        get = self._have.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            found = self._pieces.lengths([words[i] for i in new])
            out[new] = found
            if self._size > CACHE_BYTES:
                self._have.clear()
                self._size = 0
            for i, n in zip(new, found):
                if len(words[i]) <= CACHE_KEY_BYTES:
                    self._have[words[i]] = n
                    self._size += len(words[i]) + 120
        return out


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    best = frequent_pretokens(docs, model, text).orderBy(F.desc("n"), "word").limit(TABLE).collect()  # at most TABLE short words
    words = [bytes(r["word"]) for r in best]
    counts = np.array(_pieces(model.value).lengths(words), np.int64) if words else np.zeros(0, np.int64)
    joined = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    h = mix(Spans(joined).hash(end - size, end) + size.astype(np.uint64)) if words else np.zeros(0, np.uint64)
    ok = h != 0
    table = spark.sparkContext.broadcast(_slots(h[ok], size[ok], counts[ok]))
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def tally(batches):
        pieces = _pieces(model.value)
        cache, slots = WorkerCache(pieces), table.value
        for b in batches:
            tokens = np.zeros(b.num_rows, np.int64)
            for first, _, found in _pretokens(b.column(1), pieces.together):
                if found is None:
                    continue
                row, start, end, h, data = found
                n = _look_up(slots, h, end - start)
                missed = np.flatnonzero(n < 0)
                if len(missed):
                    _, at, back = np.unique(h[missed], return_index=True, return_inverse=True)
                    one = missed[at]
                    raw = data.tobytes()
                    n[missed] = cache.lengths([raw[s:e] for s, e in zip(start[one].tolist(), end[one].tolist())])[back]
                total = np.bincount(row, weights=n)
                tokens[first:first + len(total)] = total
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(tokens), pa.array(tokens > limit)],
                                             names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(tally, schema)
