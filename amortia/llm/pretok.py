"""Vectorised split of texts into byte-level BPE words, and a per-task word -> ids cache.

The split is that of the public byte-level pattern: contractions, then an optional blank with a run
of letters, numbers or other characters, then runs of white space of which the last character is
left to the next word. It is computed on UTF-8 bytes: classes come from a table for ASCII and from
decoded lead bytes otherwise, so no per-character Python runs.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from amortia.llm.bytesvec import Spans

SPACE, WHITE, LETTER, NUMBER, OTHER = 0, 1, 2, 3, 4
# Unicode White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_tables: dict[str, np.ndarray] = {}


def _class_of(cp: int) -> int:
    if cp == 0x20:
        return SPACE
    if cp in WHITE_SPACE:
        return WHITE
    kind = unicodedata.category(chr(cp))[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


def _class_table() -> np.ndarray:
    """Class of every code point; filled on first use of a code point's block of 256."""
    if "cls" not in _tables:
        _tables["cls"] = np.full(0x110000, 255, np.uint8)
        _tables["done"] = np.zeros(0x1100, bool)
    return _tables["cls"]


def _classes(cps: np.ndarray) -> np.ndarray:
    cls = _class_table()
    blocks = np.unique(cps >> 8)
    for b in blocks[~_tables["done"][blocks]]:
        cls[b << 8:(b + 1) << 8] = [_class_of(c) for c in range(b << 8, (b + 1) << 8)]
        _tables["done"][b] = True
    return cls[cps]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    if "ascii" not in _tables:
        _tables["ascii"] = np.array([_class_of(c) for c in range(128)] + [OTHER] * 128, np.uint8)
    cls = _tables["ascii"][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b0 = data[lead].astype(np.int64)
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        c1, c2, c3 = pad[lead + 1] & 63, pad[lead + 2] & 63, pad[lead + 3] & 63
        two, three = b0 < 0xE0, (b0 >= 0xE0) & (b0 < 0xF0)
        cp = np.where(two, ((b0 & 31) << 6) | c1,
                      np.where(three, ((b0 & 15) << 12) | (c1 << 6) | c2,
                               ((b0 & 7) << 18) | (c1 << 12) | (c2 << 6) | c3))
        k = _classes(np.minimum(cp, 0x10FFFF))
        width = np.where(two, 2, np.where(three, 3, 4))
        for j in range(4):
            at = lead[width > j] + j
            inside = at < len(data)
            cls[at[inside]] = k[width > j][inside]
    return cls


def word_starts(data: np.ndarray, offsets: np.ndarray, cls: np.ndarray | None = None) -> np.ndarray:
    """Start of every word of a block of texts (``offsets`` as of ``bytesvec.text_blocks``)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = byte_classes(data) if cls is None else cls
    run = np.where(cls == SPACE, WHITE, cls)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets[:-1]] = True
    text_start[n] = True
    begin = np.zeros(n, bool)
    begin[0] = True
    begin[1:] = (run[1:] != run[:-1])
    begin |= text_start[:n]
    # White space before a word: its last character stands alone, or joins the word if it is a blank.
    cont = (data & 0xC0) == 0x80
    word_here = np.flatnonzero(begin & (run != WHITE) & ~text_start[:n])
    word_here = word_here[word_here > 0]
    word_here = word_here[run[word_here - 1] == WHITE]
    prev = word_here - 1
    for _ in range(2):  # white space beyond ASCII has up to three bytes
        prev = np.where(cont[prev], prev - 1, prev)
    blank = data[prev] == 0x20
    begin[word_here[blank]] = False
    begin[prev] = True
    # Contractions: a lone apostrophe that starts a word, then letters s t m d or re ve ll.
    ap = np.flatnonzero((data[:-1] == 0x27) & begin[:-1] & (cls[1:] == LETTER) & ~text_start[1:n])
    if len(ap):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        stop = np.concatenate([text_start, [True, True]])
        a, b = pad[ap + 1], pad[ap + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ~stop[ap + 2] & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        for which, length in ((one, 1), (two & ~one, 2)):
            at = ap[which]
            begin[at + 1] = False
            after = at + 1 + length
            after = after[after < n]
            begin[after] = True
    return np.flatnonzero(begin)


class WordCache:
    """Ids of words by 64-bit hash, in sorted arrays. ``encode(list of bytes) -> (ids, counts)`` runs for words that
    are new in this worker only; the cache starts over when it holds ``limit`` words (some 24 bytes each)."""

    def __init__(self, encode, limit: int = 400_000):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self):
        self._keys, self._slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._ids = np.zeros(1 << 16, np.uint16)
        self._used = 0
        self._start = np.zeros(1 << 16, np.int32)
        self._count = np.zeros(1 << 16, np.int32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: ids of all words in order and the number of ids of each word."""
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))
        # the length keeps words of leading table-zero bytes apart
        h = Spans(data).hash(starts, ends) + (ends - starts).astype(np.uint64)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self._keys) + len(uniq) > self._limit:
            self._clear()
        place = np.searchsorted(self._keys, uniq)
        slot = np.full(len(uniq), -1, np.int64)
        inside = np.flatnonzero(place < len(self._keys))
        hit = inside[self._keys[place[inside]] == uniq[inside]]
        slot[hit] = self._slots[place[hit]]
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw = data.tobytes()
            at = first[new]
            words = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            ids, counts = self._encode(words)
            base = len(self._keys)
            self._ids = self._room(self._ids, self._used + len(ids))
            self._start = self._room(self._start, base + len(new))
            self._count = self._room(self._count, base + len(new))
            self._ids[self._used:self._used + len(ids)] = ids
            self._start[base:base + len(new)] = self._used + np.cumsum(counts) - counts
            self._count[base:base + len(new)] = counts
            self._used += len(ids)
            slot[new] = np.arange(base, base + len(new))
            self._keys = np.insert(self._keys, place[new], uniq[new])
            self._slots = np.insert(self._slots, place[new], slot[new])
        word = slot[inverse]
        counts = self._count[word].astype(np.int64)
        ends_out = np.cumsum(counts)
        total = int(ends_out[-1])
        src = np.arange(total, dtype=np.int64) + np.repeat(self._start[word] - (ends_out - counts), counts)
        return self._ids[src], counts
