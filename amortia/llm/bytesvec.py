"""Vectorised work on the UTF-8 bytes of a batch of texts (numpy, inside tasks).

A batch is cut into blocks of whole texts (about ``BLOCK_BYTES`` each, a longer text is a block of
its own), so memory is bounded by the block or by the longest single text. Hashes are polynomial
hashes modulo 2**64 of a random byte table: the hash of any span is the difference of two prefix
sums, scaled back to offset 0, so spans at different places compare equal when their bytes do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SMALL_BLOCK = 1 << 18  # for work that holds many numbers per byte

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n. A table is kept up to the block size; longer ones are not."""
    kept = _powers.get("up")
    if kept is not None and len(kept) > n:
        return kept, _powers["down"]
    size = (SMALL_BLOCK if n <= SMALL_BLOCK else max(n, BLOCK_BYTES)) + 1
    out = []
    for base in (BASE, BASE_INV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= 2 * BLOCK_BYTES:
        _powers["up"], _powers["down"] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES):
    """Yield ``(first_row, offsets, data)``: rows ``first_row .. first_row+len(offsets)-2`` have the
    bytes ``data[offsets[i]:offsets[i+1]]``. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset:]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may still span bytes: copy to be sure that it is empty
        texts = texts.fill_null("")
        offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset:]
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, offs[first:last + 1] - offs[first], data[offs[first]:offs[last]]
        first = last


class Spans:
    """Prefix sums of the polynomial hash over one block."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        if len(data):
            np.cumsum(_TABLE[data] * up[:len(data)], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes start..end (end excluded) for each pair; equal bytes give equal hashes."""
        return (self._sums[end] - self._sums[start]) * self._down[start]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Maximal runs of word bytes that stay inside one text: ``(row, start, end)``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[data]
    begins = m.copy()
    begins[1:] &= ~m[:-1]
    ends = m.copy()
    ends[:-1] &= ~m[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] |= m[cut]          # a text starts: a run that crosses the border is two words
    ends[cut - 1] |= m[cut - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start, end


NOT_SPACE = ~IS_SPACE


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]
