"""Bigram language model in a log-frequency Bloom filter.

N-gram counts (orders 1 and 2) of the training documents are quantised to levels floor(log2 c), 0 for those
seen once. The filter holds (n-gram, 0) .. (n-gram, level), ``PROBES`` bits each, so a count is read back by probing
level after level until one is missing. The filter is cut into one region per counting bucket, of ``BITS_PER_ENTRY`` bits for
each of its entries at every input size. No process holds the whole filter: each bucket counts its n-grams, fills its
region in a task and reads back there what the documents ask for. The log10 probability of a word after
another is that of LAMBDA * c(v w) / c(v) + (1 - LAMBDA) * (c(w) + 1) / (N + V + 1), with counts from the filter.

Filter and exact word counts are too large to broadcast: documents are taken in chunks of ``CHUNK`` ids; every chunk asks the
counting buckets for its distinct n-grams and words, once each, and gets levels and counts back.

Cases: null text is the end token alone; a null doc_id is never held out and its row is in a chunk of its text's hash;
repeated rows count and score like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amortia.llm.bytesvec import NOT_SPACE, Spans, lower_ascii, mix, text_blocks, word_spans
from amortia.llm.common import ship, shuffle_partitions, staged

CHUNK = 4096
PROBES = 4
BITS_PER_ENTRY = 8
#: A larger region is filled and probed in pieces of its n-grams (memory of a task; every n-gram is in one piece).
MAX_FILTER_BYTES = 64 << 20
LAMBDA = 0.4
#: The least level that is entered.
LEAST = 0
TOP_LEVEL = 48
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
LOW = np.uint64((1 << 40) - 1)


def token_blocks(texts: pa.Array):
    """Yield per block ``(first_row, bounds, tokens)``: 64-bit hashes of the words of each text and its end token."""
    for first, offsets, data in text_blocks(texts):
        low = lower_ascii(data)
        row, start, end = word_spans(low, offsets, NOT_SPACE)
        words = mix(Spans(low).hash(start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
        rows = len(offsets) - 1
        n = np.bincount(row, minlength=rows)
        stop = np.cumsum(n)
        tokens = np.insert(words, stop, END)
        yield first, np.concatenate([[0], np.cumsum(n + 1)]), tokens


def ngram_places(bounds: np.ndarray, tokens: np.ndarray, buckets: int):
    """Place (bucket << 40 | low bits) of the unigram and of the bigram of every token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    return place_of(tokens, buckets, 1), place_of(mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens), buckets, 2)


def place_of(x: np.ndarray, buckets: int, order: int) -> np.ndarray:
    """The lowest bit tells bigrams from unigrams."""
    x = mix(x)
    low = (x & LOW & ~np.uint64(1)) | np.uint64(order - 1)
    return (((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(40)) | low


def _to_planes(x: np.ndarray, size: int) -> bytes:
    """Little-endian byte planes: high planes of small numbers are zeros, which the shuffle compresses."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def _cuts(bucket: np.ndarray):
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist()))


def _sum_sorted(keys: list[np.ndarray], counts: list[np.ndarray]):
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting: numpy's hashed ``unique`` is much slower on many different values)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in sorted ``keys``, looked up in order, which memory serves faster."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(keys, x[order])
    return out


def _rows(docs: DataFrame, text: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    chunk = F.coalesce(F.floor(F.col("doc_id") / CHUNK), -1 - F.pmod(F.xxhash64(F.col(text)), F.lit(1024)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), chunk.cast("long").alias("chunk"), F.col(text).alias("text"))


# ---- the filter --------------------------------------------------------------------------------

def _asked(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, places, counts): the distinct n-grams of a chunk's documents (of one batch), with their number in
    training documents."""
    def ask(batches):
        for b in batches:
            chunk, held = np.asarray(b.column("chunk")), np.asarray(b.column("held_out").cast(pa.int8())).astype(np.uint64)
            parts = [[], []]
            for first, bounds, tokens in token_blocks(b.column("text")):
                n = np.diff(bounds)
                doc = slice(first, first + len(n))
                for places in ngram_places(bounds, tokens, buckets):
                    parts[0].append(np.repeat(chunk[doc], n))
                    parts[1].append(places << np.uint64(1) | np.repeat(held[doc], n))
            if not parts[0]:
                continue
            c, x = (np.concatenate(p) for p in parts)
            order = np.argsort(c, kind="stable")
            c, x = c[order], x[order]
            out = [[], [], [], []]
            for i, j in _cuts(c):
                own = np.sort(x[i:j])
                places = own >> np.uint64(1)
                first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
                places, counts = places[first], np.add.reduceat(np.uint64(1) - (own & np.uint64(1)), first)
                low = places & LOW
                for f, t in _cuts(places >> np.uint64(40)):
                    out[0].append(int(places[f] >> np.uint64(40)))
                    out[1].append(int(c[i]))
                    out[2].append(_to_planes(np.diff(low[f:t], prepend=np.uint64(0)), 5))
                    out[3].append(_to_planes(counts[f:t], 4))
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["bucket", "chunk", "places", "counts"])

    return rows.select("chunk", "held_out", "text").mapInArrow(ask, "bucket int, chunk long, places binary, counts binary")


def _counted(table: pa.Table, least: int):
    """``(places of each request, places, levels, [tokens, types])`` of a bucket; the level of n-grams that are not entered is
    ``least`` - 1."""
    keys = [np.cumsum(_from_planes(x, 5), dtype=np.uint64) for x in table.column("places").to_pylist()]
    k, c = _sum_sorted(keys, [_from_planes(x, 4) for x in table.column("counts").to_pylist()])
    words = c[k & np.uint64(1) == 0]
    level = np.minimum(np.floor(np.log2(np.maximum(c, 1))), TOP_LEVEL).astype(np.int64)
    return keys, k, np.where(c >= 1 << least, level, least - 1), [int(words.sum()), int((words > 0).sum())]


def _region_bits(level: np.ndarray, least: int) -> int:
    return -(-max(64, int((level - least + 1).sum()) * BITS_PER_ENTRY) // 8) * 8


def _fill(bucket: int, low: np.ndarray, level: np.ndarray, bits: int, least: int) -> np.ndarray:
    region = np.zeros(bits, bool)
    own = np.full(len(low), bucket, np.uint64)
    for j in range(least, int(level.max(initial=least - 1)) + 1):
        hit = level >= j
        for probe in range(PROBES):
            region[_bit_at(own[hit], low[hit], j, probe, bits)] = True
    return np.packbits(region)


def _ngram_levels(rows: DataFrame, buckets: int, max_bytes: int) -> DataFrame:
    """(chunk, bucket, levels, sums): a byte for each distinct n-gram of a chunk by place, the levels read back from the
    bucket's region of the filter (``probe_levels`` less LEAST - 1); chunk null: tokens and types of a bucket."""
    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, k, level, sums = _counted(table, LEAST)
        pieces = -(-_region_bits(level, LEAST) // (8 * max_bytes))
        read = np.zeros(len(k), np.uint8)
        for at in np.array_split(np.arange(len(k)), pieces):
            bits = _region_bits(level[at], LEAST)
            region = _fill(bucket, k[at], level[at], bits, LEAST)
            read[at] = probe_levels(region, bits, LEAST, np.uint64(bucket << 40) | k[at], bucket) - (LEAST - 1)
        asked: dict[int, list[np.ndarray]] = {}
        for chunk, places in zip(table.column("chunk").to_pylist(), keys):
            asked.setdefault(chunk, []).append(places)
        back = [read[np.searchsorted(k, p[0] if len(p) == 1 else _distinct(np.concatenate(p)))].tobytes() for p in asked.values()]
        return pa.table({"chunk": pa.array([*asked, None], pa.int64()), "bucket": pa.array([bucket] * (len(asked) + 1), pa.int32()),
                         "levels": pa.array([*back, None], pa.binary()), "sums": pa.array([None] * len(asked) + [sums], pa.list_(pa.int64()))})

    return _asked(rows, buckets).groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, levels binary, sums array<long>")


def _bit_at(bucket: np.ndarray, low: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    x = mix((bucket << np.uint64(40) | low) + np.uint64(level * 0x1000193))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return (x + np.uint64(probe) * step) % np.uint64(bits)


def build_filter(rows: DataFrame, buckets: int, least: int = 1) -> tuple[np.ndarray, int, int, int]:
    """The whole filter in one array, for a corpus whose filter fits the driver: ``(bytes of the filter, bits of a region,
    least level held, tokens + types + 1)``. Scoring does not use it: there each region stays in its bucket's task,
    and n-grams seen once (level 0) are entered, which a ``least`` of 1 leaves out."""
    def total(table: pa.Table) -> pa.Table:
        _, k, level, sums = _counted(table, least)
        k, level = k[level >= least], level[level >= least]
        return pa.table({"bucket": table.column("bucket")[:1], "places": pa.array([k.tobytes()], pa.binary()),
                         "levels": pa.array([level.astype(np.uint8).tobytes()], pa.binary()), "mass": pa.array([sum(sums)], pa.int64())})

    counted = _asked(rows.where("not held_out"), buckets).groupBy("bucket").applyInArrow(total, "bucket int, places binary, levels binary, mass long").collect()
    regions = [(r["bucket"], np.frombuffer(r["places"], np.uint64), np.frombuffer(r["levels"], np.uint8).astype(np.int64)) for r in counted]
    bits = max((_region_bits(level, least) for _, _, level in regions), default=64)
    out = np.zeros((buckets, bits // 8), np.uint8)
    for bucket, low, level in regions:
        out[bucket] = _fill(bucket, low, level, bits, least)
    return out.ravel(), bits, least, sum(r["mass"] for r in counted) + 1


def probe_levels(table: np.ndarray, bits: int, least: int, places: np.ndarray, first: int = 0) -> np.ndarray:
    """Levels read back, ``least`` - 1 for absent n-grams. ``table`` starts with the region of bucket ``first``."""
    bucket, low = places >> np.uint64(40), places & LOW
    level = np.full(len(places), least - 1, np.int64)
    on = np.arange(len(places))
    j = least
    while len(on) and j <= TOP_LEVEL:
        for probe in range(PROBES):
            at = (bucket[on] - np.uint64(first)) * np.uint64(bits) + _bit_at(bucket[on], low[on], j, probe, bits)
            on = on[(table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
        level[on] = j
        j += 1
    return level


def counts_of(level: np.ndarray, least: int) -> np.ndarray:
    """0 for absent n-grams, 1 at level 0, else the middle of the level's range."""
    return np.where(level >= least, np.where(level > 0, np.exp2(level + 0.5), 1.0), 0.0)


def probe_counts(table: np.ndarray, bits: int, least: int, places: np.ndarray) -> np.ndarray:
    """Counts read back."""
    return counts_of(probe_levels(table, bits, least, places), least)


# ---- exact word counts, by chunk ---------------------------------------------------------------

def _word_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(chunk, words, counts): training counts of the distinct words of each chunk; chunk null: sums of a bucket."""
    def ask(batches):
        for b in batches:
            chunk, held = np.asarray(b.column("chunk")), np.asarray(b.column("held_out").cast(pa.int8()))
            parts = [[], [], []]
            for first, bounds, tokens in token_blocks(b.column("text")):
                n = np.diff(bounds)
                doc = slice(first, first + len(n))
                parts[0].append(np.repeat(chunk[doc], n))
                parts[1].append(tokens)
                parts[2].append(np.repeat(1 - held[doc], n))
            if not parts[0]:
                continue
            c, w, n = (np.concatenate(p) for p in parts)
            order = np.lexsort((w, c))
            c, w, n = c[order], w[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
            c, w, n = c[first], w[first], np.add.reduceat(n, first)
            to = ((w >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (to[1:] != to[:-1])]))
            pairs = list(zip(cut.tolist(), np.append(cut[1:], len(c)).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cut].astype(np.int32)), pa.array(c[cut]), pa.array([w[i:j].tobytes() for i, j in pairs], pa.binary()),
                 pa.array([_to_planes(n[i:j], 4) for i, j in pairs], pa.binary())], names=["bucket", "chunk", "words", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        keys, counts = _sum_sorted(words, [_from_planes(x, 4) for x in table.column("counts").to_pylist()])
        sums = np.array([counts.sum(), (counts > 0).sum()], np.uint64)
        back = [_to_planes(counts[np.searchsorted(keys, w)], 5) for w in words]
        return pa.table({"chunk": pa.concat_arrays([table.column("chunk").combine_chunks(), pa.nulls(1, pa.int64())]),
                         "words": pa.array(table.column("words").to_pylist() + [None], pa.binary()),
                         "counts": pa.array(back + [sums.tobytes()], pa.binary())})

    return (rows.select("chunk", "held_out", "text").mapInArrow(ask, "bucket int, chunk long, words binary, counts binary")
            .groupBy("bucket").applyInArrow(answer, "chunk long, words binary, counts binary"))


def score_documents(docs: DataFrame, text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    buckets = shuffle_partitions(spark)
    rows = _rows(docs, text)
    levels = staged(_ngram_levels(rows, buckets, max_filter_bytes), "levels")
    mass = 1 + (levels.agg(F.sum(F.col("sums")[0] + F.col("sums")[1])).first()[0] or 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # sums of the buckets
            sums = sum(np.frombuffer(x, np.uint64).astype(np.int64) for x in right.column("counts").to_pylist())
            return pa.table({"doc_id": pa.nulls(1, pa.int64()), "held_out": pa.nulls(1, pa.bool_()), "n_tokens": pa.array([int(sums[0])], pa.int64()),
                             "n_known": pa.array([int(sums[1])], pa.int64()), "log_counts": pa.nulls(1, pa.float64()), "score": pa.nulls(1, pa.float64())})
        words = right.filter(right.column("words").is_valid())
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in words.column("words").to_pylist()])
        counts = np.concatenate([_from_planes(x, 5) for x in words.column("counts").to_pylist()]).astype(np.int64)
        keys, first = np.unique(keys, return_index=True)
        counts = counts[first]
        blocks = [(bounds, tokens) for _, bounds, tokens in token_blocks(left.column("text").combine_chunks())]
        places = _distinct(np.concatenate([_distinct(np.concatenate(ngram_places(*b, buckets))) for b in blocks]))
        found = right.filter(right.column("levels").is_valid()).sort_by("bucket").column("levels").to_pylist()
        level = np.frombuffer(b"".join(found), np.uint8)
        if len(level) != len(places):
            raise ValueError(f"{len(level)} levels for {len(places)} n-grams of a chunk")
        middle = counts_of(np.arange(TOP_LEVEL + 2) + LEAST - 1, LEAST)
        read = lambda p: middle[level[_find(places, p)]]
        out = [[], [], [], []]
        for bounds, tokens in blocks:
            c = counts[_find(keys, tokens)]
            begin = bounds[:-1]
            one, two = ngram_places(bounds, tokens, buckets)
            c1, c2 = read(one), read(two)
            history = np.empty(len(tokens))
            history[1:] = c1[:-1]
            history[begin] = 0  # the start of a text: as often as the end token
            history[begin] = read(place_of(np.array([END]), buckets, 1))[0]
            bigram = np.where(c2 > 0, c2 / np.maximum(np.maximum(history, c2), 1.0), 0.0)
            out[0] += np.diff(bounds).tolist()
            out[1] += np.add.reduceat((c > 0).astype(np.int64), begin).tolist()
            out[2] += np.add.reduceat(np.log10(c + 1.0), begin).tolist()
            out[3] += np.add.reduceat(np.log10(LAMBDA * bigram + (1 - LAMBDA) * (c1 + 1) / mass), begin).tolist()
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(out[0], pa.int64()),
                         "n_known": pa.array(out[1], pa.int64()), "log_counts": pa.array(out[2], pa.float64()), "score": pa.array(out[3], pa.float64())})

    back = _word_counts(rows, buckets).unionByName(levels.where("chunk is not null").drop("sums"), allowMissingColumns=True)
    found = staged(rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"), "scores")
    sums = found.where("held_out is null").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_known"), F.lit(0)).alias("v")).first()
    floor = math.log10(sums["n"] + sums["v"] + 1)
    return found.where("held_out is not null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(sums["n"]).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")
