"""Token-id shards as wavelet matrices.

Documents are range-partitioned by ``doc_id`` and sorted; each partition becomes one shard: the ids of
its documents (each ended by ``end_id``) as a wavelet matrix, that is one bit-plane per id bit, every
plane stably split by the bits of the plane before. A shard is one byte string (format below) in one
row of one Parquet file, so Spark's writers commit it on any shared store and a task that is run again
replaces its own output. The shard answers, without decoding it, which id stands at a place
(``access``), how often an id occurs up to a place (``rank``) and where its k-th occurrence is
(``select``); ``decode`` reads all ids back.

Format (little endian): magic ``WVM1``, u32 levels, u64 ids, u64 documents; u64[levels] zeros per plane;
i64[documents] doc ids; u8[documents] id-is-null flags; u64[documents + 1] starts within the shard; then
per plane the bits (packed, most significant first) and u32 counts of ones before every 512 bits.

Cases: null text is empty (one end id); null ``doc_id`` sorts first; repeated ``doc_id`` rows are ordered by
a hash of the text; an empty table gives no shard; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amortia.llm import pretok
from amortia.llm.bpe import tokenised_blocks
from amortia.llm.common import ship, shuffle_partitions, text_key

BLOCK = 512
STEP = 1 << 16
_encoders: dict[str, tuple] = {}


# ---- one shard ---------------------------------------------------------------------------------

def build(ids: np.ndarray, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Zeros per plane and the bits of each plane (bool arrays)."""
    seq, other, zeros, planes = ids.copy(), np.empty_like(ids), np.zeros(levels, np.uint64), []
    for level in range(levels):
        bit = (seq & seq.dtype.type(1 << (levels - 1 - level))) != 0
        planes.append(bit)
        low, high = 0, len(seq) - int(np.count_nonzero(bit))
        zeros[level] = high
        for i in range(0, len(seq), STEP):  # by places, which stay in the cache: masks of mixed bits are several times slower
            part, at = seq[i:i + STEP], bit[i:i + STEP]
            one, none = np.flatnonzero(at), np.flatnonzero(~at)
            np.take(part, none, out=other[low:low + len(none)], mode="clip")
            np.take(part, one, out=other[high:high + len(one)], mode="clip")
            low, high = low + len(none), high + len(one)
        seq, other = other, seq
    return zeros, planes


def pack(doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    zeros, planes = build(ids, levels)
    parts = [b"WVM1", struct.pack("<IQQ", levels, len(ids), len(doc_ids)), zeros.astype("<u8").tobytes(),
             doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    for bit in planes:
        packed = np.packbits(bit)
        parts.append(packed.tobytes())
        whole = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        whole[:len(packed)] = packed
        per_block = np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        parts.append((np.cumsum(per_block) - per_block).astype("<u4").tobytes())
    return b"".join(parts)


class Shard:
    """A packed shard; arrays are views into its bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"WVM1":
            raise ValueError("not a wavelet shard")
        self.levels, self.n, docs = struct.unpack_from("<IQQ", raw, 4)
        at = 24

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.zeros = take("<u8", self.levels).astype(np.int64)
        self.doc_ids, self.nulls, self.starts = take("<i8", docs), take("u1", docs), take("<u8", docs + 1)
        self.planes, self.counts = [], []
        for _ in range(self.levels):
            self.planes.append(take("u1", (self.n + 7) // 8))
            self.counts.append(take("<u4", (self.n + BLOCK - 1) // BLOCK))

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (7 - (i & 7))) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i == 0:
            return 0
        block = (i - 1) // BLOCK
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(i + 7) // 8])[:i - block * BLOCK]
        return int(self.counts[level][block]) + int(bits.sum())

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, end: int, begin: int = 0) -> int:
        """Occurrences of ``value`` in places begin..end-1."""
        if value < 0 or value >> self.levels:
            return 0
        for level in range(self.levels):
            a, b = self._ones(level, begin), self._ones(level, end)
            if value >> (self.levels - 1 - level) & 1:
                begin, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                begin, end = begin - a, end - b
        return end - begin

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of ``value``; -1 if there are fewer."""
        if k < 0 or k >= self.rank(value, self.n):
            return -1
        begin = 0
        for level in range(self.levels):
            ones = self._ones(level, begin)
            begin = int(self.zeros[level]) + ones if value >> (self.levels - 1 - level) & 1 else begin - ones
        i = begin + k
        for level in reversed(range(self.levels)):
            one = value >> (self.levels - 1 - level) & 1
            want = i - int(self.zeros[level]) if one else i
            lo, hi = 0, self.n  # the place of the want-th such bit: least p with count(p + 1) > want
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            i = lo
        return i

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable splits from the last plane up."""
        seq = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z = int(self.zeros[level])
            out = np.empty_like(seq)
            low, high, value = 0, z, seq.dtype.type(1 << (self.levels - 1 - level))
            for i in range(0, self.n, STEP):
                part, at = out[i:i + STEP], bit[i:i + STEP]
                one, none = np.flatnonzero(at), np.flatnonzero(~at)
                part[none] = seq[low:low + len(none)]
                part[one] = seq[high:high + len(one)] | value
                low, high = low + len(none), high + len(one)
            seq = out
        return seq


# ---- Spark jobs --------------------------------------------------------------------------------

def _token_bytes(lib) -> np.ndarray | None:
    """Bytes of each id's token; None if the vocabulary does not stand for the text's bytes one by one."""
    spec = json.loads(lib.to_str())
    if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        return None
    added = {t["id"]: t["content"] for t in spec["added_tokens"]}
    if any(" " in content or t.get("lstrip") or t.get("rstrip") for t, content in zip(spec["added_tokens"], added.values())):
        return None
    n = np.zeros(max([*spec["model"]["vocab"].values(), *added]) + 1, np.int64)
    for token, i in spec["model"]["vocab"].items():
        n[i] = len(token)
    for i, content in added.items():
        n[i] = len(content.encode())
    return n


def encode_joined(words: list[str], n_bytes: np.ndarray, single, token_bytes: np.ndarray | None, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, counts)`` of words; ``single(texts) -> (ids, counts)`` is the library. A call on a word alone costs more than its
    merges, so words of a blank and a run without white space are joined: the split takes each blank as a word's begin again. The
    bytes of the ids tell where a word ends; texts whose ids do not end with every word are encoded word by word."""
    counts = np.zeros(len(words), np.int64)
    alone, joined = [], []
    for i, w in enumerate(words):
        (joined if w[:1] == " " and w.split() == [w[1:]] and "\u180e" not in w else alone).append(i)
    if token_bytes is None:
        alone, joined = list(range(len(words))), []
    order, parts = [], []
    groups = [joined[i:i + at_once] for i in range(0, len(joined), at_once)]
    if groups:
        ids, lengths = single(["".join([words[i] for i in g]) for g in groups])
        for g, part in zip(groups, np.split(ids, np.cumsum(lengths)[:-1])):
            ends, reached = np.cumsum(n_bytes[g]), np.cumsum(token_bytes[part])
            last = np.searchsorted(reached, ends)
            if len(part) and reached[-1] == ends[-1] and (reached[last] == ends).all():
                counts[g] = np.diff(last, prepend=-1)
                order += g
                parts.append(part)
            else:
                alone += g
    if alone:
        ids, counts[alone] = single([words[i] for i in alone])
        order += alone
        parts.append(ids)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    # from the order of the calls to that of the words
    start = np.zeros(len(words), np.int64)
    start[order] = np.cumsum(counts[order]) - counts[order]
    ends = np.cumsum(counts)
    src = np.arange(len(ids), dtype=np.int64) + np.repeat(start - (ends - counts), counts)
    return ids[src], counts


def _encoder(vocabulary: str):
    """Special tokens, number of ids and word cache of a vocabulary file; new words are encoded by
    the tokenizers library, in batches."""
    if vocabulary not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(vocabulary)
        lib.no_truncation()
        lib.no_padding()
        special = {t.content.encode(): i for i, t in lib.get_added_tokens_decoder().items()}

        def single(texts):
            ids = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint16), np.array([len(x) for x in ids], np.int64)

        token_bytes = _token_bytes(lib)

        def encode(words):
            return encode_joined([w.decode() for w in words], np.array([len(w) for w in words], np.int64), single, token_bytes)

        _encoders[vocabulary] = special, lib.get_vocab_size(), pretok.WordCache(encode)
    return _encoders[vocabulary]


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shards: int | None = None,
                 text: str = "text") -> None:
    """Encode every text, append ``end_id``, and write one wavelet shard per range of ``doc_id``."""
    spark = docs.sparkSession
    ship(spark)
    n = shards or shuffle_partitions(spark)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
               .withColumn("__tie", text_key(F.col("text")))
               .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("__tie"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("__tie")))

    def run(batches):
        special, size, cache = _encoder(vocabulary)
        ids, lengths, doc_ids, nulls = [], [], [], []
        for b in batches:
            d = b.column("doc_id")
            nulls.append(np.asarray(d.is_null()))
            doc_ids.append(np.asarray(d.fill_null(0)))
            for _, block, bounds in tokenised_blocks(b.column("text"), special, cache):
                n_ids = np.diff(bounds)
                ids.append(np.insert(block, bounds[1:], np.uint16(end_id)))
                lengths.append(n_ids + 1)
        if lengths:
            lengths = np.concatenate(lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            doc_ids, nulls = np.concatenate(doc_ids), np.concatenate(nulls)
            levels = max(int(size - 1).bit_length(), int(end_id).bit_length())
            raw = pack(doc_ids, nulls, starts, np.concatenate(ids), levels)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bool(nulls[0])]), pa.array([int(doc_ids[0])], pa.int64()), pa.array([len(doc_ids)], pa.int64()),
                 pa.array([int(starts[-1])], pa.int64()), pa.array([raw], pa.binary())],
                names=["first_null", "first_doc_id", "n_docs", "n_ids", "shard"])

    (ordered.mapInArrow(run, "first_null boolean, first_doc_id long, n_docs long, n_ids long, shard binary")
     .withColumn("part", F.spark_partition_id())
     .write.option("compression", "uncompressed").mode("overwrite").parquet(path))


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the written shards."""
    ship(spark)
    shards = spark.read.parquet(path)
    # One narrow row per shard: where each starts in the whole sequence.
    offsets = (shards.select("part", "n_ids")
               .withColumn("__offset", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))
               .select(F.col("part").alias("__part"), "__offset"))

    def run(batches):
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("shard")):
                s = Shard(raw.as_buffer())
                ids = s.decode().astype("<u4")
                at = s.starts.astype(np.int64)
                bounds = at.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(s.doc_ids), pa.int32()), pa.array(s.doc_ids, mask=s.nulls == 1),
                     pa.array(at[:-1]), pa.array(np.diff(at)),
                     pa.array([zlib.crc32(ids[i:j]) for i, j in zip(bounds, bounds[1:])], pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard").mapInArrow(
        run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # The offsets have one row per shard (as many as shuffle partitions).
    return (rows.join(F.broadcast(offsets), rows["part"] == offsets["__part"])
            .select("doc_id", (F.col("start") + F.col("__offset")).alias("start"), "n_tokens", "ids_crc32"))
