"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes when some string of ``span`` (100) bytes that covers it also starts earlier: in a document of a
smaller id, or earlier in the same one. A full suffix array of the corpus is not needed for that:

1. *Anchors.* Every window of ``span`` bytes has a leftmost least hash among its strings of span/2 bytes. Windows
   that share this anchor are neighbours; equal windows have equal anchors at equal offsets. One record per anchor
   (about one in 26 bytes) goes through the shuffle: hash of the anchor, hash of its whole context (the union of its
   windows), document and place. Records of equal anchor and context collapse to the earliest one, first inside each
   batch, so a passage that a third of all documents hold costs one record a batch; the spans of the others are
   removed.
2. *Suffix sort.* Anchors that are left with two or more different contexts get the bytes of these contexts. Inside
   each anchor the suffixes from the anchor on, and the reversed prefixes before it, are sorted by mergesort; two
   suffixes are compared by binary search over prefix polynomial hashes for their common extension, so in a logarithmic
   number of steps. Order and common extensions of all neighbours are then verified on the bytes; a group with a
   hash collision is sorted again by its bytes. Windows at one offset are equal when neither order separates
   them; all but the earliest are removed.
3. An anchor with more than ``group_limit`` different contexts is not sorted in one task: its windows are grouped by
   hash with partial minima (the same result, spread over the cluster).

Cases: null or empty text has no bytes; texts shorter than ``span`` lose nothing; rows equal in doc_id and text count as
one document and get the same result, rows that share only the doc_id are ordered by a 32-bit key of their text; a null
doc_id comes first; an empty table gives no rows; extra columns are ignored. Hashes are 64 bits, and records must agree
in both anchor and context hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amortia.llm.bytesvec import Spans, mix, text_blocks
from amortia.llm.common import ship, shuffle_partitions, staged

SPAN = 100
GROUP_LIMIT = 20_000
BLOCK_BYTES = 1 << 20
FLUSH_BYTES = 4 << 20
#: A packed side is broadcast when it was measured to be at most this large.
BROADCAST_BYTES = 32 << 20
NULL_ID = np.int64(-(1 << 63))
_RECORD = [("a", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("lo", "<u4"), ("more", "u1"), ("off", "u1")]


# ---- anchors -----------------------------------------------------------------------------------

def _least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """For each p the leftmost place of the least of h[p:p + width]."""
    least, place, w = h, np.arange(len(h), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        take = least[step:] < least[:-step]
        least = np.where(take, least[step:], least[:-step])
        place = np.where(take, place[step:], place[:-step])
        w += step
    return place


def anchors_of(data: np.ndarray, offsets: np.ndarray, span: int):
    """Anchor intervals of one block: row, first window start ``lo``, last ``hi``, anchor place, anchor and context hash."""
    k = span // 2
    if len(data) < span:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    spans = Spans(data)
    at = np.arange(len(data) - k + 1)
    h = mix(spans.hash(at, at + k))
    place = _least_in_window(h, span - k + 1)
    lengths = np.diff(offsets)
    whole = np.zeros(len(data) + 1, np.int32)  # +1 over window starts that fit in their text
    fits = lengths >= span
    np.add.at(whole, offsets[:-1][fits], 1)
    np.add.at(whole, (offsets[1:] - span + 1)[fits], -1)
    p = np.flatnonzero(np.cumsum(whole)[:len(place)] > 0)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    a = place[p].astype(np.int64)
    row = np.repeat(np.arange(len(lengths))[fits], (lengths[fits] - span + 1))
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    lo, hi = p[first], p[np.append(first[1:], len(p)) - 1]
    a, row = a[first], row[first]
    shape = ((a - lo) << 8 | (hi - lo)).astype(np.uint64)
    return row, lo, hi, a, h[a], mix(spans.hash(lo, hi + span) ^ mix(shape + np.uint64(1)))


def _merged(doc, tag, start, end):
    """Union of spans per (doc, tag): sorted, overlapping or touching ones joined."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    if not len(doc):
        return doc, tag, start, end
    same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])])
    group = np.cumsum(~same)
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big  # furthest end so far in the document
    new = ~same
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], tag[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _pack(rec: dict, which) -> bytes:
    return b"".join(rec[name][which].astype(kind).tobytes() for name, kind in _RECORD)


def _unpack(blobs: list[bytes]) -> dict:
    width = sum(np.dtype(kind).itemsize for _, kind in _RECORD)
    parts = {name: [] for name, _ in _RECORD}
    for raw in blobs:
        n, at = len(raw) // width, 0
        for name, kind in _RECORD:
            parts[name].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(p) if p else np.zeros(0, kind) for (name, kind), p in zip(_RECORD, parts.values())}


def _split_equal(rec: dict):
    """Sort records by (anchor, context, place); ``first`` marks the earliest of each (anchor, context), ``later`` those
    that start after it."""
    order = np.lexsort((rec["lo"], rec["tag"], rec["doc"], rec["c"], rec["a"]))
    rec = {k: v[order] for k, v in rec.items()}
    n = len(order)
    first = np.ones(n, bool)
    if n:
        first[1:] = (rec["a"][1:] != rec["a"][:-1]) | (rec["c"][1:] != rec["c"][:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    later = np.zeros(n, bool)
    for k in ("doc", "tag", "lo"):
        later |= rec[k] != rec[k][head]
    return rec, first, later


_OUT = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                  ("anchor", pa.int64()), ("off", pa.int32()), ("big", pa.bool_())])
_OUT_SQL = "kind byte, doc long, tag long, start long, end long, anchor long, off int, big boolean"


def _out(kind, doc, tag, start, end, anchor=None, off=None, big=None):
    n = len(doc)
    fill = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return [pa.array(np.full(n, kind, np.int8)), pa.array(doc.astype(np.int64)), pa.array(tag.astype(np.int64)),
            pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)),
            fill(None if anchor is None else anchor.view(np.int64), pa.int64()),
            fill(off, pa.int32()), fill(big, pa.bool_())]


# ---- suffix sort -------------------------------------------------------------------------------

class _Side:
    """Suffixes of one direction: ``length[i]`` bytes from the anchor of context i on (or back from it)."""

    def __init__(self, data: np.ndarray, anchor: np.ndarray, length: np.ndarray, backward: bool):
        self.data, self.anchor, self.length, self.backward = data, anchor, length, backward
        self.spans = Spans(data)

    def _hash(self, i, n):
        a = self.anchor[i]
        return self.spans.hash(a - n, a) if self.backward else self.spans.hash(a, a + n)

    def _byte(self, i, n):
        a = self.anchor[i]
        return self.data[a - n - 1] if self.backward else self.data[a + n]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of suffixes i and j, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_] + 1) // 2
            eq = self._hash(i[open_], mid) == self._hash(j[open_], mid)
            lo[open_] = np.where(eq, mid, lo[open_])
            hi[open_] = np.where(eq, hi[open_], mid - 1)

    def compare(self, i: np.ndarray, j: np.ndarray, ext: np.ndarray | None = None) -> np.ndarray:
        """-1, 0, 1 as suffix i is before, equal to or after suffix j."""
        n = self.extension(i, j) if ext is None else ext
        out = np.sign(self.length[i] - self.length[j])
        inner = np.flatnonzero((n < self.length[i]) & (n < self.length[j]))
        x, y = self._byte(i[inner], n[inner]), self._byte(j[inner], n[inner])
        out[inner] = np.sign(x.astype(np.int64) - y.astype(np.int64))
        return out

    def true_extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same as ``extension``, from the bytes."""
        most = np.minimum(self.length[i], self.length[j])
        n, same, step = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        while True:
            same = same[step < most[same]]
            if not len(same):
                return n
            same = same[self._byte(i[same], step) == self._byte(j[same], step)]
            n[same] += 1
            step += 1

    def raw(self, i: int) -> bytes:
        a, n = int(self.anchor[i]), int(self.length[i])
        return self.data[a - n:a][::-1].tobytes() if self.backward else self.data[a:a + n].tobytes()


def suffix_sort(side: _Side, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort items inside each group (``group`` is ascending): ``(order, ext)`` where ext[r] is the common extension of
    the items at r - 1 and r (0 at the start of a group). Bottom-up mergesort; all merges of a level run at once."""
    n = len(group)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    g0, gn = np.repeat(begin, size), np.repeat(size, size)
    place = np.arange(n) - g0
    order = np.arange(n)
    width = 1
    while n and width < size.max():
        run = place // width
        other = run ^ 1
        lo = np.minimum(other * width, gn)
        hi = np.minimum(lo + width, gn)
        busy = np.flatnonzero(lo < hi)
        left = (run[busy] & 1) == 0
        start = lo[busy].copy()
        a, b = lo[busy].copy(), hi[busy].copy()
        while True:  # how many of the other run come before this element (ties: left run first)
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) // 2
            sign = side.compare(order[g0[busy[open_]] + mid], order[busy[open_]])
            before = (sign < 0) | ((sign == 0) & ~left[open_])
            a[open_] = np.where(before, mid + 1, a[open_])
            b[open_] = np.where(before, b[open_], mid)
        target = np.arange(n)
        pair0 = (run[busy] & ~1) * width
        target[busy] = g0[busy] + pair0 + (place[busy] - run[busy] * width) + (a - start)
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        width *= 2
    ext = np.zeros(n, np.int64)
    inner = np.flatnonzero(place > 0)
    if len(inner):
        i, j = order[inner - 1], order[inner]
        ext[inner] = side.extension(i, j)
        true = side.true_extension(i, j)
        wrong = (true != ext[inner]) | (side.compare(i, j, true) > 0)
        if wrong.any():  # hash collision: these groups by their bytes
            for g in np.unique(g0[inner[wrong]]).tolist():
                m = int(gn[g])
                order[g:g + m] = sorted(order[g:g + m].tolist(), key=side.raw)
            ext[inner] = side.true_extension(order[inner - 1], order[inner])
    return order, ext


def repeated_windows(data, base, off, more, group, rank, span: int):
    """Contexts of anchors (items sorted by ``group``): for each item the largest and the least offset of a window that
    an item of lower rank holds too, or (-1, -1)."""
    n = len(base)
    anchor = base + off
    orders = []
    for backward in (False, True):
        length = off.copy() if backward else more - off + span
        order, ext = suffix_sort(_Side(data, anchor, np.minimum(length, span), backward), group)
        fresh = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        orders.append((order, np.where(fresh, -1, ext)))
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for o in range(int(off.max()) + 1 if n else 0):
        valid = np.flatnonzero((off - more <= o) & (o <= off))
        if len(valid) < 2:
            continue
        for (order, ext), cls, need in zip(orders, classes, (span - o, o)):
            cls[order] = np.cumsum((ext < need) | (ext < 0))
        key = classes[0][valid] * (n + 1) + classes[1][valid]
        by = np.lexsort((rank[valid], key))
        k, r = key[by], rank[valid][by]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        hit = valid[by[r > r[head]]]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return most, least


# ---- Spark jobs --------------------------------------------------------------------------------

def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc"),
                       (F.xxhash64(F.col(text)).bitwiseAND(0xFFFFFFFF)).alias("tag"), F.col(text).alias("text"))


def _anchor_stage(rows: DataFrame, span: int, group_limit: int) -> DataFrame:
    """kind 0: spans to remove; kind 1: contexts (start = lo, end = hi) of anchors with several different contexts."""
    buckets = 4 * shuffle_partitions(rows.sparkSession)

    def records(batches):
        for b in batches:
            doc, tag = np.asarray(b.column("doc")), np.asarray(b.column("tag"))
            parts, size = [], 0
            for first, offsets, data in text_blocks(b.column("text"), BLOCK_BYTES):
                row, lo, hi, a, ha, hc = anchors_of(data, offsets, span)
                parts.append({"a": ha, "c": hc, "doc": doc[first + row], "tag": tag[first + row], "lo": lo - offsets[row],
                              "more": hi - lo, "off": a - lo})
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield from packed(parts)
                    parts, size = [], 0
            if parts:
                yield from packed(parts)

    def packed(parts):
        rec, _, later = _split_equal({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})
        spans = _merged(*(rec[k][later] for k in ("doc", "tag", "lo")), (rec["lo"] + rec["more"] + span)[later])
        keep = np.flatnonzero(~later)
        # in the order of places, so that documents and places compress
        keep = keep[np.lexsort((rec["lo"][keep], rec["doc"][keep]))]
        # an anchor is the least hash of its window, so its own high bits are mostly zero
        to = ((mix(rec["a"][keep]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        keep, to = keep[order], to[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(to))
        if len(cut):
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cut].astype(np.int32)), pa.array([_pack(rec, keep[i:j]) for i, j in zip(cut.tolist(), ends.tolist())], pa.binary()),
                 pa.nulls(len(cut), pa.binary())], names=["bucket", "anchors", "spans"])
        if len(spans[0]):
            # known spans travel with the documents' own buckets, not with the (hot) anchor's
            own = (mix(spans[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            own = own[order]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            flat = np.stack([s[order].astype(np.int64) for s in spans], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[cut].astype(np.int32)), pa.nulls(len(cut), pa.binary()),
                 pa.array([flat[i:j].tobytes() for i, j in zip(cut.tolist(), np.append(cut[1:], len(own)).tolist())], pa.binary())],
                names=["bucket", "anchors", "spans"])

    def bucket(table: pa.Table) -> pa.Table:
        known = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in table.column("spans").drop_null().to_pylist()]
        rec, first, later = _split_equal(_unpack(table.column("anchors").drop_null().to_pylist()))
        lo = rec["lo"].astype(np.int64)
        end = lo + rec["more"] + span
        doc, tag, start, stop = (np.concatenate(x) for x in zip(
            (rec["doc"][later], rec["tag"][later].astype(np.int64), lo[later], end[later]), *(k.T for k in known)))
        cols = [_out(0, *_merged(doc, tag, start, stop))]
        rep = np.flatnonzero(first)
        anchor = rec["a"][rep]
        if len(rep):
            new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            size = np.diff(np.append(np.flatnonzero(new), len(rep)))
            size = np.repeat(size, size)
            rep, size = rep[size > 1], size[size > 1]
        cols.append(_out(1, rec["doc"][rep], rec["tag"][rep], lo[rep], lo[rep] + rec["more"][rep], rec["a"][rep],
                         rec["off"][rep].astype(np.int32), (size > group_limit) if len(rep) else np.zeros(0, bool)))
        return pa.concat_tables([pa.Table.from_arrays(c, schema=_OUT) for c in cols])

    return (rows.select("doc", "tag", "text").mapInArrow(records, "bucket int, anchors binary, spans binary")
            .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(bucket, _OUT_SQL))


def _packed_lists(rows: DataFrame, kinds: list[tuple[str, str]], merge: bool = False) -> DataFrame:
    """(doc, tag, packed): the rows of each document as one binary of columns, written. A document's rows are at most its
    length. ``merge`` joins overlapping spans."""
    names = [n for n, _ in kinds]
    lists = rows.groupBy("doc", "tag").agg(F.collect_list(F.struct(*names)).alias("rows"))

    def run(batches):
        for b in batches:
            blobs = []
            for found in b.column("rows"):
                cols = [np.asarray(found.values.field(n)) for n in names]
                if merge:
                    z = np.zeros(len(cols[0]), np.int64)
                    cols = list(_merged(z, z, *cols)[2:])
                blobs.append(b"".join(c.astype(kind).tobytes() for c, (_, kind) in zip(cols, kinds)))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), pa.array(blobs, pa.binary())], names=["doc", "tag", "packed"])

    return staged(lists.mapInArrow(run, "doc long, tag long, packed binary"), "packed")


def _unpacked(raw: bytes, kinds: list[tuple[str, str]]) -> list[np.ndarray]:
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for _, k in kinds), 0, []
    for _, kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _small(packed: DataFrame) -> DataFrame:
    """Broadcast hint for a packed side that was measured; a larger one is joined by shuffle."""
    size = packed.agg(F.coalesce(F.sum(F.length("packed") + 40), F.lit(0))).first()[0]
    return F.broadcast(packed) if size <= BROADCAST_BYTES else packed


_PROBE = [("anchor", "<i8"), ("start", "<u4"), ("end", "<u4"), ("off", "u1"), ("big", "u1")]
_RUN = [("start", "<u4"), ("end", "<u4")]


def _contexts(rows: DataFrame, probes: DataFrame, span: int) -> DataFrame:
    """Bytes of the probes' contexts: anchor, doc, tag, lo, more, off, big, context."""
    per_doc = _packed_lists(probes.withColumn("big", F.col("big").cast("int")), _PROBE)

    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for doc, tag, text, raw_probes in zip(*(b.column(c).to_pylist() for c in ("doc", "tag", "text", "packed"))):
                raw = text.encode()
                anchor, start, end, off, big = (x.tolist() for x in _unpacked(raw_probes, _PROBE))
                out[0] += anchor
                out[1] += [doc] * len(anchor)
                out[2] += [tag] * len(anchor)
                out[3] += start
                out[4] += [j - i for i, j in zip(start, end)]
                out[5] += off
                out[6] += [x == 1 for x in big]
                out[7] += [raw[i:j + span] for i, j in zip(start, end)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))],
                names=["anchor", "doc", "tag", "lo", "more", "off", "big", "context"])

    return rows.select("doc", "tag", "text").join(_small(per_doc), ["doc", "tag"]).mapInArrow(
        run, "anchor long, doc long, tag long, lo long, more int, off int, big boolean, context binary")


def _sorted_spans(contexts: DataFrame, span: int) -> DataFrame:
    buckets = 4 * shuffle_partitions(contexts.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        col = {c: np.asarray(table.column(c).combine_chunks()) for c in ("anchor", "doc", "tag", "lo", "more", "off")}
        order = np.lexsort((col["lo"], col["tag"], col["doc"], col["anchor"]))
        col = {k: v[order].astype(np.int64) for k, v in col.items()}
        blobs = table.column("context").to_pylist()
        blobs = [blobs[i] for i in order.tolist()]
        base = np.cumsum([0] + [len(x) for x in blobs])[:-1]
        place = col["lo"] + col["off"]
        # rank of (document, place of the anchor); equal ones are the same occurrence of a repeated row
        by = np.lexsort((place, col["tag"], col["doc"]))
        step = np.zeros(len(by), np.int64)
        for k in (col["doc"], col["tag"], place):
            step[1:] |= k[by][1:] != k[by][:-1]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(step)
        most, least = repeated_windows(np.frombuffer(b"".join(blobs), np.uint8), base, col["off"], col["more"], col["anchor"], rank, span)
        hit = np.flatnonzero(most >= 0)
        return pa.table({"doc": col["doc"][hit], "tag": col["tag"][hit], "start": place[hit] - most[hit], "end": place[hit] - least[hit] + span})

    return (contexts.where("not big").withColumn("bucket", F.pmod(F.col("anchor"), F.lit(buckets))).drop("big")
            .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "doc long, tag long, start long, end long"))


def _window_spans(contexts: DataFrame, span: int) -> DataFrame:
    """Anchors with very many contexts: one row per window, earliest by partial minima."""
    def run(batches):
        for b in batches:
            for anchor, doc, tag, lo, more, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc", "tag", "lo", "more", "context"))):
                p = np.arange(more + 1)
                h = mix(Spans(np.frombuffer(raw, np.uint8)).hash(p, p + span)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), v)) for v in (anchor,)] + [pa.array(h)]
                                                 + [pa.array(np.full(len(p), v)) for v in (doc, tag)] + [pa.array(p + lo)],
                                                 names=["anchor", "window", "doc", "tag", "start"])

    windows = contexts.where("big").mapInArrow(run, "anchor long, window long, doc long, tag long, start long")
    earliest = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc", "tag", "start")).alias("first"))
    return (windows.join(earliest, ["anchor", "window"]).where(F.struct("doc", "tag", "start") > F.col("first"))
            .select("doc", "tag", "start", (F.col("start") + span).alias("end")))


def repeated_spans(docs: DataFrame, span: int = SPAN, text: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc, tag, packed): for every document with something to remove, its maximal removed runs (starts, then ends, u32)."""
    ship(docs.sparkSession)
    rows = _keyed(docs, text)
    found = staged(_anchor_stage(rows, span, group_limit), "anchors")
    probes = found.where("kind = 1")
    contexts = staged(_contexts(rows, probes, span), "contexts")
    parts = found.where("kind = 0").select("doc", "tag", "start", "end").unionByName(_sorted_spans(contexts, span))
    if not contexts.where("big").isEmpty():
        parts = parts.unionByName(_window_spans(contexts, span))
    return _packed_lists(parts, _RUN, merge=True)


def remove_repeats(docs: DataFrame, span: int = SPAN, text: str = "text", group_limit: int = GROUP_LIMIT, with_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with
    ``with_bytes`` the runs (``removed``: array of start, end) and the ``kept`` bytes."""
    rows = _keyed(docs, text)
    joined = rows.join(_small(repeated_spans(docs, span, text, group_limit)), ["doc", "tag"], "left")

    def run(batches):
        for b in batches:
            cols = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")}
            for text_, found in zip(b.column("text").to_pylist(), b.column("packed").to_pylist()):
                raw = (text_ or "").encode()
                runs = list(zip(*(x.tolist() for x in _unpacked(found, _RUN)))) if found else []
                at, kept = 0, []
                for i, j in runs:
                    kept.append(raw[at:i])
                    at = j
                kept = b"".join([*kept, raw[at:]])
                for k, v in zip(cols, (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                                       [{"start": i, "end": j} for i, j in runs] if with_bytes else None, kept if with_bytes else None)):
                    cols[k].append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(v, t) for v, t in zip(cols.values(), types)], names=["doc_id", *cols])

    out = joined.select("doc_id", "text", "packed").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept binary")
    return out if with_bytes else out.drop("removed", "kept")
