"""MinHash near-duplicates by a multi-index Hamming join.

Every document's set of word shingles gets a signature of ``CHUNKS * WIDTH`` b-bit min-hash symbols (b = 16).
The distance of two signatures is the number of differing symbols. The signature is split into
``CHUNKS`` chunks; by pigeonhole two signatures at distance <= CHUNKS * (ERRORS + 1) - 1 = 31 of 112 have a chunk
with at most ``ERRORS`` = 1 difference, so every chunk is entered in the index once for each symbol that may
differ (that symbol left out): all pairs under the threshold share a key, with certainty. Two sets of
Jaccard similarity 0.8 also share a key beyond the threshold unless all 16 chunks have two or more
differences: probability (1 - 0.8**7 - 7 * 0.2 * 0.8**6)**16 = 1e-6, less for more similar ones. (Six symbols
that must agree keep documents that merely share a passage apart: similarity 0.3 shares a key with 6 %.)

Equal sets are one class first (a third of all rows may be copies), and only classes are indexed.
Members of a key are never paired with each other at once: they are compared with a centre per key,
components are formed, and only members in other components than the rest of their key go on: to the most
central member, then (what is left) to the members of other components in blocks, where a bound lets them through. The bound
counts the shingles that a member shares with no other: two sets of sizes n, m with e, f such shingles have at most
min(n - e, m - f) in common. So no link between components is lost, and a large group of copies with edits of
their own costs about its size. Links are confirmed on the full sets.

Cases: null or empty text, or text without a word, has an empty set and links with nothing; a text of
fewer words than a shingle has its whole word sequence as the one shingle; repeated rows are members of
one class; a null ``doc_id`` never becomes the smallest id unless its component has no other; an empty
table gives no rows; extra columns are kept by ``drop_near_duplicates`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amortia.llm.bytesvec import NOT_SPACE, SMALL_BLOCK, Spans, lower_ascii, mix, text_blocks, word_spans
from amortia.llm.common import broadcast_if_small, give_back, ship, shuffle_partitions, staged, text_key
from amortia.llm.components import components

CHUNKS, WIDTH, ERRORS = 16, 7, 1
SYMBOLS = CHUNKS * WIDTH
#: Signatures further apart are not compared in full: at similarity 0.8 the distance has mean 22.4 and
#: standard deviation 4.2, so 48 is passed over with probability below 1e-8.
FAR = 48
#: The least similarity that chunks, errors and FAR are made for: below it true links would be missed.
LEAST_SIMILARITY = 0.8
#: Members of a cluster that one task holds in the exact step.
BLOCK_MEMBERS = 512

_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_LO, _HI = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def shingle_blocks(texts: pa.Array, k: int):
    """Yield per block ``(first_row, rows, row, hash)``: the number of texts in the block and the distinct
    shingles of each, sorted by row and hash."""
    for first, offsets, data in text_blocks(texts, SMALL_BLOCK):
        low = lower_ascii(data)
        row, start, end = word_spans(low, offsets, NOT_SPACE)
        words = mix(Spans(low).hash(start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
        per_row = np.bincount(row, minlength=len(offsets) - 1)
        begin = np.cumsum(per_row) - per_row
        # position of a word in its text, and the number of words of its shingle
        place = np.arange(len(row)) - begin[row]
        length = np.minimum(per_row[row], k)
        at = np.flatnonzero(place <= per_row[row] - length)
        h = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
        for j in range(k):
            inside = j < length[at]
            h[inside] = mix(h[inside] ^ (words[at[inside] + j] + np.uint64(j + 1)))
        r = row[at]
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        if len(r):
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
            r, h = r[new], h[new]
        yield first, len(offsets) - 1, r, h


def signatures(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_lo, set_hi (128-bit digest of the set), sig (min-hash symbols). No shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            n_all, lo_all, hi_all, sig_all = [], [], [], []
            for _, rows_, r, h in shingle_blocks(b.column("text"), k):
                n = np.bincount(r, minlength=rows_)
                lo, hi = np.zeros(rows_, np.uint64), np.zeros(rows_, np.uint64)
                sig = np.zeros((rows_, SYMBOLS), np.uint16)
                some = np.flatnonzero(n)
                if len(some):
                    begin = (np.cumsum(n) - n)[some]
                    lo[some] = np.add.reduceat(mix(h ^ _LO), begin)
                    hi[some] = np.add.reduceat(mix(h ^ _HI), begin)
                    for j in range(SYMBOLS):
                        least = np.minimum.reduceat((h ^ _SEEDS[j]) * _FACTORS[j], begin)
                        sig[some, j] = mix(least) & np.uint64(0xFFFF)
                n_all.append(n)
                lo_all.append(lo)
                hi_all.append(hi)
                sig_all += [s.tobytes() for s in sig]
            if n_all:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_key"), pa.array(np.concatenate(n_all)),
                     pa.array(np.concatenate(lo_all).view(np.int64)), pa.array(np.concatenate(hi_all).view(np.int64)),
                     pa.array(sig_all, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "set_lo", "set_hi", "sig"])
        give_back()

    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_lo long, set_hi long, sig binary")


def _index_keys(classes: DataFrame) -> DataFrame:
    """(key, node): every chunk with each of its symbols left out once."""
    def run(batches):
        for b in batches:
            node = np.asarray(b.column("node"))
            if not len(node):
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(len(node), CHUNKS, WIDTH).astype(np.uint64)
            for c in range(CHUNKS):
                for out in range(WIDTH):
                    kept = [i for i in range(WIDTH) if i != out]
                    key = np.full(len(node), c * WIDTH + out + 1, np.uint64)
                    for i in kept:
                        key = mix(key << np.uint64(16) ^ key ^ sig[:, c, i])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], names=["key", "node"])
        give_back()

    spread = classes.select("node", "sig").repartition(shuffle_partitions(classes.sparkSession), "node")  # a small table, many keys
    return spread.mapInArrow(run, "key long, node long")


def _close(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sizes and signatures allow the similarity (narrow rows, no texts)."""
    a, b = (classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    rows = pairs.join(a, "a").join(b, "b").where(
        (F.least("na", "nb") >= similarity * F.greatest("na", "nb")))

    def run(batches):
        for x in batches:
            if not x.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
            near = (sa != sb).sum(1) <= FAR
            yield pa.RecordBatch.from_arrays([x.column(c).filter(pa.array(near)) for c in "ab"], names=["a", "b"])
        give_back()

    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose full sets have at least the similarity: exact integer test in hundredths."""
    percent = round(similarity * 100)
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")

    def run(batches):
        for x in batches:
            keep = []
            for s, t in zip(x.column("sa").to_pylist(), x.column("sb").to_pylist()):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = np.sort(np.concatenate([s, t]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([x.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], names=["a", "b"])
        give_back()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, text: str) -> DataFrame:
    """(node, shingles) of the representative rows ``wanted(node, doc_id, text_key)``."""
    w = broadcast_if_small(wanted).select(F.col("node"), F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
            .join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))).select("node", "text"))

    def run(batches):
        for b in batches:
            blobs = []
            for _, n, r, h in shingle_blocks(b.column("text"), k):
                cut = np.searchsorted(r, np.arange(n + 1))
                blobs += [h[i:j].tobytes() for i, j in zip(cut.tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(blobs, pa.binary())], names=["node", "shingles"])
        give_back()

    return rows.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, component_id (smallest doc_id reachable over links
    of at least ``similarity``, itself included), set class, kept (doc_id = component_id)."""
    if similarity < LEAST_SIMILARITY:
        raise ValueError(f"similarity {similarity} is below {LEAST_SIMILARITY}, for which the signatures are made")
    rows = staged(signatures(docs, k, text), "signatures")
    classes = (rows.where("n_shingles > 0").groupBy("set_lo", "set_hi")
               .agg(F.min_by(F.struct("doc_id", "text_key", "sig"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("r"),
                    F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")))
    classes = staged(classes.select("set_lo", "set_hi", "n_shingles", "copies", "r.doc_id", "r.text_key", "r.sig"), "classes")
    # A class is named by its smallest doc_id where ids tell classes apart, else by its digest.
    ids = classes.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    node = F.col("doc_id") if ids["n"] == ids["d"] else F.col("set_lo")
    classes = classes.withColumn("node", node)
    labels = _labels(docs, classes, k, similarity, text)
    named = classes.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("set_lo", "set_hi", "component_id", "label")
    out = rows.select("doc_id", "text_key", "n_shingles", "set_lo", "set_hi").join(named, ["set_lo", "set_hi"], "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "text_key", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(None)).otherwise(F.col("label")).alias("component_label"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labels(docs: DataFrame, classes: DataFrame, k: int, similarity: float, text: str) -> DataFrame:
    keys = _index_keys(classes)
    shared = staged(keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("centre")).where("members > 1"), "keys")
    members = staged(keys.join(broadcast_if_small(shared), "key"), "members")
    wanted = staged(members.select("node").distinct().join(classes, "node").select("node", "doc_id", "text_key"), "wanted")
    sets = staged(_sets_of(docs, wanted, k, text), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        near = staged(_close(pairs, classes, similarity), "near")
        return staged(_confirmed(near, sets, similarity), "confirmed")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    links = confirm(members.where("node <> centre").select(*pair("node", "centre")).distinct())
    labels = components(links)
    members = members.where("members > 2").select("key", "node")

    # Members of keys that still hold several components. Shingles that no other of them has are dead weight: they
    # bound the similarity of a pair by two numbers a member, and the member with the least of them is most central.
    seen, mixed = _mixed(members, labels)
    members = staged(seen.join(mixed, "key"), "mixed")
    if members.isEmpty():
        return labels
    weight = staged(_dead_weight(members, sets).join(classes.select("node", "n_shingles"), "node"), "weights")
    members = staged(members.select("key", "node").join(weight.select("node", F.col("dead").alias("e"), F.col("n_shingles").alias("n")), "node"), "mixed")
    bound = lambda n, e, m, f: (
        F.least(n - e, m - f) * (1 + similarity) >= similarity * (n + m) - 1e-6)
    seen, mixed = _mixed(members, labels)
    central = seen.groupBy("key").agg(F.min(F.struct(F.col("e") / F.col("n"), "node", "label", "n", "e")).alias("c"))
    met = (seen.join(central.join(mixed, "key"), "key").select(F.col("node").alias("x"), "label", "n", "e", "c")
           .where(F.col("label") != F.col("c.label")).where(bound(F.col("n"), F.col("e"), F.col("c.n"), F.col("c.e")))
           .select("x", F.col("c.node").alias("y")))
    found = confirm(met.select(*pair("x", "y")).distinct())
    if not found.isEmpty():
        links = staged(links.union(found), "links")
        labels = components(links)
    seen, mixed = _mixed(members, labels)
    seen = staged(seen.join(mixed, "key"), "mixed")
    if seen.isEmpty():
        return labels
    found = staged(_exact_rest(seen, sets, similarity), "rest")
    return labels if found.isEmpty() else components(staged(links.union(found), "links"))


def _exact_rest(seen: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members of one key that are still in different components. The largest component of a key names
    its cluster; members outside of it are the cluster's queries, and are held against all members of the cluster in
    blocks of about ``BLOCK_MEMBERS``, once for all keys. A task sees one block and a slice of the queries; only links
    leave it."""
    percent = round(similarity * 100)
    largest = (seen.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
               .agg(F.max(F.struct("c", "label")).alias("m")).select("key", F.col("m.label").alias("cluster")))
    all_ = seen.join(largest, "key").select("cluster", "node", "label", "n", "e").distinct()
    of = lambda c: F.ceil(c / BLOCK_MEMBERS).cast("int")
    size = all_.groupBy("cluster").agg(of(F.count("*")).alias("blocks"), of(F.count_if(F.col("label") != F.col("cluster"))).alias("slices"))
    sized = staged(all_.join(size.where("slices > 0"), "cluster"), "clusters")
    columns = ["cluster", "block", "slice", "node", "label", "n", "e"]
    # a member is in one block and meets every slice of queries; a query is in one slice and meets every block
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    member = (sized.withColumn("block", own("blocks")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
              .select(*columns, F.lit(False).alias("query")))
    query = (sized.where("label <> cluster").withColumn("slice", own("slices")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*columns, F.lit(True).alias("query")))
    rows = member.unionByName(query).join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        is_query = np.asarray(table.column("query").combine_chunks().cast(pa.int8())) == 1
        node, label, n, e = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "label", "n", "e"))
        blobs = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        m = np.flatnonzero(~is_query)
        a, b = [], []
        if len(m) and is_query.any():
            flat = np.concatenate([blobs[i] for i in m])
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(m)), [len(blobs[i]) for i in m])[order]
            flat = flat[order]
            for q in np.flatnonzero(is_query).tolist():
                most = np.minimum(n[q] - e[q], n[m] - e[m])
                open_ = (label[m] != label[q]) & (most * (100 + percent) >= percent * (n[q] + n[m]))
                if not open_.any():
                    continue
                lo, hi = np.searchsorted(flat, blobs[q], "left"), np.searchsorted(flat, blobs[q], "right")
                count = hi - lo
                at = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
                common = np.bincount(owner[at], minlength=len(m))
                hit = m[open_ & (100 * common >= percent * (n[q] + n[m] - common))]
                a += np.minimum(node[hit], node[q]).tolist()
                b += np.maximum(node[hit], node[q]).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cluster", "block", "slice").applyInArrow(run, "a long, b long").distinct()


def _mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the label of their component, and the keys that hold more than one."""
    seen = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return seen, seen.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")


def _dead_weight(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, dead): how many shingles of a node no other of the nodes has. Counts are partial sums."""
    def explode(batches):
        for b in batches:
            blobs = [np.frombuffer(x, np.int64) for x in b.column("shingles").to_pylist()]
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("node")), [len(x) for x in blobs])), pa.array(np.concatenate(blobs))],
                                                 names=["node", "shingle"])
        give_back()

    nodes = members.select("node").distinct()
    own = (sets.join(nodes, "node", "left_semi").mapInArrow(explode, "node long, shingle long").groupBy("shingle")
           .agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("dead")))
    return nodes.join(own, "node", "left").withColumn("dead", F.coalesce("dead", F.lit(0)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The input rows without all but one row of every group of near-duplicates: the one of the smallest
    doc_id (a null id only if the group has no other; then the smallest text key). Rows without a word
    all stay. Columns are unchanged."""
    found = staged(near_duplicates(docs, k, similarity, text), "groups")
    grouped = found.where("component_label is not null")
    best = grouped.groupBy("component_label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")).select("best.doc_id", "best.text_key")
    gone = staged(grouped.select("doc_id", "text_key").distinct().join(
        best.select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key")),
        F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")), "left_anti")
        .select(F.col("doc_id").alias("__llm_id"), F.col("text_key").alias("__llm_key")), "gone")
    kept = docs.join(broadcast_if_small(gone), docs["doc_id"].cast("long").eqNullSafe(F.col("__llm_id"))
                     & (text_key(docs[text]) == F.col("__llm_key")), "left_anti")
    repeated = grouped.groupBy("doc_id", "text_key").count().where("count > 1").join(
        best.withColumnsRenamed({"doc_id": "b_id", "text_key": "b_key"}),
        F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")), "left_semi")
    if repeated.isEmpty():
        return kept
    # rows that repeat both id and text: one of them stays
    tmp = kept.withColumn("__llm_text_key", text_key(F.col(text))).withColumn("__llm_own", F.when(
        ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.monotonically_increasing_id()))
    return tmp.dropDuplicates(["doc_id", "__llm_text_key", "__llm_own"]).drop("__llm_text_key", "__llm_own")
