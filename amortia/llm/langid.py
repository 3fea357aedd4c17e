"""Language identification by nearest centroid.

A text's vector holds its byte trigrams (letters lower-cased, runs between words one blank), hashed to ``DIMENSIONS``, as
log term frequency times inverse document frequency, scaled to length 1. Document frequencies are counted over all
training rows. Each language is described by the centroids of up to ``CLUSTERS`` spherical k-means clusters, fitted on at
most ``SAMPLE`` labelled training rows per language (those with the smallest hash of doc_id; the one bound of this
operator). A cluster that lies nearer to another language's mean than to its own is label noise and is left out.
A text gets the language of its nearest centroid by cosine; ``rejected`` tells that even this one is further away
than all but ``REJECT_SHARE`` of the cluster's own sample.

Cases: null text, or text without a letter, is ``und`` with score 0 and rejected; a null doc_id is a training row;
a null language is never learned from; without any labelled row every text is ``und``; repeated rows get equal
results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amortia.llm.bytesvec import LOWER, text_blocks
from amortia.llm.common import broadcast_if_small, ship, staged, text_key
from amortia.llm.pretok import LETTER, byte_classes

DIMENSIONS = 4096
CLUSTERS = 4
SAMPLE = 1000
ITERATIONS = 12
REJECT_SHARE = 0.005
ROWS_AT_ONCE = 512

# letters of ASCII in lower case, everything else of ASCII a blank, other bytes as they are
_FOLD = np.array([b if b >= 128 else int(LOWER[b]) if chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def count_blocks(texts: pa.Array):
    """Yield ``(counts, has_letter)``: trigram counts (rows x DIMENSIONS, float32) of up to ROWS_AT_ONCE texts."""
    for _, offsets, data in text_blocks(texts):
        letter = np.concatenate([[0], np.cumsum(byte_classes(data) == LETTER)])
        x = _FOLD[data].astype(np.uint32)
        gram = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) if len(x) > 2 else np.zeros(0, np.uint32)
        place = (gram * np.uint32(2654435761)) >> np.uint32(20)
        use = np.ones(len(gram), bool)
        use[(x[:-2] == 0x20) & (x[1:-1] == 0x20)] = False
        for back in (1, 2):  # trigrams that run into the next text
            cut = offsets[1:] - back
            cut = cut[(cut >= 0) & (cut < len(gram))]
            use[cut] = False
        for r in range(0, len(offsets) - 1, ROWS_AT_ONCE):
            bounds = offsets[r:r + ROWS_AT_ONCE + 1]
            rows = len(bounds) - 1
            a, b = bounds[0], min(bounds[-1], len(gram))
            row = np.repeat(np.arange(rows), np.diff(bounds))[:max(b - a, 0)]
            key = (row * DIMENSIONS + place[a:b])[use[a:b]]
            counts = np.bincount(key, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS).astype(np.float32)
            yield counts, np.diff(letter[bounds]) > 0


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)


def _cluster(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids and the cluster of each row."""
    unit = lambda m: m / max(float(np.sqrt((m * m).sum())), 1e-9)
    seeds = [unit(x.mean(0))]
    while len(seeds) < min(CLUSTERS, len(x)):
        seeds.append(x[int(np.argmin((x @ np.array(seeds).T).max(1)))])
    centroids = np.array(seeds)
    for _ in range(ITERATIONS):
        own = (x @ centroids.T).argmax(1)
        centroids = np.array([unit(x[own == k].mean(0)) if (own == k).any() else centroids[k] for k in range(len(centroids))])
    return centroids, (x @ centroids.T).argmax(1)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE):
    """``(idf, languages, centroids, radii)`` from the rows of ``docs(doc_id, lang, text)`` with a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col(text).isNotNull()).select("doc_id", "lang", F.col(text).alias("text"))

    def frequency(batches):
        held, rows = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            for counts, _ in count_blocks(b.column("text")):
                held += (counts > 0).sum(0)
                rows += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(np.append(held, rows))], names=["d", "n"])

    df = np.zeros(DIMENSIONS + 1, np.int64)
    for r in known.select("text").mapInArrow(frequency, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect():  # DIMENSIONS + 1 rows
        df[r["d"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1

    # The rows of least hash. They lie under a cut that leaves some ``4 * sample`` rows a language, so what is ranked in one
    # task does not grow with the language's rows.
    sizes = staged(known.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "n_lang"), "sizes")
    share = F.xxhash64("doc_id") / float(1 << 64) + 0.5
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "k")
    chosen = (known.select("doc_id", "lang", text_key(F.col("text")).alias("k"))
              .join(broadcast_if_small(sizes), F.col("lang") == F.col("n_lang")).where(share * F.col("n") <= 4 * sample)
              .withColumn("r", F.row_number().over(order))
              .where(F.col("r") <= sample).select(F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang"), F.col("k").alias("c_k")))
    chosen = broadcast_if_small(staged(chosen, "sample"))  # at most ``sample`` rows a language, counted
    rows = known.join(chosen, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("lang") == F.col("c_lang")) & (text_key(F.col("text")) == F.col("c_k")), "left_semi")

    def embed(batches):
        for b in batches:
            v = [vectors(c, idf).astype(np.float16) for c, _ in count_blocks(b.column("text"))]
            if v:
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([x.tobytes() for m in v for x in m], pa.binary())], names=["lang", "v"])

    def cluster(table: pa.Table) -> pa.Table:
        x = np.sort(np.array(table.column("v").to_pylist(), object))  # the same fit whatever the order of rows
        x = np.frombuffer(b"".join(x), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
        centroids, own = _cluster(x)
        used = [k for k in range(len(centroids)) if (own == k).any()]
        radius = [float(np.quantile(x[own == k] @ centroids[k], REJECT_SHARE)) for k in used]
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": [lang] * len(used), "rows": pa.array([int((own == k).sum()) for k in used], pa.int64()), "radius": radius,
                         "centroid": pa.array([centroids[k].astype(np.float32).tobytes() for k in used], pa.binary())})

    # CLUSTERS rows a language come to the driver
    found = sorted(rows.select("lang", "text").mapInArrow(embed, "lang string, v binary").groupBy("lang").applyInArrow(
        cluster, "lang string, rows long, radius double, centroid binary").collect(), key=lambda r: (r["lang"], r["centroid"]))
    if not found:
        return idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0)
    c = np.array([np.frombuffer(r["centroid"], np.float32) for r in found])
    langs, size = [r["lang"] for r in found], np.array([r["rows"] for r in found], float)
    names = sorted(set(langs))
    mean = np.array([(c * size[:, None])[[x == n for x in langs]].sum(0) for n in names])
    mean /= np.maximum(np.sqrt((mean * mean).sum(1, keepdims=True)), 1e-9)
    keep = [i for i, n in enumerate(langs) if names[int((mean @ c[i]).argmax())] == n] or list(range(len(langs)))
    missing = set(names) - {langs[i] for i in keep}
    keep += [i for i, n in enumerate(langs) if n in missing]
    return idf, [langs[i] for i in keep], c[keep], np.array([found[i]["radius"] for i in keep])


def predict(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row; only the text is looked at."""
    idf, langs, centroids, radii = model
    names = np.array([*langs, "und"], object)

    def run(batches):
        for b in batches:
            lang, score, rejected = [], [], []
            for counts, letters in count_blocks(b.column("text")):
                if not len(langs):
                    letters = np.zeros(len(counts), bool)
                    near, best = np.zeros(len(counts), np.int64), np.zeros(len(counts))
                else:
                    cosine = vectors(counts, idf) @ centroids.T
                    near = cosine.argmax(1)
                    best = np.clip(cosine[np.arange(len(near)), near].astype(float), 0.0, 1.0)
                lang += names[np.where(letters, near, len(langs))].tolist()
                score += np.where(letters, best, 0.0).tolist()
                rejected += (~letters | (best < (radii[near] if len(langs) else 2.0))).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, text: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score, rejected."""
    ship(docs.sparkSession)
    model = fit(docs.where(~held_out()), text)
    return predict(docs, model, text).withColumn("held_out", held_out())
