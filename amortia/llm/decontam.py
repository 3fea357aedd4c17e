"""Benchmark decontamination over a distributed positional inverted index, DataFrame functions only.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window). The frequency of
every benchmark word in the documents picks the two rarest words of each window; only for these are postings (document,
position) stored. The list of the rarest word, shifted by the words' places in the item, is intersected with the
list of the second rarest, which leaves (document, item, offset) alignments. Only aligned documents are indexed in full:
their postings of the other benchmark words are intersected at the aligned positions, and runs of at least a
window of matching words are exact phrase matches. A window with a word that no document has is never looked up.

Cases: null texts and texts without a word have no words; an item without words has no window; items that share an
item_id count as one id, a null item_id hits but is not listed; repeated documents get equal results; empty tables give
no hits; extra columns are ignored by ``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from amortia.llm.common import broadcast_if_small, lower_ascii, staged, text_key

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NULL_ID = -(1 << 63)


def _pieces(text: Column) -> Column:
    """Words, with an empty string in front or behind where the text starts or ends between words."""
    return F.split(lower_ascii(text), NOT_WORD)


def _count(a: Column) -> Column:
    n = F.size(a)
    return (n - (F.get(a, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(a, n - 1) == "")).cast("int")).cast("long")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"),
                       text_key(F.col(text)).alias("k"), _pieces(F.col(text)).alias("a"))


def _words(keyed: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, word) of every word."""
    rows = keyed.select(*keys, (F.get("a", F.lit(0)) == "").cast("int").alias("__lead"), F.posexplode("a").alias("__pos", "word"))
    return rows.where("word <> ''").select(*keys, (F.col("__pos") - F.col("__lead")).cast("long").alias("pos"), "word")


def benchmark_terms(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(item, item_id, m, ipos, term): the words of every distinct item."""
    items = (benchmark.select("item_id", F.xxhash64("item_id", text).alias("item"), _pieces(F.col(text)).alias("a"))
             .where(F.col("a").isNotNull()).dropDuplicates(["item"]).withColumn("m", _count(F.col("a"))))
    return _words(items, "item", "item_id", "m").withColumnsRenamed({"pos": "ipos", "word": "term"})


def _rare_pairs(terms: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(item, p1, t1, p2, t2): places and words of the rarest and second rarest word of each window, once each."""
    known = terms.join(broadcast_if_small(frequency), "term")
    length = F.least(F.col("m"), F.lit(window))
    starts = known.select("item", "ipos", "term", "n", length.alias("length"), F.explode(F.sequence(
        F.greatest(F.lit(0).cast("long"), F.col("ipos") - length + 1), F.least(F.col("ipos"), F.col("m") - length))).alias("start"))
    order = Window.partitionBy("item", "start").orderBy("n", "ipos")  # a window's words
    ranked = starts.withColumn("r", F.row_number().over(order))
    per = ranked.groupBy("item", "start").agg(
        F.count("*").alias("found"), F.first("length").alias("length"),
        *[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{a}{r}") for r in (1, 2) for c, a in (("ipos", "p"), ("term", "t"))])
    return per.where("found = length").select("item", "p1", "t1", "p2", "t2").distinct()


def alignments(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text"):
    """(item terms, postings of rare words, rare pairs, candidate (d, k, item, delta))."""
    terms = staged(benchmark_terms(benchmark), "terms")
    vocabulary = staged(terms.select(F.col("term").alias("word")).distinct(), "vocabulary")
    keyed = _keyed(docs, text)
    frequency = staged(_words(keyed).join(broadcast_if_small(vocabulary), "word")
                       .groupBy(F.col("word").alias("term")).agg(F.count("*").alias("n")), "frequency")
    pairs = staged(_rare_pairs(terms, frequency, window), "pairs")
    rare = staged(pairs.select(F.col("t1").alias("word")).union(pairs.where("t2 is not null").select("t2")).distinct(), "rare")
    postings = staged(_words(keyed, "d", "k").join(broadcast_if_small(rare), "word"), "postings")
    shifted = (postings.join(broadcast_if_small(pairs), F.col("word") == F.col("t1"))
               .select("d", "k", "item", (F.col("pos") - F.col("p1")).alias("delta"), "t2", "p2"))
    second = postings.select("d", "k", F.col("word").alias("t2"), F.col("pos").alias("q"))
    both = (shifted.where("t2 is not null").withColumn("q", F.col("delta") + F.col("p2"))
            .join(second, ["d", "k", "t2", "q"], "left_semi").select("d", "k", "item", "delta"))
    single = shifted.where("t2 is null").select("d", "k", "item", "delta")
    return terms, postings, pairs, staged(both.union(single).distinct(), "aligned")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(d, k, item, item_id, pos): every document word inside an occurrence of a window, per item."""
    terms, _, _, aligned = alignments(docs, benchmark, window, text)
    needed = aligned.join(broadcast_if_small(terms), "item").select(
        "d", "k", "item", "item_id", "m", "delta", "ipos", (F.col("delta") + F.col("ipos")).alias("pos"), F.col("term").alias("word")).where("pos >= 0")
    some = _keyed(docs, text).join(broadcast_if_small(staged(aligned.select("d", "k").distinct(), "aligned-docs")), ["d", "k"], "left_semi")
    index = _words(some.dropDuplicates(["d", "k"]), "d", "k")
    met = needed.join(index, ["d", "k", "pos", "word"], "left_semi")
    lane = Window.partitionBy("d", "k", "item", "delta")  # at most the words of one item
    runs = met.withColumn("run", F.col("ipos") - F.row_number().over(lane.orderBy("ipos")))
    whole = runs.withColumn("length", F.count("*").over(Window.partitionBy("d", "k", "item", "delta", "run")))
    return whole.where(F.col("length") >= F.least(F.col("m"), F.lit(window))).select("d", "k", "item", "item_id", "pos")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(d, k, item, pos1, pos2): the two rarest words of a window of the item, at most ``slop`` words from the distance
    that they have in the item. A band join: the second list is met by position blocks of slop + 1."""
    _, postings, pairs, _ = alignments(docs, benchmark, window, text)
    step = slop + 1
    block = lambda c: F.floor(F.col(c) / step)
    first = (postings.join(broadcast_if_small(pairs), F.col("word") == F.col("t1")).where("t2 is not null")
             .select("d", "k", "item", F.col("pos").alias("pos1"), "t2", (F.col("pos") - F.col("p1") + F.col("p2")).alias("q"))
             .withColumn("block", F.explode(F.array(*[block("q") + i for i in (-1, 0, 1)]))))
    second = postings.select("d", "k", F.col("word").alias("t2"), F.col("pos").alias("pos2"), block("pos").alias("block"))
    return (first.join(second, ["d", "k", "t2", "block"]).where(F.abs(F.col("pos2") - F.col("q")) <= slop)
            .select("d", "k", "item", "pos1", "pos2").distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, k, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    hits = phrase_matches(docs, benchmark, window, text)
    per_pos = hits.groupBy("d", "k", "pos").agg(F.collect_set("item_id").alias("ids"))
    per_doc = staged(per_pos.groupBy("d", "k").agg(F.count("*").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids")), "hits")
    rows = _keyed(docs, text).select("doc_id", "d", "k", F.coalesce(_count(F.col("a")), F.lit(0).cast("long")).alias("n_words"))
    ids = F.sort_array(F.transform(F.coalesce("ids", F.array()), lambda x: x.cast("string")))
    return rows.join(per_doc, ["d", "k"], "left").select(
        "doc_id", "k", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The input rows without those that hold a window of a benchmark item."""
    bad = staged(phrase_matches(docs, benchmark, window, text).select(F.col("d").alias("__llm_id"), F.col("k").alias("__llm_key")).distinct(), "contaminated")
    return docs.join(broadcast_if_small(bad), (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col("__llm_id"))
                     & (text_key(docs[text]) == F.col("__llm_key")), "left_anti")


ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w FROM benchmark),
g AS (SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') gram FROM
  (SELECT item_id, w, least(len(w), {WINDOW}) len, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM g),
occ AS (SELECT doc_id, p, s.len, item_id FROM (SELECT doc_id, len, unnest(range(1, len(w) - len + 2)) p, w FROM d, lens WHERE len(w) >= len) s
  JOIN g ON g.len = s.len AND g.gram = array_to_string(s.w[p:p + s.len - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(range(p, p + len)) q FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR id FROM occ) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256,
  n_hit IS NOT NULL contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
