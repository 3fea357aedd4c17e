"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Five filters give each document a mask of failed filters, one bit each:

* A: fewer than 50 words; B: fewer than 65 % distinct words; C: more than 5 % capital letters A-Z;
* D: one of ``# $ % & * |``; E: the text of a document with a smaller id.

Documents collapse to *cells*, (part, mask) with the number of documents and of their labels. Every cell
folds across the array of all 120 orders with ``transform`` and ``aggregate``: 600 structs (order, step)
weighted by the cell's counts. The cells of a part (at most 32) are merged by elementwise sums.

E is decided on digests (SHA-256 of the text): documents with one digest, part, mask and labels are one
row before anything is dealt by digest, so a large group of copies is absorbed by partial aggregation.

Cases: a null text is empty, a null source is the part ''; words are runs of non-blanks; repeated rows
count each time, and rows with equal ids do not make each other fail E; a row without id neither fails
E nor makes others fail; a document without label is neither good nor toxic, and one with several
labels is good (toxic) if one of them says so; an empty table has no parts and no rows. Further columns
are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) with the bits of A to D."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = {"A": n < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT * n,
             "C": 100 * capitals > MAX_CAPITALS * F.length("text"), "D": F.col("text").rlike(SYMBOLS)}
    mask = sum((F.when(cond, BIT[f]).otherwise(0) for f, cond in fails.items()), F.lit(0))
    return d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents and labelled documents per part and mask of all five filters."""
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks(docs).join(said, "doc_id", "left")
    alike = ["digest", "part", "mask", "good", "toxic"]
    # rows of one id are one row, so that the first of a group of copies is known with its number of rows
    rows = rows.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    original = F.col("no_id") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    rows = rows.withColumn("original", original)
    parts = F.array(F.struct(F.col("mask"), F.col("original").alias("n")),
                    F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    rows = rows.select("part", "good", "toxic", F.inline(parts)).where("n > 0")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def _fold_sql() -> str:
    """SQL over a cell's mask, n, good and toxic: ``walked`` folds the mask along every order to the step that removes it
    (0: none), ``takes`` counts the orders in which each filter is that step, and the last transform makes the 600
    structs. Both are bound as lambda variables, so each is made once per cell."""
    every = "array(" + ", ".join("array(" + ", ".join(str(BIT[f]) for f in o) + ")" for o in orders()) + ")"
    walked = f"""transform({every}, (o, p) -> named_struct('o', o, 'p', p, 'at',
        aggregate(sequence(1, 5), 0, (at, k) -> if(at = 0 and (mask & element_at(o, k)) <> 0, k, at))))"""
    takes = f"transform(array({', '.join(str(b) for b in BIT.values())}), b -> size(filter(walked, w -> w.at > 0 and element_at(w.o, w.at) = b)))"
    bit = "element_at(w.o, k)"
    step = f"""named_struct('order_at', w.p, 'step', k,
        'kept', if(w.at = 0 or w.at > k, n, 0L), 'removed', if(w.at = k, n, 0L),
        'redundant', if(w.at > 0 and w.at < k and (mask & {bit}) <> 0, n, 0L), 'unique_fails', if(mask = {bit}, n, 0L),
        'good_lost', if(w.at = k, good, 0L), 'toxic_lost', if(w.at = k, toxic, 0L),
        'shapley', n * element_at(takes, cast(log2({bit}) as int) + 1))"""
    made = f"flatten(transform(walked, w -> transform(sequence(1, 5), k -> {step})))"
    return f"flatten(transform(array({walked}), walked -> flatten(transform(array({takes}), takes -> {made}))))"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of ``COUNTS``."""
    folded = cells(docs, labels).select("part", F.expr(_fold_sql()).alias("steps"))
    add = ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS)
    total = f"""aggregate(slice(many, 2, size(many)), many[0],
        (sum, one) -> zip_with(sum, one, (x, y) -> named_struct('order_at', x.order_at, 'step', x.step, {add})))"""
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("many")).select("part", F.expr(f"inline({total})"))
    named = F.element_at(F.array(*[F.lit(o) for o in orders()]), F.col("order_at") + 1)
    return merged.select("part", named.alias("filter_order"), "step", *COUNTS)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
m AS (SELECT w.doc_id, w.part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
        100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 5 * length(w.t) AS c,
        regexp_matches(w.t, '[#$%&*|]') AS dd, w.doc_id > f.first AS e,
        coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad
      FROM w JOIN firsts f ON w.t = f.t LEFT JOIN labels l ON l.doc_id = w.doc_id),
cell AS (SELECT part, a, b, c, dd, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ord AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letter p, letter q, letter r, letter s, letter u
        WHERE q.x <> p.x AND r.x NOT IN (p.x, q.x) AND s.x NOT IN (p.x, q.x, r.x) AND u.x NOT IN (p.x, q.x, r.x, s.x)),
fails AS (SELECT part, n, good, bad, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
            || (CASE WHEN dd THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM cell),
st AS (SELECT part, n, good, bad, failed, filter_order, step, substr(filter_order, step, 1) AS f,
         (SELECT min(i) FROM unnest([1, 2, 3, 4, 5]) v(i) WHERE contains(failed, substr(filter_order, i, 1))) AS pos
       FROM fails, ord, unnest([1, 2, 3, 4, 5]) k(step)),
r AS (SELECT part, filter_order, step, f,
        CAST(sum(CASE WHEN pos IS NULL OR pos > step THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN pos = step THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN pos < step AND contains(failed, f) THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN failed = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN pos = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN pos = step THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM st GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
