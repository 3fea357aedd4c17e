"""Line de-duplication by a log-template tree, DataFrame functions only.

Every line with a word goes down a tree of fixed depth: number of words, then the leading words, with variable
words (any with a digit) generalised, unless they are more than half of the line. Its leaf holds the whole generalised line, and three templates that
generalise one more field each: the first, middle or last third of the words behind the leading ones. Lines that
differ in one such field (a name, a title) so meet in a template. A template *recurs* when at least ``min_docs`` documents
hold a line of it; its lines are dropped from all documents.

A document that is recurring lines for more than half of its words is a copy, not a text with boilerplate: it is
left whole for document-level de-duplication. Templates are 64-bit hashes; a document counts once per template, and
counts are partial sums, so a line that a third of all rows hold is no hot key.

Cases: null text stays null; empty texts and lines without a word are left as they are; each row counts as one
document, repeated rows too; an empty table gives no rows; columns are kept, ``n_lines`` and ``n_dropped`` replace
columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amortia.llm.common import broadcast_if_small, staged, text_key

LEADING = 2
#: Templates with a field left out need as many fixed words at least.
MIN_FIXED = 4
MIN_DOCS = 3
FIELDS = 3


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"[\x09-\x0D\x20]+"), lambda w: w != "")


def _templates(w: Column) -> Column:
    """Hashes of the templates of a line's generalised words."""
    n = F.size(w)
    rest = n - LEADING
    out = [F.xxhash64(F.lit(-1), w)]
    for k in range(FIELDS):
        start, stop = F.floor(rest * k / FIELDS).cast("int"), F.floor(rest * (k + 1) / FIELDS).cast("int")
        out.append(F.when((stop > start) & (n - (stop - start) >= MIN_FIXED), F.xxhash64(
            F.lit(k), n, F.slice(w, F.lit(1), start + LEADING), F.lit("|"), F.slice(w, stop + LEADING + 1, rest - stop))))
    return F.array_compact(F.array(*out))


def parsed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key and ``lines``: array of (place, n words, templates) of the lines with a word. No shuffle."""
    def parse(line, place):
        def generalised(low):
            # from the start of a word, without going back: linear in the line
            masked = _words(F.regexp_replace(low, r"(?<![^\x09-\x0D\x20])[^\x09-\x0D\x200-9]*+[0-9][^\x09-\x0D\x20]*+", "<*>"))
            # a line that is mostly variable has no template but itself
            return _let(masked, lambda m: F.when(2 * F.size(F.filter(m, lambda w: w == "<*>")) <= F.size(m), m).otherwise(_words(low)))

        # without a digit a line's words are the same either way
        words = _let(F.lower(line), lambda low: F.when(low.rlike("[0-9]"), generalised(low)).otherwise(_words(low)))
        return _let(words, lambda w: F.struct(place.alias("place"), F.size(w).alias("n"), F.when(F.size(w) > 0, _templates(w)).alias("templates")))

    return docs.where(F.col(text).isNotNull()).select(
        "doc_id", text_key(F.col(text)).alias("text_key"),
        F.filter(F.transform(F.split(text, "\n"), parse), lambda x: x["n"] > 0).alias("lines"))


def recurring_templates(parsed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(template): those that lines of at least ``min_docs`` rows share. A row counts once: its templates are made
    distinct in the row, so the count is one partial aggregation."""
    own = F.array_distinct(F.flatten(F.transform("lines", lambda x: x["templates"])))
    return (parsed.select(F.explode(own).alias("template")).groupBy("template").agg(F.count("*").alias("docs"))
            .where(F.col("docs") >= min_docs).select("template"))


def recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, places, n_dropped): documents that lose lines, with the places of these lines."""
    parsed = staged(parsed_lines(docs, text), "lines")
    recurring = staged(recurring_templates(parsed, min_docs), "templates")
    each = parsed.select("doc_id", "text_key", F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]).alias("total"),
                         F.explode("lines").alias("line"))
    hit = (each.select("doc_id", "text_key", "total", "line.place", "line.n", F.explode("line.templates").alias("template"))
           .join(broadcast_if_small(recurring), "template", "left_semi")
           .groupBy("doc_id", "text_key", "place").agg(F.first("total").alias("total"), F.first("n").alias("n")))
    per_doc = hit.groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("places"), F.sum("n").alias("words"), F.first("total").alias("total"))
    return per_doc.where(2 * F.col("words") <= F.col("total")).select("doc_id", "text_key", "places", F.size("places").cast("long").alias("n_dropped"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The input rows with ``text`` less its recurring lines, ``n_lines`` (lines with a word) and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    found = staged(recurring_lines(docs, text, min_docs), "dropped")
    places = found.agg(F.coalesce(F.sum("n_dropped"), F.lit(0))).first()[0]
    side = found.select(F.col("doc_id").alias("__llm_id"), F.col("text_key").alias("__llm_key"), F.col("places").alias("__llm_places"), F.col("n_dropped").alias("__llm_dropped"))
    # 4 bytes a place: broadcast below some 20 MB, else a shuffled join
    joined = docs.join(F.broadcast(side) if places <= 1_000_000 else side,
                       docs["doc_id"].eqNullSafe(F.col("__llm_id")) & (text_key(docs[text]) == F.col("__llm_key")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.concat_ws("\n", F.filter(lines, lambda x, i: ~F.array_contains("__llm_places", i)))
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x09-\x0D\x20]"))).cast("long")
    return joined.withColumns({
        "n_lines": F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n_lines),
        "n_dropped": F.coalesce("__llm_dropped", F.lit(0)),
        text: F.when(F.col("__llm_places").isNull(), F.col(text)).otherwise(kept)}).drop("__llm_id", "__llm_key", "__llm_places", "__llm_dropped")


ORACLE = f"""
WITH l AS (SELECT doc_id, i - 1 AS place, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) i FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, place, list_filter(string_split_regex(regexp_replace(lower(line), '[^\x09-\x0D\x20]*[0-9][^\x09-\x0D\x20]*', '<*>', 'g'), '[\x09-\x0D\x20]+'), lambda x: x <> '') m,
  list_filter(string_split_regex(lower(line), '[\x09-\x0D\x20]+'), lambda x: x <> '') raw FROM l),
w AS (SELECT doc_id, place, CASE WHEN 2 * len(list_filter(m, lambda x: x = '<*>')) <= len(m) THEN m ELSE raw END w FROM m),
p AS (SELECT *, len(w) n, unnest([-1, {', '.join(str(k) for k in range(FIELDS))}]) k FROM w WHERE len(w) > 0),
c AS (SELECT *, floor((n - {LEADING}) * k / {FIELDS}.0)::BIGINT a, floor((n - {LEADING}) * (k + 1) / {FIELDS}.0)::BIGINT b FROM p),
t AS (SELECT doc_id, place, n, CASE WHEN k = -1 THEN {{'k': k, 'n': n, 'x': w, 'y': []::VARCHAR[]}}
  ELSE {{'k': k, 'n': n, 'x': w[1:a + {LEADING}], 'y': w[b + {LEADING} + 1:]}} END tpl
  FROM c WHERE k = -1 OR (b > a AND n - (b - a) >= {MIN_FIXED})),
r AS (SELECT tpl FROM t GROUP BY tpl HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
hit AS (SELECT DISTINCT doc_id, place, n FROM t WHERE tpl IN (SELECT tpl FROM r)),
tot AS (SELECT doc_id, sum(len(w)) total, count(*) FILTER (len(w) > 0) n_lines FROM w GROUP BY doc_id),
cut AS (SELECT doc_id, list(place) places, count(*) n_dropped FROM hit JOIN tot USING (doc_id) GROUP BY doc_id, total HAVING 2 * sum(n) <= total)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT n_lines, coalesce(n_dropped, 0)::BIGINT n_dropped,
  sha256(coalesce(CASE WHEN places IS NULL THEN text ELSE (SELECT string_agg(line, chr(10) ORDER BY place) FROM l WHERE l.doc_id = d.doc_id AND NOT list_contains(cut.places, l.place)) END, '')) kept_sha256
FROM documents d LEFT JOIN tot USING (doc_id) LEFT JOIN cut USING (doc_id)"""
