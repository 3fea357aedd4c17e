"""Quality rules with adaptive thresholds, DataFrame functions only.

Each document gets counts (words, symbols, repeated lines, words in repeated 3-word windows) and four integer
rates. Per language and source every rate is summarised in a quantile sketch: counts in log-linear buckets (exact below
64, then 32 buckets per power of two, so a relative error of 1/32). Sketches merge by adding counts: they are built by
partial aggregation, and a (language, source) with fewer than ``min_docs`` documents uses the merged sketch of
its language, or of all documents. The threshold of a rate is its median plus or minus
``max(spread_factor * (q75 - q25), min_spread)``; a document outside of one is rejected. So clean documents of an odd source
are judged by that source, and no share of the documents is cut by rule.

Cases: null text counts as empty (0 words: the base rule fails); null language or source is a group of its own;
repeated rows get equal results; an empty table gives no rows; columns of the same names as the results are not
passed on (``score`` returns doc_id, lang, source, text_key and results; ``filter_documents`` returns the input columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from amortia.llm.common import broadcast_if_small, staged, text_key

SPACES = r"[\x09-\x0D\x20]+"
#: rate -> least distance of a threshold from the median, in the rate's units
MIN_SPREAD = {"symbol_rate": 100, "upper_rate": 300, "dup_line_rate": 400, "word_length": 300}
SPREAD_FACTOR = 4
MIN_DOCS = 100


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source, text_key, counts and rates of every row. No shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    one = docs.select("doc_id", "lang", "source", text_key(F.col(text)).alias("text_key"), t.alias("t"))
    two = one.select(
        "doc_id", "lang", "source", "text_key",
        F.filter(F.split("t", SPACES), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("upper"))
    # 3-word windows by hash, with their place
    hashes = two.withColumn("h", F.when(F.size("w") > 2, F.transform(
        F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))))
    # only texts with an equal pair are sorted: neighbours in the order of hashes are repeats
    ordered = hashes.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    last = F.size("s") - 1
    at = lambda i: F.get(F.col("s"), i)["h"]
    places = ordered.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda x, i: ((i > 0) & (x["h"] == at(i - 1))) | ((i < last) & (x["h"] == at(i + 1)))), lambda x: x["i"])))
    # a window covers three words, less where the next repeated window starts earlier
    covered = F.aggregate(F.transform("p", lambda x, i: F.when(i < F.size("p") - 1, F.least(F.lit(3), F.get("p", i + 1) - x)).otherwise(3)),
                          F.lit(0), lambda a, x: a + x)
    counts = places.select(
        "doc_id", "lang", "source", "text_key", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "upper", F.size("lines").cast("long").alias("n_lines"))
    per = lambda x, of, scale: F.when(F.col(of) > 0, F.expr(f"{scale} * {x} div {of}")).otherwise(F.lit(0)).cast("long")
    return counts.withColumns({
        "symbol_rate": per("n_symbols", "n_words", 1000), "upper_rate": per("upper", "word_chars", 1000),
        "dup_line_rate": per("n_dup_lines", "n_lines", 1000), "word_length": per("word_chars", "n_words", 100),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))})


def bucket_of(v: Column) -> Column:
    """Log-linear bucket of an integer >= 0."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (32 * e + F.call_function("shiftright", v, e)).cast("long")


def bucket_floor(b: Column) -> Column:
    """Least value of a bucket."""
    e = F.greatest(F.floor(b / 32).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", b - 32 * e, e).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): mergeable by summing n. Rows that fail the base rule are left out."""
    names = ", ".join(f"'{r}', {r}" for r in MIN_SPREAD)
    long_ = measured.where("not base_failed").select("lang", "source", F.expr(f"stack({len(MIN_SPREAD)}, {names}) as (rate, v)"))
    return long_.groupBy("lang", "source", "rate", bucket_of(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, *by: str, spread_factor: int = SPREAD_FACTOR) -> DataFrame:
    """Per group and rate: n documents, lo and hi. A window holds one group's buckets (at most some hundreds of rows)."""
    group = Window.partitionBy(*by, "rate")
    up_to = F.sum("n").over(group.orderBy("bucket"))
    cum = sketch.withColumns({"cum": up_to, "total": F.sum("n").over(group)})
    q = lambda p: bucket_floor(F.min(F.when(100 * F.col("cum") >= p * F.col("total"), F.col("bucket"))))
    stats = cum.groupBy(*by, "rate").agg(F.max("total").alias("docs"), q(25).alias("q25"), q(50).alias("q50"), q(75).alias("q75"))
    least = F.create_map(*[x for k, v in MIN_SPREAD.items() for x in (F.lit(k), F.lit(v))])[F.col("rate")]
    room = F.greatest(spread_factor * (F.col("q75") - F.col("q25")), least)
    return stats.select(*by, "rate", "docs", (F.col("q50") - room).alias("lo"), (F.col("q50") + room).alias("hi"))


def _limits(sketch: DataFrame, min_docs: int) -> DataFrame:
    """One row per (language, source): lo_ and hi_ of every rate, from the smallest level with enough documents."""
    own = thresholds(sketch, "lang", "source")
    language = thresholds(merge(sketch, "lang"), "lang").select(F.col("lang").alias("l_lang"), F.col("rate").alias("l_rate"),
                                                               F.col("docs").alias("l_docs"), F.col("lo").alias("l_lo"), F.col("hi").alias("l_hi"))
    whole = thresholds(merge(sketch)).select(F.col("rate").alias("w_rate"), F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"))
    both = (own.join(language, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")), "left")
            .join(F.broadcast(whole), F.col("rate") == F.col("w_rate"), "left"))  # one row per rate
    pick = lambda x: (F.when(F.col("docs") >= min_docs, F.col(x)).when(F.col("l_docs") >= min_docs, F.col(f"l_{x}"))
                      .otherwise(F.col(f"w_{x}")))
    chosen = both.select("lang", "source", "rate", pick("lo").alias("lo"), pick("hi").alias("hi"))
    return chosen.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(
        *[F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{c}_{r}") for r in MIN_SPREAD for c in ("lo", "hi")])


def score(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts, rates, base_failed and kept of every row."""
    measured = staged(measures(docs, text), "measures")
    sketch = staged(sketches(measured), "sketches")
    limits = staged(_limits(sketch, min_docs), "limits")
    joined = measured.join(broadcast_if_small(limits), F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for r in MIN_SPREAD:
        inside = inside & F.coalesce(F.col(r).between(F.col(f"lo_{r}"), F.col(f"hi_{r}")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select(*measured.columns, "kept")


def filter_documents(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The input rows that are kept, with their columns."""
    gone = staged(score(docs, text, min_docs).where("not kept").select(
        F.col("doc_id").alias("__llm_id"), F.col("text_key").alias("__llm_key"), F.col("lang").alias("__llm_lang"), F.col("source").alias("__llm_source")).distinct(), "rejected")
    return docs.join(broadcast_if_small(gone), docs["doc_id"].eqNullSafe(F.col("__llm_id")) & (text_key(docs[text]) == F.col("__llm_key"))
                     & docs["lang"].eqNullSafe(F.col("__llm_lang")) & docs["source"].eqNullSafe(F.col("__llm_source")), "left_anti")


def _oracle() -> str:
    rates = list(MIN_SPREAD)
    level = lambda name, by, src: f"""  # noqa: E731
{name}_c AS (SELECT {by}rate, bucket, n, sum(n) OVER (PARTITION BY {by}rate ORDER BY bucket) cum, sum(n) OVER (PARTITION BY {by}rate) total FROM {src}),
{name}_q AS (SELECT {by}rate, max(total) docs,
  min(CASE WHEN 100 * cum >= 25 * total THEN bucket END) b25, min(CASE WHEN 100 * cum >= 50 * total THEN bucket END) b50, min(CASE WHEN 100 * cum >= 75 * total THEN bucket END) b75
  FROM {name}_c GROUP BY {by}rate),
{name} AS (SELECT {by}rate, docs, {val('b50')} - greatest({SPREAD_FACTOR} * ({val('b75')} - {val('b25')}), m) lo,
  {val('b50')} + greatest({SPREAD_FACTOR} * ({val('b75')} - {val('b25')}), m) hi FROM {name}_q JOIN spread USING (rate))""".replace("  # noqa: E731", "")
    val = lambda b: f"(CASE WHEN {b} < 64 THEN {b} ELSE ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1) END)"
    passes = " AND ".join(f"coalesce(bool_and({r} BETWEEN lo AND hi) FILTER (rate = '{r}'), true)" for r in rates)
    return f"""
WITH spread(rate, m) AS (VALUES {', '.join(f"('{r}', {v}::BIGINT)" for r, v in MIN_SPREAD.items())}),
base AS (SELECT doc_id, lang, source, coalesce(text, '') t FROM documents),
words AS (SELECT *, list_filter(string_split_regex(t, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D\\x20]')) lines FROM base),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM words WHERE len(w) > 2)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM tri) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT k) n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) k FROM rep) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT n_words, length(regexp_replace(t, '[\\x09-\\x0D\\x20]', '', 'g'))::BIGINT word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT upper, len(lines)::BIGINT n_lines
  FROM words LEFT JOIN rw USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END symbol_rate, CASE WHEN word_chars > 0 THEN 1000 * upper // word_chars ELSE 0 END upper_rate,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END dup_line_rate, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END word_length,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m),
u AS (UNPIVOT (SELECT lang, source, symbol_rate, upper_rate, dup_line_rate, word_length FROM f WHERE NOT base_failed) ON {', '.join(rates)} INTO NAME rate VALUE v),
sk AS (SELECT lang, source, rate, 32 * greatest(length(bin(v)) - 6, 0) + (v >> greatest(length(bin(v)) - 6, 0)) bucket, count(*) n FROM u GROUP BY ALL),
skl AS (SELECT lang, rate, bucket, sum(n) n FROM sk GROUP BY ALL),
skw AS (SELECT rate, bucket, sum(n) n FROM sk GROUP BY ALL),
{level('own', 'lang, source, ', 'sk')},
{level('lng', 'lang, ', 'skl')},
{level('whole', '', 'skw')},
lim AS (SELECT o.lang, o.source, o.rate, CASE WHEN o.docs >= {MIN_DOCS} THEN o.lo WHEN l.docs >= {MIN_DOCS} THEN l.lo ELSE w.lo END lo,
  CASE WHEN o.docs >= {MIN_DOCS} THEN o.hi WHEN l.docs >= {MIN_DOCS} THEN l.hi ELSE w.hi END hi
  FROM own o JOIN lng l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate JOIN whole w ON w.rate = o.rate)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passes} AS kept
FROM f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.lang AND f.source IS NOT DISTINCT FROM lim.source
GROUP BY doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""


ORACLE = _oracle()
