"""Spelling variants by permuterm rotations.

Every word is marked with an end sign and turned: ``w$`` of length m + 1 has m + 1 rotations. The
rotation ``b$a`` of a word ``ab`` is the common prefix of

* the rotations ``b$ax`` of all words ``axb``: one character put in, and
* for two words ``axb`` and ``ayb``: one character replaced.

So each word is entered under all its rotations (as the shorter word) and under all its rotations
without their last character, which is the edited one (as the longer, or as a replacement). The
entries are sorted in ranges by this prefix; one scan over each prefix range sees at most one entry per
character of the alphabet and the shorter word, and hands every entry the number of its neighbours
and the best of them. No pair is written. An insertion into a run of one character is found under
several prefixes and counted under that of the run's start only.

The root of a word follows the forms by pointer doubling: counts at least double with each step, so a
chain has at most log2(n) words and few rounds are needed; each round is a written table.

Cases: null or empty texts have no words; a row without id deletes no character; very long texts and
very frequent words are absorbed by partial counts; repeated rows count each time; ties go to the
smallest word in code-point order; an empty table gives an empty result; further columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amortia.llm.common import lower_ascii, shuffle_partitions, staged

RUN = "[A-Za-zÀ-ÿ]+"
END = "$"                      # not in the alphabet
DELETE_EVERY, MIN_CHARS, MIN_COUNT, FORM_FACTOR = 97, 5, 3, 2


def words(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least ``MIN_CHARS`` characters that occur ``MIN_COUNT`` times or more."""
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run")).alias("run"))
    # a deletion leaves one character less, so shorter runs than this cannot become words
    runs = runs.where(F.length("run") >= MIN_CHARS)
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
                .where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_CHARS)))


def rotations(vocabulary: DataFrame) -> DataFrame:
    """(prefix, word, n, shorter, first): each word under its rotations (``shorter``), and under its rotations without
    their last character; ``first`` unless that character equals the one before it in the word."""
    w, size = F.col("word"), F.length("word")
    at = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    a, at_next = F.substring(w, F.lit(1), F.col("at")), F.col("at") + 1
    tail = lambda i: F.substring(w, i + 1, size)  # noqa: E731 - from position i (from 0) on
    entries = F.array(
        F.struct(F.concat(tail(F.col("at")), F.lit(END), a).alias("prefix"), F.lit(True).alias("shorter"), F.lit(False).alias("first")),
        F.when(F.col("at") < size, F.struct(
            F.concat(tail(at_next), F.lit(END), a).alias("prefix"), F.lit(False).alias("shorter"),
            ((F.col("at") == 0) | (F.substring(w, at_next, F.lit(1)) != F.substring(w, F.col("at"), F.lit(1)))).alias("first"))))
    return at.select("word", "n", F.explode(entries).alias("e")).where("e is not null").select("e.*", "word", "n")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best: struct(n, word)) of the words that have a neighbour."""
    spark = vocabulary.sparkSession
    entries = rotations(vocabulary).repartitionByRange(shuffle_partitions(spark), "prefix")
    group = Window.partitionBy("prefix")
    best_first = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    who = F.struct("n", "word")
    scanned = entries.select(
        "word", "shorter", "first", F.first(who).over(best_first).alias("top"), F.nth_value(who, 2).over(best_first).alias("second"),
        F.sum(F.col("shorter").cast("int")).over(group).alias("n_shorter"), F.sum((~F.col("shorter")).cast("int")).over(group).alias("n_longer"),
        F.sum(F.col("first").cast("int")).over(group).alias("n_first")).where("second is not null")
    near = F.when(F.col("shorter"), F.col("n_first")).otherwise(
        F.col("n_longer") - 1 + F.when(F.col("first"), F.col("n_shorter")).otherwise(0))
    other = F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top"))
    return scanned.groupBy("word").agg(F.sum(near).cast("long").alias("n_near"),
                                       F.min(F.struct((-other["n"]).alias("minus"), other["word"].alias("word"))).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers doubled until none moves."""
    links = staged(forms.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = staged(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                 F.col("further").isNotNull().alias("moved")), "links")
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs``."""
    vocabulary = staged(words(docs), "words")
    joined = vocabulary.join(neighbours(vocabulary), "word", "left")
    best_n = -F.col("best.minus")
    is_form = best_n >= FORM_FACTOR * F.col("n")
    forms = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"),
                                 F.when(is_form, best_n).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# CRC-32 (reflected polynomial EDB88320) in SQL: the byte table by rule, then a fold over the bytes of "<doc_id>:<run>".
ORACLE = r"""
WITH tab AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM documents WHERE text IS NOT NULL),
per AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2),
        lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INT) + 1]))) AS h FROM per, tab),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word,
                 CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1),
v AS (SELECT word, n FROM words WHERE n >= 3 AND length(word) >= 5),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM v),
del AS (SELECT word, n, j, substr(word, 1, j - 1) || substr(word, j + 1) AS rest FROM cut),
pairs AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.rest = b.rest AND a.j = b.j AND a.word <> b.word
          UNION SELECT d.word, v.word, v.n FROM del d JOIN v ON d.rest = v.word
          UNION SELECT v.word, d.word, d.n FROM del d JOIN v ON d.rest = v.word),
ranked AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS r, count(*) OVER (PARTITION BY word) AS k FROM pairs),
forms AS (SELECT v.word, v.n, coalesce(r.k, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN r.other END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
          FROM v LEFT JOIN ranked r ON r.word = v.word AND r.r = 1),
chain AS (WITH RECURSIVE c(word, node, depth) AS (SELECT word, word, 0 FROM forms
            UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN forms f ON f.word = c.node WHERE f.form IS NOT NULL)
          SELECT word, arg_max(node, depth) AS root FROM c GROUP BY word)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain ON chain.word = f.word"""
