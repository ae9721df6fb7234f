"""Quality rules from cross-document line frequency, with DataFrame functions only.

Lines are normalised and hashed; a hash that occurs in too large a part of a host's
documents is boilerplate. Its lines are removed, and a document that loses more than
half its words so is rejected, beside simple rules on the document itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import LOWER, STRIP, UPPER, stored, with_columns

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: A line is boilerplate of a host from so many of its documents and so large a part of them on.
LINE_DOCS, LINE_PART = 10, 0.05
#: A document is depleted that loses more than this part of its words.
DEPLETED = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value, body):
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words):
    """How many words lie in a window of three words found twice or more in ``words``.

    The windows' hashes are sorted with their places, so equal ones are neighbours;
    a linear pass over the sorted places of the repeated ones counts covered words.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(s):
        same = lambda a, b: a.getField("h") == b.getField("h")
        twice = F.filter(s, lambda w, i: F.coalesce(same(w, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(w, F.get(s, i - 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda w: w.getField("i")))

    covered = F.aggregate(
        let(F.sort_array(windows), places),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc.getField("n") + F.least(F.lit(3), i - acc.getField("last"))).alias("n"), i.alias("last")),
        lambda acc: acc.getField("n"),
    )
    return F.when(n < 3, 0).otherwise(covered).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = words_in(text)
    lines = F.filter(F.split(text, "\n"), lambda line: ~blank(line))
    dups = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    found = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dups.alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    # As a generated row the counts are made once, whatever later filters and columns use them.
    plain = docs.drop(*COUNTS, "base_failed")
    counted = plain.select("*", F.inline(F.array(found)))
    return with_columns(counted, base_failed=(F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def blank(line):
    return F.btrim(line, F.lit(STRIP)) == ""


def words_in(text):
    """The words of ``text``, cut at each white space; plain replacements and one split are faster than a pattern."""
    spaced = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), STRIP[1:], text)
    return F.array_remove(F.split(spaced, " "), "")


def line_key(line):
    """A line's hash: white space off its ends, A-Z lower-cased, each digit a 0."""
    return F.xxhash64(F.translate(F.btrim(line, F.lit(STRIP)), UPPER + "123456789", LOWER + "0" * 9))


def keyed_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, doc_id, __hit, pos, h, n): hash and number of words of each line that has a word; __hit tells rows apart.

    Both the lines' counts and their join read it, so it is made once and stored (its lines are numbers, no texts).
    """
    lines = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda line: ~blank(line))
    keyed = F.transform(lines, lambda line: F.struct(line_key(line).alias("h"), F.size(words_in(line)).alias("n")))
    row = F.xxhash64("doc_id", "text", host)
    return stored(docs.select(F.col(host).alias("host"), "doc_id", row.alias("__hit"), F.posexplode(keyed).alias("pos", "x")).select("host", "doc_id", "__hit", "pos", "x.h", "x.n"))


def boilerplate(docs: DataFrame, lines: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_part: float = LINE_PART) -> DataFrame:
    """(host, h) of each line hash in at least ``line_docs`` documents of a host and over ``line_part`` of them."""
    lines = lines.groupBy("host", "h").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= line_docs)
    hosts = docs.groupBy(F.col(host).alias("__host")).agg(F.count_distinct("doc_id").alias("docs"))
    return lines.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).where(F.col("n") > line_part * F.col("docs")).select("host", "h")


def quality_rules(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_part: float = LINE_PART, depleted: float = DEPLETED) -> DataFrame:
    """``docs`` (doc_id, text, host, ...) with the counts of the rules, n_boilerplate, boilerplate_lines and kept.

    base_failed: under MIN_WORDS words, or over MAX_REPEATED_PERCENT of them in windows
    of three words that repeat. n_boilerplate: words in lines over the host's limits;
    boilerplate_lines: their hashes. kept: not base_failed, and n_boilerplate is at
    most ``depleted`` of n_words.

    A null or empty text has no words and no lines, so it fails. A null host is a host.
    Rows with the same doc_id count as one document of their host; rows without
    doc_id count in none. Lines without a word are never boilerplate. Added columns
    replace others of their names. An empty table gives an empty table.
    """
    row = F.xxhash64("doc_id", "text", host)
    lines = keyed_lines(docs, host)
    over = boilerplate(docs, lines, host, line_docs, line_part).withColumnRenamed("host", "__host").withColumnRenamed("h", "__h")
    hits = lines.join(over, F.col("host").eqNullSafe(F.col("__host")) & (F.col("h") == F.col("__h"))).dropDuplicates(["__hit", "pos"])
    hits = hits.groupBy("__hit").agg(F.sum("n").alias("__n"), F.collect_set("__h").alias("__hs"))
    ruled = with_columns(base_rules(docs), __row=row).join(hits, F.col("__row") == F.col("__hit"), "left")
    out = with_columns(ruled, n_boilerplate=F.coalesce("__n", F.lit(0)).cast("long"), boilerplate_lines=F.coalesce("__hs", F.array().cast("array<bigint>"))).drop("__row", "__hit", "__n", "__hs")
    return with_columns(out, kept=~F.col("base_failed") & (F.col("n_boilerplate") <= depleted * F.col("n_words")))


def clean(ruled: DataFrame) -> DataFrame:
    """The kept documents of ``quality_rules``, their boilerplate lines removed."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    left = F.filter(lines, lambda line: blank(line) | ~F.array_contains("boilerplate_lines", line_key(line)))
    text = F.when(F.size("boilerplate_lines") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return ruled.where("kept").select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in ruled.columns))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs).select("doc_id", *COUNTS, "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source
), over_ AS (
  SELECT l.source, k FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, k, docs HAVING count(DISTINCT doc_id) >= 10 AND count(DISTINCT doc_id) > 0.05 * docs
), hit AS (
  SELECT l.doc_id, sum(n) AS n FROM lines l JOIN over_ o ON l.source IS NOT DISTINCT FROM o.source AND l.k = o.k GROUP BY l.doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE c > 1) GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(hit.n, 0) AS boiler
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN hit USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND boiler <= 0.5 * n_words AS kept FROM failed
"""
