"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Within each source the keys are cut into a
fixed number of equal ranges; words are summed per range, the ranges' sums are
prefix-summed per source, and a document's prefix is its range's prefix plus the
words before it in its own range. No task sees a whole source: a range of a source
holds 1 / RANGES of its documents. A document is taken where its prefix lies under
the source's budget, so each source is cut at its exact number of words; a budget
over the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import WORD, with_columns

WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS = 1.5, 2
#: Hex digits of a key that name its range: 16 ** 3 ranges a source.
DIGITS = 3


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): words for each source of ``sized`` (source, size).

    Sources by code point, null last, weigh ``weights`` in turn. ``share`` times all
    words are dealt by weight; no target exceeds ``epochs`` times its source's words,
    and what is over goes to the others by weight. That is the level L at which
    sum(min(epochs * size, weight * L)) is the whole, found from prefix sums over the
    sources in the order in which they fill up. One row a source, so the unpartitioned
    windows are over a table of sources, not of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1)
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = per_source.withColumn("weight", weight).withColumn("ratio", epochs * F.col("source_size") / F.col("weight"))
    levels = filled.withColumn(
        "level",
        (share * F.sum("source_size").over(everything) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after),
    )
    fits = levels.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
    return fits.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), epochs * F.col("source_size").cast("double")), epochs * F.col("source_size").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken.

    size: words of the text (null or empty: 0). taken: words the mix takes of the
    document, repeats counted. A source's budget is the floor of its target: whole
    epochs of the source, then documents in the order of their keys up to the rest;
    the document on the edge gives only the words that still fit. So no document
    exceeds ``epochs`` times its size.

    Keys are the MD5 of the seed, doc_id and text, so reruns agree. Repeated rows have
    the same key and are ordered by it, size, and then as equals: each counts, and
    which of them stands on the edge makes no difference. A null source is a source.
    A source without words has target 0. Columns of the four names give way; an empty
    table gives an empty table.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    sized = with_columns(docs, size=n_words(F.col("text").cast("string")), __key=key).withColumn("__range", F.substring("__key", 1, DIGITS))
    per_range = sized.groupBy("source", "__range").agg(F.sum("size").alias("size"))
    starts = per_range.select("source", "__range", F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    budget = targets(per_range, weights, share, epochs)
    plan = starts.join(budget.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    plan = plan.select(F.col("source").alias("__s"), F.col("__range").alias("__r"), "__start", "source_size", "target")
    inside = Window.partitionBy("source", "__range").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = sized.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    names = [c for c in sized.columns if c not in ("size", "__key", "__range", "source_size", "target", "taken")]
    at = running.drop("source_size", "target", "taken").join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")), "left")
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target") - whole * F.col("source_size") - F.col("__start") - F.col("__inside")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return at.select(*(F.col(f"`{c}`") for c in names), "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken"))


def take(mixed: DataFrame) -> DataFrame:
    """The documents of the mix: a row for each epoch that takes the document.

    The copy on its source's edge keeps its first words only, joined by one space;
    documents of no words are taken once, whole. The columns of the plan go.
    """
    size, taken = F.col("size"), F.col("taken")
    epochs = F.when(size > 0, F.ceil(taken / F.greatest(size, F.lit(1)))).otherwise(1).cast("int")
    rows = mixed.where(epochs > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(1), epochs)))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    left = taken - (F.col("__epoch") - 1) * size
    text = F.when((size > 0) & (left < size), F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")).otherwise(F.col("text"))
    gone = ("size", "source_size", "target", "taken", "__epoch")
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in mixed.columns if c not in gone))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s
), l AS (
  SELECT *, 2 * source_size / weight AS ratio,
    (1.5 * sum(source_size) OVER ()
      - 2 * coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, coalesce(least((min_by(level, ratio) FILTER (level <= ratio) OVER ()) * weight, 2.0 * source_size), 2.0 * source_size)::DOUBLE AS target FROM l
), p AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)))::BIGINT AS taken
FROM p
"""
