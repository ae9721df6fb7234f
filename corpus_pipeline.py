"""From raw documents to a tokenised training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the columns of
documents; the last returns token ids. Text changes bring n_chars up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from fieldweave.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their hosts' boilerplate lines."""
    return _documents(quality_rules.clean(quality_rules.quality_rules(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a line of five documents or more stays in one of them. Some may be left empty."""
    return _documents(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return ngram_join.drop_near_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: a row for each epoch that takes a document. A null source is one of its own; documents without words are taken once."""
    return _documents(mixing.take(mixing.mix_sources(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row of the mix; a null text has no tokens, a null doc_id stays null."""
    coded = bpe.round_trip(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mix), ("byte_bpe", tokens)]

#: Token ids can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if i else docs, sf_dir)
    return docs
