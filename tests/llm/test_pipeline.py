"""The pipeline's stages, each on what the one before kept, and the queries' registration."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fieldweave.llm import bpe

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_in_order(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).checkpoint()
        seen.append(after.count())
        if name != "byte_bpe":
            assert after.columns == docs.columns
            assert after.where("n_chars <> length(text)").isEmpty()
        if name in ("quality_rules", "line_dedup", "ngram_join"):
            assert after.join(before, "doc_id", "left_anti").isEmpty() and after.select("doc_id").distinct().count() == after.count()
        if name == "byte_bpe":
            codec = bpe.Codec(*(lambda r: (r, bpe.merges_of(r)))(bpe.read_ranks(bpe.RANKS)))
            texts = Counter((r.doc_id, r.text or "") for r in before.select("doc_id", "text").collect())
            assert Counter((r.doc_id, codec.decode(__import__("numpy").array(r.ids, "int32")).decode()) for r in after.collect()) == texts
        before = after
    assert seen[0] >= seen[2] > 0 and seen[1] == seen[0] and seen[4] == seen[3]


def odd_documents():
    """Good texts, copies and near copies, texts without words or too short, rows without id or source, a very long one, repeats."""
    prose = lambda k, n: " ".join(f"w{k}x{(i * i + k) % 997}y{i}" for i in range(n))
    rows = [(i, prose(i, 60 + i), "en", f"s{i % 2}", 0) for i in range(12)]
    rows += [(100, prose(1, 61), "en", "s1", 0), (101, prose(2, 62) + " end", None, None, None), (None, prose(3, 63), "en", "s1", 0), (None, prose(50, 90), None, None, None)]
    rows += [(200, None, "en", "s0", None), (201, "", "en", "s0", 0), (202, " \n\t", None, None, 3), (203, "too few words", "en", "s0", 13), (204, prose(7, 30_000), "en", "s1", 0)]
    return [*rows, rows[5], rows[5]]


def test_odd_documents_come_through(spark):
    docs = spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        kept[name] = Counter(r.doc_id for r in docs.collect())
    good = Counter(r[0] for r in odd_documents() if len(WORDS.findall(r[1] or "")) >= 50)
    assert kept["quality_rules"] == kept["line_dedup"] == good
    # Of 1 and 100, 2 and 101, and 3 and a row without id, one stays each; so does one of three equal rows.
    assert kept["ngram_join"] == Counter([*range(12), None, 204])
    assert set(kept["mixing"]) <= set(kept["ngram_join"]) and max(kept["mixing"].values()) <= 2 and kept["byte_bpe"] == kept["mixing"]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
    assert docs.count() == 0


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_queries_match_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    shown = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    rows = Counter(shown(r) for r in frame.select(*(F.col(c) for c in columns)).collect())
    assert rows == Counter(shown(r) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
