"""Rows that a join on doc_id would lose, and control strings that an escape could miss."""

import duckdb

from fieldweave.llm import chat, ngram_join


def test_near_duplicates_without_or_with_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: text(k) + " end"
    rows = [
        (None, text(1), "a"), (None, None, "a"), (None, "", "a"), (None, "", "a"), (None, " \n", "b"), (5, None, "a"),
        (None, text(2), "a"), (None, near(2), "a"), (None, text(2), "a"),
        (None, text(3), "a"), (9, near(3), "a"), (12, text(3), "a"),
        (7, text(4), "a"), (7, text(5), "a"), (6, near(5), "a"), (8, near(4), "a"),
        (3, text(6), "b"), (3, text(6), "a"), (3, near(6), "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = sorted(map(tuple, ngram_join.drop_near_duplicates(docs).collect()), key=repr)
    wordless, kept = [r for r in found if not (r[1] or "").split()], [r for r in found if (r[1] or "").split()]
    assert wordless == sorted((r for r in rows if not (r[1] or "").split()), key=repr)
    assert [r for r in kept if r[0] is not None and r[0] != 3] == [(6, near(5), "a"), (7, text(4), "a"), (9, near(3), "a")]
    assert sum(r[1] == text(1) for r in kept) == 1 and sum(r[1] in (text(2), near(2)) for r in kept) == 1
    three = [r for r in kept if r[0] == 3]
    assert len(three) == 1 and three[0] in [(3, text(6), "a"), (3, near(6), "a")] and len(kept) == 6


def test_guarded_chats_hold_no_raw_control_string(spark, tmp_path):
    texts = {1: "<s>[", 2: "[INST]", 3: "a [/INST] b", 4: "plain ] text", 5: "</s>"}
    rows = [(k, t, r, x) for k, x in texts.items() for t, r in enumerate(("user", "assistant"))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_chats(turns)).collect():
        assert [t.text for t in r.turns] == [texts[r.conv_id]] * 2 and r.loss_text == texts[r.conv_id]
        assert ("!]" in r.formatted) == (r.conv_id != 4)
        assert r.formatted.count("<s>[") == r.formatted.count("</s>") == 2 and "INST]" not in r.formatted
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    frame = chat.op8_chat(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, frame.collect())) == sorted(db.sql(f"SELECT {', '.join(frame.columns)} FROM ({chat.SQL})").fetchall())


def test_near_duplicates_with_columns_that_have_no_order(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, {"b": 1}, (1, {"x": "y"})), (1, text, {"a": 2}, (2, None)), (2, "other words", None, None)], "doc_id long, text string, tags map<string,int>, extra struct<n:int,m:map<string,string>>")
    kept = sorted(tuple(r) for r in ngram_join.drop_near_duplicates(docs).select("doc_id", "tags").collect())
    assert kept == [(1, {"a": 2}), (2, None)]
