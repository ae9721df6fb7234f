"""Chat formatting with a grammar round trip, with DataFrame functions only.

Grammar of a formatted conversation:

    conversation := turn*
    turn         := "<s>[" role mark "]" body "</s>"
    mark         := "" (body as it is) | "!" (body escaped)

A deterministic parser reads it back: it cuts at every "</s>", and a piece is a role
up to its first "]" and a body. Roles, and texts that hold a control string, are always
escaped, so no text shows one raw. (The template's own brackets round a role may spell
one: a role named /INST is written [/INST].) What the parser recovers is compared with
the source and, where it differs, all texts are escaped. Escaping writes the characters
of the grammar, and the backslash, as a backslash and a letter, so it is undone exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[", "</s>"
#: Strings that a text may not hold unescaped: the template's own, and the common instruction marks.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: Fixed table of escapes.
ESCAPES = {"<": "\\l", "[": "\\b", "]": "\\e", "!": "\\x"}
LEARNED = "assistant"


def escape(text):
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES.items(), F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text):
    """Undoes ``escape``: between doubled backslashes, each backslash starts an escape."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), ESCAPES.items(), p)), "\\")


def turn_text(role, body, escaped):
    return F.concat(F.lit(OPEN), escape(role), F.when(escaped, F.lit("!]")).otherwise(F.lit("]")), F.when(escaped, escape(body)).otherwise(body), F.lit(CLOSE))


def parse(formatted):
    """The turns of a formatted conversation, as array<struct<role, text>>; null where it breaks the grammar."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece):
        inner = F.substr(piece, F.lit(len(OPEN) + 1))
        head = F.substring_index(inner, "]", 1)
        body = F.substr(inner, F.length(head) + 2)
        marked = F.endswith(head, F.lit("!"))
        role = F.when(marked, F.substr(head, F.lit(1), F.length(head) - 1)).otherwise(head)
        return F.when(
            F.startswith(piece, F.lit(OPEN)) & F.contains(inner, F.lit("]")),
            F.struct(unescape(role).alias("role"), F.when(marked, unescape(body)).otherwise(body).alias("text")),
        )

    parsed = F.transform(turns, turn)
    return F.when((F.get(pieces, F.size(pieces) - 1) == "") & ~F.exists(parsed, lambda t: t.isNull()), parsed)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns, loss_spans) for each conversation of ``turns`` (conv_id, turn, role, text).

    loss_spans: array<struct<start, length>>, code points of ``formatted`` that hold the
    (possibly escaped) text of each assistant turn, and whether it is escaped.

    Turns stand in the order of turn, nulls first; equal turn numbers by role, then
    text, and repeated rows are turns of their own. A null text or role is an empty one.
    A row without conv_id is a conversation of its own, so such rows never gather. Other
    columns, whatever their names, are left out. An empty table gives an empty table; a conversation that cannot be recovered is an error.
    """
    rows = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("__alone"),
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id", "__alone").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.withColumn("source", F.transform("ts", lambda t: F.struct(t.getField("role").alias("role"), t.getField("text").alias("text"))))
    holds = lambda t: reduce(lambda a, b: a | b, (F.contains(t.getField("text"), F.lit(c)) for c in CONTROL))
    levels = (holds, lambda t: F.lit(True))

    def rendered(level):
        return F.array_join(F.transform("source", lambda t: turn_text(t.getField("role"), t.getField("text"), level(t))), "")

    for i, level in enumerate(levels):
        convs = convs.withColumn(f"try{i}", rendered(level))
    same = lambda i: F.coalesce(parse(F.col(f"try{i}")) == F.col("source"), F.lit(False))
    convs = convs.withColumn("level", F.when(same(0), 0).when(same(1), 1).otherwise(F.raise_error(F.lit("a conversation does not survive its own grammar"))).cast("int"))
    escaped = lambda t: F.when(F.col("level") == 0, holds(t)).otherwise(F.lit(True))
    lengths = F.transform(
        "source",
        lambda t: F.struct(
            (F.lit(len(OPEN) + 1) + F.length(escape(t.getField("role"))) + escaped(t).cast("int")).alias("head"),
            F.when(escaped(t), F.length(escape(t.getField("text")))).otherwise(F.length(t.getField("text"))).alias("body"),
            (t.getField("role") == LEARNED).alias("learned"),
            escaped(t).alias("escaped"),
        ),
    )
    span = "struct<start:int,length:int,escaped:boolean>"
    spans = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.getField("at") + x.getField("head") + x.getField("body") + len(CLOSE)).alias("at"),
            F.when(
                x.getField("learned"),
                F.concat(acc.getField("spans"), F.array(F.struct((acc.getField("at") + x.getField("head")).alias("start"), x.getField("body").alias("length"), x.getField("escaped").alias("escaped")))),
            ).otherwise(acc.getField("spans")).alias("spans"),
        ),
        lambda acc: acc.getField("spans"),
    )
    return convs.select("conv_id", F.when(F.col("level") == 0, F.col("try0")).otherwise(F.col("try1")).alias("formatted"), F.size("ts").cast("long").alias("n_turns"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with the turns that the parser recovers and the unescaped text under the loss mask."""
    piece = lambda s: F.substr(F.col("formatted"), s.getField("start") + 1, s.getField("length"))
    masked = F.array_join(F.transform("loss_spans", lambda s: F.when(s.getField("escaped"), unescape(piece(s))).otherwise(piece(s))), "")
    return formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_text", masked)


def op8_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    back = read_back(format_chats(turns.unionByName(extra)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') AS holds,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone,
    length(text) + length(regexp_replace(text, '[^\\<\[\]!]', '', 'g')) AS escaped_length,
    length(role) + length(regexp_replace(role, '[^\\<\[\]!]', '', 'g')) AS role_length
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(9 + role_length + CASE WHEN holds THEN 1 + escaped_length ELSE length(text) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
