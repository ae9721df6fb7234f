"""Exact top-k search by distributed histogram selection.

Every candidate has, for a query, a key of two words: how far its score lies under the
query's bound, and its id. The k-th smallest key is found DIGIT bits at a time: all
candidates are scored in chunks, the next digits of those that share the digits found
so far are counted in one global histogram a query, and the digit where the count
passes k is kept. The loop ends for a query when at most SLACK candidates lie at or
under its bracket. Then everything is scored once more, what lies at or under the
bracket comes out, and is ranked.

A chunk counts only digits up to its own k-th candidate: the global k-th lies no later,
so nothing that matters is left out, and a chunk sends few counts a query. Ties beyond
SLACK are split by the digits of their ids, so even a query that scores all candidates
alike returns few rows. Scores are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.ann import stacked
from fieldweave.llm.common import cut

K, SCALE = 10, 1024
#: Bits of a key counted in a round; candidates at or under a bracket at which a query needs no further round.
DIGIT, SLACK = 12, 64
#: Vectors of a chunk, queries of a block.
CHUNK, BLOCK = 1024, 256
#: Parts of the candidates at least, and vectors of one; a block of queries goes to every part.
PARTS, PART_ROWS = 32, 500_000
#: Scores are held within this.
MOST = 2**62 - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of rows that take part, one a vec_id; ``v`` holds whole numbers as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).dropna()
    rows = rows.where(F.size("x") > 0).withColumn("x", F.transform("x", lambda x: x * scale))
    rows = rows.where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return rows.groupBy("vec_id").agg(F.max("x").alias("x")).select("vec_id", F.transform("x", whole).alias("v"))


def products(query: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: by doubles as long as no sum can pass 53 bits, else by Python's integers, held within MOST."""
    if np.abs(query).max() * np.abs(chunk).max() * query.shape[1] < 2**53:
        return (query @ chunk.T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in row] for row in a], object)
    return np.clip(whole(query) @ whole(chunk).T, -MOST, MOST).astype(np.int64)


def first_digits(digits: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``digits`` in order and their counts, up to the one that holds the ``wanted``-th smallest."""
    if len(digits) > wanted:
        digits = digits[digits <= np.partition(digits, wanted - 1)[wanted - 1]]
    return np.unique(digits, return_counts=True)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each query among ``vectors``, but for its own row.

    ``vectors`` and ``queries`` are (vec_id, embedding, ...). A component x counts as
    floor(scale * x); the score is the integer inner product, ties go to the smaller
    vec_id. With fewer candidates than ``k`` all come out. Vectors that are null, empty,
    or hold a component that is null or not finite (times ``scale`` too) take no part,
    nor do rows without vec_id; a zero vector does. Vectors of different lengths do not
    meet. Rows of one vec_id count once, by the greatest of their vectors. Scores beyond
    62 bits are held at the limit. Other columns are not looked at, whatever their names;
    an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, scale)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                own = batch.filter(pa.array(widths == width))
                for lo in range(0, own.num_rows, CHUNK):
                    part = own.slice(lo, CHUNK)
                    v = stacked(part.column("v"))
                    values = [v.tobytes(), part.column("vec_id").to_numpy().tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([int(width)], pa.int32()), *(pa.array([x], pa.binary()) for x in values)], ["width", "chunk", "ids"])

    candidates = cut(rows.withColumn("width", F.size("v")))
    seen = candidates.agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.max("vec_id").alias("most"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not seen["n"]:
        return spark.createDataFrame([], out)
    least, id_bits = seen["least"], max(1, (seen["most"] - seen["least"]).bit_length())
    parts = max(PARTS, -(-seen["n"] // PART_ROWS))
    chunks = cut(candidates.mapInArrow(packed, "width int, chunk binary, ids binary").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")))

    bound = F.least(F.lit(float(MOST)), F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)) * (seen["largest"] * (1 + 1e-9)) + 1).cast("long")
    asked = scaled(queries, scale).withColumn("top", F.least(bound, F.lit(MOST)))
    asked = asked.withColumn("bits", F.length(F.bin(F.col("top") * 2))).withColumn("width", F.size("v"))
    zero = F.lit(0).cast("long")
    asked = cut(asked.select("vec_id", "v", "width", "top", "bits", F.lit(0).alias("word"), zero.alias("p0"), zero.alias("p1"), zero.alias("above"), F.lit(False).alias("done")))
    blocks = max(1, -(-asked.count() // BLOCK))

    def meetings(asked: DataFrame) -> DataFrame:
        """Each block of queries beside each chunk of candidates."""
        names = [c for c in asked.columns if c not in ("width", "done")]
        block = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("width", "block").agg(F.collect_list(F.struct(*names)).alias("asked"))
        block = block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return chunks.join(block, ["width", "part"]).select("width", "chunk", "ids", "asked")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For each query and chunk: the query's state, the other candidates' ids, and both words of their keys."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                chunk = np.frombuffer(batch.column("chunk")[i].as_py(), np.float64).reshape(len(ids), -1)
                own = batch.column("asked")[i].values
                score = products(stacked(own.field("v")), chunk)
                second = ids.astype(np.uint64) - np.uint64(least % 2**64)
                states = zip(*(own.field(c).to_pylist() for c in ("vec_id", "top", "bits", "word", "p0", "p1", "above")), strict=True)
                for state, row in zip(states, score, strict=True):
                    other = ids != state[0]
                    yield state, ids[other], row[other], (state[1] - row[other]).astype(np.uint64), second[other]

    def shifted(x: np.ndarray | int, bits: int):
        return x >> (np.uint64(bits) if isinstance(x, np.ndarray) else bits) if bits < 64 else x * 0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (query, _, bits, word, p0, p1, above), _, _, w0, w1 in scored(batches):
            key = w1[w0 == p0] if word else w0
            key = key[shifted(key, bits) == shifted((p1 if word else p0) % 2**64, bits)]
            low = max(bits - DIGIT, 0)
            digits, n = first_digits(shifted(key, low).astype(np.int64) & ((1 << (bits - low)) - 1), k - above)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), query)), pa.array(digits), pa.array(n)], ["vec_id", "digit", "n"])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (query, _, bits, word, p0, p1, _), ids, score, w0, w1 in scored(batches):
            tied = (w0 == p0) & (shifted(w1, bits) <= shifted(p1 % 2**64, bits)) if word else False
            keep = (w0 < p0) | tied if word else shifted(w0, bits) <= shifted(p0, bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), query)), pa.array(ids[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    upto = Window.partitionBy("vec_id").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    while not asked.where("NOT done").isEmpty():
        active = asked.where("NOT done")
        counts = meetings(active).mapInArrow(counted, "vec_id long, digit long, n long").groupBy("vec_id", "digit").agg(F.sum("n").alias("n"))
        found = counts.withColumn("sum", F.sum("n").over(upto)).join(active.select("vec_id", "above"), "vec_id")
        at = found.groupBy("vec_id").agg(
            F.min(F.when(F.col("above") + F.col("sum") >= k, F.struct("digit", "n", (F.col("sum") - F.col("n")).alias("before")))).alias("at"),
            F.sum("n").alias("all"),
        )
        low = F.greatest(F.col("bits") - DIGIT, F.lit(0))
        digit = F.call_function("shiftleft", F.col("at.digit"), low)
        short = F.col("at").isNull()  # fewer candidates than k: all of them pass
        above, word = F.col("above") + F.coalesce("at.before", F.lit(0)), F.col("word")
        done = short | (above + F.col("at.n") <= SLACK) | ((word == 1) & (low == 0))
        tied = ~done & (low == 0)
        nxt = active.join(at, "vec_id", "left").select(
            "vec_id", "v", "width", "top",
            F.when(short, 64).when(tied, id_bits).otherwise(low).cast("int").alias("bits"),
            F.when(short, 0).when(tied, 1).otherwise(word).alias("word"),
            F.when(short | (word == 1), F.col("p0")).otherwise(F.col("p0").bitwiseOR(digit)).alias("p0"),
            F.when(short | (word == 0), F.col("p1")).otherwise(F.col("p1").bitwiseOR(digit)).alias("p1"),
            above.alias("above"), done.alias("done"),
        )
        asked = cut(asked.where("done").unionByName(nxt))
    best = meetings(asked).mapInArrow(passed, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
