"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of codewords, one from each of CODEBOOKS full-
dimensional codebooks; each codebook is fitted to what the ones before it leave.
Encoding is a beam search. A query's table of inner products with all codewords gives
its distance to any code as norm - 2 * (sum of table entries), with the norm of the
approximation stored beside the code. The best CANDIDATES by that score are ranked
again by the exact distance on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import cut

CODEBOOKS, CODEWORDS, BEAM = 32, 256, 2
CANDIDATES, K = 200, 10
#: Rows that codebooks are fitted on, the first by a hash of their id.
SAMPLE = 10_000
#: Vectors in a chunk of codes, queries in a block.
CHUNK, BLOCK = 8192, 256
#: Blocks of queries whose best candidates a task keeps across chunks (some 0.6 MB each) before it lets them go.
BLOCKS_HELD = 64
#: Parts of the codes at least, and vectors of one; every query goes to every part, codes move once.
PARTS, PART_ROWS = 32, 500_000


def fit(sample: np.ndarray, books: int, words: int, rounds: int = 6) -> np.ndarray:
    """Codebooks (books, words, dimensions) by k-means on the residuals, in a fixed order."""
    rng = np.random.default_rng(7)
    left, out = sample.astype(np.float32), []
    for _ in range(books):
        centre = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            near = np.argmin((centre**2).sum(1) - 2 * left @ centre.T, axis=1)
            order, size = np.argsort(near, kind="stable"), np.bincount(near, minlength=words)
            full = np.flatnonzero(size)
            sums = np.add.reduceat(left[order], (np.cumsum(size) - size)[full])
            centre[full] = sums / size[full, None]
        near = np.argmin((centre**2).sum(1) - 2 * left @ centre.T, axis=1)
        left = left - centre[near]
        out.append(centre)
    return np.stack(out)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) as bytes, and the squared norms of what they stand for."""
    n, row = len(vectors), np.arange(len(vectors))[:, None]
    left = vectors.astype(np.float32)[:, None]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        wide = left.shape[1]
        error = (left**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * (left.reshape(n * wide, -1) @ book.T).reshape(n, wide, -1)
        best = np.argpartition(error.reshape(n, -1), beam - 1, axis=1)[:, :beam]
        parent, word = best // len(book), best % len(book)
        codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.uint8)], axis=2)
        left = left[row, parent] - book[word]
    first = (left**2).sum(2).argmin(1)
    codes, left = codes[row[:, 0], first], left[row[:, 0], first]
    return codes, ((vectors - left) ** 2).sum(1).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows that take part: an id, and a vector without null or non-finite components that is not zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).dropna()
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` found nearest to each query among ``vectors``, but for its own row.

    ``vectors`` (vec_id, embedding, ...) and ``queries`` (the same). Nearness is the
    Euclidean distance in double precision on the original vectors; equal distances go
    to the smaller vec_id. Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do rows without vec_id or of another dimension than the
    sample's most frequent one. Repeated rows of one vec_id count once. With fewer than
    ``k`` candidates all come out; other columns, whatever their names, are not looked
    at; an empty table gives an empty table.

    Equal vectors are searched once and stand for their ``k`` + 1 smallest ids, so a
    vector that very many rows hold does not crowd out others.
    """
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    if not sample:
        return spark.createDataFrame([], out)
    sizes, n = np.unique([len(v) for v in sample], return_counts=True)
    width = int(sizes[n.argmax()])
    books = spark.sparkContext.broadcast(fit(np.array([v for v in sample if len(v) == width]), CODEBOOKS, CODEWORDS))

    same = Window.partitionBy("h", "v")
    copies = rows.where(F.size("v") == width).withColumn("h", F.xxhash64("v"))
    copies = copies.withColumn("nth", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    copies = cut(copies.withColumn("rep", F.min("vec_id").over(same)).select("rep", "vec_id", "v", "nth").distinct())
    asked = cut(usable(queries).where(F.size("v") == width).dropDuplicates(["vec_id"]))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                v = stacked(part.column("v")).astype(np.float32)
                done = [encode(v[i : i + 1024], books.value, BEAM) for i in range(0, len(v), 1024)]
                codes, norms = (np.concatenate(x) for x in zip(*done, strict=True))
                ids = part.column("rep").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, codes, norms)], ["ids", "codes", "norms"])

    blocks = max(1, -(-asked.count() // BLOCK))
    block = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
    parts = max(PARTS, -(-copies.count() // PART_ROWS))
    block = block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    chunks = copies.where("nth = 1").select("rep", "v").mapInArrow(coded, "ids binary, codes binary, norms binary")
    chunks = chunks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # of a block of queries: their ids, and the best so far

        def let_go() -> Iterator[pa.RecordBatch]:
            for asked_ids, near, reps in held.values():
                columns = [np.repeat(asked_ids, near.shape[1]), reps.ravel(), near.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "rep", "near"])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                ids, norms = np.frombuffer(batch.column("ids")[i].as_py(), np.int64), np.frombuffer(batch.column("norms")[i].as_py(), np.float32)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(ids), -1)
                own, number = batch.column("asked")[i].values, batch.column("block")[i].as_py()
                query = stacked(own.field("v")).astype(np.float32)
                near = np.repeat(norms[None], len(query), axis=0)
                for book, code in zip(books.value, codes.T, strict=True):
                    near -= 2 * (query @ book.T)[:, code]
                reps = np.broadcast_to(ids, near.shape)
                if number in held:
                    near, reps = np.concatenate([held[number][1], near], 1), np.concatenate([held[number][2], reps], 1)
                keep = min(candidates, near.shape[1])
                best = np.argpartition(near, keep - 1, axis=1)[:, :keep]
                held[number] = own.field("vec_id").to_numpy(), np.take_along_axis(near, best, 1), np.take_along_axis(reps, best, 1)
                if len(held) > BLOCKS_HELD:
                    yield from let_go()
        yield from let_go()

    met = chunks.join(block, "part").select("block", "ids", "codes", "norms", "asked")
    found = met.mapInArrow(scored, "query_id long, rep long, near float")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "rep"))).where(F.col("place") <= candidates)
    exact = found.select("query_id", "rep").join(copies, "rep").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").where("vec_id <> query_id")
    distance = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    exact = exact.select("query_id", "vec_id", distance.alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
