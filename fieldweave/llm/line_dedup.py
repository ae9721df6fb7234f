"""Line dedup by a sharded minimal perfect hash.

Every distinct line hash of the corpus is placed by a minimal perfect hash, one
per shard of the hash space. A shard's value arrays hold, at the place the hash
gives, a fingerprint, the number of documents with the line, and the largest
doc_id among them. Documents send their line hashes to the shards, which look
them up in the arrays; lines are never joined with lines.

A shard holds a bounded number of keys, so one task's memory is bounded. A shard
that is asked often (a line in very many documents) is copied, and its questions
are dealt over the copies. Questions stream past the arrays, never grouped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import cut, mix, with_columns

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys in a shard, and questions to one copy of a shard.
SHARD_KEYS, COPY_PROBES = 1 << 17, 1 << 19


class MinimalPerfectHash:
    """Places n distinct 64-bit keys at 0..n-1, in about 4 bits a key.

    Level by level, keys that are alone on their slot of a bit array of 2 slots a
    key are placed; the others try the next level under another seed. A key's place
    is the number of set bits before its own.
    """

    def __init__(self, sizes: list[int], packed: np.ndarray):
        self.sizes = sizes
        self.taken = np.unpackbits(packed, count=sum(sizes)).astype(bool)
        self.before = np.cumsum(self.taken) - self.taken

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The sizes of the levels and their bits, packed."""
        sizes: list[int] = []
        bits = [np.zeros(0, bool)]
        left = np.unique(keys)
        while len(left):
            size = max(64, 2 * len(left))
            slot = cls.slot(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            left = left[~alone[slot]]
        return sizes, np.packbits(np.concatenate(bits))

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((0xA0761D6478BD642F * (level + 1)) % (1 << 64))
        return (mix(keys + seed) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The places of ``keys``; -1, or any place, for a key that is not in it."""
        place = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        start = 0
        for level, size in enumerate(self.sizes):
            slot = start + self.slot(keys[open_], level, size)
            hit = self.taken[slot]
            place[open_[hit]] = self.before[slot[hit]]
            open_ = open_[~hit]
            start += size
        return place


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["h"].to_numpy(np.int64).view(np.uint64)
    levels = MinimalPerfectHash.build(keys)
    at = MinimalPerfectHash(*levels)(keys)
    n = len(keys)
    prints, counts, owners = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.int64)
    prints[at] = fingerprint(keys)
    counts[at] = np.minimum(pdf["n_docs"].to_numpy(np.int64), np.iinfo(np.uint32).max)
    owners[at] = pdf["owner"].to_numpy(np.int64)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "blob": [pickle.dumps((levels, prints, counts, owners), protocol=5)]})


def line_hashes(text: bytes, min_chars: int) -> list[int | None]:
    """For each line its key's hash, or None if the key is too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_64_intdigest(key) if long else None)
    return out


def line_index(keys: DataFrame) -> tuple[DataFrame, int]:
    """``keys`` (h, doc_id) as shards (shard, blob), and the number of shards."""
    stats = cut(
        keys.groupBy("h", "doc_id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n_docs"), F.coalesce(F.max("doc_id"), F.lit(-(1 << 63))).alias("owner"))
    )
    shards = max(1, -(-stats.count() // SHARD_KEYS))
    blobs = stats.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInPandas(build_shard, "shard long, blob binary")
    return blobs, shards


def probe(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, copy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "copy"))
            h = batch.column("h").fill_null(0).to_numpy()
            doc, known = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            blobs = batch.column("blob")
            asked = blobs.is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(copy) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(shard)], strict=True):
                if (shard[lo], copy[lo]) != at:
                    levels, prints, counts, owners = pickle.loads(blobs[lo].as_py())
                    at, place = (shard[lo], copy[lo]), MinimalPerfectHash(*levels)
                rows = np.arange(lo, hi)[asked[lo:hi]]
                if len(rows):
                    keys = h[rows].view(np.uint64)
                    spot = place(keys)
                    drop = (spot >= 0) & (prints[spot] == fingerprint(keys)) & (counts[spot] >= min_docs) & ~(known[rows] & (owners[spot] == doc[rows]))
                    rows = rows[drop]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(h[rows])], ["doc_id", "h"])

    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, h) for each long line of ``docs`` to drop: it is in ``min_docs`` documents, and another has the larger doc_id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                found = {h for h in line_hashes(text or b"", min_chars) if h is not None}
                rows += [i] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), batch.column("doc_id").take(pa.array(rows, pa.int64()))], ["h", "doc_id"])

    keys = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(emit, "h long, doc_id long"))
    blobs, shards = line_index(keys)
    keys = keys.withColumn("shard", F.pmod("h", F.lit(shards)))
    copies = keys.groupBy("shard").agg(F.ceil(F.count("*") / COPY_PROBES).cast("int").alias("copies"))
    asked = keys.join(copies, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "h"), "copies").cast("int").alias("copy"), "h", "doc_id", F.lit(None).cast("binary").alias("blob"))
    held = blobs.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("doc_id"), "blob")
    # The blob row stands first in its group, so each group's questions stream past it.
    dealt = asked.union(held).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())
    return dealt.mapInArrow(probe(min_docs), "doc_id long, h long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines dropped from ``text``.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys
    of ``min_chars`` code points or more that are in ``min_docs`` documents or more
    lose all their lines, except in the largest doc_id that holds them. Adds n_lines
    and n_dropped; columns of these names give way, all others stay.

    A null or empty text is one empty line, and comes back empty. Rows with the same
    doc_id are one document, so a repeated row counts once and both keep or lose a
    line together; rows without doc_id are one document that is never the largest.
    A line that a document repeats is dropped or kept in all places. An empty table
    gives an empty table.
    """
    drops = repeated_lines(docs, min_chars, min_docs).groupBy("doc_id").agg(F.collect_set("h").alias("__drop")).withColumnRenamed("doc_id", "__id")

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def keep(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        kept, lines, dropped = [], [], []
        for text, out in zip(texts, drop, strict=True):
            text = text or ""
            parts = text.split("\n")
            if out is not None and len(out):
                gone = set(np.asarray(out, np.int64).view(np.uint64).tolist())
                stay = [p for p, h in zip(parts, line_hashes(text.encode(), min_chars), strict=True) if h not in gone]
            else:
                stay = parts
            kept.append("\n".join(stay))
            lines.append(len(parts))
            dropped.append(len(parts) - len(stay))
        return pd.DataFrame({"text": kept, "n_lines": lines, "n_dropped": dropped})

    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left").select(*(docs[c] for c in docs.columns), keep(docs["text"].cast("string"), "__drop").alias("__kept"))
    out = with_columns(joined, n_lines=F.col("__kept.n_lines"), n_dropped=F.col("__kept.n_dropped"))
    return out.select(*(F.col("__kept.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in out.columns if c != "__kept"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), hot AS (
  SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(owner)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL), '')) AS kept_sha256
FROM (SELECT l.*, h.owner FROM lines l LEFT JOIN hot h ON l.k = h.k AND l.doc_id <> h.owner)
GROUP BY doc_id
"""
