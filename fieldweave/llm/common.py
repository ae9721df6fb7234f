"""Helpers the operators share: the shared scratch folder, words, and 64-bit hashes.

White space here always means the six characters space, tab, newline, vertical
tab, form feed and carriage return, so a word is a run of anything else. On
UTF-8 bytes that is what ``bytes.split()`` and ``bytes.strip()`` use, and
``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.shared import cut, fresh_path  # noqa: F401

SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIP = " \t\n\x0b\x0c\r"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it from there.

    A checkpoint keeps Spark's estimate of its size, a product over all joins before it;
    over rounds of joins the numbers themselves grow too long to plan with. A table has
    the size of its files, and columns that are not asked for are not read.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_columns(df: DataFrame, **new) -> DataFrame:
    """``df`` with ``new`` columns last; a column of the same name gives way."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in new), *(c.alias(k) for k, c in new.items()))


def stripped(column):
    return F.regexp_replace(column, f"^[{SPACE}]+|[{SPACE}]+$", "")


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive hashes, order included."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total = total * GOLDEN + hashes[i : i + size]
    return mix(total)


LONG_WORD = 1024
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[ord(c) for c in STRIP]] = True


class Words:
    """The words of a batch of texts as 64-bit hashes, found and hashed column-wise.

    ``hashes``: all words in order; ``bounds``: those of text i are bounds[i] to
    bounds[i + 1]. A word is hashed eight bytes at a time by a bijection, so words of up to
    eight bytes have different hashes; those over LONG_WORD bytes are hashed one by one.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        raw = b" ".join([b"", *(t or b"" for t in texts), b" " * 8])
        self.raw = np.frombuffer(raw, np.uint8)
        self.bytes = LOWERED[self.raw] if lower else self.raw
        edges = np.diff(IS_SPACE[self.raw].view(np.int8))
        self.starts, self.ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
        begins = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, begins)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        eights = np.ndarray(len(self.bytes) - 7, "<u8", buffer=self.bytes, strides=(1,))
        length = self.ends - self.starts
        out = mix(length.astype(np.uint64) * GOLDEN)
        long = length > LONG_WORD
        at, left, which = self.starts[~long], length[~long], np.flatnonzero(~long)
        while len(which):
            masks = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8))
            out[which] = mix(out[which] ^ (eights[at] & masks))
            more = left > 8
            at, left, which = at[more] + 8, left[more] - 8, which[more]
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh3_64_intdigest(self.bytes[self.starts[i] : self.ends[i]].tobytes())
        return out

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def grams(self, n: int) -> np.ndarray:
        """A hash of ``n`` words from each word on; the last n - 1 of a text run on into the next."""
        return gram_hashes(self.hashes, n)


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each batch in pieces of about ``most`` bytes of ``column``, with that column's values; a longer text is a piece of its own."""
    for batch in batches:
        values = binary(batch.column(column))
        ends = np.cumsum([len(v or b"") for v in values])
        start = 0
        while start < len(values):
            stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), side="right")))
            yield batch.slice(start, stop - start), values[start:stop]
            start = stop
