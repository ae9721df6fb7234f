"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary comes as ranks: one line a token, its bytes in base64 and its rank. Byte
values map to printable characters, so the library's string vocabulary can hold any
bytes; the merges are recovered from the ranks. Texts are cut where a single token can
never reach across (before a space that follows and precedes other characters), each
distinct piece of a batch is encoded once, and the pieces' ids are put together again.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import slices, with_columns

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pieces whose ids a worker remembers; past it the memory starts empty again. Idle workers keep it while other stages run.
REMEMBERED = 200_000
#: Bytes of text that are cut into pieces at once; a longer text by itself.
AT_ONCE = 1_000_000


def byte_characters() -> list[str]:
    """The character that stands for each byte value: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 0x100
    for b in range(256):
        table[b] = chr(b) if b in prints else chr(spare)
        spare += b not in prints
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of two bytes or more, in order of rank.

    A token's bytes are merged lowest rank first, by lower ranks than its own only,
    until two parts are left.
    """
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def pieces_of(text: str) -> list[str]:
    """``text`` cut before each space that stands between two characters that are not white space.

    No match of the pre-tokenizer's pattern reaches across such a place: a match takes
    a space only as its first character or in a run of white space. A comma or full stop
    at a piece's end is cut off from a letter a-z before it, as no match holds both.
    """
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    ends = []
    for piece in out:
        if piece[-1:] in (".", ",") and "a" <= piece[-2:-1] <= "z":
            ends += (piece[:-1], piece[-1])
        else:
            ends.append(piece)
    return ends


class Codec:
    """Encodes texts to ids and ids back to bytes; made once a worker."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        table = byte_characters()
        named = lambda token: "".join(table[b] for b in token)
        self.tokenizer = Tokenizer(models.BPE(vocab={named(t): r for t, r in ranks.items()}, merges=[(named(a), named(b)) for a, b in merges]))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [pieces_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = {p for ps in pieces for p in ps if p not in self.known}
        # Pieces that start and end at such a place can stand side by side in one text.
        whole = [p for p in fresh if p[:1] == " " and not p[1:2].isspace() and len(p) > 1 and not p[-1].isspace()]
        for lo in range(0, len(whole), 4096):
            part = whole[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in part])) + 1
            raw, start = ids.tobytes(), 0
            for piece, end in zip(part, (4 * ends).tolist(), strict=True):
                self.known[piece] = raw[start:end]
                start = end
        rest = list(fresh.difference(whole))
        for piece, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(found.ids, np.int32).tobytes()
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, ps)), np.int32) for ps in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``; a character split over tokens comes whole again, as bytes are joined first."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        at = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        return self.flat[at].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """First and last-plus-one character of each token; tokens that share a split character overlap on it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        end = np.cumsum(self.lengths[ids])
        start = end - self.lengths[ids]
        return np.stack([character[start], character[end - 1] + 1], axis=1) if len(ids) else np.zeros((0, 2), np.int64)


def shared_codec(spark: SparkSession, path: str):
    """A function that gives a task its codec, one for all tasks of a Python worker.

    The vocabulary, of fixed size, is read and its merges found once, on the driver.
    """
    ranks = read_ranks(path)
    held = spark.sparkContext.broadcast({"vocabulary": (ranks, merges_of(ranks))})

    def codec() -> Codec:
        if "codec" not in held.value:
            held.value["codec"] = Codec(*held.value["vocabulary"])
        return held.value["codec"]

    return codec


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """``docs`` (text, ...) with ids array<int> and offsets array<array<int>> (characters from, to).

    Encoding is what the ranks of ``path`` give, each match of the pattern by itself,
    without special tokens: their strings are ordinary text. A null or empty text has
    no ids. Columns named ids or offsets give way.
    """
    codec = shared_codec(docs.sparkSession, path)

    @F.pandas_udf("ids array<int>, offsets array<array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec()
        for texts in batches:
            texts = texts.fillna("").tolist()
            ids = own.encode(texts)
            yield pd.DataFrame({"ids": ids, "offsets": [own.offsets(t, i).tolist() for t, i in zip(texts, ids, strict=True)]})

    out = docs.select("*", run(F.col("text").cast("string")).alias("__e"))
    return with_columns(out, ids=F.col("__e.ids"), offsets=F.col("__e.offsets")).drop("__e")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``encoded`` (ids, ...) with decoded, the bytes of the ids. Null ids decode to no bytes."""
    codec = shared_codec(encoded.sparkSession, path)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec()
        for rows in batches:
            yield pd.Series([b"" if r is None else own.decode(np.asarray(r, np.int32)) for r in rows], dtype=object)

    return with_columns(encoded, decoded=run("ids"))


def round_trip(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs`` (doc_id, text, ...): encoded, and decoded again from the ids, in one pass.

    A null or empty text has no ids and decodes to no bytes; a null doc_id stays null.
    Repeated rows come out as often as they came in, with equal ids. Other columns,
    whatever their names, are left out. An empty table gives an empty table.
    """
    codec = shared_codec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for part, texts in slices(batches, most=AT_ONCE):
            own = own or codec()
            ids = own.encode([(t or b"").decode() for t in texts])
            ends = np.cumsum([0, *(len(i) for i in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array([own.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])
        pa.default_memory_pool().release_unused()  # else an idle worker keeps it

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


