"""Substring dedup by relative Lempel-Ziv parsing.

The corpus itself is the reference, indexed in blocks: a run of windows (of ``window``
words) whose smallest k-gram hash is the same belongs to the block of that hash, its
anchor, so equal windows always meet in one block, wherever they stand. A document is
parsed against every block that its own anchors name:

* a run that equals another run of its block is a factor as a whole;
* the other runs of a block, one of each, are its reference text, indexed by a suffix
  order. Each run is factored greedily: a factor is the longest match, elsewhere in the
  block, from where the last one ended, or one word that stands nowhere else. A factor of
  ``window`` words or more is a duplicate span;
* at factor boundaries, a window that no factor holds is looked up in the index, as
  another place of the reference may have it.

Every word under a span is a duplicate; spans of neighbouring blocks join in the document.
Blocks of one run are never shipped, unless it holds a window twice. Equal
runs of an Arrow batch go into one row before any shuffle, so a passage in very many
documents comes to its block as a few rows. A block of over BLOCK_RUNS differing runs is
cut into pieces at windows, dealt by their hashes, so that its factors there are one
window long and no task holds the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import Words, cut, mix, slices, with_columns

WINDOW = 35
#: Words of an anchor.
ANCHOR = 8
#: Runs of a block whose reference text one task holds.
BLOCK_RUNS = 2000
#: Words and windows that are factored at once; blocks stay whole.
AT_ONCE = 1_000_000
OCCURRENCE = np.dtype([("row", "<i8"), ("start", "<i4")])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before in one of ``keys``."""
    differs = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        differs |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], differs]))[: len(keys[0])]


def runs_of(texts: list[bytes | None], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Text, anchor, hash, first window and number of windows of each run of ``texts``, and whether it holds a window twice."""
    words = Words(texts)
    windows = words.grams(window)
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))[: len(windows)]
    at = np.flatnonzero(np.arange(len(windows)) + window <= words.bounds[text + 1])
    least = sliding_min(words.grams(anchor), window - anchor + 1)[at]
    first = starts_of(least, text[at])
    lengths = np.diff(np.append(first, len(at)))
    begin = at[first]
    # A run is told by its first and last windows and its length, and by the sum of those between.
    sums = np.concatenate([[np.uint64(0)], np.cumsum(windows)])
    end = begin + lengths
    run = mix(mix(windows[begin]) + windows[end - 1] + mix(lengths.astype(np.uint64))) ^ mix(sums[end] - sums[begin])
    own = np.repeat(np.arange(len(first)), lengths)
    order = np.argsort(windows[at], kind="stable")
    a, b = order[:-1], order[1:]
    twice = np.zeros(len(first), bool)
    twice[own[a[(windows[at[a]] == windows[at[b]]) & (own[a] == own[b])]]] = True
    return text[begin], least[first], run, begin - words.bounds[text[begin]], lengths, twice


def emit_runs(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            which, anchors, runs, starts, lengths, twice = runs_of(texts, window, anchor)
            if not len(which):
                continue
            at = np.empty(len(anchors), OCCURRENCE)
            at["row"], at["start"] = batch.column("row").to_numpy()[which], starts
            order = np.lexsort((at["start"], at["row"], runs, anchors))
            anchors, runs, lengths, twice, at = anchors[order], runs[order], lengths[order], twice[order], at[order]
            first = starts_of(anchors, runs)
            n = np.diff(np.append(first, len(anchors)))
            ends = np.append(first, len(anchors)) * OCCURRENCE.itemsize
            held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(at.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[first].view(np.int64)), pa.array(runs[first].view(np.int64)), pa.array(lengths[first].astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(twice[first]), held],
                ["anchor", "run", "length", "n", "twice", "at"],
            )

    return run


def unpack(first_only: bool):
    """(row, start, length) of each occurrence, or the first of each row; with its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("at").to_pylist()
            if first_only:
                held = [h[: OCCURRENCE.itemsize] for h in held]
            counts = [len(h) // OCCURRENCE.itemsize for h in held]
            at = np.frombuffer(b"".join(held), OCCURRENCE)
            repeat = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), counts))
            yield pa.RecordBatch.from_arrays([repeat("anchor"), pa.array(at["row"]), pa.array(at["start"]), repeat("length"), repeat("total")], ["anchor", "row", "start", "length", "total"])

    return run


UNPACKED = "anchor long, row long, start int, length int, total long"


def emit_reference(window: int, block_runs: int):
    """The words of each asked run; of a large block the windows instead, dealt by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            words = Words(texts)
            windows = words.grams(window)
            for i, (row, asked) in enumerate(zip(batch.column("__row").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                for a in asked:
                    begin, parts = words.bounds[i] + a["start"], -(-a["total"] // block_runs)
                    if parts == 1:
                        pieces = [(0, words.hashes[begin : begin + a["length"] + window - 1].tobytes(), None)]
                    else:
                        own, places = windows[begin : begin + a["length"]], np.arange(a["start"], a["start"] + a["length"], dtype=np.int32)
                        part = (own % np.uint64(parts)).astype(np.int64)
                        pieces = [(int(p), own[part == p].tobytes(), places[part == p].tobytes()) for p in np.unique(part)]
                    for p, hashes, places in pieces:
                        for column, value in zip(out, (a["anchor"], p, row, a["start"], hashes, places), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["anchor", "part", "row", "start", "hashes", "places"])

    return run


REFERENCE = "anchor long, part int, row long, start int, hashes binary, places binary"


class Suffixes:
    """An index of the reference text of blocks: the suffixes of their runs in order, by doubling.

    ``run`` and ``block`` number the runs and blocks of ``words``, which stand one after
    another; a match ends where either run does. A suffix has its longest match beside it.
    """

    def __init__(self, words: np.ndarray, run: np.ndarray, block: np.ndarray):
        n = len(words)
        self.run, self.block = run, block
        self.left = np.repeat(np.append(starts_of(run)[1:], n), np.diff(np.append(starts_of(run), n))) - np.arange(n)
        tokens = np.unique(words, return_inverse=True)[1].astype(np.int64)
        self.ranks = [np.unique(block.astype(np.int64) * (n + 1) + tokens, return_inverse=True)[1].astype(np.int64) + 1]
        most = int(self.left.max(initial=1))
        while 2 ** len(self.ranks) <= most:
            later = self._later(len(self.ranks) - 1)
            self.ranks.append(np.unique(self.ranks[-1] * (n + 1) + later, return_inverse=True)[1].astype(np.int64) + 1)
        self.order = np.lexsort((self._later(len(self.ranks) - 1), self.ranks[-1]))
        self.at = np.empty(n, np.int64)
        self.at[self.order] = np.arange(n)

    def _later(self, level: int) -> np.ndarray:
        """The rank of what follows 2 ** level words on, 0 beyond a run."""
        step = 2**level
        moved = np.append(self.ranks[level], np.zeros(step, np.int64))[step:]
        return np.where(self.left > step, moved, 0)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words places ``a`` and ``b`` have in common from there on; 0 in different blocks."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            for _ in range(2 if k == len(self.ranks) - 1 else 1):
                fits = np.minimum(self.left[a], self.left[b]) >= out + 2**k
                fits[fits] = self.ranks[k][a[fits] + out[fits]] == self.ranks[k][b[fits] + out[fits]]
                out[fits] += 2**k
        return out

    def longest(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of the longest match of each of ``places`` at another place of its block, and that place, -1 for none."""
        length, where = np.zeros(len(places), np.int64), np.full(len(places), -1)
        for side in (-1, 1):
            at = self.at[places] + side
            there = (at >= 0) & (at < len(self.order))
            beside = self.order[at[there]]
            found = np.zeros(len(places), np.int64)
            found[there] = self.common(places[there], beside)
            better = found > length
            where[better] = self.order[at[better]]
            length[better] = found[better]
        return length, where


def greedy_factors(index: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The factors (start, length, place in the reference) of each run, in order.

    A factor is the longest match from where the last one ended; a word that stands
    nowhere else is one of length 1 without a place, -1. All runs are parsed side by side.
    """
    first = starts_of(index.run)
    at, stop, found = first, np.append(first[1:], len(index.run)), []
    while len(at):
        length, where = index.longest(at)
        length = np.maximum(length, 1)
        found.append((at, length, where))
        going = at + length < stop
        at, stop = (at + length)[going], stop[going]
    starts, lengths, places = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(starts)
    return starts[order], lengths[order], places[order]


def duplicate_windows(index: Suffixes, window: int) -> np.ndarray:
    """Which places start a window that also starts elsewhere, from the factors.

    Windows inside a factor stand at its place in the reference too. A window that runs
    over a factor's end may stand at another place: those of the last places of each
    factor are looked up in the index.
    """
    starts, lengths, places = greedy_factors(index)
    n = len(index.run)
    edges = np.zeros(n + 1, np.int64)
    long = (places >= 0) & (lengths >= window)
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, (starts + lengths)[long] - window + 1, -1)
    good = np.cumsum(edges[:-1]) > 0
    ends, known = np.repeat(starts + lengths, lengths), np.repeat(places >= 0, lengths)
    asked = np.flatnonzero(known & ~good & (np.arange(n) + window > ends) & (index.left >= window))
    good[asked] = index.longest(asked)[0] >= window
    return good


def parse_blocks(window: int):
    """The spans (row, start, length) of windows that stand elsewhere too. Blocks come one after another, many at a time."""

    def spans(rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((places, rows))
        rows, places = rows[order], places[order]
        first = starts_of(rows, places - np.arange(len(places)))
        return pa.RecordBatch.from_arrays([pa.array(rows[first]), pa.array(places[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(rows))).astype(np.int32))], ["row", "start", "length"])

    def factored(table: pa.Table) -> pa.RecordBatch:
        hashes = table.column("hashes").to_pylist()
        counts = np.array([len(h) // 8 for h in hashes])
        words, run = np.frombuffer(b"".join(hashes), np.uint64), np.repeat(np.arange(len(counts)), counts)
        block = np.unique(table.column("anchor").to_numpy(), return_inverse=True)[1][run]
        good = np.flatnonzero(duplicate_windows(Suffixes(words, run, block), window))
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(table.column("start").to_numpy().astype(np.int64), counts)
        return spans(np.repeat(table.column("row").to_numpy(), counts)[good], place[good])

    def dealt(table: pa.Table) -> pa.RecordBatch:
        hashes = table.column("hashes").to_pylist()
        windows, places = np.frombuffer(b"".join(hashes), np.uint64), np.frombuffer(b"".join(table.column("places").to_pylist()), np.int32)
        _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
        twice = n[which] > 1
        return spans(np.repeat(table.column("row").to_numpy(), [len(h) // 8 for h in hashes])[twice], places[twice].astype(np.int64))

    def parsed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        words = table.column("places").is_null()
        for own, how in ((table.filter(words), factored), (table.filter(pa.compute.invert(words)), dealt)):
            if own.num_rows:
                yield how(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part = batch.column("anchor").to_numpy(), batch.column("part").to_numpy()
            ends = np.cumsum(pa.compute.binary_length(batch.column("hashes")).to_numpy() // 8)
            first, begun = starts_of(anchor, part), 0
            if last == (anchor[0], part[0]):
                first = first[1:]
            for f in first.tolist():
                if size + (ends[f - 1] if f else 0) - (ends[begun - 1] if begun else 0) >= AT_ONCE:
                    parts.append(batch.slice(begun, f - begun))
                    yield from parsed(parts)
                    parts, size, begun = [], 0, f
            parts.append(batch.slice(begun))
            size += int(ends[-1] - (ends[begun - 1] if begun else 0))
            last = (anchor[-1], part[-1])
        if parts:
            yield from parsed(parts)

    return run


def duplicate_spans(base: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row, start, length): runs of windows of ``base`` (__row, text, ...) whose words also start somewhere else."""
    rows = base.select(F.col("__row").alias("row"), F.col("text").cast("string").alias("text"))
    runs = rows.mapInArrow(emit_runs(window, anchor), "anchor long, run long, length int, n long, twice boolean, at binary")
    block, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "run")
    runs = runs.withColumn("total", F.sum("n").over(block)).where("total > 1 OR twice")
    runs = runs.withColumn("copies", F.sum("n").over(same)).withColumn("nth", F.row_number().over(same.orderBy("at")))
    runs = cut(runs)
    factors = runs.where("copies > 1").mapInArrow(unpack(False), UNPACKED).select("row", "start", "length")
    ends = runs.where("(total > copies OR twice) AND nth = 1").mapInArrow(unpack(True), UNPACKED)
    asked = ends.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "length", "total")).alias("asked")).withColumnRenamed("row", "__asks")
    # All columns go along, so that this join and the last one read the same shuffle of the texts.
    words = base.join(asked, F.col("__row") == F.col("__asks")).mapInArrow(emit_reference(window, BLOCK_RUNS), REFERENCE)
    dealt = words.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return factors.unionByName(dealt.mapInArrow(parse_blocks(window), "row long, start int, length int"))


def covered(text: str, spans: list, window: int) -> tuple[list[bytes], np.ndarray]:
    """The words of ``text`` and which of them the spans (first window, number of windows) cover."""
    raw = text.encode().split()
    edges = np.zeros(len(raw) + 1, np.int64)
    if spans is not None and len(spans):
        own = np.array([(s["start"], s["length"]) for s in spans], np.int64)
        np.add.at(edges, own[:, 0], 1)
        np.add.at(edges, own[:, 0] + own[:, 1] + window - 1, -1)
    return raw, np.cumsum(edges[:-1]) > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` (doc_id, text, ...) without words under any window of ``window`` words that also starts elsewhere.

    text: the kept words joined by one space. Adds n_words, n_removed and spans, an
    array<struct<start, length>> of the removed words' places. Windows are those of the
    input, of one document each, their words compared unchanged; a passage that only
    repeats within its own document counts too, and all its copies go.

    A null or empty text, and one under ``window`` words, loses nothing. Repeated rows
    are copies of each other, so their windows go in both. Columns n_words, n_removed and
    spans give way, others stay. An empty table gives an empty table. Windows and runs
    are compared by hashes of 64 bits.
    """
    if anchor >= window:
        raise ValueError("an anchor must be shorter than a window")
    base = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = duplicate_spans(base, window, anchor)
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("__spans")).withColumnRenamed("row", "__found")

    @F.pandas_udf("text string, n_words long, n_removed long, spans array<struct<start:int,length:int>>")
    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans, strict=True):
            words, gone = covered(text or "", own, window)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
            out.append((kept.decode(), len(words), int(gone.sum()), [{"start": int(a), "length": int(b - a)} for a, b in edges.reshape(-1, 2)]))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed", "spans"])

    joined = base.join(spans, F.col("__row") == F.col("__found"), "left")
    joined = joined.select(*(base[c] for c in docs.columns), run(base["text"].cast("string"), "__spans").alias("__kept"))
    out = with_columns(joined, n_words=F.col("__kept.n_words"), n_removed=F.col("__kept.n_removed"), spans=F.col("__kept.spans"))
    return out.select(*(F.col("__kept.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in out.columns if c != "__kept"))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), dup AS (
  SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM dup, range(0, 35) AS r(j)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL), '') AS kept
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
