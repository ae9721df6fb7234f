"""Phrase collocations: word sequences that stand together more often than their parts do alone.

Counting is by HAT-tries. A task keeps its counts in hash containers under a shallow trie
of word ids; a container that grows too large bursts into one for each next byte of the
ids. When the trie is full, its largest subtrees leave as runs sorted by key, and the runs
of all tasks are merged in partitions by prefix.

Texts are read three times: for words, for pairs of words, and for phrases of three and
four. A phrase is no more frequent than its parts, so each reading counts only phrases
whose parts were frequent; which those are is known from a bit filter of bounded size.
What the filter lets through in error is counted and dropped later, so it changes the
work only.

A word id is 8 bytes of hash of the language and the word; a phrase's key is its ids in
order. Exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import GOLDEN, LOWERED, Words, mix, slices, stored

LEAST, LONGEST, FIRST = 30, 4, 2000
#: A phrase goes whose words lie in a longer one that occurs at least this often for each of its own occurrences, in percent.
COVERED = 80
#: Entries of a container before it bursts, and of a task's trie before it spills; bytes of words kept with it.
BURST, ENTRIES, NAMES = 16_384, 600_000, 16_000_000
#: Bytes of text that are cut into words at once, and rows that are looked at for them.
AT_ONCE, ROWS = 1_500_000, 256
#: Bits of a filter for each of its members, and at most (64 MB).
BITS_EACH, BITS_MOST = 16, 2**29
BREAKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
IS_BREAK, IS_GAP = np.zeros(256, bool), np.zeros(256, bool)
IS_BREAK[[ord(c) for c in BREAKS]] = True
IS_GAP[[ord(c) for c in BREAKS + BLANKS]] = True
ID = 8


class Container:
    """Keys (rows of ids) with counts and what else is told of a key at first, in the order of the keys' hashes; newer ones wait to be merged."""

    def __init__(self):
        self.waiting, self.size, self.settled = [], 0, 0

    def add(self, columns: list[np.ndarray]) -> None:
        self.waiting.append(columns)
        self.size += len(columns[0])

    def settle(self) -> list[np.ndarray]:
        """All entries, each key once: hashes, keys, counts, and the rest."""
        hashes, keys, counts, *rest = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        if len(self.waiting) > 1:
            order = np.argsort(hashes, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
            at = order[first]
            hashes, keys, counts, rest = hashes[at], keys[at], np.add.reduceat(counts[order], first), [r[at] for r in rest]
        self.waiting, self.size, self.settled = [[hashes, keys, counts, *rest]], len(hashes), len(hashes)
        return self.waiting[0]


class HatTrie:
    """Counts by key, a row of ids. A node has a child, node or container, for each next byte of the ids; a container has the keys below.

    A container of over ``burst`` keys becomes a node. Keys are told apart by their hashes.
    """

    def __init__(self, burst: int = BURST, entries: int = ENTRIES):
        self.root, self.burst, self.entries = {}, burst, entries

    def add(self, keys: np.ndarray, counts: np.ndarray, *rest: np.ndarray) -> None:
        """``keys`` (n, ids) with their counts, and columns of which the first value of a key is kept."""
        if len(keys):
            self._add(self.root, 0, [combined(keys), keys, counts, *rest])

    def _add(self, node: dict, level: int, columns: list[np.ndarray]) -> None:
        keys = columns[1]
        step = (keys[:, level // ID] >> np.uint64(56 - 8 * (level % ID))) & np.uint64(255)
        order = np.argsort(step, kind="stable")
        firsts = np.flatnonzero(np.append(True, np.diff(step[order]) != 0))
        for own in np.split(order, firsts[1:]):
            at = int(step[own[0]])
            child, part = node.setdefault(at, Container()), [c[own] for c in columns]
            if isinstance(child, dict):
                self._add(child, level + 1, part)
                continue
            child.add(part)
            if child.size > self.burst and child.size > 2 * child.settled:
                entries = child.settle()
                if child.size > self.burst and level + 1 < ID * keys.shape[1]:
                    node[at] = {}
                    self._add(node[at], level + 1, entries)

    def _containers(self, node) -> Iterator[Container]:
        if isinstance(node, Container):
            yield node
        else:
            for child in node.values():
                yield from self._containers(child)

    def size(self) -> int:
        return sum(c.size for c in self._containers(self.root))

    def spill(self, everything: bool = False) -> Iterator[list[np.ndarray]]:
        """Runs sorted by key (keys, counts, and the rest), each a whole subtree under the root, the largest first, until half of the entries, or all of them, are gone."""
        sizes = {at: sum(c.size for c in self._containers(child)) for at, child in self.root.items()}
        left = sum(sizes.values())
        for at in sorted(sizes, key=sizes.get, reverse=True):
            if not everything and left <= self.entries // 2:
                break
            left -= sizes[at]
            _, keys, *rest = (np.concatenate(c) for c in zip(*(c.settle() for c in self._containers(self.root.pop(at))), strict=True))
            order = np.lexsort(keys.T[::-1])
            yield [c[order] for c in (keys, *rest)]

    def full(self) -> bool:
        """Whether there are more than the entries it may hold, once all that waits is merged."""
        if self.size() <= self.entries:
            return False
        for c in self._containers(self.root):
            c.settle()
        return self.size() > self.entries


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that stand one after the other in ``data``, up to ``ends``."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def key_column(keys: np.ndarray) -> pa.Array:
    return binaries(keys.astype("<u8").view(np.uint8).ravel(), np.arange(1, len(keys) + 1) * ID * keys.shape[1])


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of ``data`` from each of ``starts`` on, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces(Words):
    """The words of a batch of texts, A-Z lower-cased, with the piece that each stands in; no phrase reaches across pieces."""

    def __init__(self, texts: list[bytes | None]):
        raw = b"\n".join([b"", *(t or b"" for t in texts), b"\n" * 8])
        self.raw = np.frombuffer(raw, np.uint8)
        self.bytes = LOWERED[self.raw]
        edges = np.diff(IS_GAP[self.raw].view(np.int8))
        self.starts, self.ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
        begins = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, begins)
        self.piece = np.cumsum(IS_BREAK[self.raw])[self.starts]
        self.hashes = self._hashes()

    def ids(self, langs: list[str]) -> np.ndarray:
        salt = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
        salts = np.array([salt[x] for x in langs], np.uint64)
        return mix(self.hashes + np.repeat(mix(salts), np.diff(self.bounds)[: len(langs)]))


def combined(ids: np.ndarray) -> np.ndarray:
    """One hash for each row of ids."""
    total = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        total = total * GOLDEN + column
    return mix(total)


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(35)) & np.uint64(bits - 1)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """64-bit words of a filter of the ``keys``; at most BITS_MOST bits, however many keys there are."""
    bits = min(BITS_MOST, max(2**16, 2 ** (keys.count() * BITS_EACH - 1).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("key").to_pylist()
            if raw:
                at = np.concatenate(places(combined(np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)), bits))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "mask"])

    words = keys.select("key").mapInArrow(marked, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint64)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in places(hashes, 64 * len(bits)):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, np.ndarray, list[str]]]:
    few = (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS))
    for batch, texts in slices(few, most=AT_ONCE):
        pieces, langs = Pieces(texts), batch.column("lang").to_pylist()
        yield pieces, pieces.ids(langs), langs


def words_counted(docs: DataFrame) -> DataFrame:
    """(lang, word, key, a) of every word of ``docs`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, spelled, begins, langs_seen = HatTrie(), [], 0, {}  # words as spelled first, one after the other

        def runs(everything: bool) -> Iterator[pa.RecordBatch]:
            names, data = list(langs_seen), np.concatenate([*spelled, np.zeros(0, np.uint8)])
            for keys, counts, starts, sizes, lang in trie.spill(everything):
                words = binaries(gathered(data, starts, sizes), np.cumsum(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(lang)), words, key_column(keys), pa.array(counts)], ["lang", "word", "key", "a"])

        for pieces, ids, langs in texts_of(batches):
            code = np.array([langs_seen.setdefault(x, len(langs_seen)) for x in langs], np.int64)
            distinct, at, n = np.unique(ids, return_index=True, return_counts=True)
            sizes = (pieces.ends - pieces.starts)[at]
            spelled.append(gathered(pieces.bytes, pieces.starts[at], sizes))
            trie.add(distinct[:, None], n, begins + np.cumsum(sizes) - sizes, sizes, np.repeat(code, np.diff(pieces.bounds)[: len(langs)])[at])
            begins += len(spelled[-1])
            if begins > NAMES:
                yield from runs(True)
                spelled, begins = [], 0
            elif trie.full():
                yield from runs(False)
        yield from runs(True)

    found = docs.mapInArrow(count, "lang string, word binary, key binary, a long")
    return found.groupBy("lang", "word", "key").agg(F.sum("a").alias("a"))


def phrases_counted(docs: DataFrame, sizes: tuple[int, ...], known: int, bits: np.ndarray) -> DataFrame:
    """(key, a) of phrases of ``docs`` of so many words, all of whose parts of ``known`` words are in the filter ``bits``."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {n: HatTrie() for n in sizes}

        def runs(everything: bool) -> Iterator[pa.RecordBatch]:
            for trie in tries.values():
                for keys, counts in trie.spill(everything):
                    yield pa.RecordBatch.from_arrays([key_column(keys), pa.array(counts)], ["key", "a"])

        for pieces, ids, _ in texts_of(batches):
            within = lambda n: pieces.piece[: len(ids) - n + 1] == pieces.piece[n - 1 :]  # noqa: B023, E731
            if len(ids) < min(sizes):
                continue
            spans = np.lib.stride_tricks.sliding_window_view
            good = within(known)
            good[good] = held(shared.value, combined(spans(ids, known)[good]))
            for n in (n for n in sizes if n <= len(ids)):
                grams = spans(ids, n)[within(n) & spans(good, n - known + 1).all(axis=1)]
                _, at, counts = np.unique(combined(grams), return_index=True, return_counts=True)
                tries[n].add(grams[at], counts)
            if any(trie.full() for trie in tries.values()):
                yield from runs(False)
        yield from runs(True)

    # the subtree of all words but the last is merged in one place; a pair has no word to spare
    found = docs.mapInArrow(count, "key binary, a long")
    if max(sizes) == 2:
        return found.groupBy("key").agg(F.sum("a").alias("a"))
    split = found.select(F.expr(f"substring(key, 1, length(key) - {ID})").alias("head"), F.expr(f"substring(key, length(key) - {ID - 1})").alias("last"), "a")
    return split.repartition("head").groupBy("head", "last").agg(F.sum("a").alias("a")).select(F.concat("head", "last").alias("key"), "a")


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), (lang, word, key, a) and (key, a): all words of each language, its frequent words, and frequent phrases of two to four."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = stored(words_counted(docs))
    often = words.where(F.col("a") >= least)
    pairs = stored(phrases_counted(docs, (2,), 1, bit_filter(often)).where(F.col("a") >= least))
    longer = stored(phrases_counted(docs, tuple(range(3, LONGEST + 1)), 2, bit_filter(pairs)).where(F.col("a") >= least))
    return words.groupBy("lang").agg(F.sum("a").alias("n")), often, pairs.unionByName(longer)


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of two to four words by score.

    ``docs`` has lang and text. Texts are lower-cased (A-Z), cut into pieces at
    ``[.,;:!?]`` and line ends, and those into words at spaces and tabs. a: a phrase's
    occurrences, at least ``least``; l, r: those of the parts of its lowest-scoring cut,
    ties to the earliest; n: all words of the language; score: floor(2000000 * a / (l +
    r)). A phrase does not come whose words lie in a longer one with f(longer) of at
    least ``covered`` percent of a. Order: score, a, both falling, then the phrase's
    bytes. A null text is empty, a null language ``und``; each repeated row counts. Other
    columns are not looked at, whatever their names. Without words, or in an empty table,
    nothing comes. All arithmetic is on whole numbers of up to 38 digits.
    """
    sizes, often, phrases = frequent(docs, least)
    known = stored(often.select("key", "a").unionByName(phrases))
    n_words = (F.length("key") / ID).cast("int")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), n_words - 1)))
    cuts = cuts.select("key", "a", "k", F.expr(f"substring(key, 1, k * {ID})").alias("left"), F.expr(f"substring(key, k * {ID} + 1)").alias("right"))
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    cuts = cuts.withColumn("score", F.expr("(cast(a AS decimal(20, 0)) * 2000000BD) div (l + r)"))
    scored = cuts.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("at")).select("key", "a", "at.score", "at.l", "at.r")

    inside = F.array_distinct(F.flatten(F.array(*(F.array(*(F.struct(F.lit(i).alias("start"), F.lit(n).alias("size")) for i in range(LONGEST - n + 1))) for n in range(2, LONGEST)))))
    subs = phrases.where(F.length("key") > 2 * ID).withColumn("sub", F.explode(inside)).where((F.col("sub.start") + F.col("sub.size") <= n_words) & (F.col("sub.size") < n_words))
    subs = subs.select(F.expr(f"substring(key, sub.start * {ID} + 1, sub.size * {ID})").alias("key"), "a").groupBy("key").agg(F.max("a").alias("over"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    kept = scored.join(subs, "key", "left").where(F.col("over").isNull() | (wide("over", 100) < wide("a", covered))).drop("over")

    each = kept.select("key", F.posexplode(F.expr(f"transform(sequence(0, cast(length(key) / {ID} AS int) - 1), i -> substring(key, i * {ID} + 1, {ID}))")).alias("i", "id"))
    named = each.join(often.select(F.col("key").alias("id"), "lang", F.col("word").cast("string").alias("word")), "id")
    named = named.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = kept.join(named, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= first)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), f AS (
  SELECT lang, ws[i:i + n - 1] AS p, count(*) AS a
  FROM (SELECT lang, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS n))
  GROUP BY ALL
), size AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE len(p) > 1 AND a >= 30
), cut AS (
  SELECT c.lang, c.p, c.a, k, l.a AS l, r.a AS r, ((2000000 * c.a::HUGEINT) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), sub AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS over
  FROM (SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < len(p))
  GROUP BY ALL
), kept AS (
  SELECT low.*, array_to_string(low.p, ' ') AS phrase FROM low LEFT JOIN sub ON sub.lang = low.lang AND sub.p = low.p
  WHERE sub.over IS NULL OR 100 * sub.over::HUGEINT < 80 * low.a::HUGEINT
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept k JOIN size s ON s.lang = k.lang QUALIFY rank <= 2000
"""
