"""N-gram Jaccard join by prefixes under several global orders.

A document is its set of word n-grams. Under any one order of all n-grams, two sets
with a Jaccard similarity of at least t share an n-gram among the first
|x| - ceil(t |x|) + 1 of each. So they do under every order, and a pair must pass the
prefix filter of ORDERS orders before its sets are compared. Each order puts n-grams of
many documents last, rarest of them first. The rest the first order sorts by the length
of their words, longest first, as those meet by chance least often: two texts share many
n-grams of short, frequent words, and the more the larger the table is. The other orders
sort the rest by hashes of their own.

Equal sets are one node from the start, so copies cost nothing. Nodes that share a prefix
n-gram of the first order meet in one of two ways, neither of which pairs out a group:

* up to GROUP nodes: their pairs, a few a node. The other orders' prefixes are joined to a
  pair, and bits that bound from below how far two sets are apart; pairs that pass all
  of these filters chain their nodes to clusters.
* more than GROUP nodes: such n-grams chain their nodes to clusters, a band of set sizes
  at a time; a node stands in two bands, and sets near enough in size share one.

A task holds a cluster (or a block of about BLOCK_BYTES of it), applies the filters of all
orders and the similarity to it in memory by an index of its prefixes, and gives the links
that hold its components together. Between blocks of one cluster, pairs are compared one by
one; of a chained cluster each block also holds a few HUBS of the whole, and then the nodes
outside its largest component meet all its other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.collocations import BITS_EACH, BITS_MOST, held
from fieldweave.llm.common import GOLDEN, Words, gram_hashes, mix, slices, stored

N, PERCENT = 5, 80
ORDERS = 3
#: Common n-grams that are told apart, at most (16 bytes each, to every task).
COMMON_MOST = 250_000
#: Nodes of a prefix n-gram whose pairs are made; more are a cluster.
GROUP = 32
#: Bytes of n-gram hashes that a task compares with each other, and nodes of a cluster that all its blocks hold.
BLOCK_BYTES, HUBS = 16_000_000, 8
#: Rows that a task gets of one n-gram; one with more is dealt to several.
PART_ROWS = 100_000
#: Kinds of rows where nodes meet: edges between places, members at their own band's place, members at the next one's, and pairs of band k as PAIR + k.
CHAIN, MEMBER, GUEST, PAIR = range(4)
#: Classes of an n-gram's length, the topmost bits of its hash, longest first: half bytes of mean length of its words, from 3 bytes on.
CLASS_BITS, SHORTEST = 4, 6
#: A hash of a row's doc_id and text, where rows and not doc_ids are told apart.
ROW = "__row"


def prefix_size(size: int, percent: int) -> int:
    return size + (-percent * size) // 100 + 1


def length_classes(words: Words, n: int) -> np.ndarray:
    """0 for n-grams of the longest words, more for shorter ones, by the mean length."""
    ends = np.cumsum(np.append(0, words.ends - words.starts))
    most = (1 << CLASS_BITS) - 1
    return most - np.clip(2 * (ends[n:] - ends[:-n]) // n - SHORTEST, 0, most)


def gram_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The set of n-gram hashes of each text; of the whole sequence if it is shorter. Sorted.

    The topmost bits of an n-gram's hash are its length class, so long n-grams come first.
    """
    words = Words(texts, lower=True)
    grams = words.grams(n) >> np.uint64(CLASS_BITS)
    if len(grams):
        grams |= length_classes(words, n).astype(np.uint64) << np.uint64(64 - CLASS_BITS)
    out = []
    for i in range(len(texts)):
        start, stop = words.bounds[i], words.bounds[i + 1]
        own = grams[start : stop - n + 1] if stop - start >= n else gram_hashes(words.of(i), stop - start) if stop > start else words.of(i)
        own = np.sort(own)
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


class Orders:
    """The global orders: by number of documents for common n-grams, which stand last; then by the n-gram itself, length class first, or by a hash of it."""

    def __init__(self, common: np.ndarray, docs: np.ndarray):
        at = np.argsort(common)
        self.common, self.docs = common[at], docs[at]

    def counts(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
        return np.where(self.common[at] == grams, self.docs[at], 0)

    def place(self, grams: np.ndarray, order: int, percent: int, counts: np.ndarray | None = None) -> np.ndarray:
        """Where in ``grams`` its prefix under ``order`` stands. ``counts`` if they are known."""
        counts = self.counts(grams) if counts is None else counts
        keep = prefix_size(len(grams), percent)
        own = mix(grams + np.uint64((order * 0xA24BAED4963EE407) % (1 << 64))) if order else grams
        rare = np.flatnonzero(counts == 0)
        if len(rare) >= keep:  # the common case: no sorting of all
            return rare[np.argpartition(own[rare], keep - 1)[:keep]] if len(rare) > keep else rare
        return np.lexsort((own, counts))[:keep]

    def prefix(self, grams: np.ndarray, order: int, percent: int) -> np.ndarray:
        return grams[self.place(grams, order, percent)]


def node_of(grams: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None


def parities(grams: np.ndarray) -> bytes:
    """The set's size and a bit for each of at least twice as many cells: whether an odd number of its n-grams fall there."""
    cells = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return len(grams).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """How many n-grams at least are in one set only, given their ``parities``: each cell whose bits differ has one."""
    low, high = sorted((x[8:], y[8:]), key=len)
    cells, wide = 8 * len(low), int.from_bytes(high, "little")
    folded = 0
    while wide:
        folded ^= wide & ((1 << cells) - 1)
        wide >>= cells
    return (folded ^ int.from_bytes(low, "little")).bit_count()


def row_key(docs: DataFrame):
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs).alias(ROW))


def common_grams(docs: DataFrame, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams in the first order's prefixes of more than GROUP documents, with those numbers, which make the orders.

    Put last, they leave the prefixes of all documents that have enough rarer n-grams.
    Any order gives the same links, so that only the COMMON_MOST most frequent are told
    apart changes the work, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Orders(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for _, texts in slices(batches):
            found = [by.prefix(g, 0, percent) for g in gram_sets(texts, n) if len(g)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["gram"])

    counts = docs.select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("docs")).where(F.col("docs") > GROUP)
    rows = counts.orderBy(F.desc("docs"), "gram").limit(COMMON_MOST).toPandas()
    return rows["gram"].to_numpy(np.int64).view(np.uint64), rows["docs"].to_numpy(np.int64)


def nodes_of(docs: DataFrame, orders, n: int, percent: int) -> DataFrame:
    """(doc_id, ROW, n_shingles, node, tails): node is a hash of the set, null for an empty one.

    tails: 2-byte tails of the set's prefix under each order but the first, and its parities, once for a node in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Orders(*orders.value)
        for batch, texts in slices(batches):
            sets = gram_sets(texts, n)
            nodes, tails, seen = [node_of(s) for s in sets], [], {None}
            for own, node in zip(sets, nodes, strict=True):
                counts = None if node in seen else by.counts(own)
                seen.add(node)
                tails.append(None if counts is None else [*(own[by.place(own, o, percent, counts)].astype("<u2").tobytes() for o in range(1, ORDERS)), parities(own)])
            columns = [batch.column("doc_id"), batch.column(ROW), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(tails, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", ROW, "n_shingles", "node", "tails"])

    return stored(docs.mapInArrow(run, f"doc_id long, {ROW} long, n_shingles long, node long, tails array<binary>"))


def prefixes_of(docs: DataFrame, orders, n: int, percent: int) -> DataFrame:
    """(gram, part, node, size): each set's prefix under the first order; part is over 0 where an n-gram's rows are dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Orders(*orders.value)
        for _, texts in slices(batches):
            grams, parts, nodes, sizes, seen = [], [], [], [], set()
            for own in gram_sets(texts, n):
                node = node_of(own) if len(own) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                counts = by.counts(own)
                at = by.place(own, 0, percent, counts)
                dealt = -(-counts[at] // PART_ROWS)
                grams.append(own[at])
                parts.append(np.where(dealt > 1, (node % np.maximum(dealt, 1)) + 1, 0))
                nodes.append(np.full(len(at), node, np.int64))
                sizes.append(np.full(len(at), len(own), np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t).view(v)) for c, t, v in ((grams, np.uint64, np.int64), (parts, np.int32, np.int32), (nodes, np.int64, np.int64), (sizes, np.int32, np.int32))], ["gram", "part", "node", "size"])

    return docs.select("text").mapInArrow(run, "gram long, part int, node long, size int")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges (a, b) as stars (node, least node), the least ones left out."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ids, 2)
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_edges = low < high
        if not open_edges.any():
            own = label != np.arange(len(nodes))
            return nodes[own], nodes[label[own]]
        np.minimum.at(label, high[open_edges], low[open_edges])
        while (label[label] != label).any():
            label = label[label]


class Pairs:
    """Pairs of a task, without repeats; they are gone through whenever twice as many have come."""

    def __init__(self):
        self.held, self.size, self.most = [], 0, 500_000

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size > self.most:
            self.held = [self.pairs()]
            self.size = len(self.held[0][0])
            self.most = max(self.most, 2 * self.size)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.shortened(*(np.concatenate(c) for c in zip(*self.held, strict=True))) if self.held else (np.zeros(0, np.int64),) * 2

    @staticmethod
    def shortened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        return a[new], b[new]


class Stars(Pairs):
    """Edges of a task, as the stars of their components."""

    shortened = staticmethod(forest)


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a partition as the stars of their components."""
    edges = Stars()
    for batch in batches:
        edges.add(*(c.to_numpy() for c in batch.columns))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in edges.pairs()], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) reaches, by alternating large and small stars.

    Each partition makes stars of its own edges first.
    """
    star = lambda df: df.select("u", "v").mapInArrow(contracted, "u long, v long")
    edges, state = stored(star(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct()), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(star(small.where("u <> v")).distinct())


def meet(percent: int):
    """Of rows (gram, part, node, size) in this order: pairs of the nodes of small n-grams, and edges that chain those of large ones."""

    width = np.log(100 / percent) + 1e-6  # of a band; sizes that a link allows are at most one band apart

    def rows_of(a, b, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(a)))], ["a", "b", "kind"])

    def bands(size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(size) / width).astype(np.int64)

    def places(node: np.ndarray, band: np.ndarray) -> np.ndarray:
        return mix(node.view(np.uint64) ^ mix(band.astype(np.uint64) + GOLDEN)).view(np.int64)

    def groups(chains: Stars, members: Pairs, guests: Pairs, gram, part, node, size, chained) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
        count = np.diff(np.append(first, len(gram)))
        large = (count > GROUP) | (part[first] > 0)
        large[0] |= chained
        out = [(node[:0], node[:0], node[:0])]
        for c in range(2, GROUP + 1):
            rows = first[~large & (count == c)][:, None] + np.arange(c)
            i, j = np.triu_indices(c, 1)
            a, b = rows[:, i].ravel(), rows[:, j].ravel()
            near = np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent
            out.append((node[a[near]], node[b[near]], PAIR + bands(np.maximum(size[a[near]], size[b[near]]))))
        inner = np.flatnonzero(np.repeat(large, count))
        if len(inner):
            at = np.append(inner, inner)
            band = bands(size[inner])
            band = np.append(band, band + 1)
            order = np.lexsort((at, band, np.repeat(np.arange(len(first)), count)[at]))
            at, band = at[order], band[order]
            own = places(node[at], band)
            begins = np.flatnonzero(np.concatenate([[True], (gram[at[1:]] != gram[at[:-1]]) | (part[at[1:]] != part[at[:-1]]) | (band[1:] != band[:-1])]))
            centre = np.repeat(own[begins], np.diff(np.append(begins, len(own))))
            parts = begins[part[at[begins]] > 0]  # parts of one n-gram meet at the n-gram itself
            chains.add(np.append(own, own[parts]), np.append(centre, places(gram[at[parts]], band[parts])))
            native = band == bands(size[at])
            members.add(own[native], node[at[native]])
            guests.add(own[~native], node[at[~native]])
        a, b, kind = (np.concatenate(x) for x in zip(*out, strict=True))
        return rows_of(np.minimum(a, b), np.maximum(a, b), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chained, chains, members, guests = None, False, Stars(), Pairs(), Pairs()
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("gram", "part", "node", "size")]
            if not len(rows[0]):
                continue
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            gram, part, node, _ = held
            held = [c[np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1])])] for c in held]
            gram, part = held[:2]
            last = int(np.argmax((gram == gram[-1]) & (part == part[-1])))
            if last:
                yield groups(chains, members, guests, *(c[:last] for c in held), chained)
                held, chained = [c[last:] for c in held], False
            elif len(gram) > PART_ROWS:  # one n-gram only: chain what is here, and go on from its first node
                yield groups(chains, members, guests, *held, True)
                held, chained = [c[:1] for c in held], True
        if held is not None:
            yield groups(chains, members, guests, *held, chained)
        yield rows_of(*chains.pairs(), CHAIN)
        yield rows_of(*members.pairs(), MEMBER)
        yield rows_of(*guests.pairs(), GUEST)

    return run


def meetings(docs: DataFrame, orders, n: int, percent: int) -> DataFrame:
    """(a, b, kind): pairs of nodes that may be similar; edges between places of nodes in bands, the stars of each task; (place, node) of members and guests."""
    dealt = prefixes_of(docs, orders, n, percent).repartition("gram", "part").sortWithinPartitions("gram", "part", "node")
    return stored(dealt.mapInArrow(meet(percent), "a long, b long, kind int").distinct())


def among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ROW is in ``wanted``, and few others: told by a filter of BITS_MOST bits at most, so that not all texts are shuffled."""
    bits = min(BITS_MOST, max(2**16, 2 ** (wanted.count() * BITS_EACH - 1).bit_length()))
    spots = F.explode(F.array(*(part.bitwiseAND(F.lit(bits - 1)) for part in (F.col(ROW), F.shiftrightunsigned(ROW, 35))))).alias("at")
    words = wanted.select(spots).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("mask")).toArrow()
    made = np.zeros(bits // 64, np.int64)
    made[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(made.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(shared.value, batch.column(ROW).to_numpy().view(np.uint64))))

    return docs.mapInArrow(run, docs.schema)


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``wanted`` (node, ...) with the node's n-gram hashes, grams.

    A node's text is that of one row, found by its ROW; only those texts are hashed again.
    Rows equal in doc_id and text may bring a node more than once.
    """
    own = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(ROW).alias(ROW)).join(wanted, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            grams = pa.array([s.astype("<u8").tobytes() for s in gram_sets(texts, n)], pa.binary())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), grams], [*kept, "grams"])

    texts = among(docs.select(ROW, "text"), own.select(ROW).distinct()).join(own, ROW).select(*wanted.columns, "text")
    return texts.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in wanted.dtypes) + ", grams binary")


def kept(pairs: DataFrame, held: DataFrame, column: str, read, check) -> DataFrame:
    """The pairs (a, b) of which ``check`` holds, given what ``read`` makes of ``column`` of either node in ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            found = []
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("b", "xa", "xb")), strict=True):
                if b != last:
                    last, own = b, read(y)
                found.append(check(read(x), own))
            good = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in names], names)

    names = pairs.columns
    one = held.where(F.col(column).isNotNull()).groupBy("node").agg(F.first(column).alias(column))
    side = lambda s: one.select(F.col("node").alias(s), F.col(column).alias(f"x{s}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "xa", "xb").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes)))


def sharing_prefixes(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a prefix n-gram under every further order too, and whose parities leave room for the similarity.

    Prefixes are told by tails, as n-grams of different tails differ.
    """

    def check(x: tuple[list[set], bytes], y: tuple[list[set], bytes]) -> bool:
        if any(p.isdisjoint(q) for p, q in zip(x[0], y[0], strict=True)):
            return False
        both = int.from_bytes(x[1][:8], "little") + int.from_bytes(y[1][:8], "little")
        common = (both - apart_at_least(x[1], y[1])) // 2
        return 100 * common >= percent * (both - common)

    return kept(pairs, rows, "tails", lambda made: ([set(memoryview(m).cast("H")) for m in made[:-1]], made[-1]), check)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def check(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    return kept(pairs, sets, "grams", lambda made: np.frombuffer(made, "<u8"), check)


class Lists:
    """Lists of numbers, one after another."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths
        self.starts = np.cumsum(lengths) - lengths

    def one(self, i: int) -> np.ndarray:
        return self.values[self.starts[i] : self.starts[i] + self.lengths[i]]

    def some(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of those lists, and where each begins among them."""
        lengths = self.lengths[which]
        begins = np.cumsum(lengths) - lengths
        return self.values[np.repeat(self.starts[which] - begins, lengths) + np.arange(lengths.sum())], begins


class Block:
    """Sets of n-grams in memory, and which of them are linked with a given one."""

    def __init__(self, sets: list[np.ndarray], by: Orders, percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        grams, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.flags = np.zeros(len(grams), bool)
        self.whole = Lists(ids, self.size)
        counts = by.counts(grams)
        self.prefixes = []
        for order in range(ORDERS):
            own = [i + by.place(s, order, percent, counts[ids[i : i + len(s)]]) for i, s in zip(self.whole.starts.tolist(), sets, strict=True)]
            self.prefixes.append(Lists(ids[np.concatenate(own)], np.array([len(p) for p in own])))
        first = self.prefixes[0]
        holders = np.repeat(np.arange(len(sets)), first.lengths)[np.argsort(first.values, kind="stable")]
        self.holders = Lists(holders, np.bincount(first.values, minlength=len(grams)))

    def _hits(self, lists: Lists, x: int, others: np.ndarray, count: np.ufunc, kind: type) -> np.ndarray:
        own = lists.one(x)
        self.flags[own] = True
        values, begins = lists.some(others)
        hits = count.reduceat(self.flags[values], begins, dtype=kind)
        self.flags[own] = False
        return hits

    def links(self, x: int, component: np.ndarray) -> np.ndarray:
        """The sets of other components that are linked with set ``x``: in every order's filter, and similar enough."""
        near = np.unique(self.holders.some(self.prefixes[0].one(x))[0])
        size, own = self.size[near], self.size[x]
        near = near[(component[near] != component[x]) & (np.minimum(size, own) * 100 >= np.maximum(size, own) * self.percent)]
        for lists in self.prefixes[1:]:
            if len(near):
                near = near[self._hits(lists, x, near, np.logical_or, bool)]
        if len(near):
            common = self._hits(self.whole, x, near, np.add, np.int64)
            near = near[100 * common >= self.percent * (self.size[near] + own - common)]
        return near


def joined(block: Block, component: np.ndarray, queries: Iterator[int]) -> list[tuple[int, int]]:
    """Links that join the components of ``queries`` with others; ``component`` is brought up to date."""
    found = []
    for x in queries:
        linked = block.links(x, component)
        if len(linked):
            others, first = np.unique(component[linked], return_index=True)
            found += [(x, int(y)) for y in linked[first]]
            component[np.isin(component, others)] = component[x]
    return found


def outside_largest(component: np.ndarray) -> Iterator[int]:
    """Members of ``component``, as it is at the time, until all that were not given are in one component."""
    asked = np.zeros(len(component), bool)
    while True:
        largest = np.bincount(component).argmax()
        rest = np.flatnonzero(~asked & (component != largest))
        if not len(rest):
            return
        asked[rest[0]] = True
        yield int(rest[0])


def within_blocks(members: DataFrame, orders, percent: int) -> DataFrame:
    """(a, b): links that hold together the components of each (cluster, block) of ``members`` (node, grams), as stars."""

    def run(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        sets = [np.frombuffer(g, "<u8") for g in table.column("grams").take(pa.array(first)).to_pylist()]
        component = np.arange(len(nodes))
        block = Block(sets, Orders(*orders.value), percent)
        joined(block, component, outside_largest(component))
        star = np.unique(component, return_index=True)[1][np.unique(component, return_inverse=True)[1]]
        own = star != np.arange(len(nodes))
        return pa.table({"a": nodes[star[own]], "b": nodes[own]})

    return stored(members.groupBy("cluster", "block").applyInArrow(run, "a long, b long"))


def across_blocks(asked: DataFrame, orders, percent: int) -> DataFrame:
    """(a, b): links of the query nodes of each (cluster, part, block) with nodes of other components there."""

    def run(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        taken = table.take(pa.array(first))
        component = np.unique(taken.column("component").to_numpy(), return_inverse=True)[1]
        queries = np.flatnonzero(np.isin(nodes, table.column("node").to_numpy()[table.column("query").to_numpy(zero_copy_only=False)]))
        block = Block([np.frombuffer(g, "<u8") for g in taken.column("grams").to_pylist()], Orders(*orders.value), percent)
        links = np.array(joined(block, component, iter(queries.tolist())), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[links[:, 0]], "b": nodes[links[:, 1]]})

    return stored(asked.groupBy("cluster", "part", "block").applyInArrow(run, "a long, b long"))


def with_own(labels: DataFrame) -> DataFrame:
    """``components`` of all nodes with links, the least of each included."""
    return labels.union(labels.select("component", "component")).distinct()


def links_between(docs: DataFrame, rows: DataFrame, orders, n: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes: all of them, but for those inside a component that other links hold together."""
    met = meetings(docs, orders, n, percent)
    pairs = sharing_prefixes(met.where(F.col("kind") >= PAIR), rows, percent)
    # Pairs left chain their nodes too, by bands; these places are other hashes, so both kinds of clusters stay apart.
    edges = pairs.select(*(F.xxhash64(c, "kind").alias(c) for c in ("a", "b")))
    labels = with_own(components(met.where(F.col("kind") == CHAIN).select("a", "b").union(edges))).select(F.col("node").alias("a"), F.col("component").alias("cluster"))
    chained = met.where(F.col("kind").isin(MEMBER, GUEST)).select("a", F.col("b").alias("node"), F.lit(True).alias("banded"), (F.col("kind") == MEMBER).alias("native"))
    paired = pairs.select(F.explode(F.array("a", "b")).alias("node"), "kind").select(F.xxhash64("node", "kind").alias("a"), "node", F.lit(False).alias("banded"), F.lit(True).alias("native"))
    clusters = chained.union(paired.distinct()).join(labels, "a").groupBy("cluster", "node").agg(F.max("banded").alias("banded"), F.max("native").alias("native"))
    members = clusters.join(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("size")), "node")
    # Guests without a member of the band are together in their own band already.
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("size") * 8 / BLOCK_BYTES).alias("blocks"), F.count("*").alias("n"), F.max("native").alias("native")).where("native AND n > 1").select("cluster", "blocks")
    placed = stored(members.join(blocks, "cluster").select("node", "cluster", "banded", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")))
    several = placed.where("blocks > 1")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("node", "cluster"), "node"))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    hubs = several.where("banded").withColumn("rank", rank).where(F.col("rank") <= HUBS).select("node", "cluster", every("blocks").alias("block"))
    links = within_blocks(sets_of(docs, rows, placed.select("node", "cluster", "block").union(hubs), n), orders, percent)
    if several.isEmpty():
        return links
    # Pairs of different blocks of their cluster are compared one by one.
    at = several.where("NOT banded").select("node", "cluster", "block")
    apart = pairs.select("a", "b").join(at.toDF("a", "ca", "ba"), "a").join(at.toDF("b", "cb", "bb"), "b").where("ca = cb AND ba <> bb").select("a", "b").distinct()
    sets = stored(sets_of(docs, rows, several.select("node").distinct(), n))
    links = links.union(similar(apart, sets, percent))
    labelled = several.where("banded").join(with_own(components(links)), "node", "left").select("node", "cluster", "blocks", "block", F.coalesce("component", "node").alias("component"))
    labelled = stored(labelled.join(sets, "node"))
    main = labelled.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    queries = labelled.join(main, "cluster").where("component <> main")
    dealt = queries.groupBy("cluster").agg(F.ceil(F.sum(F.length("grams")) / BLOCK_BYTES).alias("parts"))
    queries = queries.join(dealt, "cluster").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts"))
    columns = ["cluster", "part", "block", "node", "component", "grams", "query"]
    asking = queries.withColumn("block", every("blocks")).withColumn("query", F.lit(True)).select(columns)
    others = labelled.join(dealt, "cluster").withColumn("part", every("parts")).withColumn("query", F.lit(False)).select(columns)
    return links.union(across_blocks(asking.union(others), orders, percent))


def labelled(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, node, ROW) of each row; (node, own): each node's least doc_id; (node, component) of the nodes that have links."""
    docs = texts_of(docs)
    orders = docs.sparkSession.sparkContext.broadcast(common_grams(docs, n, percent))
    rows = nodes_of(docs, orders, n, percent)
    names = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("own"))
    return rows, names, with_own(components(links_between(docs, rows, orders, n, percent)))


def ngram_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    A document's set is its distinct n-grams of words, A-Z lower-cased; of fewer words
    than n, the whole sequence. Two documents link when 100 * intersection >= percent *
    union. component_id is the least doc_id that links reach. A null or empty text, or
    one without words, has an empty set, links with nothing and is its own component.

    Repeated rows come out as often as they came in. Rows without doc_id take part, but
    give no component its name; a component of such rows only has none. Other columns of
    ``docs``, whatever their names, are not looked at. An empty table gives an empty
    table. Sets and n-grams are told apart by hashes of 64 bits.
    """
    sets, names, labels = labelled(docs, n, percent)
    named = labels.join(names, "node")
    least = named.groupBy("component").agg(F.min("own").alias("least"))
    named = names.join(named.select("node", "component").join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "own").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def orderable(field: T.StructField):
    """A column to order by: itself, or what stands for it as text where its type has no order."""
    column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
    if "variant" in kind or kind == "interval":
        return column.cast("string")
    return F.to_json(F.struct(column.alias("c"))) if "map<" in kind else column


def drop_near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, and every row without words.

    The row that stays is the one of least doc_id, nulls last, and of these the one of
    least ROW; of rows equal in both doc_id and text, the first by the other columns (maps by their JSON). So a
    component of rows without doc_id keeps one of them, and rows that share a doc_id but
    not a component each stand for their own.
    """
    sets, _, labels = labelled(docs, n, percent)
    rows = sets.select("doc_id", "node", ROW)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).getField(ROW)
    first = rows.where("node IS NOT NULL").join(labels, "node", "left").groupBy(F.coalesce("component", "node")).agg(least.alias(ROW)).select(ROW, F.lit(False).alias("__all"))
    stay = first.union(rows.where("node IS NULL").select(ROW, F.lit(True)).distinct())
    # Dealt by ROW for the join, the rows need not move again for the window.
    others = [orderable(f) for f in docs.schema if f.name not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy(ROW, "doc_id", "text").orderBy(*others or [F.lit(0)]))
    return docs.withColumn(ROW, row_key(docs)).join(stay, ROW).withColumn("__place", place).where("__all OR __place = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), n=4, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT r.a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
