"""Conversation prefix trie: which openings conversations share, and what sharing them would save.

A node is a distinct sequence of turns. Turns are numbered, and prefixes keyed by 128
bits of polynomial hashes, in one pass over rows ranged by conversation and turn: a
conversation may run on over several tasks, whose totals (one row a task) are carried
over. Conversations that are equal to the end are one sequence with a count.

Sequences are dealt to shards by a prefix that is short enough to be shared and long
enough that at most SHARD_TURNS turns have it; it is found among the depths 1, 2, 4 and
so on. A shard packs its sequences into a double-array trie (BASE and CHECK over dense
turn ids), walks them through it and sums its nodes and their subtrees. Nodes above the
cuts are shared by shards; their counts are merged globally, and what lies under them
is summed by pointer doubling. So no task holds more than a shard, whatever opening is
shared by whatever part of all conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import cut, mix, stored

BASES, CARRY = 100, 6
#: Turns of a shard, and shards at least.
SHARD_TURNS, SHARDS = 200_000, 64
#: conv_ids that one piece of an unfinished list holds.
PIECE = 8192
#: Free slots looked at for a node of several children, before it goes to the end of the arrays.
TRIES = 64
RADIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
NOTHING = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie in two arrays: the child of node s by code c is BASE[s] + c, and CHECK of it is s. Node 0 is the top."""

    def __init__(self):
        self.base, self.check, self.free, self.end = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), 1, 1
        self.check[0] = 0

    def _room(self, upto: int) -> None:
        if upto >= len(self.check):
            more = max(upto + 1, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def add(self, node: int, codes: np.ndarray) -> None:
        """Give ``node`` its children, of the distinct, ascending ``codes``."""
        steps = codes - codes[0]
        self._room(self.end + int(steps[-1]) + TRIES)
        while self.check[self.free] >= 0:
            self.free += 1
        tried = np.flatnonzero(self.check[self.free : self.free + TRIES] < 0) + self.free
        at = next((s for s in tried.tolist() if (self.check[np.minimum(s + steps, self.end)] < 0).all()), self.end) if len(codes) > 1 else self.free
        self._room(at + int(steps[-1]) + TRIES)
        self.base[node] = at - codes[0]
        self.check[at + steps] = node
        self.end = max(self.end, at + int(steps[-1]) + 1)

    def walk(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        found = self.base[nodes] + codes
        assert (self.check[found] == nodes).all()
        return found

    @classmethod
    def packed(cls, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> DoubleArray:
        """The trie of the sequences codes[start : start + size], built level by level."""
        trie, at = cls(), np.zeros(len(starts), np.int64)
        for level in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > level)
            own = codes[starts[on] + level]
            pairs = np.unique(np.stack([at[on], own], 1), axis=0)
            firsts = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
            for lo, hi in zip(firsts, [*firsts[1:], len(pairs)], strict=True):
                trie.add(int(pairs[lo, 0]), pairs[lo:hi, 1])
            at[on] = trie.walk(at[on], own)
        return trie


def power(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base ** n mod 2 ** 64."""
    base, out, n = np.array([base]), np.ones(len(n), np.uint64), n.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), out * base, out)
        base, n = base * base, n >> np.uint64(1)
    return out


def values(turns: pa.Array) -> np.ndarray:
    """(2, n): both halves of 16-byte turn ids, mixed; 0 for null."""
    none = np.asarray(turns.is_null())
    raw = np.frombuffer(b"".join(turns.fill_null(bytes(16)).to_pylist()), "<u8").reshape(-1, 2).T
    return np.where(none, np.uint64(0), mix(raw))


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [(c.split()[0], TYPES[c.split()[1]]) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=pa.schema(fields))


def running(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` (conv_id, turn binary, chars, ...) in ``order`` within conv_id, with pos from 0, and keys.

    a, b: both lanes of the key of the turns so far; pa, pb: of those before. Rows are
    ranged over tasks, so a conversation of any length is dealt to many.
    """
    ranged = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", "turn", "chars")
    out = "conv_id long, turn binary, chars long, part int, pos long, a long, b long, last boolean"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        conv, size, sums = None, 0, np.zeros(2, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            first = np.append(True, ids[1:] != ids[:-1])
            start = np.flatnonzero(first)
            run = np.cumsum(first) - 1
            pos = np.arange(len(ids)) - start[run]
            if ids[0] == conv:
                pos[run == 0] += size
            value, keys = values(batch.column("turn")), []
            for lane, radix in enumerate(RADIX):
                total = np.cumsum(value[lane] * power(radix, pos))
                total -= np.append(np.uint64(0), total)[start][run]
                if ids[0] == conv:
                    total[run == 0] += sums[lane]
                keys.append(total)
            conv, size, sums = ids[-1], int(pos[-1]) + 1, np.array([k[-1] for k in keys])
            columns = [*(batch.column(c) for c in ("conv_id", "turn", "chars")), pa.array(np.full(len(ids), part, np.int32)), pa.array(pos)]
            columns += [*(pa.array(k.view(np.int64)) for k in keys), pa.array(np.zeros(len(ids), bool))]
            made = pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in out.split(", ")])
            if held is not None:
                yield held
            yield made.slice(0, made.num_rows - 1)
            held = made.slice(made.num_rows - 1)
        if held is not None:
            yield held.set_column(7, "last", pa.array([True]))

    done = stored(ranged.mapInArrow(local, out))
    carried, before = {}, None
    for r in sorted(done.where("last").select("part", "conv_id", "pos", "a", "b").collect()):  # one row a task
        size, lanes = r["pos"] + 1, [r["a"] % 2**64, r["b"] % 2**64]
        if before and before[0] == r["conv_id"]:
            carried[r["part"]] = before
            lanes = [(x + pow(int(g), before[1], 2**64) * y) % 2**64 for x, y, g in zip(before[2], lanes, RADIX, strict=True)]
            size += before[1]
        elif before:
            carried[r["part"]] = before
        before = (r["conv_id"], size, lanes)
    carried = rows.sparkSession.sparkContext.broadcast(carried)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, part, pos = (batch.column(c).to_numpy() for c in ("conv_id", "part", "pos"))
            keys, pos = [batch.column(c).to_numpy().astype(np.uint64) for c in "ab"], pos.copy()
            for p in np.unique(part).tolist():
                if p in carried.value:
                    conv, size, lanes = carried.value[p]
                    own = (part == p) & (ids == conv)
                    pos[own] += size
                    for lane, radix in enumerate(RADIX):
                        keys[lane][own] = keys[lane][own] * np.uint64(pow(int(radix), size, 2**64)) + np.uint64(lanes[lane])
            value = values(batch.column("turn"))
            befores = [k - v * power(r, pos) for k, v, r in zip(keys, value, RADIX, strict=True)]
            arrays = [batch.column("conv_id"), pa.array(pos), batch.column("turn"), batch.column("chars"), *(pa.array(k.view(np.int64)) for k in keys + befores)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "pos", "turn", "chars", "a", "b", "pa", "pb"])

    return done.mapInArrow(settled, "conv_id long, pos long, turn binary, chars long, a long, b long, pa long, pb long")


def sequences(ends: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id, n, ends_sha256): each distinct whole sequence of ``ends`` (conv_id, depth, a, b).

    conv_id is the smallest of its conversations, ``n`` their number, and ends_sha256 the
    SHA-256 of their ids in order. Rows are ranged by sequence and id; only the first and
    the last sequence of a task can go on in another, and send their ids in pieces.
    """
    kept = "depth long, a long, b long, conv_id long, n long, ends_sha256 string"
    out = f"{kept}, part int, piece int, ids string"
    order = ["depth", "a", "b", "conv_id"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(key, ids) of sorted rows, at most PIECE ids of one key at once."""
        for batch in batches:
            keys, ids, lo = list(zip(*(batch.column(c).to_pylist() for c in order[:3]), strict=True)), batch.column("conv_id").to_pylist(), 0
            while lo < len(ids):
                hi = lo + 1
                while hi < len(ids) and keys[hi] == keys[lo] and hi - lo < PIECE:
                    hi += 1
                yield keys[lo], ids[lo:hi]
                lo = hi

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, pieces, ready, first = TaskContext.get().partitionId(), None, [], [], True

        def closed(edge: bool) -> list[tuple]:
            if edge:
                return [(*key, least, n, None, part, i, ids) for i, (least, n, ids) in enumerate(pieces)]
            whole = ",".join(ids for _, _, ids in pieces)
            return [(*key, pieces[0][0], sum(n for _, n, _ in pieces), hashlib.sha256(whole.encode()).hexdigest(), None, None, None)]

        for k, ids in runs(batches):
            if k != key:
                if key is not None:
                    ready += closed(first)
                    first = False
                key, pieces = k, []
            pieces.append((ids[0], len(ids), ",".join(map(str, ids))))
            if len(ready) >= 5000:
                yield batch_of(ready, out)
                ready = []
        if key is not None:
            yield batch_of(ready + closed(True), out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = {}  # of the sequences at the edges of tasks, a few of them in each task here
        for batch in batches:
            for r in batch.to_pylist():
                own = digests.setdefault((r["depth"], r["a"], r["b"]), [r["conv_id"], 0, hashlib.sha256()])
                own[2].update(f"{',' if own[1] else ''}{r['ids']}".encode())
                own[1] += r["n"]
        yield batch_of([(*k, least, n, digest.hexdigest()) for k, (least, n, digest) in digests.items()], kept)

    found = cut(ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(listed, out))
    names = [c.split()[0] for c in kept.split(", ")]
    edges = found.where("ids IS NOT NULL").repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "part", "piece")
    return found.where("ids IS NULL").select(*names).unionByName(edges.mapInArrow(joined, kept))


NODE = "depth long, a long, b long, pa long, pb long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, is_cut boolean"


def shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of a shard's sequences (conv_id, pos, turn, chars, a, b, pa, pb, n, depth, ends_sha256), from their cuts down.

    Rows of a sequence start at its cut. A cut's subtree is whole here; the conversation above it is found later.
    """
    col = {c: rows.column(c).to_numpy() for c in ("conv_id", "pos", "chars", "a", "b", "pa", "pb", "n", "depth")}
    order = np.lexsort((col["pos"], col["conv_id"]))
    col = {c: v[order] for c, v in col.items()}
    first = np.append(True, col["conv_id"][1:] != col["conv_id"][:-1])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(order)))
    level = np.arange(len(order)) - np.repeat(starts, sizes)
    # dense ids: turns in the order of their depth, so that siblings lie close; a cut is a symbol of its own
    halves = values(rows.column("turn").combine_chunks())[:, order]
    symbols = np.stack([np.where(first, col["a"].view(np.uint64), halves[0]), np.where(first, col["b"].view(np.uint64), halves[1]), np.where(first, col["pos"], -1).astype(np.uint64)], 1)
    _, at, codes = np.unique(symbols, axis=0, return_index=True, return_inverse=True)
    place = np.empty(len(at), np.int64)
    place[np.lexsort((at, level[at]))] = np.arange(len(at))
    codes = place[codes.ravel()]
    trie = DoubleArray.packed(codes, starts, sizes)

    slots = np.zeros(len(order), np.int64)
    for k in range(int(sizes.max())):
        on = starts[sizes > k] + k
        slots[on] = trie.walk(slots[on - 1] if k else np.zeros(len(on), np.int64), codes[on])
    n, least = np.zeros(trie.end, np.int64), np.full(trie.end, np.iinfo(np.int64).max)
    np.add.at(n, slots, col["n"])
    np.minimum.at(least, slots, col["conv_id"])
    nodes, row = np.unique(slots, return_index=True)
    parent = np.full(trie.end, 0, np.int64)
    parent[nodes] = trie.check[nodes]
    saved, depth = np.zeros(trie.end, np.int64), np.zeros(trie.end, np.int64)
    saved[nodes], depth[nodes] = (n[nodes] - 1) * col["chars"][row], level[row] + 1
    children = np.bincount(parent[nodes], minlength=trie.end)
    leaves = (children == 0).astype(np.int64)
    deepest = nodes[np.argsort(-depth[nodes], kind="stable")]
    for same in np.split(deepest, np.flatnonzero(np.diff(depth[deepest])) + 1):
        np.add.at(leaves, parent[same], leaves[same])
        np.add.at(saved, parent[same], saved[same])
    is_cut = depth[nodes] == 1
    sha = np.full(trie.end, NOTHING, object)
    last = starts + sizes - 1
    sha[slots[last]] = np.array(rows.column("ends_sha256").to_pylist(), object)[order[last]]
    columns = [col[c][row] for c in ("pos", "a", "b", "pa", "pb")] + [least[nodes]]
    columns = [pa.array(c) for c in columns] + [pa.array(least[parent[nodes]], mask=is_cut)]
    return pa.table([*columns, *(pa.array(c[nodes]) for c in (n, children, leaves, saved)), pa.array(sha[nodes], pa.string()), pa.array(is_cut)], names=[c.split()[0] for c in NODE.split(", ")])


def upper_nodes(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The nodes above the cuts, from ``rows`` of sequences (pos, a, b, pa, pb, chars, n, conv_id, ends_sha256 at a sequence's end) and the ``cuts`` under them."""
    key = ["depth", "a", "b"]
    own = rows.withColumn("depth", F.col("pos")).groupBy(*key).agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.max("chars").alias("chars"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"))
    own = stored(own.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))))
    under = (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")
    links = cuts.select(*under, F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    links = links.unionByName(own.where("depth > 0").select(*under, F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    below = links.groupBy(*key).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    some = lambda c: F.coalesce(c, F.lit(0))
    nodes = stored(
        own.join(below, key, "left").select(
            *own.columns,
            some("n_children").alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + some("saved")).alias("saved_tokens"),
        )
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = nodes.select(*key, "n_leaves", "saved_tokens", F.when(F.col("depth") > 0, F.struct(*under)).alias("up"))
    reach = 1
    while reach <= deepest:  # after each step: sums over the nearest 2 * reach levels, and the ancestor so far up
        lower = sums.where("up IS NOT NULL").select("up.*", "n_leaves", "saved_tokens").groupBy(*key).agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("more_saved"))
        far = sums.select(F.struct(*key).alias("up"), F.col("up").alias("next"))
        sums = sums.join(lower, key, "left").join(far, "up", "left")
        sums = stored(sums.select(*key, (F.col("n_leaves") + some("more")).alias("n_leaves"), (F.col("saved_tokens") + some("more_saved")).alias("saved_tokens"), F.col("next").alias("up")))
        reach *= 2
    nodes = nodes.drop("n_leaves", "saved_tokens").join(sums.drop("up"), key)
    nodes = nodes.withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("is_cut", F.lit(False))
    return nodes.select(*(c.split()[0] for c in NODE.split(", ")))


def rebuilt(turns: DataFrame, bases: int = BASES, carry: int = CARRY) -> DataFrame:
    """(conv_id, src, pos, turn, chars): every conversation's rebuilt turns, in the order of src and pos; and a row before them all."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("at"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    own = running(rows, [F.col("at").asc_nulls_first(), F.col("turn"), F.col("row")]).select("conv_id", "pos", "turn", "chars")
    carried = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(carry))
    convs = own.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % bases).withColumn("h", carried)
    heads = own.where((F.col("conv_id") % bases == 0) & (F.col("pos") < carry - 1)).select(F.col("conv_id").alias("base"), "pos", "turn", "chars")
    first = convs.join(heads, "base").where("pos < h").select("conv_id", F.lit(0).alias("src"), "pos", "turn", "chars")
    rest = own.where(F.col("pos") >= carried).select("conv_id", F.lit(1).alias("src"), "pos", "turn", "chars")
    top = convs.select("conv_id", F.lit(-1).alias("src"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("chars"))
    return top.unionByName(first).unionByName(rest)


def prefix_trie(turns: DataFrame, bases: int = BASES, carry: int = CARRY, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations of ``turns`` (conv_id, turn, role, text): a row for each.

    A conversation c is rebuilt from the first h turns of conversation c - c % ``bases``
    (h: crc32 of its decimal id, modulo ``carry``) and its own after the first h. Turns
    stand in the order of turn, nulls first; those of equal number in that of the MD5 of
    role and text; repeated rows are turns of their own. Turns are equal whose role and
    text are; a null role or text is an empty one. conv_id names a node by its smallest
    member. Rows without conv_id are of no conversation and take no part. Other columns
    are not looked at, whatever their names; an empty table has no nodes, not even a top.
    Exact but for collisions of 128-bit hashes.
    """
    rows = stored(running(rebuilt(turns, bases, carry), [F.col("src"), F.col("pos")]))
    whole = rows.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("end")).select("conv_id", F.col("end.pos").alias("depth"), "end.a", "end.b")
    reps = stored(sequences(whole)).select("conv_id", "depth", "n", "ends_sha256", F.col("a").alias("ea"), F.col("b").alias("eb"))

    marks = rows.where("pos > 0 AND (pos & (pos - 1)) = 0").join(reps.select("conv_id", "depth"), "conv_id").select("conv_id", "pos", "a", "b", "depth")
    marks = stored(marks)
    turns = rows.count()
    most = max(1, min(shard_turns, turns // SHARDS))
    heavy = marks.groupBy("pos", "a", "b").agg(F.sum("depth").alias("turns")).where(F.col("turns") > most).drop("turns")
    above = marks.join(heavy, ["pos", "a", "b"], "left_semi").groupBy("conv_id").agg(F.count("*").alias("marks"))
    level = F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce("marks", F.lit(0)).cast("int"))
    plan = reps.join(above, "conv_id", "left").withColumn("level", level).drop("marks")
    at = marks.select("conv_id", F.col("pos").alias("level"), "a", "b")
    shards = max(SHARDS, -(-turns // shard_turns))
    plan = plan.join(at, ["conv_id", "level"], "left").withColumn("shard", F.pmod(F.xxhash64("level", "a", "b"), F.lit(shards)).cast("int")).drop("a", "b", "ea", "eb")
    paths = rows.join(plan, "conv_id")
    paths = stored(paths.withColumn("ends_sha256", F.when(F.col("pos") == F.col("depth"), F.col("ends_sha256"))))

    below = paths.where("pos >= level").drop("level")
    nodes = stored(below.groupBy("shard").applyInArrow(shard_nodes, NODE))
    upper = stored(upper_nodes(paths.where("pos < level"), nodes.where("is_cut")))
    parents = upper.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    outer = nodes.where("is_cut").unionByName(upper).join(parents, ["depth", "pa", "pb"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("above")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where("NOT is_cut").select(*columns).unionByName(outer.select(*columns))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = """
WITH r AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda crc, byte: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
    4294967295::BIGINT)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM r)
), b AS (
  SELECT c.conv_id, 0 AS src, r.pos, r.t, r.text FROM c JOIN r ON r.conv_id = c.base AND r.pos < c.h
  UNION ALL SELECT c.conv_id, 1, r.pos, r.t, r.text FROM c JOIN r ON r.conv_id = c.conv_id AND r.pos >= c.h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY src, pos) AS depth, t, length(text) AS chars FROM b
), p AS (
  SELECT conv_id, depth, chars, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY k, depth
), e AS (
  SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k
), u AS (
  SELECT left(k, 32 * (depth - 1)::INT) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), d AS (
  SELECT p.k, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (u.k IS NULL) AS leaves
  FROM n LEFT JOIN u USING (k) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.k
)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN up.conv_id END AS parent_conv_id, n.n_convs, coalesce(u.n_children, 0)::BIGINT AS n_children,
  d.leaves::BIGINT AS n_leaves, d.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n LEFT JOIN n up ON n.depth > 0 AND up.k = left(n.k, 32 * (n.depth - 1)::INT) LEFT JOIN u ON u.k = n.k JOIN d ON d.k = n.k LEFT JOIN e ON e.k = n.k
"""
