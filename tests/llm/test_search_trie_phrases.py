"""Exact top-k, the prefix trie and collocations against brute force: nulls, ties, repeats, hot keys, very long rows, clashing names, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import collocations, topk, trie

EMBEDDINGS = "vec_id long, embedding array<double>"


def best_by_hand(rows, queries, k, scale=1024):
    whole = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x * scale) for x in v):
            continue
        whole[i] = max(whole.get(i, v), v)
    whole = {i: [math.floor(scale * x) for x in v] for i, v in whole.items()}
    out = []
    for q in queries:
        if q in whole:
            scores = [(-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("slack", [64, 10])
def test_top_k_equals_brute_force(spark, monkeypatch, slack):
    monkeypatch.setattr(topk, "SLACK", slack)
    monkeypatch.setattr(topk, "CHUNK", 37)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 1024]) for i in range(300)]
    rows += [(i, [0.5, -0.25, 1e-20, -1e-20, 0.0, 1.0]) for i in range(1000, 1200)]  # one vector that many hold
    rows += [(2000, [0.0] * 6), (2010, None), (2020, []), (2030, [None] * 6), (2040, [float("nan")] * 6), (2050, [float("inf")] * 6), (2060, [1e308] * 6), (2070, [1.0] * 3), (2080, [2.0] * 3), (None, [1.0] * 6), (-10, [-1.0] * 6), rows[0], (0, [9.0] * 6)]
    frame = spark.createDataFrame(rows, EMBEDDINGS).withColumns({"score": F.lit("old"), "bits": F.lit("x")}).repartition(5)
    found = topk.top_k(frame, frame.where("vec_id % 10 = 0"))
    queries = {i for i, _ in rows if i is not None and i % 10 == 0}
    assert sorted(map(tuple, found.collect())) == best_by_hand(rows, queries, 10)
    assert topk.top_k(frame.where("false"), frame).count() == 0 and topk.top_k(frame, frame.where("false")).count() == 0
    few = frame.where("vec_id IN (3, 10, 11)")
    assert sorted(map(tuple, topk.top_k(few, few.where("vec_id = 10")).collect())) == best_by_hand([r for r in rows if r[0] in (3, 10, 11)], [10], 10)


def test_top_k_of_large_components(spark):
    rows = [(i, [float(2**21 + i), -float(2**22 - i), 3.0 * 2**20]) for i in range(40)]
    found = topk.top_k(spark.createDataFrame(rows, EMBEDDINGS), spark.createDataFrame(rows[:2], EMBEDDINGS), 5, 1 << 8)
    assert sorted(map(tuple, found.collect())) == best_by_hand(rows, [0, 1], 5, 1 << 8)


def nodes_by_hand(rows):
    def turn_key(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    members, children, text = defaultdict(list), defaultdict(set), {}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
            text[whole[c][:d]] = whole[c][d - 1][1] if d else ""
            if d:
                children[whole[c][: d - 1]].add(whole[c][:d])
    leaves, saved = Counter(), Counter()
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(text[node])
    ends = lambda node: ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
    return sorted(
        (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n in members
    )


def chats(seed=4):
    rng = random.Random(seed)
    texts = ["hi", "hello there", "é漢😀", "", "x" * 3000]
    rows = []
    for c in [*range(-30, 260), 10**15]:
        for t in range(rng.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(texts[: 2 + t % 4])))
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(60) for t in range(7)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(400)] + [(301, t, "user", f"long {t}") for t in range(390)]
    rows += [(400, None, None, None), (400, 1, "user", "b"), (400, 1, "user", "a"), (400, 1, "user", "a"), (400, None, "user", "z"), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    return rows


CHATS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_turns", [200_000, 20])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(trie, "SHARDS", 3 if shard_turns > 20 else 64)
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = chats()
    frame = spark.createDataFrame(rows, CHATS).withColumns({"pos": F.lit("old"), "depth": F.lit(1), "shard": F.lit("x")}).repartition(5)
    found = trie.prefix_trie(frame, shard_turns=shard_turns)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.select(*order).collect()), key=repr) == sorted(nodes_by_hand(rows), key=repr)
    assert trie.prefix_trie(frame.where("false")).count() == 0


def test_prefix_trie_sql_equals_brute_force(tmp_path):
    rows = [r for r in chats(5) if r[0] not in (300, 301)]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(db.sql(trie.SQL).fetchall(), key=repr) == sorted(nodes_by_hand(rows), key=repr)


def test_double_array_holds_every_sequence():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 9, 400)
    starts = np.cumsum(sizes) - sizes
    codes = rng.integers(0, 30, sizes.sum())
    packed = trie.DoubleArray.packed(codes, starts, sizes)
    slots = {}
    for lo, n in zip(starts, sizes, strict=True):
        at = np.zeros(1, np.int64)
        for i in range(n):
            at = packed.walk(at, codes[lo + i : lo + i + 1])
            assert slots.setdefault(tuple(codes[lo : lo + i + 1]), int(at[0])) == int(at[0])
    assert len(set(slots.values())) == len(slots) and packed.end < 2 * len(slots) + 64


def phrases_by_hand(rows, first, least, covered=80):
    counts = Counter()
    for lang, text, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang if lang is not None else "und", tuple(ws[i : i + n])) for n in range(1, 5) for i in range(len(ws) - n + 1))
    size = Counter()
    for (lang, p), a in counts.items():
        size[lang] += a if len(p) == 1 else 0
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    over = Counter()
    for (lang, p), a in often.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                over[lang, p[i : i + n]] = max(over[lang, p[i : i + n]], a)
    out = defaultdict(list)
    for (lang, p), a in often.items():
        score, _, l, r = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        if 100 * over[lang, p] < covered * a:
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, n, p.decode(), -a, l, r, size[lang], -s) for lang, ps in out.items() for n, (s, a, p, l, r) in enumerate(sorted(ps)[:first], 1))


def prose(seed=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé漢") for _ in range(rng.randint(1, 4))) for _ in range(40)] + ["w" * 3000]
    rows = []
    for i in range(300):
        ws = [rng.choice(vocabulary[: rng.choice([5, 15, 41])]) for _ in range(rng.randint(0, 60))]
        ws = [w.upper() if w.isascii() and rng.random() < 0.2 else w for w in ws]
        text = "".join(w + rng.choice([" "] * 12 + ["\t", ", ", ".", "\n", "!\r\n", "\x0b", "  "]) for w in ws)
        rows.append((rng.choice(["en", "en", "en", "fr", None, ""]), text + rng.choice(["", " new york city hall", " New York. City"])))
    return [*rows, ("en", None), ("en", ""), (None, " \t"), ("de", "..,"), ("en", "a b " * 3000), *rows[:20]]


@pytest.mark.parametrize(("burst", "entries"), [(4096, 400_000), (3, 40)])
def test_collocations_equal_brute_force(spark, monkeypatch, burst, entries):
    made = collocations.HatTrie
    monkeypatch.setattr(collocations, "HatTrie", lambda: made(burst, entries))
    monkeypatch.setattr(collocations, "NAMES", 10_000 if burst == 3 else 64_000_000)
    rows = prose()
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({"key": F.lit(1), "a": F.lit("old"), "word": F.lit("x")}).repartition(4)
    for first, least in ((2000, 8), (5, 2)):
        assert sorted(map(tuple, collocations.collocations(frame, first, least).collect())) == phrases_by_hand(rows, first, least)
    assert collocations.collocations(frame.where("false")).count() == 0
    assert collocations.collocations(frame.where("lang = 'de'")).count() == 0


def test_hat_trie_counts_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    tree, want, got, firsts = collocations.HatTrie(burst=4, entries=50), Counter(), Counter(), {}
    for _ in range(60):
        keys = rng.integers(0, 5, (40, 2)).astype(np.uint64) << np.uint64(rng.choice([0, 56]))
        keys = np.unique(keys, axis=0)
        tree.add(keys, np.full(len(keys), 2), np.arange(len(keys)))
        for i, k in enumerate(map(tuple, keys.tolist())):
            want[k] += 2
            firsts.setdefault(k, i)
        if tree.full():
            gone = set()
            for run, n, first in tree.spill():
                run = list(map(tuple, run.tolist()))
                assert run == sorted(run) and [firsts.pop(k) for k in run] == first.tolist()
                got.update(dict(zip(run, n.tolist(), strict=True)))
                gone |= {k[0] >> 56 for k in run}
            assert tree.size() <= 25 and not gone & set(tree.root)
    assert any(isinstance(x, dict) for x in tree.root.values())
    for run, n, _ in tree.spill(True):
        got.update(dict(zip(map(tuple, run.tolist()), n.tolist(), strict=True)))
    assert got == want and tree.size() == 0


def test_filter_never_misses_a_key(spark):
    keys = [(bytes([i % 256, i // 256] + [0] * 6) + b"12345678",) for i in range(3000)]
    bits = collocations.bit_filter(spark.createDataFrame(keys, "key binary"))
    ids = np.frombuffer(b"".join(k for (k,) in keys), "<u8").reshape(-1, 2)
    assert collocations.held(bits, collocations.combined(ids)).all()
    assert collocations.held(bits, np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.1
