"""The operators against brute-force versions on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import ann, bpe, chat, langid, line_dedup, mixing, ngram_join, quality_pu, quality_rules, rlz

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def corpus(seed=1):
    """About 140 documents: unique ones, copies, near copies, shared lines and passages, and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line, passage = prose(12), prose(50)
    texts = [prose(rng.randint(1, 150)) for _ in range(50)]
    texts += [texts[3]] * 6 + [f"{prose(rng.randint(5, 60))}\n  {line.upper() if i % 2 else line}\t\n{prose(8)}" for i in range(20)]
    texts += [f"{prose(rng.randint(0, 40))} {passage} {prose(rng.randint(0, 40))}" for _ in range(12)]
    base = prose(200).split()
    for _ in range(30):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [None, "", " \n\t ", "\n\n", "one", "a a a a a a a a a a a", "x y z " * 40, "漢字 かな 😀 😀 😀", prose(6000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[60]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_minimal_perfect_hash_is_a_bijection():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    place = line_dedup.MinimalPerfectHash(*line_dedup.MinimalPerfectHash.build(keys))
    assert sorted(place(keys)) == list(range(len(np.unique(keys))))
    assert len(line_dedup.MinimalPerfectHash(*line_dedup.MinimalPerfectHash.build(keys[:0]))(keys)) == len(keys)


def test_line_dedup(docs, empty, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "COPY_PROBES", 8)
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text, *_ in corpus():
        for x in (text or "").split("\n"):
            holders[low(x)].add(i)
    found = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("old")), 40, 5)
    rows = found.collect()
    assert len(rows) == len(corpus()) and any(r.n_dropped for r in rows)
    text_of = {i: t for i, t, *_ in corpus()}
    for r in rows:
        lines = (text_of[r.doc_id] or "").split("\n")
        kept = [x for x in lines if not (len(low(x)) >= 40 and len(holders[low(x)]) >= 5 and r.doc_id != max(holders[low(x)]))]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_nearest_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.normal(size=(600, 16))]
    vectors[:40] = [vectors[0]] * 40  # more equal vectors than are asked for
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] + [1.0] * 15), (1300, [None] + [1.0] * 15), (1400, [1.0] * 5), (None, [1.0] * 16), rows[7]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("old"))
    found = ann.nearest(frame, frame.where("vec_id % 20 = 0")).collect()
    x, hits = np.array(vectors), []
    for q in range(0, 600, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id]) for r in own)
        hits.append(len(set(best) & {r.vec_id for r in own}) / 10)
        if q < 40:
            assert [r.vec_id for r in own] == [i for i in range(11) if i != q][:10]
    assert np.mean(hits) >= 0.9 and {r.query_id for r in found} == set(range(0, 600, 20))
    few = frame.where("vec_id < 3")
    assert ann.nearest(few, few).count() == 6
    assert ann.nearest(frame.where("false"), frame).count() == 0


def test_quality_scores_hold_out_a_third(spark):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)) + "."
    bad = lambda: "BUY!! NOW$$$ " * rng.randint(20, 60)
    rows = [(i, good() if i % 3 else bad()) for i in range(900)] + [(5000, None), (5001, ""), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 900, 2)], "doc_id long, quality int")
    found = quality_pu.score_quality(frame, labels).collect()
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert 200 < len(held) < 400 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found) and len(found) == len(rows)
    one = {r.doc_id: r.score for r in found}
    assert one[5000] == one[5001]
    none = quality_pu.score_quality(frame, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_pu.score_quality(frame.where("false"), labels).count() == 0


def brute_targets(sizes):
    """Targets by resharing until none is above its stop."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, empty):
    found = mixing.mix_sources(docs.withColumn("target", F.lit("old"))).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in corpus():
        sizes[source] += len(words(text))
    target, taken = brute_targets(sizes), defaultdict(int)
    for r in found:
        assert (r["size"], r.source_size) == (len(words(r.text)), sizes[r.source])
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(found) == len(corpus()) and all(taken[s] == int(target[s] + 1e-6) for s in sizes)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)
    out = mixing.take(mixing.mix_sources(docs)).collect()
    assert sum(len(words(r.text)) for r in out) == sum(taken.values()) and out[0].asDict().keys() == set(docs.columns)
    assert mixing.mix_sources(empty).count() == 0


def brute_components(rows, n, percent):
    sets = {}
    for i, text, *_ in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n, percent, group, part, block", [(4, 85, 8, 100_000, 4_000_000), (5, 80, 2, 100_000, 12_000), (2, 60, 3, 7, 6_000), (3, 70, 1, 3, 20_000)])
def test_ngram_join(docs, empty, monkeypatch, n, percent, group, part, block):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "PART_ROWS", part)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    wanted = brute_components(corpus(), n, percent)
    found = ngram_join.ngram_components(docs, n, percent).collect()
    assert len(found) == len(corpus())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert len({c for _, c in wanted.values()}) < len(wanted) - 10
    assert ngram_join.ngram_components(empty, n, percent).count() == 0


def test_near_duplicates_leave_one_of_each_group(docs):
    wanted = {c for _, c in brute_components(corpus(), 5, 80).values()}
    assert {r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()} == wanted


def test_texts_do_not_meet_by_their_short_words(spark):
    rng = np.random.default_rng(4)
    short = [" ".join(rng.choice(["of", "to", "the", "and"], 150)) for _ in range(24)]
    texts = [t + " " + " ".join(f"extraordinary{i}x{j}" for j in range(40)) for i, t in enumerate(short)]
    docs = ngram_join.texts_of(spark.createDataFrame([*enumerate(texts), (24, texts[7] + " again")], "doc_id long, text string"))
    orders = spark.sparkContext.broadcast(ngram_join.common_grams(docs, 4, 85))
    met = ngram_join.meetings(docs, orders, 4, 85).where(F.col("kind") >= ngram_join.PAIR)
    assert met.select("a", "b").distinct().count() == 1


def test_only_texts_asked_for_are_read_again(spark):
    docs = ngram_join.texts_of(spark.createDataFrame([(i, f"text {i}") for i in range(5000)], "doc_id long, text string"))
    wanted = docs.where("doc_id % 50 = 7").select(ngram_join.ROW)
    found = {r.doc_id for r in ngram_join.among(docs, wanted).collect()}
    assert set(range(7, 5000, 50)) <= found and len(found) < 200
    assert ngram_join.among(docs, wanted.limit(0)).count() == 0


def test_any_order_has_the_prefix_of_similar_sets():
    rng = np.random.default_rng(2)
    by = ngram_join.Orders(np.arange(20, dtype=np.uint64), np.arange(20, 0, -1))
    for _ in range(200):
        a = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
        b = np.unique(np.append(rng.choice(a, len(a) - 5, replace=False), rng.integers(200, 210, 3).astype(np.uint64)))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert all(set(by.prefix(a, o, 80)) & set(by.prefix(b, o, 80)) for o in range(3))


def test_byte_bpe_as_the_ranks_say(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    rows = bpe.round_trip(docs).collect()
    text_of = {i: t or "" for i, t, *_ in corpus()}
    assert len(rows) == len(corpus())
    for r in rows:
        assert r.ids == own.encode_ordinary(text_of[r.doc_id]) and bytes(r.decoded) == text_of[r.doc_id].encode()
    assert bpe.round_trip(empty).count() == 0


def test_byte_bpe_remembers_a_bounded_number_of_pieces():
    """Idle workers keep what they remember, so many different words must not fill them."""
    ranks = bpe.read_ranks(bpe.RANKS)
    codec, most = bpe.Codec(ranks, bpe.merges_of(ranks)), 0
    for k in range(8):
        text = " ".join(f"w{k}x{i}" for i in range(40_000))
        assert codec.decode(codec.encode([text])[0]).decode() == text
        most = max(most, len(codec.known))
    assert most <= 250_000


def test_byte_bpe_on_odd_texts():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    ranks = bpe.read_ranks(bpe.RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, bpe.merges_of(ranks)), random.Random(4)
    bits = [" ", "  ", "\n", "\t", " ", " ", "\x85", "'s", "a", "Z.", "é", "1", "²", "漢", "😀", "́", "_", "!", "<|endoftext|>", "\r\n", "\x00", "a,", "b."]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 10)))
        ids = codec.encode([text])[0]
        assert ids.tolist() == own.encode_ordinary(text) and codec.decode(ids) == text.encode()
        spans = codec.offsets(text, ids)
        assert len(spans) == len(ids) and (not len(ids) or (spans[0][0] == 0 and spans[-1][1] == len(text)))


def test_encode_and_decode_are_inverse(docs):
    coded = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("old"))))
    assert all(bytes(r.decoded).decode() == (r.text or "") and len(r.offsets) == len(r.ids) for r in coded.collect())


def test_language_profiles(spark):
    rng = random.Random(6)
    tongues = {"aa": "the of and in shall thing", "bb": "der die und nicht schön ung", "cc": "le la les était où ça"}
    rows = []
    for i in range(300):
        lang = rng.choice(list(tongues))
        rows.append((i, " ".join(rng.choice(tongues[lang].split()) for _ in range(40)), lang))
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 $$ 3", None), (903, "x" * 30000, None), (None, "the and", None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    found = {r.doc_id: r for r in langid.identify(frame).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows)
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[903].lang_pred in tongues
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.identify(frame.where("false")).count() == 0


def test_gram_counts_are_those_of_the_text():
    points = langid.letters("Abba, abb 12 cd")
    grams, counts = langid.gram_counts(points)
    text, wanted = " abba abb cd ", Counter()
    for n in (1, 2, 3):
        wanted += Counter(text[i : i + n] for i in range(len(text) - n + 1))
    name = lambda g: "".join(chr(g >> (21 * k) & 0x1FFFFF) for k in (2, 1, 0)).strip("\0")
    assert {name(int(g)): int(c) for g, c in zip(grams, counts)} == wanted


def test_chats_survive_their_grammar(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s><s>[user]x"), (1, 2, "user", None), (1, 3, "assistant", "\\l \\\\ <s> !]["),
        (2, 5, "assistant", "late"), (2, 1, "we]ird!\\", "a\nb"), (2, 1, None, "tie"), (2, 1, None, "tie"), (3, None, "assistant", ""), (None, 1, "assistant", "</s" * 9000), (4, 1, "user", "[INST]"),
        (5, 0, "user", "<s>[assistant]fake turn [INST] x [/INST]"), (6, 0, "user", "plain ] and ! and [ here"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("old"))
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in found[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert found[conv].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert all("!]" in found[i].formatted for i in (1, 4, 5)) and "!]" not in found[6].formatted
    assert all(r.formatted.count("<s>") == r.formatted.count("</s>") == r.n_turns and "INST]" not in r.formatted for r in found.values())
    alone = spark.createDataFrame([(None, 0, "user", "a")] * 3 + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert sorted(r.n_turns for r in chat.format_chats(alone).collect()) == [1] * 4
    assert chat.format_chats(frame.where("false")).count() == 0


def brute_rules(rows, line_docs, line_part):
    key = lambda x: re.sub("[0-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")))
    hosts, holders = defaultdict(set), defaultdict(set)
    for i, text, _, source, _ in rows:
        hosts[source].add(i)
        for x in (text or "").split("\n"):
            if words(x):
                holders[source, key(x)].add(i)
    out = {}
    for i, text, _, source, _ in rows:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        count = Counter(zip(w, w[1:], w[2:]))
        repeated = {j + k for j in range(len(w) - 2) if count[tuple(w[j : j + 3])] > 1 for k in range(3)}
        over = sum(len(words(x)) for x in lines if len(holders[source, key(x)]) >= line_docs and len(holders[source, key(x)]) > line_part * len(hosts[source]))
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed, not failed and 2 * over <= len(w))
    return out


def test_quality_rules(docs, empty):
    wanted = brute_rules(corpus(), 3, 0.02)
    found = quality_rules.quality_rules(docs.withColumn("kept", F.lit("old")), "source", 3, 0.02).collect()
    assert {r.doc_id: tuple(r[c] for c in (*quality_rules.COUNTS, "base_failed", "kept")) for r in found} == wanted
    assert len(found) == len(corpus()) and any(r.n_boilerplate for r in found)
    cleaned = quality_rules.clean(quality_rules.quality_rules(docs, "source", 3, 0.02)).collect()
    assert {r.doc_id for r in cleaned} == {i for i, w in wanted.items() if w[-1]}
    assert sum(len(words(r.text)) for r in cleaned) == sum(r.n_words - r.n_boilerplate for r in found if r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def brute_removed(rows, window):
    starts = defaultdict(list)
    for k, (_, text, *_) in enumerate(rows):
        w = words(text)
        for j in range(len(w) - window + 1):
            starts[tuple(w[j : j + window])].append((k, j))
    gone = defaultdict(set)
    for places in starts.values():
        if len(places) > 1:
            for k, j in places:
                gone[k] |= set(range(j, j + window))
    return gone


@pytest.mark.parametrize("window, anchor, runs", [(35, 8, 2000), (10, 3, 4), (4, 1, 1)])
def test_substring_dedup(docs, empty, monkeypatch, window, anchor, runs):
    monkeypatch.setattr(rlz, "BLOCK_RUNS", runs)
    rows = corpus()
    gone = brute_removed(rows, window)
    wanted = Counter((i, len(words(t)), len(gone[k]), sha(" ".join(w for j, w in enumerate(words(t)) if j not in gone[k]))) for k, (i, t, *_) in enumerate(rows))
    found = rlz.dedup_substrings(docs.withColumn("spans", F.lit("old")), window, anchor).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, sha(r.text)) for r in found) == wanted and sum(r.n_removed for r in found) > 1000
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in found)
    assert rlz.dedup_substrings(empty).count() == 0


def test_factors_are_the_longest_matches():
    rng = np.random.default_rng(1)
    for _ in range(150):
        runs = int(rng.integers(1, 6))
        lengths = rng.integers(1, 25, runs)
        run, block = np.repeat(np.arange(runs), lengths), np.repeat(np.sort(rng.integers(0, 3, runs)), lengths)
        words = rng.integers(0, rng.choice([1, 2, 3, 10]), len(run)).astype(np.uint64)
        ends = np.repeat(np.cumsum(lengths), lengths)

        def common(i, j):
            k = 0
            while i + k < ends[i] and j + k < ends[j] and words[i + k] == words[j + k]:
                k += 1
            return k

        wanted = [max((common(i, j) for j in range(len(words)) if i != j and block[i] == block[j]), default=0) for i in range(len(words))]
        index = rlz.Suffixes(words, run, block)
        found, place = index.longest(np.arange(len(words)))
        assert found.tolist() == wanted
        assert all(not n or (p != i and block[p] == block[i] and common(i, p) == n) for i, (n, p) in enumerate(zip(wanted, place.tolist(), strict=True)))
        at, factors = 0, []
        while at < len(words):
            factors.append((at, max(wanted[at], 1)))
            at += factors[-1][1]
        starts, sizes, sources = rlz.greedy_factors(index)
        assert list(zip(starts.tolist(), sizes.tolist(), strict=True)) == factors
        assert all((p < 0) == (wanted[s] == 0) and (p < 0 or common(s, p) == n) for s, n, p in zip(starts.tolist(), sizes.tolist(), sources.tolist(), strict=True))
        for window in (1, 3, 6):
            assert rlz.duplicate_windows(index, window).tolist() == [n >= window for n in wanted]


def test_windows_come_from_factors(monkeypatch):
    words = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 8], np.uint64)
    index = rlz.Suffixes(words, np.repeat([0, 1], 6), np.zeros(12, int))
    assert np.flatnonzero(rlz.duplicate_windows(index, 3)).tolist() == [0, 1, 2, 6, 7, 8]
    monkeypatch.setattr(rlz, "greedy_factors", lambda index: (np.arange(12), np.ones(12, int), np.full(12, -1)))
    assert not rlz.duplicate_windows(index, 3).any()


def test_quantised_search_finds_neighbours_among_few_candidates(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(frame, frame.where("vec_id % 100 = 0"), candidates=60).collect()  # 1.5 % of the rows
    hits = []
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits.append(len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in found if r.query_id == q}) / 10)
    assert np.mean(hits) >= 0.9


def test_the_risk_and_its_gradient():
    rng = np.random.default_rng(2)
    p, u, w = rng.normal(1, 1, (50, 4)), rng.normal(0, 1, (80, 4)), rng.normal(size=4)
    good, bad, up, down = quality_pu.unbiased_risk(w, p, u, 0.4)
    loss = lambda f: float(np.mean([np.log(1 + np.exp(-v)) for v in f]))
    assert good == pytest.approx(0.4 * loss(p @ w)) and bad == pytest.approx(loss(-(u @ w)) - 0.4 * loss(-(p @ w)))
    for i in range(4):
        step = np.zeros(4)
        step[i] = 1e-6
        more = quality_pu.unbiased_risk(w + step, p, u, 0.4)
        assert (more[0] - good) / 1e-6 == pytest.approx(up[i], abs=1e-4) and (more[1] - bad) / 1e-6 == pytest.approx(down[i], abs=1e-4)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_the_class_prior_is_found(prior):
    rng = np.random.default_rng(8)
    rows = lambda n, share: np.column_stack([np.where(rng.random(n) < share, rng.normal(2.5, 1, n), rng.normal(-2.5, 1, n)), np.ones(n)])
    assert abs(quality_pu.class_prior(rows(3000, 1), rows(6000, prior)) - prior) < 0.12


def test_quality_scores_as_summed_by_hand(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d1", "e$", "f."]) for _ in range(rng.randint(0, 60))) + "\n" * (i % 3) for i in range(300)] + ["long word " * 30000, "", "漢字 é"]
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("GAMMA" not in t)) for i, t in rows], "doc_id long, quality int")
    edges, weights, _ = quality_pu.learn(frame, labels)
    found = quality_pu.score_quality(frame, labels).collect()

    def by_hand(text):
        total, start = weights[-1], 0
        for value, own in zip(quality_pu.statistics(text), edges, strict=True):
            total += weights[start + sum(e <= value for e in own)]
            start += len(own) + 1
        return 1 / (1 + np.exp(-total))

    assert len(found) == len(rows) + 2 and all(r.score == pytest.approx(by_hand(texts[r.doc_id]), abs=1e-9) for r in found)
    assert len({r.score for r in found if r.doc_id == 3}) == 1 and len({round(r.score, 6) for r in found}) > 5


def test_languages_by_distances_counted_by_hand(spark):
    rng = random.Random(12)
    tongues = {"aa": "the of and in shall thing", "bb": "der die und nicht schön ung", "cc": "le la les était où ça", "dd": "der die und nicht schön ung"}
    rows = [(i, " ".join(rng.choice(tongues[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000 + i, text, "dd") for i, text, lang in rows if lang == "bb"]
    mixed = [(5000 + i, " ".join(rng.choice(tongues[rng.choice("abc") * 2].split()) for _ in range(8)) + " 12!", None) for i in range(60)]
    frame = spark.createDataFrame([*rows, *mixed, mixed[0]], "doc_id long, text string, lang string")
    names, lists = langid.learn(frame)

    name = lambda g: "".join(chr(int(g) >> (21 * k) & 0x1FFFFF) for k in (2, 1, 0)).strip("\0")

    def ranked(text):
        text = " " + " ".join(re.sub(r"[\W\d_]+", " ", text.lower()).split()) + " "
        counts = Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][: langid.PROFILE]

    profiles = [[name(g) for g in x] for x in lists]
    for r in langid.identify(frame).collect():
        own = ranked(r.text)
        assert len(own) < langid.PROFILE
        far = [sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for p in profiles]
        best = names[min(range(len(far)), key=far.__getitem__)]
        assert (r.lang_pred, round(r.score, 9)) == (best, round(1 - min(far) / (langid.PROFILE * len(own)), 9))


def test_parities_never_set_sets_too_far_apart():
    rng = np.random.default_rng(13)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 700).astype(np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 500)))
        b = np.unique(np.append(rng.choice(a, rng.integers(1, len(a) + 1)), rng.choice(pool, rng.integers(0, 60))))
        found = ngram_join.apart_at_least(ngram_join.parities(a), ngram_join.parities(b))
        assert 0 <= found <= len(np.setxor1d(a, b)) and ngram_join.apart_at_least(ngram_join.parities(a), ngram_join.parities(a)) == 0
