"""Shards, periodic runs and prefix tries against brute force and on odd rows."""

import hashlib
import random
import re
import time
import zlib

import pytest

from backflow.llm import runs, sharding, tries
from backflow.llm.common import checkpoint

TEXTS = "doc_id long, text string, size int, shard int, slot string, place long, at long"


def documents(spark, pairs):
    return spark.createDataFrame([(k, t, 3, 1, "x", 7, 8) for k, t in pairs], TEXTS)


# --- shards ---------------------------------------------------------------------------


def place_of(text):
    return int(hashlib.sha256((text or "").encode()).hexdigest()[:15], 16)


def plain_plan(pairs, shards):
    """(largest shard, place of each text -> shard), with all units in one list."""
    units = {}
    for _, t in pairs:
        units[place_of(t)] = units.get(place_of(t), 0) + len((t or "").encode()) + 16
    left, n, alone = sum(units.values()), shards, []
    for p, size in sorted(units.items(), key=lambda x: (-x[1], x[0])):
        if size * n <= left:
            break
        alone.append(p)
        left, n = left - size, n - 1
    light = sorted((p, s) for p, s in units.items() if p not in alone)

    def fill(capacity):
        out, shard, used = {}, 0, 0
        for p, s in light:
            if s > capacity:
                return None
            if used + s > capacity:
                shard, used = shard + 1, 0
            out[p], used = shard, used + s
        return out if shard < n else None

    capacity = next((c for c in range(-(-left // n), left + 1) if fill(c) is not None), 0)
    where = {p: k for k, p in enumerate(alone)} | {p: s + len(alone) for p, s in (fill(capacity) or {}).items()}
    return max([capacity, *(units[p] for p in alone)]), where


def many_texts(seed, rows, hot):
    r = random.Random(seed)
    texts = ["x" * r.choice([0, 1, 5, 30, 200, r.randrange(900)]) + str(r.randrange(rows // 2)) for _ in range(rows)]
    return [(k, "hot one" if r.random() < hot else None if r.random() < 0.02 else t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed,rows,hot,shards,cells", [(1, 400, 0.0, 40, 16), (2, 400, 0.33, 40, 8), (3, 300, 0.1, 7, 1 << 15), (4, 60, 0.5, 40, 4), (5, 200, 0.0, 3, 2)])
def test_shards_are_the_smallest_that_can_be(spark, seed, rows, hot, shards, cells):
    pairs = many_texts(seed, rows, hot)
    docs = documents(spark, pairs).repartition(5)
    largest, where = plain_plan(pairs, shards)
    plan = sharding.minimax_plan(sharding.stored(sharding.sized(docs)), shards, cells)
    assert plan.capacity == largest
    got = sharding.shard_slots(docs, shards, cells=cells).collect()
    texts = dict(pairs)
    assert len(got) == rows and all(r["shard"] == where[place_of(texts[r["doc_id"]])] for r in got)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)
    for s in set(where.values()):
        inside = sorted((r["slot"], place_of(texts[r["doc_id"]]), r["doc_id"]) for r in got if r["shard"] == s)
        assert [x[0] for x in inside] == list(range(len(inside))) and [x[1:] for x in inside] == sorted(x[1:] for x in inside)


def test_shards_of_odd_rows(spark):
    pairs = [(1, "a"), (1, "a"), (1, "a"), (None, "a"), (None, None), (2, ""), (3, None), (4, "é" * 50_000), (4, "b")]
    got = sharding.shard_slots(documents(spark, pairs), 4).collect()
    assert len(got) == len(pairs)
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"a")}) == 1 and len({r["shard"] for r in got if r["size"] == 16}) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert max(r["size"] for r in got) == 100_016
    assert sharding.shard_slots(documents(spark, []), 4).collect() == []
    same = sharding.shard_slots(documents(spark, [(5, "t")] * 900).repartition(3), 4).collect()
    assert {r["shard"] for r in same} == {0} and sorted(r["slot"] for r in same) == list(range(900))


def test_capacity_search_looks_at_few_cells(spark, monkeypatch):
    asked = []
    cells = sharding._cells
    monkeypatch.setattr(sharding, "_cells", lambda rows, shift: asked.append(cells(rows, shift)) or asked[-1])
    rows = sharding.stored(sharding.sized(spark.range(40_000).selectExpr("id AS doc_id", "repeat('ab', CAST(pmod(hash(id), 90) AS INT)) || id AS text")))
    plan = sharding.minimax_plan(rows, 10, 256)
    assert max(len(x) for x in asked) <= 512 and len(asked) <= 12
    sizes = sorted((r["place"], r["size"]) for r in rows.groupBy("place").agg({"size": "sum"}).withColumnRenamed("sum(size)", "size").collect())
    filled = [0]
    for _, s in sizes:
        filled = filled + [s] if filled[-1] + s > plan.capacity else filled[:-1] + [filled[-1] + s]
    assert len(filled) <= 10 and max(filled) == plan.capacity


def test_written_shards_hold_all_rows(spark, tmp_path):
    pairs = many_texts(9, 120, 0.3)
    docs = spark.createDataFrame(pairs, "doc_id long, text string").withColumnRenamed("doc_id", "at")
    plan = sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r["at"], r["text"]) for r in back.collect())) and back.count() == 120 and set(back.columns) == {"at", "text", "shard"}
    assert plan == sharding.minimax_plan(sharding.stored(sharding.sized(docs, "at")), 5)
    assert {(r["at"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in sharding.shard_slots(docs.withColumnRenamed("at", "doc_id"), 5).collect()}


# --- runs -----------------------------------------------------------------------------


def plain_runs(words, exponent=4, least=6):
    """Every period at every place; stretches that have a smaller period too go."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, exponent * q):
                found.append((s, i - s + q, q))
            i += i == s
    return sorted((r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)), key=lambda r: (r[0], r[2]))


def periodic_words(r, longest):
    words = [str(r.randrange(r.choice([1, 2, 3, 9]))) for _ in range(r.randrange(longest))]
    for _ in range(r.randrange(4)):
        part = [str(r.randrange(4)) for _ in range(r.randrange(1, 6))]
        at = r.randrange(len(words) + 1)
        words[at:at] = (part * 9)[: r.randrange(1, 9 * len(part) + 1)]
    return words


def test_runs_of_random_words():
    r = random.Random(11)
    for _ in range(1500):
        words = periodic_words(r, 50)
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        for exponent, least in ((4, 6), (3, 1), (5, 12)):
            assert runs.runs_of([numbers[w] for w in words], exponent, least) == plain_runs(words, exponent, least)


def plain_digests(doc_id, text):
    words = re.findall(runs.WORD, text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_query_against_brute_force(spark):
    r = random.Random(12)
    pairs = [(k, r.choice([" ", "\n", " \t "]).join(periodic_words(r, 90))) for k in range(250)]
    pairs += [(1000, None), (1001, ""), (1002, " \t\x0b "), (1003, "a " * 50), (1003, "a " * 50), (None, "b " * 9), (None, None), (1004, "é\xa0é é\xa0é " * 7), (1005, "x\x1cy " * 8), (1006, " lead " * 6), (1007, "A a " * 12)]
    docs = documents(spark, pairs).repartition(3)
    got = runs.run_digests(runs.word_runs(runs.with_planted_periods(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(x) for x in got.collect()) == order(plain_digests(*x) for x in pairs)
    assert runs.run_digests(runs.word_runs(documents(spark, []))).collect() == []


def test_runs_of_long_texts_take_linear_work(spark):
    r = random.Random(13)
    part = [str(r.randrange(2000)) for _ in range(9000)]
    texts = [(1, " ".join(part * 5)), (2, "same " * 40_000), (3, " ".join(str(k) for k in range(200_000)))]
    begin = time.time()
    got = {x["doc_id"]: x for x in runs.word_runs(documents(spark, texts)).collect()}
    assert time.time() - begin < 60
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 45_000, 9000)] and got[1]["collapsed"] == " ".join(part)
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 40_000, 1)] and got[2]["collapsed"] == "same"
    assert got[3]["runs"] == [] and got[3]["n_words"] == 200_000 and got[3]["collapsed"] == texts[2][1]


def test_words_that_cannot_repeat_stay_out_of_the_automaton(spark, monkeypatch):
    import numpy as np

    gaps = np.full(5000, 9999)
    gaps[::7] = 3
    assert runs.candidate_stretches(gaps, 5000) == []
    gaps[100:112] = 4
    assert runs.candidate_stretches(gaps, 5000) == [(93, 113)]


# --- tries ----------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, conv string, depth int, pos long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)


def plain_trie(rows, share=True):
    """Every node of the trie, from all prefixes of all rebuilt conversations."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if share else 0
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((
        min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids.get(k, [])), leaves[k], saved[k],
        hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest(),
    ) for k, cs in members.items())


def trie_rows(found):
    return sorted(tuple(r) for r in found.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect())


def random_turns(seed, convs, longest, words):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot"]), "é" * r.randrange(words)) for c in range(convs) for t in range(r.randrange(1, longest))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,convs,longest,words,walked", [(1, 60, 7, 2, 500_000), (2, 90, 20, 1, 12), (3, 40, 5, 900, 3)])
def test_trie_against_brute_force(spark, seed, convs, longest, words, walked):
    rows = random_turns(seed, convs, longest, words)
    turns = tries.with_shared_heads(tries.numbered_turns(conversations(spark, rows).repartition(4)))
    assert trie_rows(tries.prefix_trie(turns, walked)) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (7, 1, "a", "x"), (7, 1, "a", "x"), (7, None, None, None), (7, None, "", ""), (7, 0, "a", None), (-7, 1, "a", "x"), (-5, 0, "b", "y"), (-9, 3, "a", "z"), (None, 1, "a", "x"), (None, None, None, None),
        (5, 2, "a", "w" * 100_000), (6, 2, "a", "w" * 100_000), (8, 1, "ab", "c"), (9, 1, "a", "bc"), (2**40, 5, "a", "x"),
    ]
    shared = tries.with_shared_heads(tries.numbered_turns(conversations(spark, rows)))
    assert trie_rows(tries.prefix_trie(shared)) == plain_trie(rows)
    plain = tries.with_roots(tries.numbered_turns(conversations(spark, rows)))
    assert trie_rows(tries.prefix_trie(plain, 2)) == plain_trie(rows, share=False)
    assert trie_rows(tries.prefix_trie(tries.with_shared_heads(tries.numbered_turns(conversations(spark, []))))) == []


def test_trie_of_a_conversation_and_a_node_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(tries, "ROWS_A_TASK", 100)
    monkeypatch.setattr(tries, "IDS_A_ROW", 7)
    rows = [(3, t, "u", str(t % 3)) for t in range(600)] + [(c, t, "u", "same") for c in range(100, 400) for t in range(2)] + [(c, 0, "u", str(c)) for c in range(1000, 1400)]
    turns = tries.with_roots(tries.numbered_turns(conversations(spark, rows)))
    nodes = checkpoint(tries.trie_nodes(tries.prefixes(turns)))
    tour = tries._sorted(nodes, ["conv", "depth"], nodes.count())
    assert max(r["count"] for r in tour.groupBy("task").count().collect()) < 300
    found = tries.trie_figures(nodes, 5)
    assert trie_rows(found) == plain_trie(rows, share=False)
    places = sorted(x for r in found.select("first", "last").collect() for x in r)
    assert places == list(range(2 * found.count()))
