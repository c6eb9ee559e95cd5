import random
import re

import numpy as np
import pytest

from duovox.llm import near


def brute(rows, percent=75):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = {i: i for i, _ in rows if i is not None}
    changed = True
    pairs = [(x[0], y[0]) for x, a in zip(rows, sets) for y, b in zip(rows, sets) if None not in (x[0], y[0]) and x[0] < y[0] and a and b and 100 * len(a & b) >= percent * len(a | b)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for (i, _), s in zip(rows, sets)), key=str)


def vary(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"new{rnd.random()}"
    return out


def corpus(rnd):
    rows, k = [], 0
    for base in range(12):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((4, 5, 9, 60, 200, 500)))]
        for copy in range(rnd.choice((1, 2, 5, 14))):
            rows.append((k, " ".join(vary(rnd, words, rnd.choice((0, 0, 1, 2, 4))))))
            k += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, component_id long").repartition(4)
    assert sorted([tuple(r) for r in near.link_components(docs).collect()], key=str) == brute(rows)


@pytest.mark.parametrize("block, size", [(1024, 16 << 20), (2, 16 << 20), (1024, 5000)])
def test_chains_need_further_pivots(spark, monkeypatch, block, size):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_BYTES", size)
    # a chain: neighbours are similar, distant members aren't, so one pivot for each bucket can't connect it
    words = [f"c{k}" for k in range(700)]
    rows = [(100 - k, " ".join(words[30 * k : 30 * k + 400])) for k in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in near.link_components(docs).collect()], key=str)
    assert got == brute(rows) and {r[2] for r in got} == {90}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c d"), (7, "A B\tC\nD "), (8, "a b c d e"), (None, "one"), (9, "ÉCOLE"), (10, "école"), (11, "x " * 30_000), (12, "X\x0bx " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in near.link_components(docs).collect()], key=str)
    assert got == brute(rows)
    assert near.link_components(docs.limit(0)).collect() == []
    twice = near.link_components(docs.union(docs)).collect()
    assert sorted(map(str, twice)) == sorted(2 * [str(r) for r in near.link_components(docs).collect()])


def test_sketch_agreement_is_near_the_similarity():
    rng = np.random.default_rng(0)
    for shared in (0.3, 0.75, 0.9):
        n = 600
        both = int(2 * n * shared / (1 + shared))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        pairs = []
        for _ in range(20):
            b = np.concatenate([a[:both], rng.integers(0, 2**63, n - both).astype(np.uint64)])
            s = near.sketches([np.unique(a), np.unique(b)])
            pairs.append((s[0] == s[1]).mean())
        assert abs(np.mean(pairs) - shared) < 0.05


def test_every_coordinate_fills():
    s = near.sketches([np.array([7], np.uint64), np.array([7, 9], np.uint64)])
    assert (s < np.iinfo(np.uint64).max).all()


def test_blocks_give_every_pair_that_agrees(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for key in range(3):
        data = rng.integers(0, 2, (40, 12)).astype("<u2")
        for i in range(40):
            rows.append((key, 100 * key + i, 100 * key + i % 9, data[i].tobytes()))
            want |= {(100 * key + j, 100 * key + i) for j in range(i) if j % 9 != i % 9 and (data[i] == data[j]).sum() >= 9}
    members = spark.createDataFrame(rows, "key long, rep long, root long, sketch binary")
    got = [tuple(r) for r in near.agreeing(near.with_blocks(members.repartition(5)), 9).collect()]
    assert len(got) == len(set(got)) and set(got) == want
