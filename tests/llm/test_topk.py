import math

import numpy as np
import pytest

from duovox.llm import topk


def brute(rows, every=100, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in fine if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(4, 6))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 4] + spread * rng.normal(size=6)]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 760)]  # many ties
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(table).collect()) == brute(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (1, [-1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (6, []), (300, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(table).collect()) == brute(rows)
    assert topk.top_k(table.limit(0)).collect() == []
    assert topk.top_k(table.where("vec_id = 0")).collect() == []


def test_it_stops_early_where_the_bound_allows():
    rng = np.random.default_rng(2)
    vectors = (rng.pareto(1.0, size=(5000, 2)) * 1000).astype(np.int64)
    lists = topk.SortedLists(np.arange(5000), vectors)
    touched = []

    class Spy(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                touched.append(len(at))
            return np.asarray(super().__getitem__(at))

    lists.floats = lists.floats.view(Spy)
    ids, score = lists.top(-1, np.array([3, 5]), 10)
    want = np.lexsort((np.arange(5000), -(vectors @ [3, 5])))[:10]
    assert ids.tolist() == want.tolist() and sum(touched) < 1000


def test_large_numbers_use_whole_arithmetic():
    vectors = np.array([[1 << 30, 1], [1 << 30, 2], [-(1 << 30), 5]])
    ids, score = topk.SortedLists(np.arange(3), vectors).top(-1, np.array([(1 << 30) + 1, 1]), 3)
    assert score.tolist() == [((1 << 30) + 1 << 30) + 2, ((1 << 30) + 1 << 30) + 1, -((1 << 30) + 1 << 30) + 5]


def test_floors_keep_ties_and_skip_blocks():
    lists = topk.SortedLists(np.arange(6), np.array([[5, 1], [4, 4], [3, 0], [3, 0], [0, 9], [-2, 2]]))
    q = np.array([2, 1])
    for floor in (None, 0, 6, 7, 11, 12, 13, 10**9):
        ids, score = lists.top(-1, q, 3, floor)
        want = sorted((-int(v @ q), i) for i, v in zip(lists.ids, lists.vectors))[:3]
        assert list(zip(ids.tolist(), score.tolist())) == [(i, -s) for s, i in want if floor is None or -s >= floor]


def test_rows_between_stages_grow_by_the_root_of_the_blocks(spark, monkeypatch):
    """400 queries' worth of blocks: the later blocks give about k rows for each block of the first pass, not k each."""
    rng = np.random.default_rng(8)
    vectors = np.rint(rng.normal(size=(6400, 8)) * 1000).astype(np.int64)
    blocks, k = 100, 10
    parts = np.array_split(np.arange(6400), blocks)
    q = np.rint(rng.normal(size=(20, 8)) * 1000).astype(np.int64)
    later = 0
    for v in q:
        first = np.sort(vectors[np.concatenate(parts[:10])] @ v)[-k]
        later += sum(len(topk.SortedLists(p, vectors[p]).top(-1, v, k, int(first))[0]) for p in parts[10:])
    assert later / len(q) < 2.5 * k * 10 < k * 90


def test_a_repeated_query_is_answered_by_its_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 7.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 2, 7 * 1024 * 1024), (0, 2, 1, 0)]
