import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from duovox.functions.plane import Region
from duovox.operators import materials, smoothing, spatial
from duovox.operators.histograms import plane_grid


def table(spark, neutron, xray=None, low=(0, 0, 0), t=0):
    xray = neutron if xray is None else xray
    rows = [(t, *(int(p + q) for p, q in zip(at, low)), float(neutron[at]), float(xray[at])) for at in itertools.product(*map(range, neutron.shape))]
    return spark.createDataFrame(rows, "t int, z int, y int, x int, neutron double, xray double")


def plain_weights(neutron, xray):
    """Weights of faces by axis, from whole arrays."""
    n, x = neutron / neutron.std(), xray / xray.std()
    gaps = [np.hypot(np.diff(n, axis=a), np.diff(x, axis=a)) for a in range(3)]
    last = sum(n.size / n.shape[a] for a in range(3) if n.shape[a] > 1)
    sigma = sum(g.sum() for g in gaps) / (sum(g.size for g in gaps) + last)
    return [np.exp(-0.5 * (g / sigma) ** 2) for g in gaps]


def plain(score, beta, sweeps, method, cost, weights):
    """Labels and the whole energy by loops over cells."""
    shape, k = score.shape[:3], score.shape[3]
    near = {at: [] for at in itertools.product(*map(range, shape))}
    for axis in range(3):
        for at in near:
            up = tuple(p + (a == axis) for a, p in enumerate(at))
            if up in near:
                near[at].append((up, weights[axis][at], True))
                near[up].append((at, weights[axis][at], False))
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    held = {at: soft(score[at]) if method == "mean_field" else np.eye(k)[score[at].argmax()] for at in near}
    for _ in range(sweeps):
        value = {at: score[at] - beta * cost @ sum((w * held[o] for o, w, _ in near[at]), np.zeros(k)) for at in near}
        held = {at: 0.5 * soft(v) + 0.5 * held[at] if method == "mean_field" else np.eye(k)[v.argmax()] for at, v in value.items()}
    label = {at: int(h.argmax()) for at, h in held.items()}
    energy = sum(-score[at][label[at]] + beta * sum(w * cost[label[at], label[o]] for o, w, up in near[at] if up) for at in near)
    return label, energy


@pytest.mark.parametrize("method", ["mean_field", "icm"])
def test_tiles_equal_loops_over_the_whole_volume(spark, method):
    rng = np.random.default_rng(2)
    neutron, xray = rng.random((9, 5, 6)), rng.random((9, 5, 6))
    cost = np.array([[0, 1.0, 3], [1.0, 0, 0.5], [3, 0.5, 0]])
    cells = table(spark, neutron, xray, (-3, 0, 7)).withColumns({f"s{k}": -F.abs(F.col("neutron") - c) * 3 for k, c in enumerate((0.2, 0.5, 0.8))})
    score = -np.abs(neutron[..., None] - np.array([0.2, 0.5, 0.8])) * 3
    want, energy = plain(score, 0.4, 4, method, cost, plain_weights(neutron, xray))
    for tile in ((3, 2, 4), (64, 64, 64)):
        got = smoothing.smoothed(cells, ["s0", "s1", "s2"], 0.4, 4, method, cost, edges=True, tile=tile).collect()
        assert {(r.z + 3, r.y, r.x - 7): r.label for r in got} == want
        assert abs(sum(r.energy for r in got) - energy) < 1e-8
    none = smoothing.smoothed(cells, ["s0", "s1", "s2"], 0.0, 4, method, tile=(4, 4, 4)).collect()
    assert all(r.label == score[r.z + 3, r.y, r.x - 7].argmax() for r in none)
    with pytest.raises(ValueError):
        smoothing.smoothed(cells, ["s0"], 1.0, cost=cost)


def test_cells_without_scores_take_no_part(spark):
    rng = np.random.default_rng(3)
    a = rng.random((4, 4, 4))
    cells = table(spark, a).withColumns({"s0": F.when(F.col("x") != 2, F.col("neutron")), "s1": F.lit(0.5)})
    got = {(r.z, r.y, r.x): r for r in smoothing.smoothed(cells, ["s0", "s1"], 0.3, 3, "icm").collect()}
    assert all((r.label is None) == (at[2] == 2) == (r.energy is None) for at, r in got.items())
    apart = {(r.z, r.y, r.x): r.label for r in smoothing.smoothed(cells.where("x < 2"), ["s0", "s1"], 0.3, 3, "icm").collect()}
    assert all(got[at].label == label for at, label in apart.items())
    assert smoothing.smoothed(cells.limit(0), ["s0", "s1"], 0.3).collect() == []


def test_components_across_tiles(spark):
    rng = np.random.default_rng(4)
    for density, reach in ((0.35, 1), (0.15, 2), (0.08, 3)):
        inside = rng.random((11, 9, 10)) < density
        cells = table(spark, inside.astype(float), low=(-5, 3, -20))
        got = {(r.z + 5, r.y - 3, r.x + 20): r.component for r in spatial.connected(cells, F.col("neutron") == 1, reach, tile=(3, 4, 2)).collect()}
        want = {}
        for at in map(tuple, np.argwhere(inside).tolist()):
            if at not in want:
                stack = [at]
                want[at] = (at[0] * 9 + at[1]) * 10 + at[2]
                while stack:
                    p = stack.pop()
                    for s in itertools.product((-1, 0, 1), repeat=3):
                        q = tuple(u + v for u, v in zip(p, s))
                        if 0 < sum(map(abs, s)) <= reach and q not in want and all(0 <= u < n for u, n in zip(q, inside.shape)) and inside[q]:
                            want[q] = want[at]
                            stack.append(q)
        assert got == want and len(set(want.values())) > 3
    snake = np.zeros((30, 3, 30))
    snake[::2, 1, :] = 1
    snake[1::4, 1, -1] = snake[3::4, 1, 0] = 1
    parts = spatial.connected(table(spark, snake), F.col("neutron") == 1, tile=(4, 4, 4)).select("component").distinct().collect()
    assert len(parts) == 1
    assert spatial.connected(cells, F.lit(False)).collect() == [] == spatial.connected(cells.limit(0), F.lit(True)).collect()


@pytest.fixture
def tables(monkeypatch):
    """One entry for each table that is written."""
    written, write = [], spatial._table
    monkeypatch.setattr(spatial, "_table", lambda df: written.append(0) or write(df))
    return written


def test_a_chain_of_links_takes_few_rounds(spark, tables):
    rng = np.random.default_rng(5)
    pairs = [(k, k + 1) for k in range(300) if k not in (99, 100, 250)] + [(1000, k) for k in range(900, 1000, 7)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2060, (50, 2))]
    root = {k: k for p in pairs for k in p}
    for a, b in pairs * 300:
        root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in spatial.merged(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert got == {k: root[k] for k in linked} and len(set(got.values())) > 4
    assert len(tables) < 40  # by the order of the nodes: over 200
    assert spatial.merged(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_along_many_tiles_takes_few_rounds(spark, tables):
    line = spark.range(32 * 40).select(F.lit(0).alias("t"), F.col("id").cast("int").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.when(F.col("id") < 1000, 1.0).otherwise(9.0).alias("neutron"))
    for reach in (1, 2):
        tables.clear()
        assert spatial.grown(line, (0, 5, 0, 0), "neutron", 1.0, reach).count() == 1000
        assert len(tables) < 25  # by the order of the nodes: over 40


def test_cells_are_not_broadcast(spark):
    cells = spatial._table(spark.range(400).select(F.lit(0).alias("t"), *[F.floor(F.col("id") / n % 10).cast("int").alias(a) for a, n in zip("zyx", (100, 10, 1))], (F.col("id") < 200).alias("m")))
    for reach in (2, 3):
        assert "Broadcast" not in plan(spatial.near_pairs(cells, "m", reach))
    opened = plan(smoothing.thin_parts(cells, "m"))
    assert "SortMergeJoin [t" in opened and "BroadcastHashJoin [t" not in opened


def test_tiles_of_the_locked_mode_meet_no_other_cells(spark):
    a = np.random.default_rng(6).random((4, 6, 6)) * 30
    a[:, :, 3:] += 60
    regions = [Region("low", 1, rectangle=(-1, 35, -1, 35)), Region("high", 2, rectangle=(50, 100, 50, 100))]
    cells = table(spark, a, a + np.random.default_rng(7).random(a.shape))
    text = plan(smoothing.locked_smooth(cells, regions, plane_grid(cells), 0.3, sweeps=2))
    assert "Window" not in text and "SortMergeJoin" not in text and text.count("FlatMapGroupsInPandas") == 1


def test_openings_and_thin_parts(spark):
    a = np.zeros((14, 14, 14))
    a[1:3, 1:9, 1:9] = 1  # a sheet of two layers
    a[6:11, 6:11, 6:11] = 1  # a solid block
    a[12, 0, :] = 1  # a thread of 14 cells
    a[5, 12, 12] = 1  # one cell
    inside = a == 1
    wide = np.pad(inside, 2)
    moves = [(0, 0, 0), *(tuple(s if k == axis else 0 for k in range(3)) for axis in range(3) for s in (-1, 1))]
    kept = np.logical_and.reduce([np.roll(wide, m, (0, 1, 2)) for m in moves])
    back = np.logical_or.reduce([np.roll(kept, m, (0, 1, 2)) for m in moves])[2:-2, 2:-2, 2:-2]
    cells = table(spark, a).withColumn("m", F.col("neutron") == 1)
    for tile in ((5, 4, 6), (64, 64, 64)):
        got = {(r.z, r.y, r.x) for r in smoothing.opened(cells, "m", tile).where("opened").collect()}
        assert got == set(map(tuple, np.argwhere(back).tolist()))
        thin = {(r.z, r.y, r.x) for r in smoothing.thin_parts(cells, "m", 20, tile).collect()}
        assert thin == {(z, y, x) for z in (1, 2) for y in range(1, 9) for x in range(1, 9)}
    assert smoothing.thin_parts(cells, "m", 10).count() == 128 + 14


def test_the_rule_of_settled_strengths():
    grid = [0, 1, 2, 4]
    assert smoothing.settled_strength(grid, [True] * 4, [0, 0.3, 0.2, 0.1], 0.05) == (4, "top")
    assert smoothing.settled_strength(grid, [True] * 4, [0, 0.3, 0.04, 0.1], 0.05) == (1, "settled")
    assert smoothing.settled_strength(grid, [False, True, True, False], [0, 0.3, 0.2, 0.1], 0.05) == (2, "guard")
    assert smoothing.settled_strength(grid, [False] * 4, [0] * 4, 0.05) == (0.0, "refused")


BANDS = [Region("low", 1, rectangle=(0, 60, 0, 60)), Region("high", 2, rectangle=(61, 140, 61, 140))]


def test_locked_mode_with_smoothing(spark):
    rng = np.random.default_rng(7)
    truth = np.zeros((6, 16, 16), int)
    truth[:, :, 8:] = 1
    base = np.where(truth, 80.0, 40.0)
    n, x = (base + rng.normal(0, 13, truth.shape) for _ in range(2))
    cells = table(spark, n, x).union(table(spark, n + 1, x - 1, t=1)).union(spark.createDataFrame([(0, 6, 0, 0, float("nan"), 1.0)], "t int, z int, y int, x int, neutron double, xray double")).cache()
    grid = plane_grid(cells)
    labels = smoothing.locked_smooth(cells, BANDS, grid, 2.0).cache()
    assert labels.count() == cells.count() and [r.label for r in labels.where("z = 6").collect()] == [materials.EXCLUDED]
    wrong = {c: sum(r[c] != truth[r.z, r.y, r.x] + 1 for r in labels.where("z < 6").collect()) for c in ("label", "plain")}
    assert wrong["label"] < wrong["plain"] / 2
    counts, found = smoothing.smooth_report(labels)
    rows = {(r.t, r.label): r for r in counts.collect()}
    assert sum(r.cells for r in rows.values()) == sum(r.plain_cells for r in rows.values()) == cells.count()
    assert abs(rows[0, 1].kept - rows[0, 1].cells / rows[0, 1].plain_cells) < 1e-12 and found.collect() == []
    assert smoothing.smooth_report(labels, most_unclassified=-1.0, least_kept=5.0)[1].count() >= 4
    strength, why, sweep = smoothing.auto_smoothing(cells.where("t = 0"), BANDS, grid, (0.5, 1.0, 2.0), share=0.002, extensions=1)
    trace = {r.strength: r for r in sweep.collect()}
    assert why in ("settled", "top") and strength > 0 and trace[0.0].worst_kept == 1.0 and trace[0.0].changed == 0
    assert (4.0 in trace) == (trace[2.0].changed >= 0.002)
    same = smoothing.locked_smooth(cells.where("t = 0"), BANDS, grid, 0.5).where("label != plain").count()
    assert abs(trace[0.5].changed - same / (cells.where("t = 0").count() - 1)) < 1e-12


def test_the_query_searches_all_strengths(spark, tmp_path):
    from duovox.jobs import smooth
    from duovox.sources.paired import grid_series

    rng = np.random.default_rng(4)
    events = [(i, float(v), f'{{"k": {k}}}') for i, (v, k) in enumerate(zip(rng.normal(50, 10, 4000).round(3), rng.integers(0, 100, 4000)))]
    spark.createDataFrame(events, "event_id long, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    rows = {(r.t, r.strength): r for r in smooth.auto_smoothing(spark, str(tmp_path)).collect()}
    tested = sorted({s for _, s in rows})
    assert set(rows) == {(t, s) for t in (0, 1) for s in tested}
    assert tested[:7] == [0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0] and tested[7:] == [16.0, 32.0][: len(tested) - 7]
    for at in (8.0, 16.0):  # the search goes on while labels change and the guards hold
        more = max(rows[t, at].changed for t in (0, 1)) >= 0.002 and all(rows[t, at].fine for t in (0, 1))
        assert (2 * at in tested) == more
        if not more:
            break
    assert 16.0 in tested
    cells = grid_series(spark, str(tmp_path))
    labels = [{(r.t, r.z, r.y, r.x): r.label for r in smoothing.locked_smooth(cells, smooth.BANDS, plane_grid(cells), s, sweeps=5).collect()} for s in (0.0, 8.0, 16.0)]
    for t in (0, 1):
        plain, was, now = ([label for at, label in sorted(one.items()) if at[0] == t] for one in labels)
        assert abs(rows[t, 16.0].changed - sum(a != b for a, b in zip(was, now)) / 2000) < 1e-12
        assert abs(rows[t, 16.0].worst_kept - min(now.count(c) / plain.count(c) for c in (1, 2, 3))) < 1e-12
        assert abs(rows[t, 16.0].unclassified - now.count(materials.UNCLASSIFIED) / 2000) < 1e-12
