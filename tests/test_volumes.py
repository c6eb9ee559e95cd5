import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duovox.operators import boxes, materials, spatial, stencils

SHAPE = (5, 7, 6)


@pytest.fixture(scope="module")
def volume(spark):
    rng = np.random.default_rng(5)
    n, x, label = rng.normal(size=SHAPE), rng.normal(size=SHAPE), rng.integers(0, 3, SHAPE)
    rows = [(0, *map(int, at), float(n[at]), float(x[at]), int(label[at])) for at in np.ndindex(SHAPE)]
    return spark.createDataFrame(rows, "t int, z int, y int, x int, neutron double, xray double, label int").repartition(3), n, x, label


def dense(df, column):
    out = np.full(SHAPE, np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = np.nan if r[column] is None else r[column]
    return out


def clamped(a, d):
    at = [np.clip(np.arange(n) + k, 0, n - 1) for n, k in zip(a.shape, d)]
    return a[np.ix_(*at)]


def plain_slopes(a):
    weight = {-1: 1, 0: 2, 1: 1}
    return [sum(clamped(a, d) * d[k] * math.prod(weight[d[j]] for j in range(3) if j != k) for d in itertools.product((-1, 0, 1), repeat=3)) for k in range(3)]


@pytest.mark.parametrize("tile", [(32, 64, 64), (2, 3, 4)])
def test_stencils_against_whole_volumes(volume, tile):
    df, n, x, _ = volume
    box = list(itertools.product((-1, 0, 1), repeat=3))
    got = stencils.local_moments(df, tile=tile)
    mean = sum(clamped(n, d) for d in box) / 27
    assert np.allclose(dense(got, "mean"), mean) and np.allclose(dense(got, "std"), np.sqrt(sum(clamped(n * n, d) for d in box) / 27 - mean**2))
    a, b = plain_slopes(n), plain_slopes(x)
    got = stencils.gradients(df, tile=tile)
    size = [np.sqrt(sum(u * u for u in g)) for g in (a, b)]
    assert np.allclose(dense(got, "gradient_n"), size[0]) and np.allclose(dense(got, "coherence"), abs(sum(u * v for u, v in zip(a, b))) / (size[0] * size[1] + 1e-6))
    tensor = np.stack([np.stack([sum(clamped(u * v, d) for d in box) / 27 for v in a], -1) for u in a], -1)
    low, middle, high = np.moveaxis(np.linalg.eigvalsh(tensor), -1, 0)
    got = stencils.structure(df, tile=tile)
    assert np.allclose(dense(got, "anisotropy"), (high - low) / (low + middle + high)) and np.allclose(dense(got, "planarity"), 2 * (middle - low) / (low + middle + high))


def test_stencils_give_null_beside_missing_cells(volume):
    df = volume[0].where("NOT (z = 2 AND y = 3 AND x = 3)").withColumn("neutron", F.when((F.col("z") == 0) & (F.col("y") == 0) & (F.col("x") == 0), None).otherwise(F.col("neutron")))
    got = stencils.local_moments(df).where("mean IS NULL").count()
    assert got == 26 + 8 and stencils.local_moments(df.limit(0)).collect() == []


def test_erosion_against_plain_steps(volume):
    df, _, _, label = volume
    inside = label > 0
    depth, left = np.zeros(SHAPE, int), inside
    for _ in range(3):
        wide = np.pad(left, 1)
        left = left & np.logical_and.reduce([np.roll(wide, s, a)[1:-1, 1:-1, 1:-1] for a in range(3) for s in (1, -1)])
        depth += left
    for tile in ((32, 64, 64), (3, 3, 3)):
        got = dense(stencils.eroded(df, F.col("label") > 0, 3, tile), "depth")
        assert np.array_equal(np.isfinite(got), inside) and np.array_equal(got[inside], depth[inside])


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_components_against_flood_fill(volume, reach):
    df, _, _, label = volume
    seen, want = {}, {}
    for at in np.ndindex(SHAPE):
        if at in seen:
            continue
        todo, seen[at] = [at], at
        while todo:
            z, y, x = todo.pop()
            for d in itertools.product((-1, 0, 1), repeat=3):
                to = (z + d[0], y + d[1], x + d[2])
                if 0 < sum(map(abs, d)) <= reach and all(0 <= v < n for v, n in zip(to, SHAPE)) and to not in seen and label[to] == label[at]:
                    seen[to] = at
                    todo.append(to)
    for at, root in seen.items():
        want.setdefault(int(label[at]), {}).setdefault(root, []).append(at)
    got = {r.label: (r.components, round(r.largest_share, 9)) for r in spatial.label_components(df, reach=reach).collect()}
    assert got == {k: (len(v), round(max(map(len, v.values())) / sum(map(len, v.values())), 9)) for k, v in want.items()}


def test_boxes():
    box = boxes.Box.of_rectangle("z", (1.2, 3.5, 9.0, 2.5), (4, 10, 20), factor=2)
    assert box.ranges == ((0, 4), (2, 8), (4, 18)) and box.with_range("z", 3, 1).z == (1, 3)
    assert boxes.Box.of_rectangle("y", (50, 60, -9, -3), (4, 10, 20)).ranges == ((3, 4), (0, 10), (0, 1))
    assert box.fraction((4, 10, 20)) == 4 * 6 * 14 / 800 and box.on_plane("z", 2) == (1, 4, 2, 9)
    with pytest.raises(ValueError):
        boxes.Box((0, 0), (0, 1), (0, 1))


def test_rectangles_of_constant_and_empty_values(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 0.0)], "neutron double, xray double")
    assert tuple(boxes.value_rectangle(df).first()) == (5 - 0.025, 5 + 0.025, -0.05, 0.05)
    assert tuple(boxes.value_rectangle(df.limit(0)).first()) == (0.0, 1.0, 0.0, 1.0)


def test_matching_against_all_permutations(spark):
    rng = np.random.default_rng(2)
    for size in ((4, 4), (3, 5), (5, 3)):
        n = rng.integers(0, 50, size)
        got = materials.best_matching(spark.createDataFrame([(p, t, int(n[p, t])) for p, t in np.ndindex(size)], "prediction int, truth int, n long")).collect()
        small, large = sorted(size)
        best = max(sum(n[(p, t) if size[0] <= size[1] else (t, p)] for p, t in zip(range(small), order)) for order in itertools.permutations(range(large), small))
        assert sum(r.n for r in got) == best and len({r.truth for r in got}) == len({r.prediction for r in got}) == len(got)


def test_guards_and_retention(spark):
    make = lambda rows: spark.createDataFrame(rows, "t int, label int, cells long")
    plain, smooth = make([(0, 1, 100), (0, 2, 50), (0, 0, 10), (0, -1, 5), (1, -1, 7)]), make([(0, 1, 140), (0, 0, 20), (0, -1, 5)])
    kept = materials.retention(smooth, plain)
    assert {(r.label, r.kept) for r in kept.collect()} == {(1, 1.4), (2, 0.0)}
    report = materials.budget_report(plain)
    found = {(r.t, r.finding) for r in materials.guards(report, kept, most_unclassified=0.05).collect()}
    assert found == {(0, "unclassified"), (0, "smoothing of class 2"), (1, "nothing measured")}
