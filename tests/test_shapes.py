"""Alignment, hulls and mixed cells on planted data."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from duovox.functions.plane import Grid
from duovox.operators import alignment, hulls, mixels, mixtures
from duovox.operators.histograms import moments
from duovox.operators.materials import Material


def table(spark, volumes):
    rows = [(t, *map(int, at), float(n[at]), float(x[at])) for t, (n, x) in enumerate(volumes) for at in itertools.product(*map(range, n.shape))]
    return spark.createDataFrame(rows, "t int, z int, y int, x int, neutron double, xray double")


def blobs(seed, shape, extruded=False):
    """Round bodies, wide enough that near shifts tell of far ones; extruded: alike along z."""
    rng = np.random.default_rng(seed)
    at = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1)
    out = np.zeros(shape)
    for _ in range(14):
        gap = (at - rng.random(3) * shape) / rng.uniform(2, 3.5)
        out += rng.uniform(40, 100) * np.exp(-0.5 * ((gap[..., 1:] if extruded else gap) ** 2).sum(-1))
    return out


def test_planted_shifts_are_found(spark):
    rng = np.random.default_rng(1)
    shape, volumes, want = (22, 24, 24), [], [(0, 2, -1), (1, 0, 3), (0, 0, 0)]
    for k, move in enumerate(want):
        wide = blobs(k, tuple(n + 8 for n in shape))
        cut = lambda off, wide=wide: wide[tuple(slice(4 - o, 4 - o + n) for o, n in zip(off, shape))]
        volumes.append((cut((0, 0, 0)) + rng.normal(0, 0.2, shape), 250 - 2 * cut(move) + rng.normal(0, 0.2, shape)))
    cells = table(spark, volumes).withColumn("neutron", F.when((F.col("t") > 0) | (F.col("x") + F.col("y") + F.col("z") != 3), F.col("neutron")))
    got = {r.t: r for r in alignment.alignment(cells, most=3, bins=16).collect()}
    for t, move in enumerate(want):
        move = tuple(-m for m in move)  # what brings xray back
        assert tuple(got[t].correction) == move and got[t].worth == any(move)
        assert all(abs(a - b) < 0.5 for a, b in zip((got[t].shift_z, got[t].shift_y, got[t].shift_x), move))
        assert got[t].after >= got[t].before and math.isclose(got[t].error, 1 - got[t].before / got[t].after)
    assert alignment.alignment(cells.limit(0)).collect() == []


def test_an_axis_without_structure_stays(spark):
    rng = np.random.default_rng(2)
    base = blobs(9, (16, 24, 20), extruded=True)
    cells = table(spark, [(base[:, 4:20, 2:18], 200 - base[:, 3:19, 2:18] + rng.normal(0, 1e-6, (16, 16, 16)))])
    r = alignment.alignment(cells, most=3, bins=16).first()
    assert not r.supported[0] and r.shift_z == 0 and tuple(r.correction) == (0, -1, 0)


def test_information_and_blur_against_whole_arrays(spark):
    rng = np.random.default_rng(3)
    n, x = rng.random((7, 9, 8)), rng.random((7, 9, 8))
    cells = table(spark, [(n, x)])
    binned = alignment.prepared(cells, 6, 0.0)
    a, b = (np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 6), 5).astype(int) for v in (n, x))
    places = spark.createDataFrame([(0, 1, 0, -1)], "t int, z int, y int, x int")
    for r in alignment.shift_information(binned, 1, 2, (2, 3, 2), places).collect():
        inner = np.s_[2:5, 3:6, 2:6]
        moved = b[1:4, 3 - r.shift : 6 - r.shift, 3:7]
        joint = np.zeros((6, 6))
        np.add.at(joint, (a[inner].ravel(), moved.ravel()), 1)
        p = joint / joint.sum()
        told = sum(p[i, j] * math.log(p[i, j] / (p[i].sum() * p[:, j].sum())) for i in range(6) for j in range(6) if p[i, j])
        assert math.isclose(r.information, told, abs_tol=1e-12)
    kernel = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    kernel /= kernel.sum()
    want = np.pad(n, 4, "symmetric")
    for axis in range(3):
        want = np.apply_along_axis(np.convolve, axis, want, kernel, "valid")
    for tile in ((4, 4, 4), (64, 64, 64)):
        got = alignment.blurred(cells, 1.0, tile=tile).collect()
        assert all(math.isclose(r.neutron, want[r.z, r.y, r.x], rel_tol=1e-12) for r in got) and len(got) == n.size


def test_hulls(spark):
    rng = np.random.default_rng(4)
    points = {1: rng.normal(size=(3000, 2)).round(2), 2: np.array([(0, 0), (1, 1), (2, 2), (1, 1)]), 3: np.array([(5, 5)]), 4: rng.integers(0, 6, (400, 2))}
    rows = [(k, float(u), float(v)) for k, p in points.items() for u, v in p] + [(1, float("nan"), 0.0), (1, None, 9.0)]
    df = spark.createDataFrame(rows, "k int, u double, v double").repartition(5)
    got = {}
    for r in sorted(hulls.hulls(df, ["k"], "u", "v").collect(), key=lambda r: (r.k, r.corner)):
        got.setdefault(r.k, []).append((r.u, r.v))
    for k, p in points.items():
        corners = np.array(got[k])
        if k in (1, 4):
            after = np.roll(corners, -1, axis=0)
            side = (after[:, None, 0] - corners[:, None, 0]) * (p[None, :, 1] - corners[:, None, 1]) - (after[:, None, 1] - corners[:, None, 1]) * (p[None, :, 0] - corners[:, None, 0])
            assert (side >= -1e-12).all() and len(corners) >= 4  # every point is left of every edge
            turn = (after - corners)[:, 0] * (np.roll(after, -1, axis=0) - after)[:, 1] - (after - corners)[:, 1] * (np.roll(after, -1, axis=0) - after)[:, 0]
            assert (turn > 0).all()
    assert got[2] == [(0, 0), (2, 2)] and got[3] == [(5, 5)]
    sizes = {r.k: r for r in hulls.hull_measures(hulls.hulls(df, ["k"], "u", "v"), ["k"]).collect()}
    assert sizes[4].area == 25 and sizes[4].corners == 4 and sizes[4].length == 20 and sizes[2].area == 0
    box = {}
    for r in hulls.outline(df, ["k"], "u", "v", 0.1).collect():
        box.setdefault(r.k, []).append((round(r.u, 6), round(r.v, 6)))
    assert sorted(box[3]) == [(4.5, 4.5), (4.5, 5.5), (5.5, 4.5), (5.5, 5.5)] and sorted(box[2]) == [(-0.2, -0.2), (-0.2, 2.2), (2.2, -0.2), (2.2, 2.2)]
    assert sorted(box[4]) == [(-0.25, -0.25), (-0.25, 5.25), (5.25, -0.25), (5.25, 5.25)]
    assert hulls.hulls(df.limit(0), ["k"], "u", "v").collect() == []


def test_hulls_of_slices(spark):
    mask = np.zeros((2, 9, 9))
    mask[0, 1:8, 2:5] = 1
    mask[0, 4:6, 5:8] = 1
    mask[1, 3, 2:7] = 1  # a line
    got = {r.z: r for r in hulls.slice_hulls(table(spark, [(mask, mask)]), F.col("neutron") == 1).collect()}
    assert got[0].area == 27 and got[0].convex_area == 6 * 2 + (6 + 1) / 2 * 3 and math.isclose(got[0].solidity, 27 / 22.5)
    assert (got[1].area, got[1].convex_area, got[1].solidity) == (5, 5.0, 1.0)


def test_fractions_follow_the_mixture(spark):
    rng = np.random.default_rng(5)
    share = rng.random(4000)
    mixed = np.outer(share, [900, 300]) + np.outer(1 - share, [300, 800]) + rng.normal(0, 12, (4000, 2))
    pure = [rng.normal(c, 20, (3000, 2)) for c in ((900, 300), (300, 800))]
    rows = [(0, float(u), float(v)) for p in (*pure, mixed) for u, v in p]
    grid = Grid(0.0, 1200.0, 0.0, 1200.0, 64)
    bins = moments(spark.createDataFrame(rows, "t int, neutron double, xray double"), grid).cache()
    spread = np.cov(mixed.T)
    library = [Material(1, "a", 900.0, 300.0, 400.0, 400.0, 0.0, 0.3, 3000), Material(2, "b", 300.0, 800.0, 400.0, 400.0, 0.0, 0.3, 3000), Material(3, "m", 600.0, 550.0, float(spread[0, 0]), float(spread[1, 1]), float(spread[0, 1]), 0.4, 4000)]
    model = mixtures.Anchored(library, grid.area, strength=0.9)
    parameters = mixtures.fitted(bins, model, 5).cache()
    declared = [mixels.Mixel(3, 1, 2), mixels.Mixel(3, 2, 1, 40, 12.0), mixels.Mixel(3, 1, 9)]
    got = {(r.iy, r.ix): r.fraction for r in mixels.fractions(bins, parameters, model, declared[:1]).collect()}
    for u, v in ((900, 300), (300, 800), (600, 550), (750, 425)):
        at = (int(v / 1200 * 64), int(u / 1200 * 64))
        assert abs(got[at] - (u - 300) / 600) < 0.08
    back = {(r.iy, r.ix): r.fraction for r in mixels.fractions(bins, parameters, model, declared[1:]).collect()}
    assert len(back) == len(got) and abs(back[22, 40] + got[22, 40] - 1) < 0.1
    assert mixels.fractions(bins, parameters, model, declared[2:]).collect() == []
    # one bin against plain numbers
    r = mixels.fractions(bins, parameters, model, declared[:1]).orderBy("iy", "ix").first()
    p, point = parameters.first(), np.array([r.sn / r.c, r.sx / r.c])
    part = lambda k: (np.array([p[f"n{k}"], p[f"x{k}"]]), np.array([[p[f"a{k}"], p[f"o{k}"]], [p[f"o{k}"], p[f"d{k}"]]]))
    (ma, ca), (mb, cb) = part(0), part(1)
    noise, logs, steps = 0.25 * min(np.trace(ca), np.trace(cb)) / 2, [], (np.arange(10) + 0.5) / 10
    for s in steps:
        c, d = s * s * ca + (1 - s) ** 2 * cb + noise * np.eye(2), point - s * ma - (1 - s) * mb
        logs.append(-0.5 * (2 * math.log(2 * math.pi) + math.log(np.linalg.det(c)) + d @ np.linalg.solve(c, d)))
    w = np.exp(np.array(logs) - max(logs))
    assert math.isclose(r.fraction, (w * steps).sum() / w.sum(), rel_tol=1e-9) and math.isclose(r.log_density, max(logs) + math.log(w.sum()) - math.log(10), rel_tol=1e-9)
    angles = mixels.line_angles(mixtures.class_rows(parameters, model)).cache()
    lines = mixels.mixing_lines(angles).collect()
    assert [(x.class_id, x.first, x.second) for x in lines] == [(3, 1, 2)] and lines[0].angle < 5 and 0.3 < lines[0].position < 0.7
    told = {(x.class_id, x.second): x.reason for x in mixels.verified(angles, [*declared[:1], mixels.Mixel(3, 1, 9), mixels.Mixel(1, 2, 3)]).collect()}
    assert told[3, 2] == "aligned" and told[3, 9] == "not fitted" and told[1, 3] in ("no long axis", "off the line")


def test_factors_of_planted_components(spark):
    from duovox.operators import factors

    rng = np.random.default_rng(6)
    base = np.zeros((2, 64))
    base[0, :30], base[1, 25:] = rng.random(30), rng.random(39)
    base /= base.sum(1, keepdims=True)
    rows = [(t, b // 8, b % 8, round(1e6 * ((1 - t / 5) * base[0, b] + t / 5 * base[1, b]))) for t in range(6) for b in range(64)]
    hist = spark.createDataFrame([r for r in rows if r[3]], "t int, iy int, ix int, count long")
    done = factors.histogram_factors(hist, 2, 6)
    x = np.zeros((6, 64))
    for t, iy, ix, n in rows:
        x[t, 8 * iy + ix] = n
    x /= x.sum(1, keepdims=True)
    w, h = np.where(np.array([0, 0, 0, 1, 1, 1])[:, None] == np.arange(2), 1.0, 0.1), np.array([x[:3].mean(0), x[3:].mean(0)]) + 1e-12
    for _ in range(6):
        h = h * (w.T @ x) / (w.T @ w @ h + 1e-12)
        w = w * (x @ h.T) / (w @ (h @ h.T) + 1e-12)
    assert np.allclose(done.weights, w, rtol=1e-9)
    got = {(r.iy, r.ix, r.component): r.value for r in done.component_rows().collect()}
    assert all(math.isclose(v, h[k, 8 * iy + ix], rel_tol=1e-9, abs_tol=1e-15) for (iy, ix, k), v in got.items())
    assert math.isclose(done.error(), ((x - w @ h) ** 2).sum(), rel_tol=1e-6) and done.error() < ((x - x.mean(0)) ** 2).sum() / 20
    assert done.weight_rows().count() == 12 and factors.histogram_factors(hist.limit(0), 2, 2).weight_rows().count() == 0
