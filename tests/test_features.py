"""Features of slices and filter banks: tiles against whole arrays, planted blobs, missing cells, ties."""

import itertools
import math

import numpy as np
import pytest

from duovox.operators import features


def table(spark, volumes):
    rows = [(t, *map(int, at), float(n[at]), float(x[at])) for t, (n, x) in enumerate(volumes) for at in itertools.product(*map(range, n.shape))]
    return spark.createDataFrame(rows, "t int, z int, y int, x int, neutron double, xray double")


def mirrored(n, i):
    m = i % (2 * n)
    return m if m < n else 2 * n - 1 - m


def smooth(a, sigma, orders=None):
    """A plain Gaussian of each axis, place by place."""
    r = int(4 * sigma + 0.5)
    for axis, order in enumerate(orders or [0] * a.ndim):
        w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
        w = [v / sum(w) * (1, -d / sigma**2, d * d / sigma**4 - 1 / sigma**2)[order] for v, d in zip(w, range(-r, r + 1))]
        n = a.shape[axis]
        a = np.stack([sum(v * np.take(a, mirrored(n, i + d), axis) for v, d in zip(w, range(-r, r + 1))) for i in range(n)], axis)
    return a


def tops(a, share, window):
    cut = np.nanquantile(a, share)
    low, high = window // 2, window - window // 2 - 1
    around = lambda y, x: a[max(0, y - low) : y + high + 1, max(0, x - low) : x + high + 1]
    return {(y, x) for y, x in itertools.product(*map(range, a.shape)) if a[y, x] > cut and a[y, x] == np.nanmax(around(y, x))}


@pytest.fixture(scope="module")
def volumes():
    rng = np.random.default_rng(3)
    return [(rng.normal(20, 5, (2, 31, 26)), rng.normal(50, 9, (2, 31, 26))) for _ in range(2)]


@pytest.mark.parametrize("tile", [features.SLICES, (1, 9, 7)])
def test_peaks_and_valleys_equal_the_whole_slice(spark, volumes, tile):
    cells = table(spark, volumes)
    high = {(r.t, r.z, r.y, r.x) for r in features.peaks(cells, tile=tile).collect()}
    low = {(r.t, r.z, r.y, r.x) for r in features.valleys(cells, tile=tile).collect()}
    for (t, (n, _)), z in itertools.product(enumerate(volumes), range(2)):
        s = smooth(n[z], 2.0)
        assert {p[2:] for p in high if p[:2] == (t, z)} == tops(s, 0.9, 10)
        assert {p[2:] for p in low if p[:2] == (t, z)} == tops(-s, 0.9, 10)


@pytest.mark.parametrize("tile", [features.SLICES, (1, 10, 12)])
def test_blobs_equal_the_whole_slice(spark, volumes, tile):
    got = {(r.t, r.z, r.y, r.x, r.radius) for r in features.blobs(table(spark, volumes), scales=(1.0, 4.0), steps=4, tile=tile).collect()}
    for (t, (n, _)), z in itertools.product(enumerate(volumes), range(2)):
        a = (n[z] - n[z].min()) / (n[z].max() - n[z].min() + 1e-10)
        each = np.stack([-(smooth(a, s, [2, 0]) + smooth(a, s, [0, 2])) * s * s for s in (1.0, 2.0, 3.0, 4.0)])
        best = each.max(0)
        assert {p[2:] for p in got if p[:2] == (t, z)} == {(y, x, 1.0 + each[:, y, x].argmax()) for y, x in tops(best, 0.8, 3)}


def test_planted_blobs_are_found_at_their_scale(spark):
    y, x = np.mgrid[:60, :70]
    plane = sum(100 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s)) for cy, cx, s in ((15, 18, 2), (40, 50, 5)))
    found = features.blobs(table(spark, [(plane[None], plane[None])]), scales=(1.0, 8.0), steps=8, percentile=95).collect()
    best = {(r.y, r.x): r.radius for r in sorted(found, key=lambda r: -r.response)[:2]}
    assert best == {(15, 18): 2.0, (40, 50): 5.0}


@pytest.mark.parametrize("method", ["correlation", "product", "both"])
def test_joint_peaks(spark, volumes, method):
    got = {(r.t, r.z, r.y, r.x) for r in features.bivariate_features(table(spark, volumes), method, tile=(1, 11, 11)).collect()}
    for (t, (n, x)), z in itertools.product(enumerate(volumes), range(2)):
        a, b = n[z], x[z]
        scores, shares = (a - a.mean()) / a.std() * (b - b.mean()) / b.std(), a / a.max() * b / b.max()
        s = smooth({"correlation": scores, "product": shares, "both": scores * shares}[method], 2.0)
        assert {p[2:] for p in got if p[:2] == (t, z)} == tops(s, 0.9, 10)


def test_filter_bank_in_tiles(spark):
    rng = np.random.default_rng(5)
    n, x = rng.normal(0, 1, (2, 7, 9, 8))
    rows = features.filter_bank(table(spark, [(n, x)]), tile=(3, 4, 5)).collect()
    assert len(rows) == n.size
    want = {"neutron": n, "neutron_smooth_3": smooth(n, 3.5), "xray_smooth_1": smooth(x, 0.7), "xray_laplace": sum(smooth(x, 1.6, [2 * (a == b) for b in range(3)]) for a in range(3)),
            "neutron_gradient": np.sqrt(sum(smooth(n, 1.0, [int(a == b) for b in range(3)]) ** 2 for a in range(3)))}
    for name, a in want.items():
        assert max(abs(r[name] - a[r.z, r.y, r.x]) for r in rows) < 1e-9


def test_missing_cells_and_ties(spark, volumes):
    n, x = (v[:1].copy() for v in volumes[0])
    n[0, 15, 13] = np.nan
    s = smooth(n[0], 0.5)
    assert np.isnan(s).sum() == 25
    cells = table(spark, [(n, x)])
    got = {(r.y, r.x) for r in features.peaks(cells, distance=3, sigma=0.5, tile=(1, 8, 8)).collect()}
    assert got == tops(s, 0.9, 3)
    # a missing row and a null are alike
    other = cells.where("NOT (y = 15 AND x = 13)")
    assert {(r.y, r.x) for r in features.peaks(other, distance=3, sigma=0.5).collect()} == got
    # two equal maxima side by side are both features; a flat slice has none
    flat = np.zeros((1, 9, 20))
    assert features.peaks(table(spark, [(flat, flat)])).collect() == []
    flat[0, 4, 9] = flat[0, 4, 10] = 1.0
    assert {(r.y, r.x) for r in features.peaks(table(spark, [(flat, flat)])).collect()} == {(4, 9), (4, 10)}
    assert features.blobs(cells.limit(0)).collect() == [] and features.filter_bank(cells.limit(0)).collect() == []
    with pytest.raises(ValueError):
        features.bivariate_features(cells, "sum")


def test_quantiles_are_the_same_without_broadcasts(spark, monkeypatch):
    from duovox.operators import quantiles

    rng = np.random.default_rng(8)
    groups = {k: rng.integers(0, 40, 50 + 30 * (k or 0)).astype(float) for k in (None, 0, 1, 2)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(2, None), (7, None)], "k int, v double")
    monkeypatch.setattr(quantiles, "GROUPS", 0)
    got = {r.k: r.q for r in quantiles.exact_quantiles(rows, ["k"], "v", [0.1, 0.5, 0.93], most=20).collect()}
    assert got.pop(7) is None and set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, [0.1, 0.5, 0.93]))
