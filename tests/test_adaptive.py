"""Mixtures, drift and series that carry state, on planted volumes."""

import math

import numpy as np
from pyspark.sql import functions as F

from duovox.functions.plane import Grid
from duovox.operators import mixtures
from duovox.operators.histograms import moments
from duovox.operators.materials import Material
from duovox.streaming import following

CENTRES = {1: 400.0, 2: 700.0, 3: 1000.0}
GRID = Grid(0.0, 2200.0, 0.0, 2200.0, 64)
SHARES = {1: 300, 2: 200, 3: 100}


def cells(spark, shifts, without=(), seed=0, name="a"):
    """Three Gaussian classes at each t, all moved by that t's shift; without: (t, class) pairs left out."""
    rng = np.random.default_rng(seed)
    rows = []
    for t, s in enumerate(shifts):
        for k, c in CENTRES.items():
            if (t, k) not in without:
                rows += [(name, t, float(u), float(v), k) for u, v in np.clip(rng.normal(c + s, 25, (SHARES[k], 2)), 20, 2180)]
    return spark.createDataFrame(rows, "series string, t int, neutron double, xray double, truth int")


def library(n=SHARES):
    total = sum(n.values())
    return [Material(k, f"m{k}", c, c, 625.0, 625.0, 30.0, n[k] / total, n[k]) for k, c in CENTRES.items()]


def model(**more):
    return mixtures.Anchored(library(), GRID.area, **more)


def test_strength_has_no_unit():
    assert mixtures.pseudo_count(0, 500) == 0 and mixtures.pseudo_count(0.5, 500) == 500 and math.isclose(mixtures.pseudo_count(0.9, 500), 4500)
    assert mixtures.pseudo_count(1.0, 5) > 1e11


def test_fit_finds_classes_and_equals_the_array_form(spark):
    bins = moments(cells(spark, [0, 40]), GRID).cache()
    for how in (model(), model(outlier=0.0, strength=0.9, dirichlet=3.0), model(strengths={2: 0.0}, fixed=frozenset({3}))):
        got = {(r.t, r.class_id): r for r in mixtures.class_rows(mixtures.fitted(bins, how, 6), how).collect()}
        for t in (0, 1):
            one = following.Series(following.Following(how, rounds=6, memory=0.0))
            b = {c: np.array([r[c] for r in bins.where(f"t = {t}").orderBy("iy", "ix").collect()]) for c in following.FIELDS}
            out = one.step(t, b)
            for k, m in enumerate(how.library):
                r = got[t, m.class_id]
                assert np.allclose([r.neutron, r.xray, r.sigma_n**2, r.sigma_x**2, r.cov, r.weight], out["classes"][k], rtol=1e-8)
            assert math.isclose(got[t, 0].weight, out["outlier"], rel_tol=1e-8, abs_tol=1e-12)
        if not how.fixed:
            assert all(abs(got[0, k].neutron - c) < 8 for k, c in CENTRES.items())
        else:
            assert got[1, 3].moved == 0 and got[1, 3].neutron == 1000 and got[1, 2].moved > 1


def test_anchor_strength_is_a_dial(spark):
    bins = moments(cells(spark, [60]), GRID).cache()
    moved = []
    for s in (1.0, 0.9, 0.5, 0.0):
        how = model(strength=s, outlier=0.0)
        moved.append({r.class_id: r.moved for r in mixtures.class_rows(mixtures.fitted(bins, how, 6), how).collect()}[2])
    assert moved[0] < 0.05 and moved == sorted(moved) and moved[-1] > 2


def test_labels_scores_and_outliers(spark):
    strange = spark.createDataFrame([("a", 0, 1900.0 + k, 300.0, 0) for k in range(40)], "series string, t int, neutron double, xray double, truth int")
    rows = cells(spark, [0]).union(strange)
    bins = moments(rows, GRID).cache()
    how = model()
    r = mixtures.responsibilities(bins, mixtures.fitted(bins, how, 6), how)
    labels = mixtures.bin_labels(r, how)
    found = {x.label: x.c for x in labels.groupBy("label").agg(F.sum("c").alias("c")).collect()}
    assert found[0] >= 40 and all(abs(found[k] - SHARES[k]) < 12 for k in CENTRES)
    picky = mixtures.bin_labels(r, how, reject=0.999999)
    assert picky.where("label = 0").agg(F.sum("c")).first()[0] >= found[0]
    s = mixtures.fit_scores(r, how).first()
    assert s.cells == rows.count() and s.icl >= s.bic and s.entropy >= 0
    assert math.isclose(s.bic, -2 * s.log_likelihood + 18 * math.log(s.cells))
    free = model(outlier=0.0)
    wide = {x.class_id: x.sigma_n for x in mixtures.class_rows(mixtures.fitted(bins, free, 6), free).collect()}
    kept = {x.class_id: x.sigma_n for x in mixtures.class_rows(mixtures.fitted(bins, how, 6), how).collect()}
    assert max(wide[k] / kept[k] for k in CENTRES) > 1.05
    assert mixtures.class_rows(mixtures.fitted(bins.limit(0), how, 2), how).count() == 0


def test_drift_of_planted_shifts(spark):
    bins = moments(cells(spark, [0, 30, 60, 320]), GRID).cache()
    inert = library()[:2]
    found = mixtures.modes(bins, inert, 12).cache()
    got = {r.t: r for r in mixtures.drift(found, inert).collect()}
    for t, s in enumerate([0, 30, 60]):
        assert abs(got[t].shift_n - s) < 6 and abs(got[t].shift_x - s) < 6 and got[t].rejected == [] and got[t].scale_n == 1
        assert math.isclose(got[t].magnitude, math.hypot(got[t].shift_n, got[t].shift_x)) and got[t].residual < 6
    assert got[3].rejected and (got[3].residual is None or len(got[3].rejected) == 1)  # the next class's mode is near
    noise = mixtures.process_noise(found, mixtures.drift(found, inert), inert).first()
    assert 1e-6 <= noise.var_n < 40
    back = mixtures.drifted(cells(spark, [0, 30]), mixtures.drift(found, inert)).groupBy("t", "truth").agg(F.avg("neutron").alias("m")).collect()
    assert all(abs(r.m - CENTRES[r.truth]) < 8 for r in back)


def test_gain_and_anchors_on_one_mode(spark):
    base = cells(spark, [0])
    gained = base.withColumns({"neutron": F.col("neutron") * 1.05 + 10, "t": F.lit(1)})
    found = mixtures.modes(moments(base.union(gained), GRID).cache(), library(), 12)
    got = {r.t: r for r in mixtures.drift(found, library(), scaled=True).collect()}
    assert abs(got[1].scale_n - 1.05) < 0.01 and abs(got[1].scale_x - 1) < 0.01 and got[0].rejected == []
    # two anchors that can only find one mode: both go, and nothing is left
    twins = [library()[0], Material(9, "twin", 430.0, 430.0, 625.0, 625.0, 0.0, 0.1, 50)]
    lost = mixtures.drift(mixtures.modes(moments(base, GRID), twins, 12), twins).first()
    assert sorted(lost.rejected) == ["m1", "twin"] and lost.residual is None and lost.shift_n == 0


def series_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batch_equals_stream(spark, tmp_path):
    rows = cells(spark, [0, 10, 20, 30, 40], without={(2, 3), (3, 3)}).union(cells(spark, [0, 20, 40], seed=4, name="b"))
    timepoints = following.packed(moments(rows, GRID, by=("series", "t")))
    how = following.Following(model(), inert=(1, 2), rounds=12, least=0.03, noise=(4.0, 4.0), limit=3.0, reactive=frozenset({1, 2}))
    batch = following.follow(timepoints, how)
    want = series_rows(batch)
    got = {(r.series, r.t, r.class_id): r for r in batch.collect()}
    for t in range(5):
        assert abs(got["a", t, 1].shift_n - 10 * t) < 8
        assert abs(got["a", t, 2].neutron - (700 + 10 * t)) < 10
        assert got["a", t, 3].dormant == (t in (2, 3)) and got["a", t, 3].resurrected == (t == 4)
    assert got["a", 4, 3].cells > 80 and got["a", 3, 3].cells == 0
    assert any(r.clipped is not None for r in got.values())
    # as a stream: each file is a batch, one comes twice and one too late
    source = tmp_path / "in"
    parts = sorted(timepoints.collect(), key=lambda r: (r.t, r.series))
    order = [parts[:2], parts[2:3], parts[3:6], parts[0:1], parts[6:], parts[2:3]]
    for n, part in enumerate(order):
        spark.createDataFrame(part, timepoints.schema).coalesce(1).write.parquet(str(source / f"{n}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for n in range(len(order)):
        next((source / f"{n}").glob("part-*.parquet")).rename(flat / f"{n}.parquet")
    stream = spark.readStream.schema(timepoints.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    query = following.follow(stream, how).writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert series_rows(spark.table("followed")) == want
    labels = following.follow(timepoints, how, "labels")
    counts = {(r.series, r.t, r.label): r.n for r in labels.groupBy("series", "t", "label").agg(F.sum("c").alias("n")).collect()}
    assert all(counts.get(k, 0) == r.cells for k, r in got.items())
    assert following.follow(timepoints.limit(0), how).count() == 0


def test_memory_weighs_the_fit_before(spark):
    timepoints = following.packed(moments(cells(spark, [0, 30, 60]), GRID, by=("series", "t"))).cache()
    lags = []
    for memory in (0.0, 0.5, 1.0):
        got = {(r.t, r.class_id): r.neutron for r in following.follow(timepoints, following.Following(model(strength=0.8), rounds=5, memory=memory)).collect()}
        lags.append(760 - got[2, 2])
    assert 60 > lags[0] > lags[1] > lags[2] > 3
