import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duovox.functions.plane import Grid, Region, bin_of, class_of, in_any, in_polygon
from duovox.operators import clusters, histograms, islands, materials, quantiles, smoothing, spatial, statistics

NAN, INF = float("nan"), float("inf")


def cells(spark, rows):
    return spark.createDataFrame(rows, "t int, neutron double, xray double")


def volume(spark, array, t=0, second=None):
    second = array if second is None else second
    rows = [(t, *map(int, at), float(v), float(second[at])) for at, v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, "t int, z int, y int, x int, neutron double, xray double")


def random_pairs(n=400, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 3)), float(a), float(b)) for a, b in rng.normal([0, 3], [1, 2], (n, 2))]


def test_bins_close_the_upper_edge_and_clamp(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 0.99, 1.0, 9.99, 10.0, -5.0, 20.0)], "v double")
    assert [r[0] for r in rows.select(bin_of(F.col("v"), 0.0, 10.0, 10)).collect()] == [0, 0, 1, 9, 9, 0, 9]


def test_histogram_matches_numpy_and_drops_non_finite_pairs(spark):
    data = random_pairs()
    table = cells(spark, data + [(0, NAN, 1.0), (0, 1.0, INF), (1, None, 2.0)])
    grid = histograms.plane_grid(table, 12)
    got = np.zeros((12, 12))
    for r in histograms.histogram(table.repartition(7), grid, by=()).collect():
        got[r.iy, r.ix] = r["count"]
    n, x = np.array(data)[:, 1], np.array(data)[:, 2]
    want, _, _ = np.histogram2d(x, n, bins=12, range=[[x.min(), x.max()], [n.min(), n.max()]])
    assert (got == want).all() and got.sum() == len(data)


def test_grid_of_constant_and_of_no_pairs(spark):
    grid = histograms.plane_grid(cells(spark, [(0, 5.0, 1.0)] * 3), 4)
    assert (grid.n_lo, grid.n_hi) == (4.5, 5.5)
    with pytest.raises(ValueError):
        histograms.plane_grid(cells(spark, [(0, NAN, 1.0)]))


def test_outside_pairs_are_clamped_or_dropped(spark):
    grid = Grid(0.0, 1.0, 0.0, 1.0, 2)
    table = cells(spark, [(0, 2.0, 0.1), (0, 0.6, 0.6)])
    assert histograms.histogram(table, grid).agg(F.sum("count")).first()[0] == 2
    assert histograms.histogram(table, grid, outside="drop").agg(F.sum("count")).first()[0] == 1


def test_shape_metrics_match_numpy(spark):
    table = cells(spark, [(0, a, b) for _, a, b in random_pairs()])
    grid = histograms.plane_grid(table, 8)
    hist = histograms.histogram(table, grid)
    d = np.zeros((8, 8))
    for r in hist.collect():
        d[r.iy, r.ix] = r["count"]
    d /= d.sum()
    got = histograms.shape_metrics(hist, grid).first()
    assert math.isclose(got.s_h, d.var(axis=1).max() / (d.var(axis=0).mean() + 1e-12), rel_tol=1e-9)
    assert math.isclose(got.s_v, d.var(axis=0).max() / (d.var(axis=1).mean() + 1e-12), rel_tol=1e-9)
    assert got.delta_n == 0


def test_log_differences_cover_bins_that_come_and_go(spark):
    hist = spark.createDataFrame([(0, 0, 0, 9), (1, 0, 1, 99)], "t int, iy int, ix int, count long")
    assert {(r.ix, round(r.log_difference, 9)) for r in histograms.log_differences(hist).collect()} == {(0, -1.0), (1, 2.0)}


def test_regions_rectangle_polygon_last_wins_hidden(spark):
    square = Region("a", 1, rectangle=(0.0, 10.0, 0.0, 10.0))
    tri = Region("b", 2, points=((5.5, 5.5), (20.5, 5.5), (5.5, 20.5)))
    gone = Region("c", 3, rectangle=(0.0, 99.0, 0.0, 99.0), visible=False)
    table = cells(spark, [(0, 0.0, 10.0), (0, 7.0, 7.0), (0, 15.0, 6.0), (0, 30.0, 30.0)])
    assert [r[0] for r in table.select(class_of([square, tri, gone])).collect()] == [1, 2, 2, 0]
    assert table.where(in_any([square, tri, gone])).count() == 3
    with pytest.raises(ValueError):
        in_any([gone])
    with pytest.raises(ValueError):
        Region("d", 4, rectangle=(1.0, 1.0, 0.0, 2.0))
    assert square.area() == 100 and tri.area() == 112.5


def test_self_crossing_polygon_follows_the_winding_rule(spark):
    star = [(0.0, 3.0), (10.0, 3.0), (2.0, 9.0), (5.0, -1.0), (8.0, 9.0)]
    table = cells(spark, [(0, 5.0, 4.0), (0, 0.5, 8.0)])
    assert [r[0] for r in table.select(in_polygon(F.col("neutron"), F.col("xray"), star)).collect()] == [True, False]


def test_validity_coverage_and_steps(spark):
    table = cells(spark, [(0, 1.0, 1.0), (0, 0.0, 1.0), (0, NAN, 1.0), (1, 0.0, 0.0), (1, 2.0, 2.0), (1, 3.0, 0.0)])
    report = statistics.validity_report(table)
    assert {tuple(r)[:6] for r in report.collect()} == {(0, 3, 1, 2, 1, 1), (1, 3, 1, 2, 0, 2)}
    assert {tuple(r) for r in statistics.coverage(table).collect()} == {(0, 1, 0, 2, 0), (1, 1, 1, 0, 1)}
    assert statistics.acquisition_steps(report).collect() == []


def test_empty_selection_has_null_statistics(spark):
    r = statistics.selection_stats(cells(spark, [(0, 1.0, 1.0)]), F.col("neutron") > 5).first()
    assert (r.selected, r.total, r.neutron_mean) == (0, 1, None)


def test_trends_events_and_runs(spark):
    series = spark.createDataFrame([("a", t, v) for t, v in enumerate((1.0, 2.0, 3.0, 3.1))] + [("b", 0, 1.0), ("c", 0, -1.0), ("c", 1, -9.0)], "name string, t int, v double")
    got = {r.name: r for r in statistics.trends(series, "v").collect()}
    slope, intercept = np.polyfit(range(4), (1.0, 2.0, 3.0, 3.1), 1)
    assert set(got) == {"a", "c"} and math.isclose(got["a"].slope, slope) and math.isclose(got["a"].intercept, intercept)
    assert [(r.name, r.t, r.kind) for r in statistics.change_events(series, "v", 10).orderBy("t").collect()] == [("a", 1, "increase"), ("a", 2, "increase")]
    runs = spark.createDataFrame([("a", t) for t in (0, 1, 2, 5, 7, 8)], "name string, t int")
    assert sorted((r.first_t, r.last_t) for r in statistics.presence_runs(runs).collect()) == [(0, 2), (5, 5), (7, 8)]


def test_bin_moments_and_labels_agree_with_cells(spark):
    rng = np.random.default_rng(1)
    rows = [(t, float(a), float(b)) for t in (0, 1) for c in ((400, 400), (900, 900)) for a, b in rng.normal(c, 30, (60, 2))]
    regions = [Region("air", 1, rectangle=(300.0, 500.0, 300.0, 500.0)), Region("steel", 2, rectangle=(800.0, 1000.0, 800.0, 1000.0))]
    table = cells(spark, rows)
    grid = histograms.plane_grid(table, 32)
    counts = {(r.t, r.label): r.cells for r in materials.locked_counts(table, regions, grid).collect()}
    assert counts[0, 1] == counts[1, 1] == 60 and counts[0, 2] == counts[1, 2] == 60
    labels = materials.locked_labels(table, regions, grid)
    assert labels.count() == 240 and labels.where((F.col("neutron") < 650) != (F.col("label") == 1)).count() == 0


def test_agreement_edge_cases(spark):
    same = materials.confusion(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), "a", "b")
    r = materials.agreement(same).first()
    assert (r.iou, r.dice, r.kappa) == (1.0, 1.0, None)


def test_cube_faces_and_mass(spark):
    mask = np.zeros((10, 10, 10), int)
    mask[2:6, 2:6, 2:6] = 1
    table = volume(spark, mask).withColumn("label", F.col("neutron").cast("int"))
    assert spatial.surface(table, "label").first().faces == 96
    assert spatial.interface(table, 0, 1).first().faces == 96
    got = {r.label: r for r in spatial.mass(table).collect()}[1]
    assert (got.n, got.centre_z, got.centre_y, got.centre_x) == (64, 3.5, 3.5, 3.5)
    assert {(r.k, r.l): r.n for r in spatial.adjacency(table).collect()}[1, 1] == 2 * 3 * 48


def test_components_and_growing_against_search(spark):
    rng = np.random.default_rng(5)
    array = (rng.random((5, 6, 7)) < 0.5).astype(int)
    seen, groups = {}, []
    for at in zip(*np.nonzero(array)):
        if at in seen:
            continue
        todo, group = [at], set()
        while todo:
            p = todo.pop()
            if p in group or not all(0 <= c < s for c, s in zip(p, array.shape)) or not array[p]:
                continue
            group.add(p)
            todo += [tuple(np.add(p, d)) for axis in np.eye(3, dtype=int) for d in (axis, -axis)]
        seen.update(dict.fromkeys(group, len(groups)))
        groups.append(frozenset(group))
    table = volume(spark, array)
    got = {}
    for r in spatial.connected(table, F.col("neutron") == 1).collect():
        got.setdefault(r.component, set()).add((r.z, r.y, r.x))
    assert set(map(frozenset, got.values())) == set(groups)
    seed = next(iter(groups[0]))
    own = spatial.grown(table, (0, *map(int, seed)), "neutron", 0.5).collect()
    assert {(r.z, r.y, r.x) for r in own} == set(groups[0])
    assert spatial.grown(table, (0, 99, 0, 0), "neutron", 0.5).collect() == []


def test_slabs_smooth_like_the_whole_volume(spark):
    rng = np.random.default_rng(6)
    table = volume(spark, rng.random((23, 4, 5))).withColumns({"u0": -F.col("neutron"), "u1": F.col("neutron") - 1})
    results = [{tuple(r)[:4]: r.label for r in smoothing.smoothed(table, ["u0", "u1"], 0.3, 3, "icm", tile=s).collect()} for s in ((4, 4, 4), (7, 64, 2), (64, 64, 64))]
    assert results[0] == results[1] == results[2] and len(results[0]) == 23 * 20


def test_blocks_leave_out_partial_ones(spark):
    array = np.arange(7 * 9 * 11, dtype=float).reshape(7, 9, 11)
    got = {(r.z, r.y, r.x): r.median for r in spatial.block_median(volume(spark, array), 2).collect()}
    assert len(got) == 3 * 4 * 5 and got[1, 2, 3] == np.median(array[2:4, 4:6, 6:8])


def test_quantiles_are_exact_without_a_map_of_values(spark, monkeypatch):
    rng = np.random.default_rng(11)
    groups = {0: rng.lognormal(0, 5, 3001), 1: rng.integers(0, 4, 1000).astype(float), 2: [7.5], 3: [-INF, -1.0, 2.0, INF], 4: [None, None], None: rng.normal(0, 1, 500)}
    rows = spark.createDataFrame([(t, None if v is None else float(v), 0.0) for t, vs in groups.items() for v in vs], "t int, neutron double, xray double").repartition(5)
    want = {r.t: list(r.q) if r.q else None for r in rows.groupBy("t").agg(F.percentile("neutron", F.array(F.lit(0.0), F.lit(0.16), F.lit(0.5), F.lit(1.0))).alias("q")).collect()}
    for most in (1, 40, 10**6):  # the least cuts again and again
        got = {r.t: list(r.q) if r.q else None for r in quantiles.exact_quantiles(rows, ["t"], "neutron", [0.0, 0.16, 0.5, 1.0], most).collect()}
        assert got == want
    assert quantiles.exact_quantiles(rows.limit(0), ["t"], "neutron", [0.5]).collect() == []
    some = rows.where("t < 2 AND neutron IS NOT NULL").withColumn("z", F.col("t"))
    profile = {r.z: r.neutron_median for r in statistics.axial_profile(some, "z", "median").collect()}
    assert profile == {t: np.median(groups[t]) for t in (0, 1)}

    def never(*_):
        raise AssertionError("a map of all distinct values of a group")

    for name in ("percentile", "median"):
        monkeypatch.setattr(F, name, never)
    statistics.auto_floor(some).collect()
    statistics.axial_profile(some, "z", "median").collect()
    statistics.quantile_bands(some, "t", "neutron").collect()


def test_clusters_of_a_series(spark):
    rng = np.random.default_rng(7)
    rows = [(t, float(a), float(b)) for t in (0, 1) for c in ((0, 0), (50, 50)) for a, b in rng.normal(c, 1, (40, 2))]
    table = cells(spark, rows)
    got = clusters.cluster_series(table, histograms.plane_grid(table, 16), 2, transient=False).collect()
    assert len(got) == 4 and all(r.cells == 40 and r.fraction == 0.5 and r.present and not r.transient_phase for r in got)


def test_correlation_of_histograms(spark):
    rng = np.random.default_rng(9)
    stack = rng.integers(0, 5, (3, 6, 6))
    rows = [(t, y, x, int(stack[t, y, x])) for t, y, x in np.ndindex(stack.shape) if stack[t, y, x]]
    got = {r.t: r.pearson for r in histograms.correlation(spark.createDataFrame(rows, "t int, iy int, ix int, count long"), 6).collect()}
    assert got == pytest.approx({t: np.corrcoef(stack[0].ravel(), stack[t].ravel())[0, 1] for t in range(3)})
    even = spark.createDataFrame([(t, y, x, 1) for t, y, x in np.ndindex(2, 2, 2)], "t int, iy int, ix int, count long")
    assert [r.pearson for r in histograms.correlation(even, 2).collect()] == [None, None]


def test_robust_grid(spark):
    values = np.random.default_rng(4).normal(size=(3000, 2)).tolist()
    grid = histograms.robust_grid(cells(spark, [*[(0, *v) for v in values], (1, NAN, 1e9), (1, None, 1e9)]), 8, tail=0.01)
    n, x = zip(*values)
    assert (grid.n_lo, grid.n_hi, grid.x_lo, grid.x_hi) == pytest.approx((*np.quantile(n, [0.01, 0.99]), *np.quantile(x, [0.01, 0.99])))
    with pytest.raises(ValueError):
        histograms.robust_grid(cells(spark, [(0, NAN, 1.0)]), 8)


def plain_islands(hist, t_count, bins):
    """Masks of islands, the largest first: each step as it is stated, bin by bin."""
    stack = np.zeros((t_count, bins, bins))
    for (t, y, x), n in hist.items():
        stack[t, y, x] = n
    weight = [math.exp(-k * k / 2) for k in range(-4, 5)]
    blurred = stack
    for axis in (1, 2):
        wide = np.pad(blurred, [(4, 4) if i == axis else (0, 0) for i in range(3)], mode="symmetric")
        blurred = sum(w / sum(weight) * np.take(wide, range(k, k + bins), axis) for k, w in enumerate(weight))
    share = (blurred >= 0.5).mean(axis=0)
    near = lambda y, x: [(v, u) for v in range(max(0, y - 1), min(bins, y + 2)) for u in range(max(0, x - 1), min(bins, x + 2))]
    spots = {at for at in np.ndindex(bins, bins) if 0 < share[at] < 0.5}
    for _ in range(4):
        spots |= {b for a in spots for b in near(*a) if share[b] < 0.5}
    out = []
    while spots:
        todo, own = [min(spots)], set()
        while todo:
            at = todo.pop()
            if at in spots:
                spots.remove(at)
                own.add(at)
                todo += near(*at)
        each = sum(stack[:, y, x] for y, x in own)
        if each.max() >= 10 and each.max() >= np.median(each) + 5 * math.sqrt(np.median(each) + 1) and each.min() <= 0.2 * each.max():
            out.append((-each.max(), min(own), own))
    return [(-p, own) for p, _, own in sorted(out)]


def test_transient_islands(spark):
    rng = np.random.default_rng(3)
    rows = [(t, *c) for t in range(5) for c in rng.normal((10, 10), 1.5, (400, 2)).tolist()]
    rows += [(t, *c) for t, at, n in ((1, (30, 30), 60), (3, (5, 35), 90), (2, (35, 4), 6)) for c in rng.normal(at, 0.5, (n, 2)).tolist()]
    table = cells(spark, [*rows, (0, 0.0, 0.0), (0, 40.0, 40.0), (0, NAN, 1.0), (1, None, 2.0), (1, 3.0, INF)])
    grid = histograms.plane_grid(table, 40)
    hist = histograms.histogram(table, grid)
    plane, peaks = islands.transient_islands(hist, 40)
    want = plain_islands({(r.t, r.iy, r.ix): r["count"] for r in hist.collect()}, 5, 40)
    assert len(peaks) >= 2 and peaks == [p for p, _ in want] and all({tuple(map(int, a)) for a in zip(*np.nonzero(plane == k))} == own for k, (_, own) in enumerate(want))
    counts = {(r.island, r.t): r.cells for r in islands.island_counts(hist, plane, peaks).collect()}
    assert len(counts) == 5 * len(peaks) and [max(counts[k, t] for t in range(5)) for k in range(len(peaks))] == peaks
    found = clusters.series_plane(hist, grid, 2)
    assert len(found.centres) == 2 + len(peaks) and (found.labels >= 2).sum() == (plane >= 0).sum()
    line = clusters.timeline(hist, found).collect()
    labelled = clusters.label_cells(table.withColumn("cluster", F.lit("old")), found)
    assert labelled.columns == ["t", "neutron", "xray", "cluster"] and labelled.where("cluster = -1").count() == 3
    of_cells = {(r.t, r.cluster): r["count"] for r in labelled.where("cluster >= 0").groupBy("t", "cluster").count().collect()}
    assert len(line) == 5 * len(found.centres) and of_cells == {(r.t, r.cluster): r.cells for r in line if r.cells}
    assert {(r.cluster, r.t) for r in line if r.transient_phase and r.present} == {(k + 2, t) for (k, t), n in counts.items() if n and n / sum(r.cells for r in line if r.t == t) >= 0.001}


def test_no_islands_without_two_timepoints(spark):
    for rows in ([], [(0, 1.0, 1.0), (0, 9.0, 9.0)]):
        table = spark.createDataFrame([(t, 1, 1, 5) for t, *_ in rows], "t int, iy int, ix int, count long")
        plane, peaks = islands.transient_islands(table, 8)
        assert peaks == [] and (plane == -1).all() and islands.island_counts(table, plane, peaks).count() == 0


def test_hourly_windows_on_a_stream(spark, tmp_path):
    from duovox.streaming.windows import hourly

    events = spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT TIMESTAMP '2024-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT TIMESTAMP '2024-01-01 05:00:00', 'b', 4.0D")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = hourly(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    job.awaitTermination()
    want = {tuple(r) for r in hourly(events).collect()}
    assert {tuple(r) for r in spark.table("hours").collect()} == want and len(want) == 2


def test_kmeans_of_cells_finds_separate_groups(spark):
    rng = np.random.default_rng(11)
    rows = [(t, float(u), float(v)) for t in (0, 1) for c, n in (((0, 0), 40), ((50, 900), 60), ((200, 100), 50)) for u, v in rng.normal(c, (1, 5), (n, 2))]
    rows += [(0, float("nan"), 1.0), (1, None, 2.0)]
    cells = spark.createDataFrame(rows, "t int, neutron double, xray double").repartition(3)
    got = sorted((r.t, round(r.neutron_mean / 50), r.n) for r in clusters.cluster_cells(cells, 3).collect())
    assert got == [(t, m, n) for t in (0, 1) for m, n in ((0, 40), (1, 60), (4, 50))]


def test_kmeans_of_cells_does_not_depend_on_partitions_and_keeps_no_pairs(spark):
    rng = np.random.default_rng(5)
    cells = spark.createDataFrame([(i % 2, float(u), float(v)) for i, (u, v) in enumerate(rng.uniform(0, 1, (4000, 2)))], "t int, neutron double, xray double")
    got = []
    for n in (1, 3, 7):
        spark.catalog.clearCache()
        kept = spark.sparkContext._jsc.getPersistentRDDs().size()
        rows = sorted((r.t, r.cluster, r.n, round(r.neutron_mean, 9), round(r.xray_mean, 9)) for r in clusters.cluster_cells(cells.repartition(n), 3).collect())
        assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept
        got.append(rows)
    assert got[0] == got[1] == got[2] and sum(r[2] for r in got[0]) == 4000


def test_kmeans_of_cells_with_far_ones_or_few_pairs(spark):
    far = spark.createDataFrame([(0, x, y) for x, y, n in ((0.0, 0.0, 50), (1.0, 0.0, 50), (1e9, 1e9, 2)) for _ in range(n)], "t int, neutron double, xray double")
    assert sorted(r.n for r in clusters.cluster_cells(far, 3).collect()) == [2, 50, 50]
    few = spark.createDataFrame([(0, 1.0, 2.0)] * 4 + [(0, 3.0, 2.0)], "t int, neutron double, xray double")
    assert sorted(r.n for r in clusters.cluster_cells(few, 3).collect()) == [1, 4]
    assert [r.n for r in clusters.cluster_cells(few.where("neutron = 1"), 3).collect()] == [4]
