"""Findings on counts with one planted fault each."""

from duovox.operators import health


def found(spark, rows, classes=(1, 2), **more):
    counts = spark.createDataFrame(rows, "t int, label int, cells long, plain_cells long")
    return sorted((r.finding, r.status, r.class_id, r.t, None if r.value is None else round(r.value, 4)) for r in health.health(counts, list(classes), **more).collect())


def series(changes=(), times=4):
    """Two classes of 100 and 50 cells, 3 without class and 7 that weren't measured, at each t; changes: (t, label) to (cells, plain_cells)."""
    base = {(t, k): (n, n) for t in range(times) for k, n in ((1, 100), (2, 50), (0, 3), (-1, 7))}
    base.update(dict(changes))
    return [(t, k, *n) for (t, k), n in base.items()]


def test_a_clean_series(spark):
    assert found(spark, series(), controls=[1]) == [("budget", "pass", None, None, 0.0), ("classes present", "pass", None, None, 2.0), ("controls", "pass", None, None, 0.0), ("unclassified", "pass", None, 0, 0.0196), ("usable data", "pass", None, None, 0.9563)]


def test_each_fault(spark):
    by_smoothing = found(spark, series([((2, 2), (0, 50)), ((2, 1), (150, 100))]))
    assert ("lost by smoothing", "fail", 2, 2, 50.0) in by_smoothing and ("no controls", "warn", None, None, None) in by_smoothing and ("budget", "pass", None, None, 0.0) in by_smoothing
    assert ("lost", "fail", 2, 1, 0.0) in found(spark, series([((1, 2), (0, 0)), ((3, 2), (0, 0))]))
    assert ("controls", "fail", 1, None, 0.0825) in found(spark, series([((3, 1), (120, 120))]), controls=[1, 2])
    assert ("unclassified", "fail", None, 2, 0.2105) in found(spark, series([((2, 0), (40, 40)), ((3, 0), (40, 40))]))
    assert ("budget", "fail", None, 1, 9.0) in found(spark, series([((1, 0), (12, 3))]))
    assert ("usable data", "warn", None, 3, 0.1835) in found(spark, series([((3, -1), (45, 45))]))


def test_births_predictions_and_what_is_handed_in(spark):
    late = found(spark, series([((0, 2), (0, 0)), ((1, 2), (0, 0))]), classes=(1, 2, 5), born={2: 2}, predicted=[5], dropped=[9])
    assert ("appears", "pass", 2, 2, 2.0) in late and ("predicted class not found", "warn", 5, None, None) in late and ("classes defined", "fail", 9, None, None) in late and not [r for r in late if r[0].startswith("lost")]
    assert ("appears", "pass", 2, 2, 2.0) in found(spark, series([((0, 2), (0, 0)), ((1, 2), (0, 0))]), predicted=[2])
    sides = spark.createDataFrame([(0, 0.001), (1, 0.3)], "t int, share double")
    mixing = spark.createDataFrame([(0, 2, True), (3, 2, False)], "t int, class_id int, accepted boolean")
    rows = found(spark, series(), one_sided=sides, mixing=mixing, smoothing=(0.5, False))
    assert {("field of view", "warn", None, 1, 0.3), ("mixed boundaries", "warn", 2, 3, None), ("smoothing strength", "warn", None, None, 0.5)} <= set(rows)


def test_nothing_segmented(spark):
    assert found(spark, series()[:0]) == [("nothing segmented", "fail", None, None, None)]
