"""Material classes: fitted from regions, matched to bins, compared with one another and over time.

Classes are few (a row each), so their numbers become literals. Cells are summed into bin moments once; scores and decisions are
made for each occupied bin, which keeps the cost of a class independent of the number of cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.functions.plane import Grid, Region, both_finite, class_of, in_any
from duovox.operators.histograms import EPSILON, binned, moments
from duovox.operators.spatial import _table

UNCLASSIFIED = 0
#: Rows of a match table (four numbers each) that are broadcast at most: some 20 MB.
BROADCAST = 500_000


@dataclass(frozen=True)
class Material:
    class_id: int
    name: str
    neutron: float
    xray: float
    var_n: float
    var_x: float
    cov: float
    weight: float
    n: int


def class_moments(cells: DataFrame, regions: list[Region], by: tuple[str, ...] = ()) -> DataFrame:
    """class_id (and by), n, means and sample covariance of the pairs of each class; the last region that holds a pair decides."""
    rows = cells.where(both_finite() & in_any(regions)).withColumn("class_id", class_of(regions))
    return rows.groupBy(*by, "class_id").agg(
        F.count("*").alias("n"), F.avg("neutron").alias("neutron_mean"), F.avg("xray").alias("xray_mean"),
        F.coalesce(F.var_samp("neutron"), F.lit(0.0)).alias("var_n"), F.coalesce(F.var_samp("xray"), F.lit(0.0)).alias("var_x"), F.coalesce(F.covar_samp("neutron", "xray"), F.lit(0.0)).alias("cov"),
    )


def class_library(cells: DataFrame, regions: list[Region]) -> DataFrame:
    """class_moments with weight, a class's share of all classified pairs."""
    out = class_moments(cells, regions)
    return out.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy()))


def materials(library: DataFrame, regions: list[Region]) -> list[Material]:
    """The library's rows, at most one for each region, ready to be used as literals; singular covariances get a small floor."""
    names = {r.class_id: r.name for r in regions}
    out = []
    for r in sorted(library.collect(), key=lambda r: r["class_id"]):
        a, d, b = r["var_n"], r["var_x"], r["cov"]
        if a * d - b * b <= 0 or a <= 0 or d <= 0:
            floor = max(1e-6 * max((a + d) / 2, 0.0), 1e-9)
            a, d = a + floor, d + floor
        out.append(Material(r["class_id"], names[r["class_id"]], r["neutron_mean"], r["xray_mean"], a, d, b, r["weight"], r["n"]))
    return out


def bin_score(m: Material) -> Column:
    """The mean log density of a bin's pairs under one Gaussian, plus the log weight, from the bin's moments (c, sn, sx, snn, sxx, snx)."""
    det = m.var_n * m.var_x - m.cov * m.cov
    if not (det > 0 and math.isfinite(det)):
        return F.lit(-math.inf)
    a, b, d = m.var_x / det, -m.cov / det, m.var_n / det
    c = F.col("c")
    mn, mx = F.col("sn") / c, F.col("sx") / c
    dn, dx = mn - m.neutron, mx - m.xray
    snn, sxx, snx = F.col("snn") / c - mn * mn, F.col("sxx") / c - mx * mx, F.col("snx") / c - mn * mx
    quadratic = a * dn * dn + 2 * b * dn * dx + d * dx * dx
    within = F.greatest(a * snn + 2 * b * snx + d * sxx, F.lit(0.0))
    return -0.5 * (2 * math.log(2 * math.pi) + math.log(det) + quadratic + within) + math.log(max(m.weight, 1e-12))


def match_table(bins: DataFrame, library: list[Material], grid: Grid, floor: float = 1e-4) -> DataFrame:
    """bins with label (a class, or 0 where a uniform density of weight floor matches better) and score. Ties go to the first class."""
    uniform = -math.log(grid.area) + math.log(floor)
    options = [F.struct(bin_score(m).alias("score"), F.lit(-k).alias("order"), F.lit(m.class_id).alias("label")) for k, m in enumerate(library)]
    options.append(F.struct(F.lit(uniform).alias("score"), F.lit(-len(library)).alias("order"), F.lit(UNCLASSIFIED).alias("label")))
    best = F.array_max(F.array(*options))
    return bins.withColumn("best", best).select(*bins.columns, F.col("best.label").alias("label"), F.col("best.score").alias("score"))


def locked_counts(cells: DataFrame, regions: list[Region], grid: Grid, defined_at: int = 0) -> DataFrame:
    """t, label, cells, bins: every timepoint matched to classes that are fitted at one timepoint. One pass over the cells, and one small one for the fit."""
    library = materials(class_library(cells.where(F.col("t") == defined_at), regions), regions)
    matched = match_table(moments(cells, grid), library, grid)
    return matched.groupBy("t", "label").agg(F.sum("c").alias("cells"), F.count("*").alias("bins"))


EXCLUDED = -1


def locked_budget(cells: DataFrame, regions: list[Region], grid: Grid, measured: Column, defined_at: int = 0) -> DataFrame:
    """t, label, cells of every cell: a class, 0 where none matches, EXCLUDED where the cell isn't measured, by the given policy. Cells
    measured but outside the grid count as 0, so a timepoint's rows add up to its cells."""
    ok = F.coalesce(measured & both_finite(), F.lit(False))
    fit = cells.where(ok)
    library = materials(class_library(fit.where(F.col("t") == defined_at), regions), regions)
    table = match_table(moments(fit, grid), library, grid).groupBy("t", "label").agg(F.sum("c").alias("cells"))
    sides = cells.groupBy("t").agg(F.count("*").alias("n"), F.count_if(ok).alias("measured"))  # a row for each t
    inside = table.groupBy("t").agg(F.sum("cells").alias("inside"))
    rest = sides.join(inside, "t", "left").select("t", F.inline(F.array(
        F.struct(F.lit(EXCLUDED).alias("label"), (F.col("n") - F.col("measured")).alias("cells")), F.struct(F.lit(UNCLASSIFIED).alias("label"), (F.col("measured") - F.coalesce("inside", F.lit(0))).alias("cells")),
    )))
    return table.select("t", "label", "cells").union(rest.select("t", "label", "cells")).groupBy("t", "label").agg(F.sum("cells").alias("cells")).where("cells > 0")


def budget_report(budget: DataFrame) -> DataFrame:
    """t, total, valid, excluded, unclassified, unclassified_share (of the measured cells), classes found."""
    one = lambda label: F.sum(F.when(F.col("label") == label, F.col("cells")).otherwise(0))
    out = budget.groupBy("t").agg(F.sum("cells").alias("total"), one(EXCLUDED).alias("excluded"), one(UNCLASSIFIED).alias("unclassified"), F.count_if(F.col("label") > 0).alias("classes"))
    valid = F.col("total") - F.col("excluded")
    return out.select("t", "total", valid.alias("valid"), "excluded", "unclassified", F.try_divide(F.col("unclassified"), valid).alias("unclassified_share"), "classes")


def retention(smoothed: DataFrame, plain: DataFrame) -> DataFrame:
    """t, label, kept: a class's cells with smoothing over those without (null where it had none)."""
    before = plain.where("label > 0").select("t", "label", F.col("cells").alias("before"))
    return before.join(smoothed.select("t", "label", "cells"), ["t", "label"], "left").select("t", "label", F.try_divide(F.coalesce("cells", F.lit(0)), F.col("before")).alias("kept"))


def guards(report: DataFrame, kept: DataFrame | None = None, most_unclassified: float = 0.5, least_kept: float = 0.2) -> DataFrame:
    """t, finding, value: reasons to refuse a result. Too many measured cells without a class, a budget that doesn't close, smoothing
    that takes a class away. A timepoint without measured cells is a finding too."""
    share = report.where(F.col("unclassified_share") > most_unclassified).select("t", F.lit("unclassified").alias("finding"), F.col("unclassified_share").alias("value"))
    empty = report.where("valid = 0").select("t", F.lit("nothing measured").alias("finding"), F.col("total").cast("double").alias("value"))
    gap = F.col("total") - F.col("valid") - F.col("excluded")
    out = share.union(empty).union(report.where(gap != 0).select("t", F.lit("budget").alias("finding"), gap.cast("double").alias("value")))
    return out if kept is None else out.union(kept.where(F.col("kept") < least_kept).select("t", F.concat(F.lit("smoothing of class "), "label").alias("finding"), "kept"))


def scores(labels: DataFrame, truth: str, prediction: str, classes: list[int]) -> DataFrame:
    """t, class_id, dice, volume_error of every class at every t: Dice is 1 where both are empty; the error is of shares of all cells of t."""
    hit = lambda c, k: F.coalesce(F.col(c) == k, F.lit(False))
    sums = labels.groupBy("t").agg(F.count("*").alias("n"), *[x for k in classes for x in (F.count_if(hit(truth, k)).alias(f"a{k}"), F.count_if(hit(prediction, k)).alias(f"b{k}"), F.count_if(hit(truth, k) & hit(prediction, k)).alias(f"c{k}"))])
    rows = sums.select("t", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("class_id"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"), F.col(f"c{k}").alias("c")) for k in classes])))
    dice = F.when(F.col("a") + F.col("b") == 0, 1.0).otherwise(2 * F.col("c") / (F.col("a") + F.col("b")))
    return rows.select("t", "class_id", dice.alias("dice"), ((F.col("b") - F.col("a")) / F.col("n")).alias("volume_error"))


def summary(scored: DataFrame) -> DataFrame:
    """class_id, dice: means over t; class_id null is the mean of the classes' means."""
    each = scored.groupBy("class_id").agg(F.avg("dice").alias("dice"))
    return each.union(each.agg(F.lit(None).cast("int").alias("class_id"), F.avg("dice").alias("dice")))


def best_matching(matrix: DataFrame) -> DataFrame:
    """prediction, truth, n of the one-to-one matching of clusters to classes with the largest overlap; the least such in order of
    classes. The confusion table, clusters x classes rows, goes to the driver; it is solved over sets of classes used, so at most 16 classes."""
    rows = matrix.where("prediction IS NOT NULL AND truth IS NOT NULL").collect()
    clusters_, classes = (sorted({r[c] for r in rows}) for c in ("prediction", "truth"))
    if len(classes) > 16:
        raise ValueError("more than 16 classes")
    n = {(r["prediction"], r["truth"]): r["n"] for r in rows}
    best = {0: (0, ())}
    for p in clusters_:
        step = {}
        for used, (total, path) in best.items():
            for k, c in [*enumerate(classes), (None, None)]:
                if k is not None and used >> k & 1:
                    continue
                key = used if k is None else used | 1 << k
                option = (total + (0 if k is None else n.get((p, c), 0)), path if k is None else (*path, (p, c)))
                if key not in step or (-option[0], option[1]) < (-step[key][0], step[key][1]):
                    step[key] = option
        best = step
    pairs = min(best.values(), key=lambda o: (-o[0], -len(o[1]), o[1]), default=(0, ()))[1]
    return matrix.sparkSession.createDataFrame([(p, c, n.get((p, c), 0)) for p, c in pairs], "prediction int, truth int, n long")


def class_pairs(library: DataFrame) -> DataFrame:
    """first, second, overlap (Bhattacharyya), elongation of the first, and the angle in degrees of its long axis to the line between both: null if it has none. A few classes pair up."""
    a, d, o = F.col("var_n"), F.col("var_x"), F.col("cov")
    root = F.sqrt((a - d) ** 2 / 4 + o * o)
    long_, short = (a + d) / 2 + root, F.greatest((a + d) / 2 - root, F.lit(0.0))
    axis = F.when(o != 0, F.atan2(long_ - a, o)).otherwise(F.when(a >= d, 0.0).otherwise(math.pi / 2))
    one = library.select(F.col("class_id").alias("first"), "neutron_mean", "xray_mean", a, d, o, F.when(short > 0, F.sqrt(long_ / short)).otherwise(F.when(long_ > 0, math.inf).otherwise(1.0)).alias("elongation"), axis.alias("axis"))
    two = library.select(F.col("class_id").alias("second"), *[F.col(c).alias(f"o_{c}") for c in ("neutron_mean", "xray_mean", "var_n", "var_x", "cov")])
    dn, dx = F.col("neutron_mean") - F.col("o_neutron_mean"), F.col("xray_mean") - F.col("o_xray_mean")
    mn, mx, mo = ((F.col(c) + F.col(f"o_{c}")) / 2 for c in ("var_n", "var_x", "cov"))
    det, dets = mn * mx - mo * mo, (a * d - o * o) * (F.col("o_var_n") * F.col("o_var_x") - F.col("o_cov") ** 2)
    distance = ((mx * dn * dn - 2 * mo * dn * dx + mn * dx * dx) / det) / 8 + F.log(det / F.sqrt(dets)) / 2
    angle = F.degrees(F.acos(F.least(F.abs(F.cos("axis") * dn + F.sin("axis") * dx) / F.hypot(dn, dx), F.lit(1.0))))
    fine = (F.col("elongation") >= 1.05) & (F.hypot(dn, dx) > 0)
    return one.join(two, F.col("first") != F.col("second")).select("first", "second", F.when((det > 0) & (dets > 0), F.exp(-F.greatest(distance, F.lit(0.0)))).alias("overlap"), "elongation", F.when(fine, angle).alias("angle"))


def locked_labels(cells: DataFrame, regions: list[Region], grid: Grid, defined_at: int = 0) -> DataFrame:
    """The finite cells in the grid with their label: the match table, at most bins x bins rows for a t, goes back to the cells by bin.

    It is written and counted: up to BROADCAST rows it is broadcast, so that hot bins need no shuffle; beyond, adaptive joins split them."""
    library = materials(class_library(cells.where(F.col("t") == defined_at), regions), regions)
    table = _table(match_table(moments(cells, grid), library, grid).select("t", "iy", "ix", "label"))
    table = F.broadcast(table) if table.count() <= BROADCAST else table
    return binned(cells, grid, "drop").join(table, ["t", "iy", "ix"]).drop("iy", "ix")


def class_metrics(cells: DataFrame, regions: list[Region]) -> DataFrame:
    """t, class_id, n, centroid, population deviations, elongation, and drift from the class's centroid at the first t."""
    rows = cells.where(both_finite() & in_any(regions)).withColumn("class_id", class_of(regions))
    each = rows.groupBy("t", "class_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c[0]}") for c in ("neutron", "xray") for p, f in (("centroid", F.avg), ("sigma", F.stddev_pop))])
    most, least = F.greatest("sigma_n", "sigma_x"), F.greatest(F.least("sigma_n", "sigma_x"), F.lit(EPSILON))
    first = Window.partitionBy("class_id").orderBy("t")
    drift = F.hypot(F.col("centroid_n") - F.first("centroid_n").over(first), F.col("centroid_x") - F.first("centroid_x").over(first))
    return each.withColumns({"elongation": F.when(most <= EPSILON, 1.0).otherwise(most / least), "drift": drift})


def davies_bouldin(metrics: DataFrame) -> DataFrame:
    """t, davies_bouldin: the mean over classes of the worst ratio of summed spreads to centroid distance. Classes of one t pair up: a few rows."""
    one = metrics.select("t", "class_id", "centroid_n", "centroid_x", F.sqrt((F.col("sigma_n") ** 2 + F.col("sigma_x") ** 2) / 2).alias("spread"))
    two = one.select("t", *[F.col(c).alias(f"o_{c}") for c in one.columns[1:]])
    pairs = one.join(two, "t").where("class_id != o_class_id")
    distance = F.hypot(F.col("centroid_n") - F.col("o_centroid_n"), F.col("centroid_x") - F.col("o_centroid_x"))
    worst = pairs.where(distance > EPSILON).groupBy("t", "class_id").agg(F.max((F.col("spread") + F.col("o_spread")) / distance).alias("worst"))
    return worst.groupBy("t").agg(F.avg("worst").alias("davies_bouldin"))


def confusion(labels: DataFrame, truth: str, prediction: str) -> DataFrame:
    return labels.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def agreement(matrix: DataFrame) -> DataFrame:
    """label, iou, dice of each label of a confusion table (null where a label never occurs), and kappa of all."""
    sides = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("row")), F.struct(F.col("prediction").alias("label"), F.lit(False).alias("row"))))
    each = matrix.select("truth", "prediction", "n", sides.alias("s")).groupBy("s.label").agg(
        F.sum(F.when(F.col("s.row"), F.col("n")).otherwise(0)).alias("rows"), F.sum(F.when(~F.col("s.row"), F.col("n")).otherwise(0)).alias("columns"),
        F.sum(F.when(F.col("s.row") & (F.col("truth") == F.col("prediction")), F.col("n")).otherwise(0)).alias("hits"),
    )
    every = Window.partitionBy()  # one row for each label
    total = F.sum("rows").over(every)
    observed, expected = F.sum("hits").over(every) / total, F.sum((F.col("rows") / total) * (F.col("columns") / total)).over(every)
    union = F.col("rows") + F.col("columns") - F.col("hits")
    full = each.withColumn("total", total).withColumn("observed", observed).withColumn("part", (F.col("rows") / F.col("total")) * (F.col("columns") / F.col("total")))
    full = full.withColumn("expected", F.sum("part").over(every))
    return full.select("label", F.try_divide(F.col("hits"), union).alias("iou"), F.try_divide(2 * F.col("hits"), F.col("rows") + F.col("columns")).alias("dice"), F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0))).alias("kappa"))


def calibration(references: DataFrame) -> DataFrame:
    """channel, gain, offset of measured over known values of (channel, known, measured): least squares; channels need two distinct references."""
    fit = references.groupBy("channel").agg(F.regr_slope("measured", "known").alias("gain"), F.regr_intercept("measured", "known").alias("offset"), F.countDistinct("known").alias("k"))
    return fit.where("k >= 2").drop("k")


def otsu_threshold(cells: DataFrame, channel: str, grid: Grid) -> DataFrame:
    """threshold_bin, between_variance: the split of a channel's histogram (grid.bins rows) with the largest variance between both sides."""
    index = grid.neutron_bin() if channel == "neutron" else grid.xray_bin()
    hist = cells.where(both_finite()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    upto, every = Window.orderBy("bin"), Window.partitionBy()
    s = hist.withColumns({"w0": F.sum("n").over(upto).cast("double"), "m0": F.sum(F.col("n") * F.col("bin")).over(upto).cast("double"), "w": F.sum("n").over(every), "m": F.sum(F.col("n") * F.col("bin")).over(every)})
    w1 = F.col("w") - F.col("w0")
    between = F.col("w0") * w1 * (F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / F.nullif(w1, F.lit(0.0))) ** 2 / F.col("w") / F.col("w")
    return s.where(w1 > 0).select(F.col("bin").alias("threshold_bin"), between.alias("between_variance")).orderBy(F.desc("between_variance"), "threshold_bin").limit(1)


def balanced_sample(labels: DataFrame, label: str, order: Column, each: int) -> DataFrame:
    """At most `each` rows of each label, by the given order (a sampling operator: the bound is its purpose)."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return labels.withColumn("place", place).where(F.col("place") <= each).drop("place")
