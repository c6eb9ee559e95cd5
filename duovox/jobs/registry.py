"""The registered queries of the paired-measurement operators, each with SQL of the same rows where SQL can express it.

Doubles are rounded on both sides: sums of another order differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duovox.functions.plane import Grid, Region, class_of, in_any
from duovox.operators import clusters, histograms, materials, smoothing, spatial, statistics
from duovox.sources.paired import grid_events, paired_lineitem, with_labels
from duovox.streaming import windows

BINS = 64
REGIONS = [
    Region("low", 1, rectangle=(1.0, 15.0, 900.0, 30000.0)),
    Region("middle", 2, points=((10.5, 10000.5), (40.5, 20000.5), (35.5, 60000.5), (12.5, 40000.5))),
    Region("high", 3, rectangle=(30.0, 50.0, 50000.0, 105000.0)),
    Region("hidden", 4, rectangle=(0.0, 50.0, 0.0, 105000.0), visible=False),
]
FLAGSHIP = "locked_counts"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def lineitem_grid(spark: SparkSession, sf_dir: str, bins: int = BINS) -> tuple[DataFrame, Grid]:
    cells = paired_lineitem(spark, sf_dir)
    return cells, histograms.plane_grid(cells, bins)


def lineitem_hist(spark: SparkSession, sf_dir: str, bins: int = BINS) -> tuple[DataFrame, Grid]:
    cells, grid = lineitem_grid(spark, sf_dir, bins)
    return histograms.histogram(cells, grid), grid


def labelled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_labels(grid_events(spark, sf_dir))


def _winding(points) -> str:
    terms = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        left = f"(({bx - ax}) * (xray - ({ay})) - (neutron - ({ax})) * ({by - ay}))"
        terms.append(f"CASE WHEN {ay} <= xray AND {by} > xray AND {left} > 0 THEN 1 WHEN {ay} > xray AND {by} <= xray AND {left} < 0 THEN -1 ELSE 0 END")
    return "(" + " + ".join(terms) + ") <> 0"


_LOW = "(neutron BETWEEN 1 AND 15 AND xray BETWEEN 900 AND 30000)"
_MIDDLE = f"({_winding(REGIONS[1].points)})"
_HIGH = "(neutron BETWEEN 30 AND 50 AND xray BETWEEN 50000 AND 105000)"
_CLASS = f"CASE WHEN {_HIGH} THEN 3 WHEN {_MIDDLE} THEN 2 WHEN {_LOW} THEN 1 ELSE 0 END"
_V = "v AS (SELECT (year(l_shipdate) - 1995)::INTEGER AS t, l_quantity AS neutron, l_extendedprice AS xray FROM lineitem), f AS (SELECT * FROM v WHERE isfinite(neutron) AND isfinite(xray))"
_R = "r AS (SELECT min(neutron) AS n0, max(neutron) AS n1, min(xray) AS x0, max(xray) AS x1 FROM f)"
_B = "b AS (SELECT t, neutron, xray, greatest(0, least(63, floor((xray - x0) / (x1 - x0) * 64)))::INTEGER AS iy, greatest(0, least(63, floor((neutron - n0) / (n1 - n0) * 64)))::INTEGER AS ix FROM f, r)"
_H = f"{_V}, {_R}, {_B}, h AS (SELECT t, iy, ix, count(*) AS count FROM b GROUP BY t, iy, ix)"
_D = f"{_H}, ts AS (SELECT DISTINCT t FROM h), k AS (SELECT DISTINCT iy, ix FROM h), d AS (SELECT ts.t, k.iy, k.ix, coalesce(h.count, 0) AS count FROM ts CROSS JOIN k LEFT JOIN h ON h.t = ts.t AND h.iy = k.iy AND h.ix = k.ix)"
_P = f"{_D}, p AS (SELECT *, count / sum(count) OVER (PARTITION BY t) AS p FROM d), q AS (SELECT *, first(p) OVER (PARTITION BY iy, ix ORDER BY t) AS q, first(count) OVER (PARTITION BY iy, ix ORDER BY t) AS c0 FROM p)"
_M = f"{_H}, m AS (SELECT t, 'neutron' AS modality, ix AS bin, sum(count) AS n FROM h GROUP BY t, ix UNION ALL SELECT t, 'xray', iy, sum(count) FROM h GROUP BY t, iy), s AS (SELECT t, modality, bin, n / sum(n) OVER (PARTITION BY t, modality) AS share FROM m)"
_G = "g AS (SELECT 0 AS t, (event_id // 400)::INTEGER AS z, ((event_id // 20) % 20)::INTEGER AS y, (event_id % 20)::INTEGER AS x, value AS neutron, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS xray FROM events), c AS (SELECT *, (xray >= 34)::INTEGER + (xray >= 67)::INTEGER AS label FROM g)"
_FACES = f"{_G}, faces AS (SELECT a.label AS a, b.label AS b, a.xray AS av, b.xray AS bv FROM c a JOIN c b ON b.z = a.z + 1 AND b.y = a.y AND b.x = a.x UNION ALL SELECT a.label, b.label, a.xray, b.xray FROM c a JOIN c b ON b.z = a.z AND b.y = a.y + 1 AND b.x = a.x UNION ALL SELECT a.label, b.label, a.xray, b.xray FROM c a JOIN c b ON b.z = a.z AND b.y = a.y AND b.x = a.x + 1)"
_STATS = ", ".join(f"round({f}({c}), 4) AS {c}_{n}" for c in ("neutron", "xray") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query("hist_global", f"WITH {_H} SELECT iy, ix, sum(count)::BIGINT AS count FROM h GROUP BY iy, ix")
def hist_global(spark, sf_dir):
    cells, grid = lineitem_grid(spark, sf_dir)
    return histograms.histogram(cells, grid, by=())


@query("hist_local", f"WITH {_H} SELECT t, iy, ix, count FROM h")
def hist_local(spark, sf_dir):
    return lineitem_hist(spark, sf_dir)[0]


@query("hist_masked", f"WITH {_V}, {_R}, {_B} SELECT t, iy, ix, count(*) AS count FROM b WHERE {_LOW} OR {_MIDDLE} OR {_HIGH} GROUP BY t, iy, ix")
def hist_masked(spark, sf_dir):
    cells, grid = lineitem_grid(spark, sf_dir)
    return histograms.histogram(cells.where(in_any(REGIONS)), grid)


@query("hist_box", "WITH " + _G + ", f AS (SELECT * FROM c WHERE isfinite(neutron) AND isfinite(xray)), " + _R + ", " + _B.replace("SELECT t,", "SELECT z, y, x, t,") + " SELECT iy, ix, count(*) AS count FROM b WHERE z >= 0 AND z < 10 AND y >= 5 AND y < 15 AND x >= 2 AND x < 18 GROUP BY iy, ix")
def hist_box(spark, sf_dir):
    cells = grid_events(spark, sf_dir)
    grid = histograms.plane_grid(cells, BINS)
    return histograms.histogram(cells.where(statistics.in_box((0, 10), (5, 15), (2, 18))), grid, by=())


@query("marginals", f"WITH {_M} SELECT t, modality, bin, round(share, 6) AS share FROM s")
def marginals(spark, sf_dir):
    return histograms.marginals(lineitem_hist(spark, sf_dir)[0])


_MD = f"{_M}, ts AS (SELECT DISTINCT t FROM s), k AS (SELECT DISTINCT modality, bin FROM s), d AS (SELECT ts.t, k.modality, k.bin, coalesce(s.share, 0) AS share FROM ts CROSS JOIN k LEFT JOIN s ON s.t = ts.t AND s.modality = k.modality AND s.bin = k.bin)"


@query("marginal_log2", f"WITH {_MD}, w AS (SELECT *, first(share) OVER (PARTITION BY modality, bin ORDER BY t) AS r FROM d) SELECT t, modality, bin, CASE WHEN share > 0 AND r > 0 THEN round(log2(share / r), 6) END AS log2_change FROM w")
def marginal_log2(spark, sf_dir):
    return histograms.marginal_changes(lineitem_hist(spark, sf_dir)[0])


@query("marginal_log2_prev", f"WITH {_MD}, w AS (SELECT *, lag(share) OVER (PARTITION BY modality, bin ORDER BY t) AS r FROM d) SELECT t, modality, bin, CASE WHEN share > 0 AND r > 0 THEN round(log2(share / r), 6) END AS log2_change FROM w")
def marginal_log2_prev(spark, sf_dir):
    return histograms.marginal_changes(lineitem_hist(spark, sf_dir)[0], "previous")


@query("log_diff_first", f"WITH {_D} SELECT t, iy, ix, round(v - r, 6) AS log_difference FROM (SELECT t, iy, ix, log10(count + 1) AS v, first(log10(count + 1)) OVER (PARTITION BY iy, ix ORDER BY t) AS r FROM d) WHERE t > (SELECT min(t) FROM d)")
def log_diff_first(spark, sf_dir):
    return histograms.log_differences(lineitem_hist(spark, sf_dir)[0])


@query("log_diff_prev", f"WITH {_D} SELECT t, iy, ix, round(v - r, 6) AS log_difference FROM (SELECT t, iy, ix, log10(count + 1) AS v, lag(log10(count + 1)) OVER (PARTITION BY iy, ix ORDER BY t) AS r FROM d) WHERE t > (SELECT min(t) FROM d)")
def log_diff_prev(spark, sf_dir):
    return histograms.log_differences(lineitem_hist(spark, sf_dir)[0], "previous")


@query("evolution_tv", f"WITH {_P} SELECT t, sum(count)::BIGINT AS cells, round(sum(abs(p - q)) / 2, 6) AS total_variation, round(max(log10(count + 1) - log10(c0 + 1)), 6) AS max_gain, round(min(log10(count + 1) - log10(c0 + 1)), 6) AS max_loss FROM q GROUP BY t")
def evolution_tv(spark, sf_dir):
    return histograms.evolution(lineitem_hist(spark, sf_dir)[0])


@query("jsd_mi", f"""WITH {_P}, w AS (SELECT *, (p + q) / 2 AS mid, sum(p) OVER (PARTITION BY t, iy) AS pr, sum(p) OVER (PARTITION BY t, ix) AS pc FROM q)
SELECT t, round(sum(((CASE WHEN p > 0 THEN p * log2(p / mid) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / mid) ELSE 0 END)) / 2), 6) AS jensen_shannon, round(sum(CASE WHEN p > 0 THEN p * log2(p / (pr * pc)) ELSE 0 END), 6) AS mutual_bits FROM w GROUP BY t""")
def jsd_mi(spark, sf_dir):
    return histograms.divergence(lineitem_hist(spark, sf_dir)[0])


@query("mutual_information", f"WITH {_H}, p AS (SELECT *, count / sum(count) OVER (PARTITION BY t) AS p FROM h), w AS (SELECT *, sum(p) OVER (PARTITION BY t, iy) AS pr, sum(p) OVER (PARTITION BY t, ix) AS pc FROM p) SELECT t, round(sum(p * ln(p / (pr * pc))), 6) AS mutual_nats FROM w GROUP BY t")
def mutual_information(spark, sf_dir):
    return histograms.mutual_information(lineitem_hist(spark, sf_dir)[0])


@query("shape_metrics", f"""WITH {_H}, d AS (SELECT t, iy, ix, count, count / sum(count) OVER (PARTITION BY t) AS d, n0 + (ix + 0.5) * ((n1 - n0) / 64) AS nc, x0 + (iy + 0.5) * ((x1 - x0) / 64) AS xc FROM h, r),
rv AS (SELECT t, max(v) AS mx, sum(v) / 64 AS mean FROM (SELECT t, iy, sum(d * d) / 64 - (sum(d) / 64) * (sum(d) / 64) AS v FROM d GROUP BY t, iy) GROUP BY t),
cv AS (SELECT t, max(v) AS mx, sum(v) / 64 AS mean FROM (SELECT t, ix, sum(d * d) / 64 - (sum(d) / 64) * (sum(d) / 64) AS v FROM d GROUP BY t, ix) GROUP BY t),
mo AS (SELECT t, sum(d * nc) AS mn, sum(d * xc) AS mx FROM d GROUP BY t),
ce AS (SELECT d.t, any_value(mn) AS mn, any_value(mx) AS mx, sqrt(sum(d * (nc - mn) * (nc - mn))) AS sn, sqrt(sum(d * (xc - mx) * (xc - mx))) AS sx, sum(d * (nc - mn) * (xc - mx)) AS co FROM d JOIN mo ON mo.t = d.t GROUP BY d.t),
me AS (SELECT t, min(xc) AS median FROM (SELECT t, xc, sum(c) OVER (PARTITION BY t ORDER BY iy) / sum(c) OVER (PARTITION BY t) AS cum FROM (SELECT t, iy, xc, sum(count) AS c FROM d GROUP BY t, iy, xc)) WHERE cum >= 0.5 GROUP BY t)
SELECT ce.t, round(rv.mx / (cv.mean + 1e-12), 3) AS s_h, round(cv.mx / (rv.mean + 1e-12), 3) AS s_v, round(co / (sn * sx + 1e-12), 3) AS s_d, round((ce.mx - median) / (sx + 1e-12), 3) AS a_x, round(ce.mn - first(ce.mn) OVER (ORDER BY ce.t), 3) AS delta_n
FROM ce JOIN rv ON rv.t = ce.t JOIN cv ON cv.t = ce.t JOIN me ON me.t = ce.t""", 3)
def shape_metrics(spark, sf_dir):
    return histograms.shape_metrics(*lineitem_hist(spark, sf_dir))


@query("grid_kymograph", f"""WITH {_H}, co AS (SELECT t, iy // 8 AS gy, ix // 8 AS gx, sum(count) AS n FROM h GROUP BY ALL), ts AS (SELECT DISTINCT t FROM co), k AS (SELECT DISTINCT gy, gx FROM co),
d AS (SELECT ts.t, k.gy, k.gx, coalesce(co.n, 0) AS n FROM ts CROSS JOIN k LEFT JOIN co ON co.t = ts.t AND co.gy = k.gy AND co.gx = k.gx), s AS (SELECT t, gy, gx, n / sum(n) OVER (PARTITION BY t) AS share FROM d), w AS (SELECT *, first(share) OVER (PARTITION BY gy, gx ORDER BY t) AS r FROM s)
SELECT t, gy::INTEGER AS gy, gx::INTEGER AS gx, round(share, 6) AS share, CASE WHEN share > 0 AND r > 0 THEN round(log2(share / r), 6) END AS log2_ratio FROM w""")
def grid_kymograph(spark, sf_dir):
    return histograms.kymograph(lineitem_hist(spark, sf_dir)[0], 8, BINS)


@query("topk_variable_bins", f"WITH {_P}, s AS (SELECT iy, ix, max(p) - min(p) AS spread, max(count) AS most FROM p GROUP BY iy, ix) SELECT iy, ix, round(spread, 6) AS spread FROM s WHERE most >= 3 ORDER BY s.spread DESC, iy, ix LIMIT 10")
def topk_variable_bins(spark, sf_dir):
    return histograms.variable_bins(lineitem_hist(spark, sf_dir)[0], least=3)


@query("bin_moments", f"WITH {_V}, {_R}, {_B} SELECT t, iy, ix, count(*) AS c, round(sum(neutron), 4) AS sn, round(sum(xray), 4) AS sx, round(sum(neutron * neutron), 4) AS snn, round(sum(xray * xray), 4) AS sxx, round(sum(neutron * xray), 4) AS snx FROM b GROUP BY t, iy, ix", 4)
def bin_moments(spark, sf_dir):
    return histograms.moments(*lineitem_grid(spark, sf_dir))


@query("roi_rect_stats", f"WITH {_V} SELECT t, 'low' AS region, count(*) AS n, {_STATS} FROM f WHERE {_LOW} GROUP BY t", 4)
def roi_rect_stats(spark, sf_dir):
    return statistics.region_stats(paired_lineitem(spark, sf_dir), REGIONS[:1])


@query("roi_polygon_stats", f"WITH {_V} SELECT t, 'middle' AS region, count(*) AS n, {_STATS} FROM f WHERE {_MIDDLE} GROUP BY t", 4)
def roi_polygon_stats(spark, sf_dir):
    return statistics.region_stats(paired_lineitem(spark, sf_dir), REGIONS[1:2])


@query("roi_stats", " UNION ALL ".join(f"(WITH {_V} SELECT t, '{n}' AS region, count(*) AS n, {_STATS} FROM f WHERE {p} GROUP BY t)" for n, p in (("low", _LOW), ("middle", _MIDDLE), ("high", _HIGH))), 4)
def roi_stats(spark, sf_dir):
    return statistics.region_stats(paired_lineitem(spark, sf_dir), REGIONS)


@query("roi_union", f"WITH {_V} SELECT t, count(*) AS n FROM f WHERE {_LOW} OR {_MIDDLE} OR {_HIGH} GROUP BY t")
def roi_union(spark, sf_dir):
    return paired_lineitem(spark, sf_dir).where(in_any(REGIONS)).groupBy("t").agg(F.count("*").alias("n"))


@query("multi_class_labels", f"WITH {_V} SELECT t, {_CLASS} AS label, count(*) AS n FROM f GROUP BY ALL")
def multi_class_labels(spark, sf_dir):
    return paired_lineitem(spark, sf_dir).groupBy("t", class_of(REGIONS).alias("label")).agg(F.count("*").alias("n"))


@query("segmentation_stats", f"WITH {_V}, s AS (SELECT t, {_LOW} OR {_MIDDLE} OR {_HIGH} AS hit, neutron, xray FROM v) SELECT t, count(*) FILTER (hit) AS selected, count(*) AS total, round(100.0 * count(*) FILTER (hit) / count(*), 4) AS percentage, " + ", ".join(f"round({f}({c}) FILTER (hit), 4) AS {c}_{n}" for c in ("neutron", "xray") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM s GROUP BY t", 4)
def segmentation_stats(spark, sf_dir):
    return statistics.selection_stats(paired_lineitem(spark, sf_dir), in_any(REGIONS))


@query("temporal_stats", f"WITH {_V} SELECT t, round(avg(neutron), 4) AS neutron_mean, round(stddev_pop(neutron), 4) AS neutron_std, round(avg(xray), 4) AS xray_mean, round(stddev_pop(xray), 4) AS xray_std FROM v GROUP BY t", 4)
def temporal_stats(spark, sf_dir):
    return statistics.temporal_stats(paired_lineitem(spark, sf_dir))


@query("scope_rollup", f"WITH {_V} SELECT CASE WHEN grouping(t) = 1 THEN 'global' ELSE 'timepoint' END AS scope, coalesce(t, -1) AS t, count(*) AS n, round(avg(neutron), 4) AS neutron_mean FROM f GROUP BY ROLLUP (t)", 4)
def scope_rollup(spark, sf_dir):
    return statistics.with_total(paired_lineitem(spark, sf_dir))


_VALID = "isfinite(neutron) AND isfinite(xray) AND neutron <> 0 AND xray <> 0"


@query("validity_report", f"WITH {_V} SELECT t, count(*) AS total, count(*) FILTER ({_VALID} AND neutron >= 3) AS valid, count(*) - count(*) FILTER ({_VALID} AND neutron >= 3) AS rejected, count(*) FILTER (NOT (isfinite(neutron) AND isfinite(xray))) AS non_finite, count(*) FILTER (isfinite(neutron) AND isfinite(xray) AND (neutron = 0 OR xray = 0)) AS missing, round((count(*) - count(*) FILTER ({_VALID} AND neutron >= 3)) / count(*), 6) AS rejected_share FROM v GROUP BY t")
def validity_report(spark, sf_dir):
    return statistics.validity_report(paired_lineitem(spark, sf_dir), floors=(3.0, None))


@query("channel_coverage", f"WITH {_G}, h AS (SELECT t, neutron <> 0 AS n, xray <> 0 AS x FROM g) SELECT t, count(*) FILTER (n AND x) AS both, count(*) FILTER (n AND NOT x) AS neutron_only, count(*) FILTER (x AND NOT n) AS xray_only, count(*) FILTER (NOT n AND NOT x) AS neither FROM h GROUP BY t")
def channel_coverage(spark, sf_dir):
    return statistics.coverage(grid_events(spark, sf_dir))


@query("acquisition_steps", f"WITH {_V}, s AS (SELECT t, count(*) FILTER (neutron < 3) / count(*) AS share FROM v GROUP BY t), w AS (SELECT t, share - lag(share) OVER (ORDER BY t) AS step FROM s) SELECT t, round(step, 6) AS step FROM w WHERE abs(step) > 0.001")
def acquisition_steps(spark, sf_dir):
    return statistics.acquisition_steps(statistics.validity_report(paired_lineitem(spark, sf_dir), floors=(3.0, None)), 0.001)


@query("auto_floor", f"WITH {_V}, a AS (SELECT 'neutron' AS channel, neutron AS v FROM f UNION ALL SELECT 'xray', xray FROM f), m AS (SELECT channel, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.5) AS med FROM a GROUP BY channel) SELECT a.channel, round(any_value(lo) - 3.0 * 1.4826 * quantile_cont(abs(v - med), 0.5), 4) AS floor FROM a JOIN m ON m.channel = a.channel GROUP BY a.channel", 4)
def auto_floor(spark, sf_dir):
    return statistics.auto_floor(paired_lineitem(spark, sf_dir))


@query("axial_profile_mean", f"WITH {_G} SELECT z, count(*) AS n, round(avg(neutron), 4) AS neutron_mean, round(stddev_pop(neutron), 4) AS neutron_std, round(avg(xray), 4) AS xray_mean, round(stddev_pop(xray), 4) AS xray_std FROM g GROUP BY z", 4)
def axial_profile_mean(spark, sf_dir):
    return statistics.axial_profile(grid_events(spark, sf_dir))


@query("axial_profile_median", f"WITH {_G} SELECT y, count(*) AS n, round(median(neutron), 4) AS neutron_median, round(stddev_pop(neutron), 4) AS neutron_std, round(median(xray), 4) AS xray_median, round(stddev_pop(xray), 4) AS xray_std FROM g GROUP BY y", 4)
def axial_profile_median(spark, sf_dir):
    return statistics.axial_profile(grid_events(spark, sf_dir), "y", "median")


@query("crop_stats", f"WITH {_G} SELECT t, count(*) AS n, round(avg(neutron), 4) AS neutron_mean, round(avg(xray), 4) AS xray_mean FROM g WHERE z >= 1 AND z < 8 AND y >= 3 AND y < 12 AND x >= 4 AND x < 20 GROUP BY t", 4)
def crop_stats(spark, sf_dir):
    box = grid_events(spark, sf_dir).where(statistics.in_box((1, 8), (3, 12), (4, 20)))
    return box.groupBy("t").agg(F.count("*").alias("n"), F.avg("neutron").alias("neutron_mean"), F.avg("xray").alias("xray_mean"))


_SERIES = f"{_V}, s AS (SELECT {_CLASS} AS name, t, avg(neutron) AS v FROM f GROUP BY ALL)"


def class_series(spark, sf_dir):
    cells = paired_lineitem(spark, sf_dir).withColumn("name", class_of(REGIONS))
    return cells.groupBy("name", "t").agg(F.avg("neutron").alias("v"))


@query("trend_regression", f"WITH {_SERIES}, w AS (SELECT *, v - lag(v) OVER (PARTITION BY name ORDER BY t) AS change FROM s) SELECT name, round(regr_slope(v, t), 5) AS slope, round(regr_intercept(v, t), 5) AS intercept, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 5) AS low, round(max(v), 5) AS high, round(avg(change), 5) AS mean_change, round(stddev_pop(change), 5) AS std_change FROM w GROUP BY name HAVING count(*) >= 2", 5)
def trend_regression(spark, sf_dir):
    return statistics.trends(class_series(spark, sf_dir), "v")


@query("event_detection", f"WITH {_SERIES}, w AS (SELECT *, lag(v) OVER (PARTITION BY name ORDER BY t) AS b FROM s) SELECT name, t, round(v - b, 5) AS change, round(100 * abs(v - b) / b, 5) AS pct_change, CASE WHEN v > b THEN 'increase' ELSE 'decrease' END AS kind FROM w WHERE 100 * abs(v - b) / b > 0.2", 5)
def event_detection(spark, sf_dir):
    return statistics.change_events(class_series(spark, sf_dir), "v", 0.2)


_PRESENT = f"{_H}, tot AS (SELECT t, sum(count) AS total FROM h GROUP BY t), pr AS (SELECT (iy // 16) * 4 + ix // 16 AS name, h.t, sum(count) / any_value(total) AS share FROM h JOIN tot ON tot.t = h.t GROUP BY ALL)"


def block_shares(spark, sf_dir):
    hist = lineitem_hist(spark, sf_dir)[0]
    name = (F.floor(F.col("iy") / 16) * 4 + F.floor(F.col("ix") / 16)).cast("int")
    each = hist.groupBy(name.alias("name"), "t").agg(F.sum("count").alias("n"))
    total = hist.groupBy("t").agg(F.sum("count").alias("total"))
    return each.join(total, "t").select("name", "t", (F.col("n") / F.col("total")).alias("share"))


@query("presence_timeline", f"WITH {_PRESENT} SELECT name::INTEGER AS name, t, round(share, 6) AS share, share >= 0.05 AS present FROM pr")
def presence_timeline(spark, sf_dir):
    return block_shares(spark, sf_dir).withColumn("present", F.col("share") >= 0.05)


@query("presence_runs", f"WITH {_PRESENT}, i AS (SELECT name, t, t - row_number() OVER (PARTITION BY name ORDER BY t) AS island FROM pr WHERE share >= 0.05) SELECT name::INTEGER AS name, min(t) AS first_t, max(t) AS last_t FROM i GROUP BY name, island")
def presence_runs(spark, sf_dir):
    return statistics.presence_runs(block_shares(spark, sf_dir).where("share >= 0.05").select("name", "t"))


@query("class_library", f"WITH {_V}, m AS (SELECT {_CLASS} AS class_id, neutron, xray FROM f WHERE t = 0) SELECT class_id, count(*) AS n, round(avg(neutron), 3) AS neutron_mean, round(avg(xray), 3) AS xray_mean, round(var_samp(neutron), 3) AS var_n, round(var_samp(xray), 3) AS var_x, round(covar_samp(neutron, xray), 3) AS cov, round(count(*) / sum(count(*)) OVER (), 3) AS weight FROM m WHERE class_id > 0 GROUP BY class_id", 3)
def class_library(spark, sf_dir):
    return materials.class_library(paired_lineitem(spark, sf_dir).where("t = 0"), REGIONS)


_MATCH = f"""{_V}, {_R}, {_B},
bm AS (SELECT t, iy, ix, count(*) AS c, sum(neutron) AS sn, sum(xray) AS sx, sum(neutron * neutron) AS snn, sum(xray * xray) AS sxx, sum(neutron * xray) AS snx FROM b GROUP BY t, iy, ix),
lib AS (SELECT {_CLASS} AS k, avg(neutron) AS mn, avg(xray) AS mx, var_samp(neutron) AS a, var_samp(xray) AS d, covar_samp(neutron, xray) AS o, count(*) / sum(count(*)) OVER () AS w FROM f WHERE t = 0 AND {_CLASS} > 0 GROUP BY 1),
sc AS (SELECT t, iy, ix, c, k, -0.5 * (2 * ln(2 * pi()) + ln(a * d - o * o) + (d * (sn / c - mn) * (sn / c - mn) - 2 * o * (sn / c - mn) * (sx / c - mx) + a * (sx / c - mx) * (sx / c - mx)) / (a * d - o * o)
  + greatest((d * (snn / c - sn / c * sn / c) - 2 * o * (snx / c - sn / c * sx / c) + a * (sxx / c - sx / c * sx / c)) / (a * d - o * o), 0)) + ln(w) AS score FROM bm, lib
  UNION ALL SELECT t, iy, ix, c, 0, -ln((n1 - n0) * (x1 - x0)) + ln(1e-4) FROM bm, r),
best AS (SELECT t, iy, ix, any_value(c) AS c, arg_max(k, score) AS label, max(score) AS score FROM sc GROUP BY t, iy, ix)"""


@query("match_table", f"WITH {_MATCH} SELECT t, iy, ix, c, label, round(score, 3) AS score FROM best", 3)
def match_table(spark, sf_dir):
    cells, grid = lineitem_grid(spark, sf_dir)
    library = materials.materials(materials.class_library(cells.where("t = 0"), REGIONS), REGIONS)
    return materials.match_table(histograms.moments(cells, grid), library, grid).select("t", "iy", "ix", "c", "label", "score")


@query("locked_counts", f"WITH {_MATCH} SELECT t, label, sum(c)::BIGINT AS cells, count(*) AS bins FROM best GROUP BY t, label")
def locked_counts(spark, sf_dir):
    cells, grid = lineitem_grid(spark, sf_dir)
    return materials.locked_counts(cells, REGIONS, grid)


@query("locked_confusion", f"WITH {_MATCH} SELECT {_CLASS} AS truth, best.label AS prediction, count(*) AS n FROM b JOIN best ON best.t = b.t AND best.iy = b.iy AND best.ix = b.ix GROUP BY ALL")
def locked_confusion(spark, sf_dir):
    cells, grid = lineitem_grid(spark, sf_dir)
    labels = materials.locked_labels(cells, REGIONS, grid).withColumn("truth", class_of(REGIONS))
    return materials.confusion(labels, "truth", "label")


_AGREE = f"WITH {_MATCH}, cm AS (SELECT {_CLASS} AS truth, best.label AS prediction FROM b JOIN best ON best.t = b.t AND best.iy = b.iy AND best.ix = b.ix), l AS (SELECT DISTINCT truth AS label FROM cm UNION SELECT prediction FROM cm), e AS (SELECT label, (SELECT count(*) FROM cm WHERE truth = label) AS rs, (SELECT count(*) FROM cm WHERE prediction = label) AS cs, (SELECT count(*) FROM cm WHERE truth = label AND prediction = label) AS hits, (SELECT count(*) FROM cm) AS total FROM l), k AS (SELECT sum(hits) / any_value(total) AS po, sum((rs / total) * (cs / total)) AS pe FROM e) SELECT label, round(hits / (rs + cs - hits), 5) AS iou, round(2 * hits / (rs + cs), 5) AS dice, round((po - pe) / (1 - pe), 5) AS kappa FROM e, k"


@query("iou_kappa", _AGREE, 5)
def iou_kappa(spark, sf_dir):
    return materials.agreement(locked_confusion(spark, sf_dir))


_CM = f"{_V}, m AS (SELECT t, {_CLASS} AS class_id, neutron, xray FROM f WHERE {_CLASS} > 0), e AS (SELECT t, class_id, count(*) AS n, avg(neutron) AS centroid_n, stddev_pop(neutron) AS sigma_n, avg(xray) AS centroid_x, stddev_pop(xray) AS sigma_x FROM m GROUP BY ALL)"


@query("class_metrics", f"WITH {_CM} SELECT t, class_id, n, round(centroid_n, 3) AS centroid_n, round(sigma_n, 3) AS sigma_n, round(centroid_x, 3) AS centroid_x, round(sigma_x, 3) AS sigma_x, round(greatest(sigma_n, sigma_x) / greatest(least(sigma_n, sigma_x), 1e-12), 3) AS elongation, round(sqrt(power(centroid_n - first(centroid_n) OVER w, 2) + power(centroid_x - first(centroid_x) OVER w, 2)), 3) AS drift FROM e WINDOW w AS (PARTITION BY class_id ORDER BY t)", 3)
def class_metrics(spark, sf_dir):
    return materials.class_metrics(paired_lineitem(spark, sf_dir), REGIONS)


@query("davies_bouldin", f"WITH {_CM}, s AS (SELECT *, sqrt((sigma_n * sigma_n + sigma_x * sigma_x) / 2) AS sp FROM e), w AS (SELECT a.t, a.class_id, max((a.sp + b.sp) / sqrt(power(a.centroid_n - b.centroid_n, 2) + power(a.centroid_x - b.centroid_x, 2))) AS worst FROM s a JOIN s b ON a.t = b.t AND a.class_id <> b.class_id GROUP BY ALL) SELECT t, round(avg(worst), 5) AS davies_bouldin FROM w GROUP BY t", 5)
def davies_bouldin(spark, sf_dir):
    return materials.davies_bouldin(materials.class_metrics(paired_lineitem(spark, sf_dir), REGIONS))


@query("calibration_fit", "SELECT p_brand AS channel, round(regr_slope(p_retailprice, p_size), 5) AS gain, round(regr_intercept(p_retailprice, p_size), 5) AS offset FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) >= 2", 5)
def calibration_fit(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return materials.calibration(parts.select(F.col("p_brand").alias("channel"), F.col("p_size").cast("double").alias("known"), F.col("p_retailprice").alias("measured")))


@query("otsu_threshold", f"WITH {_V}, {_R}, {_B}, n AS (SELECT ix AS bin, count(*) AS n FROM b GROUP BY ix), s AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w0, sum(n * bin) OVER (ORDER BY bin) AS m0, sum(n) OVER () AS w, sum(n * bin) OVER () AS m FROM n) SELECT bin AS threshold_bin, round(w0 * (w - w0) * power(m0 / w0 - (m - m0) / (w - w0), 2) / w / w, 5) AS between_variance FROM s WHERE w > w0 ORDER BY w0 * (w - w0) * power(m0 / w0 - (m - m0) / (w - w0), 2) / w / w DESC, bin LIMIT 1", 5)
def otsu_threshold(spark, sf_dir):
    cells, grid = lineitem_grid(spark, sf_dir)
    return materials.otsu_threshold(cells, "neutron", grid)


@query("balanced_sample_counts", f"WITH {_G} SELECT label, least(count(*), 200) AS n FROM c GROUP BY label")
def balanced_sample_counts(spark, sf_dir):
    cells = labelled_grid(spark, sf_dir)
    return materials.balanced_sample(cells, "label", F.xxhash64("z", "y", "x"), 200).groupBy("label").agg(F.count("*").alias("n"))


_ADJ = f"{_FACES}, p AS (SELECT a AS k, b AS l FROM faces UNION ALL SELECT b, a FROM faces), ad AS (SELECT k, l, count(*) AS n FROM p GROUP BY k, l)"


@query("adjacency_counts", f"WITH {_ADJ} SELECT k, l, n FROM ad")
def adjacency_counts(spark, sf_dir):
    return spatial.adjacency(labelled_grid(spark, sf_dir))


@query("boundary_cost", f"WITH {_ADJ}, ks AS (SELECT unnest([0, 1, 2]) AS k), fu AS (SELECT a.k, b.k AS l, coalesce(ad.n, 0) + 1 AS n FROM ks a CROSS JOIN ks b LEFT JOIN ad ON ad.k = a.k AND ad.l = b.k), ra AS (SELECT k, l, -ln(n / sum(n) OVER (PARTITION BY k)) AS c FROM fu), rb AS (SELECT k, l, c - max(CASE WHEN k = l THEN c END) OVER (PARTITION BY k) AS c FROM ra) SELECT x.k, x.l, CASE WHEN x.k = x.l THEN 0.0::DOUBLE ELSE round(greatest(0, least(5, (x.c + y.c) / 2)), 6) END AS cost FROM rb x JOIN rb y ON y.k = x.l AND y.l = x.k")
def boundary_cost(spark, sf_dir):
    return spatial.boundary_cost(spatial.adjacency(labelled_grid(spark, sf_dir)), 3)


@query("surface_area", f"WITH {_FACES} SELECT 0 AS t, count(*) FILTER ((av >= 50) <> (bv >= 50)) AS faces FROM faces")
def surface_area(spark, sf_dir):
    return spatial.surface(grid_events(spark, sf_dir).withColumn("mask", F.col("xray") >= 50), "mask")


@query("interface_area", f"WITH {_FACES} SELECT 0 AS t, count(*) FILTER ((a = 0 AND b = 2) OR (a = 2 AND b = 0)) AS faces FROM faces")
def interface_area(spark, sf_dir):
    return spatial.interface(labelled_grid(spark, sf_dir), 0, 2)


@query("centre_of_mass", f"WITH {_G} SELECT t, label, count(*) AS n, round(avg(z), 5) AS centre_z, round(avg(y), 5) AS centre_y, round(avg(x), 5) AS centre_x, round(sqrt(var_pop(z) + var_pop(y) + var_pop(x)), 5) AS gyration FROM c GROUP BY t, label", 5)
def centre_of_mass(spark, sf_dir):
    return spatial.mass(labelled_grid(spark, sf_dir))


@query("median_binning", f"WITH {_G} SELECT t, z // 2 AS z, y // 2 AS y, x // 2 AS x, round(median(neutron), 5) AS median FROM g GROUP BY t, z // 2, y // 2, x // 2 HAVING count(*) = 8", 5)
def median_binning(spark, sf_dir):
    return spatial.block_median(grid_events(spark, sf_dir), 2)


@query("mask_binning", f"WITH {_G} SELECT t, z // 4 AS z, y // 4 AS y, x // 4 AS x, bool_or(xray >= 95) AS hit FROM g GROUP BY t, z // 4, y // 4, x // 4")
def mask_binning(spark, sf_dir):
    return spatial.block_mask(grid_events(spark, sf_dir), 4, F.col("xray") >= 95)


@query("connected_components")
def connected_components(spark, sf_dir):
    return spatial.connected(grid_events(spark, sf_dir), F.col("xray") >= 60).groupBy("t", "component").agg(F.count("*").alias("n"))


@query("region_grow")
def region_grow(spark, sf_dir):
    return spatial.grown(grid_events(spark, sf_dir), (0, 1, 10, 10), "xray", 30.0)


@query("mrf_icm")
def mrf_icm(spark, sf_dir):
    """Cells by label after smoothing with one cost for all pairs of unlike labels; icm_costs and mean_field have learned costs and edge weights."""
    cells = grid_events(spark, sf_dir).withColumns({f"u{k}": -F.abs(F.col("xray") - centre) / 33 for k, centre in enumerate((17.0, 50.0, 83.0))})
    return smoothing.smoothed(cells, ["u0", "u1", "u2"], 0.2, method="icm").groupBy("t", "z", "label").agg(F.count("*").alias("n"))


@query("kmeans_series")
def kmeans_series(spark, sf_dir):
    """The timeline of the series: four persistent clusters, then the transient islands, which are found and set aside first."""
    cells, grid = lineitem_grid(spark, sf_dir)
    return clusters.cluster_series(cells, grid, 4)


@query("kmeans_volume")
def kmeans_volume(spark, sf_dir):
    return clusters.cluster_cells(paired_lineitem(spark, sf_dir), 3)


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", 4)
def event_windows(spark, sf_dir):
    return windows.hourly(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("pair_features", f"WITH {_V} SELECT t, count(*) AS n, round(avg(neutron / (xray + 1e-6)), 6) AS ratio, round(avg(neutron + xray), 3) AS total, round(avg(neutron - xray), 3) AS difference, round(avg(sqrt(neutron * neutron + xray * xray)), 3) AS magnitude FROM f GROUP BY t")
def pair_features(spark, sf_dir):
    rows = statistics.pair_features(paired_lineitem(spark, sf_dir)).groupBy("t")
    out = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("ratio", "total", "difference", "magnitude")])
    return out.select("t", "n", "ratio", *[F.round(c, 3).alias(c) for c in ("total", "difference", "magnitude")])


_TREND = " UNION ALL ".join(f"SELECT t, '{n}' AS region, neutron, xray FROM f WHERE {p}" for n, p in (("low", _LOW), ("middle", _MIDDLE), ("high", _HIGH)))


@query("region_trend", f"WITH {_V}, u AS ({_TREND}), a AS (SELECT t, count(*) AS total FROM f GROUP BY t), e AS (SELECT u.t, region, count(*) AS n, count(*) / any_value(total) AS fraction, avg(neutron) AS nm, avg(xray) AS xm FROM u JOIN a ON a.t = u.t GROUP BY u.t, region) SELECT t, region, n, round(fraction, 4) AS fraction, round(fraction / first(fraction) OVER (PARTITION BY region ORDER BY t), 4) AS relative, round(nm, 4) AS neutron_mean, round(xm, 4) AS xray_mean FROM e", 4)
def region_trend(spark, sf_dir):
    return statistics.region_trend(paired_lineitem(spark, sf_dir), REGIONS)


@query("metrics_long", f"WITH {_CM}, w AS (SELECT t, class_id, n::DOUBLE AS n, round(centroid_n, 3) AS centroid_n, round(centroid_x, 3) AS centroid_x FROM e) UNPIVOT w ON n, centroid_n, centroid_x INTO NAME metric VALUE value", 3)
def metrics_long(spark, sf_dir):
    wide = materials.class_metrics(paired_lineitem(spark, sf_dir), REGIONS).select("t", "class_id", "n", "centroid_n", "centroid_x")
    return statistics.long_metrics(wide, ["t", "class_id"])


@query("quantile_bands", f"WITH {_V} SELECT t, round(quantile_cont(xray, 0.16), 4) AS low, round(quantile_cont(xray, 0.5), 4) AS middle, round(quantile_cont(xray, 0.84), 4) AS high FROM v GROUP BY t", 4)
def quantile_bands(spark, sf_dir):
    return statistics.quantile_bands(paired_lineitem(spark, sf_dir), "t", "xray")


@query("block_counts", f"WITH {_G}, m AS (SELECT max(z) + 1 AS nz FROM g), b AS (SELECT (least(z * 5 // nz, 4) * 5 + least(y * 5 // 20, 4)) * 5 + least(x * 5 // 20, 4) AS block FROM g, m) SELECT block::INTEGER AS block, count(*) AS n FROM b GROUP BY block")
def block_counts(spark, sf_dir):
    cells = grid_events(spark, sf_dir)
    slabs = cells.agg(F.max("z")).first()[0] + 1
    return spatial.block_ids(cells, (slabs, 20, 20)).groupBy("block").agg(F.count("*").alias("n"))


@query("mask_disagreement", f"WITH {_G}, u AS (SELECT t, z, y, x, xray >= 50 AS a, neutron >= 35 AS b, ((xray >= 50) <> (neutron >= 35))::INTEGER AS un FROM g), d AS (SELECT *, un = 1 AND coalesce(lag(un) OVER w, 1) = 1 AND coalesce(lead(un) OVER w, 1) = 1 AS deep FROM u WINDOW w AS (PARTITION BY t, z, y ORDER BY x)) SELECT t, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second, count(*) FILTER (deep) AS deep, round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 6) AS jaccard FROM d GROUP BY t")
def mask_disagreement(spark, sf_dir):
    return spatial.disagreement(grid_events(spark, sf_dir), F.col("xray") >= 50, F.col("neutron") >= 35)
