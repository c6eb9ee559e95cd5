"""Clustering of cells by their pair, and of a series by its histogram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duovox.functions.plane import Grid, both_finite
from duovox.operators.histograms import histogram
from duovox.operators.islands import transient_islands
from duovox.operators.spatial import _table


def lloyd(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """Centres of weighted k-means on a small table of points, seeded by weighted distances."""
    rng = np.random.default_rng(seed)
    centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < k:
        d = ((points[:, None] - centres[None]) ** 2).sum(-1).min(1) * weights
        if d.sum() == 0:
            raise ValueError(f"fewer than {k} distinct pairs")
        centres = np.concatenate([centres, points[[rng.choice(len(points), p=d / d.sum())]]])
    for _ in range(rounds):
        own = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([np.average(points[own == j], axis=0, weights=weights[own == j]) if (own == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres[np.lexsort(centres.T[::-1])]


@dataclass(frozen=True)
class SeriesPlane:
    """One clustering of the histogram plane, for every t: the cluster of each bin (iy, ix), and centres (neutron, xray); those from `persistent` on are transient islands."""

    grid: Grid
    labels: np.ndarray
    centres: np.ndarray
    persistent: int

    def table(self, spark: SparkSession) -> DataFrame:
        """iy, ix, cluster: bins x bins rows."""
        return spark.createDataFrame([(int(y), int(x), int(k)) for (y, x), k in np.ndenumerate(self.labels)], "iy int, ix int, cluster int")


def series_plane(hist: DataFrame, grid: Grid, k: int, transient: bool = True, emphasise_small: bool = False) -> SeriesPlane:
    """k-means on the bins of the mean normalised histogram, less those of transient islands, which become clusters after the k.

    Centres of bins are scaled by their weighted deviation. emphasise_small: weights log1p of the cells of a mean timepoint. Every bin gets a
    cluster, empty ones too. Only numbers for each bin, at most bins x bins of them, reach the driver.
    """
    island, peaks = transient_islands(hist, grid.bins) if transient else (np.full((grid.bins, grid.bins), -1), [])
    totals = hist.groupBy("t").agg(F.sum("count").alias("total"))  # a row for each t
    of = totals.agg(F.count("*"), F.avg("total")).first()
    rows = hist.join(totals, "t").groupBy("iy", "ix").agg((F.sum(F.col("count") / F.col("total")) / of[0]).alias("w"), F.max("count").alias("peak")).toPandas()
    weight, peak = np.zeros((2, grid.bins, grid.bins))
    weight[rows["iy"], rows["ix"]], peak[rows["iy"], rows["ix"]] = rows["w"], rows["peak"]
    if emphasise_small:
        weight = np.log1p(weight * of[1])
    at = (np.arange(grid.bins) + 0.5) / grid.bins
    x, y = np.meshgrid(grid.n_lo + at * (grid.n_hi - grid.n_lo), grid.x_lo + at * (grid.x_hi - grid.x_lo))
    every, fit = np.stack([x.ravel(), y.ravel()], axis=1), ((weight > 0) & (island < 0)).ravel()
    if fit.sum() < k:
        raise ValueError(f"{fit.sum()} bins hold data, fewer than {k}")
    points, w = every[fit], weight.ravel()[fit]
    mean = np.average(points, axis=0, weights=w)
    scale = np.sqrt(np.average((points - mean) ** 2, axis=0, weights=w))
    scale[scale == 0] = 1
    unit = lloyd((points - mean) / scale, w, k)
    gaps = (((every - mean) / scale)[:, None] - unit[None]) ** 2
    labels = gaps.sum(-1).argmin(1).reshape(island.shape)
    labels[island >= 0] = k + island[island >= 0]
    own = [[np.average(v[island == i], weights=peak[island == i]) for v in (x, y)] for i in range(len(peaks))]
    return SeriesPlane(grid, labels, np.array([*(unit * scale + mean), *own]), k)


def label_cells(cells: DataFrame, plane: SeriesPlane) -> DataFrame:
    """cells with their cluster, by their bin; values out of range go to the edge bins, cells without a finite pair to -1."""
    finite = both_finite()
    rows = cells.withColumns({"_iy": F.when(finite, plane.grid.xray_bin()), "_ix": F.when(finite, plane.grid.neutron_bin())})
    table = plane.table(cells.sparkSession).toDF("_iy", "_ix", "_cluster")
    return rows.join(F.broadcast(table), ["_iy", "_ix"], "left").select(*[F.col(c) for c in cells.columns if c != "cluster"], F.coalesce("_cluster", F.lit(-1)).alias("cluster"))


def timeline(hist: DataFrame, plane: SeriesPlane, presence: float = 0.001) -> DataFrame:
    """t, cluster, transient_phase, neutron_centre, xray_centre, cells, fraction, present: a row for each t and cluster."""
    spark = hist.sparkSession
    names = spark.createDataFrame([(j, j >= plane.persistent, float(a), float(b)) for j, (a, b) in enumerate(plane.centres)], "cluster int, transient_phase boolean, neutron_centre double, xray_centre double")
    counts = hist.join(F.broadcast(plane.table(spark)), ["iy", "ix"]).groupBy("t", "cluster").agg(F.sum("count").alias("cells"))
    totals = counts.groupBy("t").agg(F.sum("cells").alias("total"))
    full = totals.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(len(plane.centres) - 1)))).join(counts, ["t", "cluster"], "left").join(F.broadcast(names), "cluster")
    cells = F.coalesce("cells", F.lit(0))
    fraction = cells / F.col("total")
    return full.select("t", "cluster", "transient_phase", "neutron_centre", "xray_centre", cells.alias("cells"), fraction.alias("fraction"), (fraction >= presence).alias("present"))


def cluster_series(cells: DataFrame, grid: Grid, k: int, transient: bool = True, emphasise_small: bool = False) -> DataFrame:
    """The timeline of a series: cells are counted by bin on the executors, once; its clusters are k persistent ones, then the transient islands."""
    hist = _table(histogram(cells, grid))
    return timeline(hist, series_plane(hist, grid, k, transient, emphasise_small))


def cluster_cells(cells: DataFrame, k: int, seed: int = 42, rounds: int = 20, bins: int = 128) -> DataFrame:
    """t, cluster, n, neutron_mean, xray_mean: k-means over all finite pairs at unit deviation, in at most k clusters, ascending by centre.

    The starts are the best of ten weighted clusterings of the pairs' counts on a grid between their extremes (bins x bins rows at most on
    the driver). Each round then sums all pairs by their nearest centre, from the source anew: a task keeps no pairs, and k rows reach the
    driver. The clusters don't depend on how rows lie in partitions.
    """
    rows = cells.where(both_finite())
    of = [f(c).alias(f"{n}_{c}") for c in ("neutron", "xray") for n, f in (("mean", F.avg), ("dev", F.stddev_pop), ("low", F.min), ("high", F.max))]
    m = rows.agg(*of).first()
    if m["mean_neutron"] is None:
        raise ValueError("no finite pairs")
    dev = {c: m[f"dev_{c}"] or 1.0 for c in ("neutron", "xray")}
    unit = rows.withColumns({n: (F.col(c) - m[f"mean_{c}"]) / dev[c] for n, c in (("_u", "neutron"), ("_v", "xray"))})
    place = [F.floor((F.col(c) - m[f"low_{c}"]) / ((m[f"high_{c}"] - m[f"low_{c}"]) or 1.0) * (bins - 1e-6)).alias(c) for c in ("neutron", "xray")]
    points = unit.groupBy(*place).agg(F.avg("_u").alias("u"), F.avg("_v").alias("v"), F.count("*").alias("n")).orderBy("neutron", "xray").toPandas()
    if len(points) < k:  # almost all pairs in few bins: the most frequent pairs instead
        points = unit.groupBy(F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "u", "v").limit(1000).toPandas()
    at, weights = points[["u", "v"]].to_numpy(), points["n"].to_numpy(float)
    k = min(k, len(at))
    starts = [lloyd(at, weights, k, seed=seed + i) for i in range(10)]
    centres = min(starts, key=lambda c: (((at[:, None] - c[None]) ** 2).sum(-1).min(1) * weights).sum())

    def own(centres: np.ndarray):
        gaps = [(F.col("_u") - float(u)) ** 2 + (F.col("_v") - float(v)) ** 2 for u, v in centres]
        return (F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))) - 1).cast("int")

    for _ in range(rounds):
        new = centres.copy()
        for r in unit.groupBy(own(centres).alias("j")).agg(F.avg("_u").alias("u"), F.avg("_v").alias("v")).collect():
            new[r["j"]] = r["u"], r["v"]
        moved, centres = ((new - centres) ** 2).sum(1).max(), new
        if moved <= 1e-8:
            break
    centres = centres[np.lexsort(centres.T[::-1])]
    return unit.groupBy("t", own(centres).alias("cluster")).agg(F.count("*").alias("n"), F.avg("neutron").alias("neutron_mean"), F.avg("xray").alias("xray_mean"))
