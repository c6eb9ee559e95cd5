"""Transient islands: parts of the histogram plane that hold cells at some timepoints only.

Histograms (t, iy, ix, count) are smoothed, and summed over t, on the executors; only the plane itself, a number for each of bins x bins
bins, and the sums of each island for each t reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel(bins: int, sigma: float) -> list[tuple[int, int, float]]:
    """(source, target, weight) of a Gaussian cut at four deviations, with mirrored edges."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    mirrored = lambda i: min(i % (2 * bins), 2 * bins - 1 - i % (2 * bins))
    return [(mirrored(j + k), j, w / sum(raw)) for j in range(bins) for k, w in zip(range(-radius, radius + 1), raw)]


def smoothed(hist: DataFrame, bins: int, sigma: float = 1.0) -> DataFrame:
    """t, iy, ix, level: each t's histogram under a Gaussian, along one axis after the other. Bins that no weight reaches have no row."""
    out = hist.select("t", "iy", "ix", F.col("count").cast("double").alias("level"))
    if sigma <= 0:
        return out
    rows = hist.sparkSession.createDataFrame(kernel(bins, sigma), "source int, target int, weight double")  # bins x (8 sigma + 1) rows
    for axis in ("iy", "ix"):
        rest = [c for c in ("iy", "ix") if c != axis]
        spread = out.join(F.broadcast(rows), F.col(axis) == F.col("source"))
        out = spread.groupBy("t", *rest, F.col("target").alias(axis)).agg(F.sum(F.col("level") * F.col("weight")).alias("level"))
    return out.select("t", "iy", "ix", "level")


def around(plane: np.ndarray, fill, reduce) -> np.ndarray:
    """reduce over each bin and its eight neighbours."""
    wide, (n, m) = np.pad(plane, 1, constant_values=fill), plane.shape
    return reduce([wide[y : y + n, x : x + m] for y in range(3) for x in range(3)], axis=0)


def groups(mask: np.ndarray) -> np.ndarray:
    """The least index of each bin's group, by edges and corners; mask.size outside."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        new = np.where(mask, around(label, mask.size, np.min), mask.size)
        if (new == label).all():
            return label
        label = new


def transient_islands(
    hist: DataFrame, bins: int, max_share: float = 0.5, sigma: float = 1.0, level: float = 0.5, min_cells: int = 10, vanish: float = 0.2
) -> tuple[np.ndarray, list[int]]:
    """The plane of bins with the number of each one's island (-1: none), and the islands' peaks, the largest first.

    Bins at `level` or more at fewer than max_share of the timepoints grow, by 3 sigma and a bin, into neighbours that aren't occupied more often.
    A group of them is an island if at its peak it holds min_cells, and five times the count noise above its median, and
    at some timepoint at most `vanish` of the peak. Equal peaks go by least bin (iy, then ix). Fewer than two timepoints: none.
    """
    none = np.full((bins, bins), -1), []
    times = hist.select("t").distinct().count()
    if times < 2:
        return none
    seen = smoothed(hist, bins, sigma).where(F.col("level") >= level).groupBy("iy", "ix").agg(F.count("*").alias("n")).toPandas()
    share = np.zeros((bins, bins))
    share[seen["iy"], seen["ix"]] = seen["n"] / times
    open_, mask = share < max_share, (share > 0) & (share < max_share)
    for _ in range(math.ceil(3 * sigma) + 1):
        mask = around(mask, False, np.any) & open_
    label = groups(mask)
    spots = [(int(y), int(x), int(label[y, x])) for y, x in zip(*np.nonzero(mask))]
    if not spots:
        return none
    table = hist.sparkSession.createDataFrame(spots, "iy int, ix int, island int")  # at most bins x bins rows
    sums = hist.join(F.broadcast(table), ["iy", "ix"]).groupBy("island", "t").agg(F.sum("count").alias("n")).toPandas()
    kept = []
    for island, part in sums.groupby("island"):
        each = np.zeros(times)
        each[: len(part)] = part["n"]
        peak, typical = each.max(), np.median(each)
        if peak >= min_cells and peak >= typical + 5 * np.sqrt(typical + 1) and each.min() <= vanish * peak:
            kept.append((-peak, island))
    kept.sort()
    out = none[0]
    for number, (_, island) in enumerate(kept):
        out[label == island] = number
    return out, [int(-p) for p, _ in kept]


def island_counts(hist: DataFrame, plane: np.ndarray, peaks: list[int]) -> DataFrame:
    """island, t, cells: a row for each island of a plane and each t of hist."""
    spots = [(int(y), int(x), int(plane[y, x])) for y, x in zip(*np.nonzero(plane >= 0))]
    table = hist.sparkSession.createDataFrame(spots, "iy int, ix int, island int")
    sums = hist.join(F.broadcast(table), ["iy", "ix"]).groupBy("island", "t").agg(F.sum("count").alias("cells"))
    every = hist.select("t").distinct().withColumn("island", F.explode(F.array(*map(F.lit, range(len(peaks))))) if peaks else F.explode(F.array().cast("array<int>")))
    return every.join(sums, ["island", "t"], "left").select("island", "t", F.coalesce("cells", F.lit(0)).alias("cells"))
