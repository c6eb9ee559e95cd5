"""Non-negative factors of a series of histograms: a few components in the plane, and how much of each every timepoint holds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duovox.operators.spatial import _table

TINY = 1e-12


@dataclass
class Factors:
    """components: iy, ix and h, an array of the components' values in each bin; weights: (timepoint, component)."""

    times: list[int]
    weights: np.ndarray
    components: DataFrame

    def weight_rows(self) -> DataFrame:
        """t, component, weight."""
        rows = [(t, k, float(w)) for t, row in zip(self.times, self.weights) for k, w in enumerate(row)]
        return self.components.sparkSession.createDataFrame(rows, "t int, component int, weight double")

    def component_rows(self) -> DataFrame:
        """iy, ix, component, value."""
        return self.components.select("iy", "ix", F.posexplode("h").alias("component", "value"))

    def error(self) -> float:
        """Sum of the squared differences between the shares and their factors."""
        model = [sum((float(w) * F.get("h", F.lit(k)) for k, w in enumerate(row)), F.lit(0.0)) for row in self.weights]
        gaps = sum(((F.get("x", F.lit(i)) - m) ** 2 for i, m in enumerate(model)), F.lit(0.0))
        return float(self.components.agg(F.sum(gaps)).first()[0] or 0.0)


def histogram_factors(hist: DataFrame, rank: int = 3, rounds: int = 20) -> Factors:
    """Factors of each t's shares of cells by bin, by so many multiplicative updates (components, then weights) from a start without chance: component k starts as the mean of
    the k-th part of the timepoints, whose weights of it start at 1, those of all others at 0.1.

    hist: (t, iy, ix, count). A bin is a row with an array over t, so components are spread over tasks; what comes to the driver each round are the products
    of components with shares and with one another, (timepoints + rank) x rank sums. Each round's components are a table in the shared folder.
    """
    totals = {r["t"]: r["n"] for r in hist.groupBy("t").agg(F.sum("count").alias("n")).collect()}  # a row for each t
    times = sorted(totals)
    if not times:
        return Factors([], np.zeros((0, rank)), hist.select("iy", "ix", F.array().cast("array<double>").alias("x"), F.array().cast("array<double>").alias("h")).limit(0))
    part = np.array([min(i * rank // len(times), rank - 1) for i in range(len(times))])
    w = np.where(part[:, None] == np.arange(rank), 1.0, 0.1)
    by_t = hist.groupBy("iy", "ix").agg(F.map_from_entries(F.collect_list(F.struct("t", "count"))).alias("m"))
    share = [F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0)) / F.lit(float(totals[t])) for t in times]
    rows = by_t.select("iy", "ix", F.array(*share).alias("x"))
    mean = [sum((F.get("x", F.lit(i)) for i in np.flatnonzero(part == k).tolist()), F.lit(0.0)) / max(int((part == k).sum()), 1) + TINY for k in range(rank)]
    rows = _table(rows.withColumn("h", F.array(*mean)))
    x, h = [F.get("x", F.lit(i)) for i in range(len(times))], [F.get("h", F.lit(k)) for k in range(rank)]
    for _ in range(rounds):
        gram = w.T @ w
        top = [sum((float(w[i, k]) * x[i] for i in range(len(times))), F.lit(0.0)) for k in range(rank)]
        low = [sum((float(gram[k, j]) * h[j] for j in range(rank)), F.lit(0.0)) for k in range(rank)]
        rows = _table(rows.withColumn("h", F.array(*[h[k] * top[k] / (low[k] + TINY) for k in range(rank)])))
        sums = rows.agg(*[F.sum(a * b) for a in x for b in h], *[F.sum(a * b) for a in h for b in h]).first()
        both = np.array(sums, float)
        cross, own = both[: len(times) * rank].reshape(len(times), rank), both[len(times) * rank :].reshape(rank, rank)
        w = w * cross / (w @ own + TINY)
    return Factors(times, w, rows)
