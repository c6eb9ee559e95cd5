"""Stencils and morphology on cells with coordinates (t, z, y, x), in tiles of bounded size along all three axes.

A tile carries a halo, so that its own cells come out as from the whole volume; past the volume's border the nearest layer counts.
A stencil that meets a missing, null or non-finite cell inside the volume gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.operators.ship import shipped
from duovox.operators.spatial import AXES, with_cells

TILE = (32, 64, 64)


def tiled(cells: DataFrame, values: list[str], halo: int | tuple[int, int, int], run: Callable[..., dict[str, np.ndarray]], returns: str, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x and the columns that run gives for each tile. halo: layers on all sides, or for each axis.

    run(arrays, cut): arrays by name over the tile and its halo within the volume, with NaN for missing cells, and how many halo layers the
    border cuts off on both sides of each axis; it returns arrays over the tile alone. A cell is copied to the tiles whose halo it
    lies in; tile edges of at least the halo keep that to 27 copies, and far fewer for thin halos.
    """
    shipped(cells.sparkSession)
    ends = cells.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]).first()
    low = np.array([ends[f"min_{a}"] or 0 for a in AXES])
    high = np.array([(ends[f"max_{a}"] or 0) + 1 for a in AXES])
    wide = np.array((halo,) * 3 if isinstance(halo, int) else halo)
    rows = cells.select("t", *AXES, *[F.col(v).cast("double").alias(v) for v in values])
    for k, (a, n) in enumerate(zip(AXES, tile)):
        at, reach = F.col(a) - int(low[k]), int(wide[k])
        rows = rows.withColumn(f"_{a}", F.explode(F.sequence(F.greatest(F.floor((at - reach) / n), F.lit(0)), F.least(F.floor((at + reach) / n), F.lit(int((high[k] - low[k] - 1) // n))))))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        number = f[[f"_{a}" for a in AXES]].iloc[0].to_numpy()
        first = low + number * np.array(tile)
        last = np.minimum(first + np.array(tile), high)
        start, stop = np.maximum(first - wide, low), np.minimum(last + wide, high)
        at = tuple((f[a].to_numpy() - s) for a, s in zip(AXES, start))
        arrays = {}
        for v in values:
            arrays[v] = np.full(tuple(stop - start), np.nan)
            arrays[v][at] = f[v].to_numpy(float)
        cut = [(int(h - (a - b)), int(h - (d - c))) for h, a, b, c, d in zip(wide, first, start, last, stop)]
        out = run(arrays, cut)
        own = f[np.logical_and.reduce([(f[a] >= x) & (f[a] < y) for a, x, y in zip(AXES, first, last)])]
        inner = tuple(own[a].to_numpy() - x for a, x in zip(AXES, first))
        return own[["t", *AXES]].assign(**{c: v[inner] for c, v in out.items()})

    return rows.groupBy("t", *[f"_{a}" for a in AXES]).applyInPandas(one, f"t int, z int, y int, x int, {returns}")


def boxed(a: np.ndarray, radius: int) -> np.ndarray:
    """Means of boxes of 2 radius + 1 cells a side; the result is smaller by radius on all sides."""
    for axis in range(3):
        n = a.shape[axis] - 2 * radius
        a = sum(np.take(a, range(k, k + n), axis) for k in range(2 * radius + 1)) / (2 * radius + 1)
    return a


def slopes(a: np.ndarray) -> list[np.ndarray]:
    """Sobel derivatives along z, y and x; smaller by one on all sides."""
    out = []
    for along in range(3):
        g = a
        for axis in range(3):
            n = g.shape[axis] - 2
            p = [np.take(g, range(k, k + n), axis) for k in range(3)]
            g = p[2] - p[0] if axis == along else p[0] + 2 * p[1] + p[2]
        out.append(g)
    return out


def null_for_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("t", *AXES, *[F.nanvl(c, F.lit(None)).alias(c) for c in columns])


def local_moments(cells: DataFrame, channel: str = "neutron", radius: int = 1, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x, mean and std (population) over the box of 2 radius + 1 cells a side around each cell."""

    def run(arrays, cut):
        a = np.pad(arrays[channel], cut, "edge")
        mean = boxed(a, radius)
        return {"mean": mean, "std": np.sqrt(np.maximum(boxed(a * a, radius) - mean * mean, 0))}

    return null_for_nan(tiled(cells, [channel], radius, run, "mean double, std double", tile), ["mean", "std"])


def gradients(cells: DataFrame, epsilon: float = 1e-6, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x, gradient_n, gradient_x (Sobel magnitudes) and coherence: the cosine's size between both channels' gradients."""

    def run(arrays, cut):
        a, b = (slopes(np.pad(arrays[c], cut, "edge")) for c in ("neutron", "xray"))
        n, x = (np.sqrt(sum(u * u for u in g)) for g in (a, b))
        return {"gradient_n": n, "gradient_x": x, "coherence": np.abs(sum(u * v for u, v in zip(a, b))) / (n * x + epsilon)}

    names = ["gradient_n", "gradient_x", "coherence"]
    return null_for_nan(tiled(cells, ["neutron", "xray"], 1, run, ", ".join(f"{n} double" for n in names), tile), names)


def structure(cells: DataFrame, channel: str = "neutron", radius: int = 1, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x, anisotropy, planarity: from the ordered eigenvalues of the gradient's outer product, averaged over a box. At the border the nearest cell's products count."""

    def run(arrays, cut):
        g = slopes(np.pad(arrays[channel], cut, "edge"))
        beyond = [(max(0, a - 1), max(0, b - 1)) for a, b in cut]  # layers of g past the border: the nearest product takes their place
        inside = tuple(slice(a, n - b) for (a, b), n in zip(beyond, g[0].shape))
        tensor = np.empty((*(n - 2 * radius for n in g[0].shape), 3, 3))
        for i in range(3):
            for j in range(i, 3):
                tensor[..., i, j] = tensor[..., j, i] = boxed(np.pad((g[i] * g[j])[inside], beyond, "edge"), radius)
        bad = ~np.isfinite(tensor).all((-1, -2))
        tensor[bad] = 0
        low, middle, high = np.moveaxis(np.maximum(np.linalg.eigvalsh(tensor), 0), -1, 0)
        total = low + middle + high + 1e-12
        return {"anisotropy": np.where(bad, np.nan, (high - low) / total), "planarity": np.where(bad, np.nan, 2 * (middle - low) / total)}

    return null_for_nan(tiled(cells, [channel], radius + 1, run, "anisotropy double, planarity double", tile), ["anisotropy", "planarity"])


def eroded(cells: DataFrame, mask: Column, steps: int, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x, depth of the cells in a mask: how many erosions by faces they survive, up to steps; beyond the volume nothing is in the mask."""

    def run(arrays, cut):
        left = np.pad(np.nan_to_num(arrays["_in"]), cut) > 0
        middle = tuple(slice(steps, n - steps) for n in left.shape)
        depth = np.zeros(tuple(n - 2 * steps for n in left.shape), np.int32)
        for _ in range(steps):
            wide = np.pad(left, 1)
            for axis in range(3):
                for k in (0, 2):
                    left = left & np.take(wide, range(k, k + left.shape[axis]), axis)[tuple(slice(None) if x == axis else slice(1, -1) for x in range(3))]
            depth += left[middle]
        return {"depth": depth}

    inside = cells.withColumn("_in", F.coalesce(mask, F.lit(False)).cast("int"))
    return with_cells(tiled(inside, ["_in"], steps, run, "depth int", tile), inside.where("_in = 1").select("t", *AXES))


def survival(cells: DataFrame, first: Column, second: Column, steps: int = 4, rind: int = 2) -> DataFrame:
    """t, n, survival_1.., f_rind of the cells that just one of two masks holds: the share that is left after each erosion; f_rind is 1 without such cells."""
    differs = F.coalesce(first, F.lit(False)) != F.coalesce(second, F.lit(False))
    some = eroded(cells, differs, steps).groupBy("t").agg(F.count("*").alias("n"), *[F.avg((F.col("depth") >= k).cast("double")).alias(f"survival_{k}") for k in range(1, steps + 1)])
    every = cells.select("t").distinct().join(some, "t", "left")
    return every.select("t", F.coalesce("n", F.lit(0)).alias("n"), *[f"survival_{k}" for k in range(1, steps + 1)], F.coalesce(1 - F.col(f"survival_{rind}"), F.lit(1.0)).alias("f_rind"))


def slice_shapes(cells: DataFrame, mask: Column) -> DataFrame:
    """t, z and the shape of a mask in each slice that it touches.

    perimeter: cells out of the mask with an edge neighbour in it; inner: cells of the mask with an edge neighbour out of it or past the border.
    Circularity is 0 without perimeter; the moments give centroid, orientation, eccentricity and aspect ratio.
    """
    rows = cells.select("t", *AXES, F.coalesce(mask, F.lit(False)).cast("int").alias("m"))
    near = []
    for a, others in (("y", ["t", "z", "x"]), ("x", ["t", "z", "y"])):
        line = Window.partitionBy(*others).orderBy(a)
        near += [F.when(f(a).over(line) == F.col(a) + d, f("m").over(line)) for f, d in ((F.lag, -1), (F.lead, 1))]
    rows = rows.withColumn("around", F.array(*[F.coalesce(n, F.lit(0)) for n in near]))
    rows = rows.withColumns({"outer": (F.col("m") == 0) & F.array_contains("around", 1), "inner": (F.col("m") == 1) & F.array_contains("around", 0)})
    own = lambda c: F.when(F.col("m") == 1, F.col(c))
    s = rows.groupBy("t", "z").agg(
        F.sum("m").alias("area"), F.count_if("outer").alias("perimeter"), F.count_if("inner").alias("inner"),
        *[f(own(a)).alias(f"{n}_{a}") for a in ("y", "x") for n, f in (("min", F.min), ("max", F.max), ("centre", F.avg), ("var", F.var_pop))], F.covar_pop(own("y"), own("x")).alias("cov"),
    ).where("area > 0")
    p, a = F.col("perimeter"), F.col("area")
    b = F.sqrt(4 * F.col("cov") ** 2 + (F.col("var_y") - F.col("var_x")) ** 2)
    s = s.withColumns({"l1": (F.col("var_y") + F.col("var_x") + b) / 2, "l2": (F.col("var_y") + F.col("var_x") - b) / 2})
    flat = F.col("l2") <= 1e-12
    return s.select(
        "t", "z", "area", "perimeter", "min_y", "max_y", "min_x", "max_x", F.col("centre_y"), F.col("centre_x"),
        F.when(p == 0, 0.0).otherwise(4 * np.pi * a / p**2).alias("circularity"), (p**2 / a).alias("compactness"), ((p + F.col("inner")) / a).alias("roughness"),
        F.when(F.abs(F.col("var_y") - F.col("var_x")) < 1e-12, 0.0).otherwise(0.5 * F.atan2(2 * F.col("cov"), F.col("var_y") - F.col("var_x"))).alias("orientation"),
        F.when(F.col("l1") > 1e-12, F.sqrt(F.greatest(1 - F.col("l2") / F.col("l1"), F.lit(0.0)))).otherwise(0.0).alias("eccentricity"), F.when(flat, 1.0).otherwise(F.sqrt(F.col("l1") / F.col("l2"))).alias("aspect_ratio"),
    )
