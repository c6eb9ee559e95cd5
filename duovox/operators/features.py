"""Features of cells at several scales: peaks, valleys, blobs and joint peaks of slices, and filter banks of volumes; in tiles with a halo.

Gaussians reach four deviations to each side; past the border values are mirrored. A cell whose stencil meets a missing, null or
non-finite cell has no response: it is no feature, and thresholds leave it out. Thresholds are exact quantiles of a slice's responses;
a feature lies above them. Cells of one slice that tie for the largest response of a neighbourhood are all features.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duovox.operators.quantiles import exact_quantiles
from duovox.operators.spatial import AXES, _table
from duovox.operators.stencils import TILE, null_for_nan, tiled

#: Tiles of slices: wide, since the halo of a scale of 20 cells is 80 wide.
SLICES = (1, 256, 256)
TINY = 1e-10


def kernel(sigma: float, order: int = 0) -> np.ndarray:
    """A Gaussian that sums to one, or its first or second derivative."""
    x = np.arange(-reach_of(sigma), reach_of(sigma) + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    return (g, -x / sigma**2 * g, (x**2 / sigma**4 - 1 / sigma**2) * g)[order]


def reach_of(sigma: float) -> int:
    return int(4 * sigma + 0.5)


def along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along an axis; shorter by the weights' reach on both sides. Each cell's terms are added in one order, whatever the tile."""
    n = a.shape[axis] - len(weights) + 1
    return sum(w * np.take(a, range(k, k + n), axis) for k, w in enumerate(weights))


def filtered(a: np.ndarray, sigma: float, orders: tuple[int, ...], axes: tuple[int, ...]) -> np.ndarray:
    for order, axis in zip(orders, axes):
        a = along(a, kernel(sigma, order), axis)
    return a


def laplacian(a: np.ndarray, sigma: float, axes: tuple[int, ...]) -> np.ndarray:
    """The sum of second derivatives of a Gaussian along axes."""
    return sum(filtered(a, sigma, tuple(2 * (b == axis) for b in axes), axes) for axis in axes)


def trimmed(a: np.ndarray, layers: int, axes: tuple[int, ...]) -> np.ndarray:
    return a[tuple(slice(layers, a.shape[k] - layers) if k in axes else slice(None) for k in range(a.ndim))] if layers else a


def largest(a: np.ndarray, before: int, after: int) -> np.ndarray:
    """The largest value of y - before .. y + after and x - before .. x + after of a slice that is wider by max(before, after) on both sides."""
    wide = max(before, after)
    for axis in (1, 2):
        n = a.shape[axis] - 2 * wide
        a = np.max([np.take(a, range(wide + k, wide + k + n), axis) for k in range(-before, after + 1)], axis=0)
    return a


def responses(cells: DataFrame, value: str, reach: int, respond: Callable[[np.ndarray], dict[str, np.ndarray]], window: int, tile: tuple[int, int, int], more: str = "") -> DataFrame:
    """t, z, y, x, response, top and what else respond gives, as a table.

    respond takes a tile that is wider by reach along y and x, and gives arrays without these layers. top: no other
    response within a square of `window` cells around the cell, which for even windows lies one cell to the low side, is larger.
    """
    before, after = window // 2, window - window // 2 - 1
    wide = max(before, after)

    def run(arrays, cut):
        out = respond(np.pad(arrays[value], cut, "symmetric"))
        held = np.nan_to_num(out["response"], nan=-np.inf)
        for axis in (1, 2):  # layers past the border take no part
            n, (low, high) = held.shape[axis], cut[axis]
            past = [*range(max(0, low - reach)), *range(n - max(0, high - reach), n)]
            held[tuple(past if k == axis else slice(None) for k in range(3))] = -np.inf
        inner = {k: trimmed(v, wide, (1, 2)) for k, v in out.items()}
        return {**inner, "top": np.isfinite(inner["response"]) & (inner["response"] == largest(held, before, after))}

    rows = tiled(cells, [value], (0, reach + wide, reach + wide), run, f"response double, top boolean{more}", tile)
    return _table(rows.withColumn("response", F.nanvl("response", F.lit(None))))


def above(found: DataFrame, share: float) -> DataFrame:
    """The cells on top whose response is above the quantile `share` of their slice."""
    marks = exact_quantiles(found, ["t", "z"], "response", [share]).select("t", "z", F.col("q")[0].alias("threshold"))
    return found.where("top").join(marks, ["t", "z"]).where("response > threshold").drop("top", "threshold")


def finite(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _peaks(cells: DataFrame, value: Column, percentile: float, distance: int, sigma: float, tile: tuple[int, int, int]) -> DataFrame:
    rows = cells.select("t", *AXES, finite(value).alias("_v"))
    smooth = lambda a: {"response": filtered(a, sigma, (0, 0), (1, 2))}
    return above(responses(rows, "_v", reach_of(sigma), smooth, distance, tile), percentile / 100)


def peaks(cells: DataFrame, channel: str = "neutron", percentile: float = 90, distance: int = 10, sigma: float = 2.0, tile: tuple[int, int, int] = SLICES) -> DataFrame:
    """t, z, y, x, response: places of each slice with the largest smoothed value around them, above a percentile of the slice."""
    return _peaks(cells, F.col(channel), percentile, distance, sigma, tile)


def valleys(cells: DataFrame, channel: str = "neutron", percentile: float = 10, distance: int = 10, sigma: float = 2.0, tile: tuple[int, int, int] = SLICES) -> DataFrame:
    """t, z, y, x, response: places with the least smoothed value around them, below a percentile of the slice."""
    return _peaks(cells, -F.col(channel), 100 - percentile, distance, sigma, tile).withColumn("response", -F.col("response"))


def _by_slice(cells: DataFrame, **measures: Column) -> DataFrame:
    """cells with aggregates of their slice; a row for each slice, joined without a hint, so that Spark broadcasts them if they are small."""
    rows = cells.groupBy("t", "z").agg(*[m.alias(n) for n, m in measures.items()])
    return cells.join(rows, ["t", "z"])


def blobs(cells: DataFrame, channel: str = "neutron", scales: tuple[float, float] = (2.0, 20.0), steps: int = 10, percentile: float = 80, tile: tuple[int, int, int] = SLICES) -> DataFrame:
    """t, z, y, x, response, radius: bright blobs of each slice and the scale that answers most, the least of equals.

    A scale's response is minus its squared deviation times the Laplacian of the Gaussian, on values between 0 and 1 of the slice.
    Memory holds one scale of a tile at a time, and the largest response so far.
    """
    sigmas = np.linspace(*scales, steps)
    reach = reach_of(sigmas.max())
    rows = _by_slice(cells.select("t", *AXES, finite(F.col(channel)).alias("v")), least=F.min("v"), most=F.max("v"))
    rows = rows.select("t", *AXES, ((F.col("v") - F.col("least")) / (F.col("most") - F.col("least") + TINY)).alias("_v"))

    def respond(a):
        best = radius = None
        for sigma in sigmas:
            one = -laplacian(trimmed(a, reach - reach_of(sigma), (1, 2)), sigma, (1, 2)) * sigma**2
            if best is None:
                best, radius = one, np.full(one.shape, sigma)
            else:
                better = one > best
                best, radius = np.maximum(one, best), np.where(better, sigma, radius)
        return {"response": best, "radius": radius}

    return above(responses(rows, "_v", reach, respond, 3, tile, ", radius double"), percentile / 100)


def bivariate_features(cells: DataFrame, method: str = "correlation", percentile: float = 90, distance: int = 10, sigma: float = 2.0, tile: tuple[int, int, int] = SLICES) -> DataFrame:
    """t, z, y, x, response: peaks of both channels together. method: 'correlation' (product of standard scores of the slice), 'product'
    (product of shares of the slice's largest values) or 'both' (the product of these two)."""
    if method not in ("correlation", "product", "both"):
        raise ValueError(f"no such method: {method}")
    n, x = F.col("_n"), F.col("_x")
    rows = cells.select("t", *AXES, finite(F.col("neutron")).alias("_n"), finite(F.col("xray")).alias("_x"))
    rows = _by_slice(rows, mn=F.avg(n), mx=F.avg(x), sn=F.stddev_pop(n), sx=F.stddev_pop(x), hn=F.max(n), hx=F.max(x))
    scores = (n - F.col("mn")) / (F.col("sn") + TINY) * (x - F.col("mx")) / (F.col("sx") + TINY)
    shares = F.try_divide(n, F.col("hn")) * F.try_divide(x, F.col("hx"))
    return _peaks(rows, {"correlation": scores, "product": shares, "both": scores * shares}[method], percentile, distance, sigma, tile)


def filter_bank(cells: DataFrame, channels: tuple[str, ...] = ("neutron", "xray"), sigmas: tuple[float, ...] = (0.7, 1.6, 3.5), gradient: float = 1.0, laplace: float = 1.6, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x and, for each channel c, c itself, c_smooth_1.. (Gaussians along all axes), c_gradient (size of the gradient) and c_laplace; null near missing cells."""
    reach = reach_of(max(*sigmas, gradient, laplace))
    names = [f"{c}{n}" for c in channels for n in ("", *[f"_smooth_{k + 1}" for k in range(len(sigmas))], "_gradient", "_laplace")]
    axes = (0, 1, 2)

    def run(arrays, cut):
        out = {}
        for c in channels:
            a = np.pad(arrays[c], cut, "symmetric")
            near = lambda sigma, a=a: trimmed(a, reach - reach_of(sigma), axes)
            out[c] = trimmed(a, reach, axes)
            for k, sigma in enumerate(sigmas):
                out[f"{c}_smooth_{k + 1}"] = filtered(near(sigma), sigma, (0, 0, 0), axes)
            out[f"{c}_gradient"] = np.sqrt(sum(filtered(near(gradient), gradient, tuple(int(b == axis) for b in axes), axes) ** 2 for axis in axes))
            out[f"{c}_laplace"] = laplacian(near(laplace), laplace, axes)
        return out

    rows = cells.select("t", *AXES, *[finite(F.col(c)).alias(c) for c in channels])
    return null_for_nan(tiled(rows, list(channels), reach, run, ", ".join(f"{n} double" for n in names), tile), names)
