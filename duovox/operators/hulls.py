"""Convex hulls: each task keeps the hulls of what it has seen, and these few points are merged by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duovox.operators.ship import shipped


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n, 2), counter-clockwise from the least; fewer than three where they lie on a line."""
    p = np.unique(points, axis=0)
    if len(p) > 512:  # the lowest and highest of each first coordinate are enough
        ends = np.flatnonzero(np.concatenate([[True], p[1:, 0] != p[:-1, 0]]))
        p = p[np.unique(np.concatenate([ends, np.append(ends[1:], len(p)) - 1]))]
    if len(p) < 3:
        return p

    def chain(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    rows = list(map(tuple, p.tolist()))
    return np.array(chain(rows) + chain(rows[::-1]))


def hulls(points: DataFrame, by: list[str], u: str, v: str) -> DataFrame:
    """by, corner, u, v: corners of the hull of each group's finite points, numbered counter-clockwise from the least. Partial hulls within tasks come first, so what
    is grouped is small whatever the group's size."""
    shipped(points.sparkSession)
    rows = points.select(*by, F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v")).where("abs(u) < double('infinity') AND abs(v) < double('infinity')")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def corners(f: pd.DataFrame, numbered: bool) -> pd.DataFrame:
        out = []
        for key, g in f.groupby(by, dropna=False, sort=False):
            h = hull(g[["u", "v"]].to_numpy(float))
            part = pd.DataFrame(dict(zip(by, key if isinstance(key, tuple) else (key,))) | {"u": h[:, 0], "v": h[:, 1]})
            out.append(part.assign(corner=np.arange(len(h))) if numbered else part)
        columns = [*by, *(["corner"] if numbered else []), "u", "v"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            if len(f):
                held = corners(f if held is None else pd.concat([held, f]), False)
                if len(held) > 100_000:
                    yield held
                    held = None
        if held is not None:
            yield held

    merged = ", ".join([*kinds.split(", ")[: len(by)], "corner int", "u double", "v double"])
    return rows.mapInPandas(partial, kinds).groupBy(*by).applyInPandas(lambda f: corners(f, True), merged)


def hull_measures(corners: DataFrame, by: list[str]) -> DataFrame:
    """by, corners, area and length of the outline of each hull (see hulls); area 0 for those on a line."""
    packed = corners.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("corner", "u", "v"))).alias("_p"))
    after = lambda i: F.get("_p", F.pmod(i + 1, F.size("_p")))
    sums = lambda f: F.aggregate(F.transform("_p", lambda a, i: f(a, after(i))), F.lit(0.0), lambda s, x: s + x)
    area = sums(lambda a, b: a["u"] * b["v"] - b["u"] * a["v"]) / 2
    length = sums(lambda a, b: F.hypot(b["u"] - a["u"], b["v"] - a["v"]))
    return packed.select(*by, F.size("_p").alias("corners"), F.when(F.size("_p") > 2, area).otherwise(0.0).alias("area"), length.alias("length"))


def slice_hulls(cells: DataFrame, mask) -> DataFrame:
    """t, z, area, corners, convex_area, solidity, convex_length of a mask in each slice that it touches: the hull of its cells' centres. Cells in one line count as convex:
    their own area, solidity 1."""
    inside = cells.where(F.coalesce(mask, F.lit(False))).select("t", "z", "y", "x")
    area = inside.groupBy("t", "z").agg(F.count("*").alias("cells"))
    measured = hull_measures(hulls(inside, ["t", "z"], "y", "x"), ["t", "z"])
    flat = F.col("area") <= 0
    return area.join(measured, ["t", "z"]).select(
        "t", "z", F.col("cells").alias("area"), "corners", F.when(flat, F.col("cells").cast("double")).otherwise(F.col("area")).alias("convex_area"), F.when(flat, 1.0).otherwise(F.col("cells") / F.col("area")).alias("solidity"), F.col("length").alias("convex_length")
    )


def outline(points: DataFrame, by: list[str], u: str = "neutron", v: str = "xray", margin: float = 0.05) -> DataFrame:
    """by, corner, u, v: a polygon around each group's points, the hull grown by margin about the mean of its corners. Points on one line, or fewer than three, get
    their bounding box, padded by margin of its sides (half a unit or a millionth of the value where a side is 0)."""
    found = hulls(points, by, u, v)
    s = found.groupBy(*by).agg(F.count("*").alias("_corners"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), *[f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))])
    grown = found.join(s, by).where("_corners > 2").select(*by, "corner", *[(F.col(f"m{c}") + (F.col(c) - F.col(f"m{c}")) * (1 + margin)).alias(c) for c in "uv"])
    pad = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * margin).otherwise(F.greatest(F.abs(F.col(f"lo_{c}")) * 1e-6, F.lit(0.5)))
    low, high = ({c: F.col(f"{n}_{c}") + sign * pad(c) for c in "uv"} for n, sign in (("lo", -1), ("hi", 1)))
    box = F.array(*[F.struct(F.lit(k).alias("corner"), a["u"].alias("u"), b["v"].alias("v")) for k, (a, b) in enumerate(((low, low), (high, low), (high, high), (low, high)))])
    return grown.unionByName(s.where("_corners <= 2").select(*by, F.inline(box)))
