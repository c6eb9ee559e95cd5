"""Boxes and grids: crops and their places, shifts, finer grids, and values under a rectangle of a slice."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duovox.operators.spatial import AXES


@dataclass(frozen=True)
class Box:
    """Half-open ranges of z, y and x, at least one cell each."""

    z: tuple[int, int]
    y: tuple[int, int]
    x: tuple[int, int]

    def __post_init__(self):
        if any(not 0 <= lo < hi for lo, hi in self.ranges):
            raise ValueError("a box needs 0 <= low < high on every axis")

    @property
    def ranges(self) -> tuple[tuple[int, int], ...]:
        return self.z, self.y, self.x

    @classmethod
    def of_rectangle(cls, axis: str, rectangle: tuple[float, float, float, float], shape: tuple[int, int, int], factor: int = 1, along: tuple[int, int] | None = None) -> Box:
        """The cells under a rectangle (row, row, column, column; either order) of a view along an axis whose pixels are `factor` cells wide."""
        rows, columns = [a for a in AXES if a != axis]
        spans = {axis: along or (0, shape[AXES.index(axis)])}
        for a, ends in ((rows, rectangle[:2]), (columns, rectangle[2:])):
            spans[a] = (math.floor(min(ends)) * factor, math.ceil(max(ends)) * factor)
        clipped = {}
        for a, n in zip(AXES, shape):
            lo = min(max(spans[a][0], 0), n - 1)
            clipped[a] = (lo, max(min(spans[a][1], n), lo + 1))
        return cls(**clipped)

    def with_range(self, axis: str, lo: int, hi: int) -> Box:
        return replace(self, **{axis: (min(lo, hi), max(lo, hi))})

    def holds(self) -> Column:
        """Literal ranges, which reach the scan."""
        out = F.lit(True)
        for a, (lo, hi) in zip(AXES, self.ranges):
            out = out & (F.col(a) >= lo) & (F.col(a) < hi)
        return out

    def fraction(self, shape: tuple[int, int, int]) -> float:
        return math.prod(hi - lo for lo, hi in self.ranges) / math.prod(shape)

    def on_plane(self, axis: str, factor: int = 1) -> tuple[float, float, float, float]:
        """The footprint in pixels of a view along an axis: row, row, column, column."""
        return tuple(v / factor for a, r in zip(AXES, self.ranges) if a != axis for v in r)


def embedded(cells: DataFrame, part: DataFrame, values: list[str], fill: float = 0.0) -> DataFrame:
    """t, z, y, x of cells with the values of part where it has them, and fill elsewhere."""
    key = ["t", *AXES]
    held = part.select(*key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_here"))
    return cells.select(*key).join(held, key, "left").select(*key, *[F.when(F.col("_here"), F.col(f"_{v}")).otherwise(F.lit(fill)).alias(v) for v in values])


def shifted(cells: DataFrame, by: tuple[float, float, float], value: str = "xray") -> DataFrame:
    """t, z, y, x, and a channel moved by whole or fractional cells: linear between the cells around the place it comes from.

    Null where one of these is missing or null. A whole shift relabels each cell once; a fraction on an axis doubles the rows.
    """
    parts = [(math.floor(d), d - math.floor(d)) for d in by]
    corners = [(0, 0, 0)]
    for k, (_, f) in enumerate(parts):
        if f:
            corners += [tuple(c[j] + (j == k) for j in range(3)) for c in corners]
    weight = lambda c: math.prod((f if c[k] else 1 - f) for k, (_, f) in enumerate(parts))
    moves = F.explode(F.array(*[F.struct(*[F.lit(whole + c[k]).alias(a) for k, (a, (whole, _)) in enumerate(zip(AXES, parts))], F.lit(float(weight(c))).alias("w")) for c in corners]))
    moved = cells.select("t", *AXES, value, moves.alias("m")).select("t", *[(F.col(a) + F.col("m")[a]).cast("int").alias(a) for a in AXES], (F.col(value) * F.col("m.w")).alias("p"))
    sums = moved.groupBy("t", *AXES).agg(F.when(F.count("p") == len(corners), F.sum("p")).alias(value))
    return cells.select("t", *AXES).join(sums, ["t", *AXES], "left")


def upscaled(cells: DataFrame, blocks: DataFrame, factor: int, value: str) -> DataFrame:
    """t, z, y, x of cells with the value of their block; cells past the last whole block take the nearest one."""
    last = blocks.groupBy("t").agg(*[F.max(a).alias(f"_last_{a}") for a in AXES])  # a row for each t
    at = cells.select("t", *AXES).join(F.broadcast(last), "t").select("t", *AXES, *[F.least(F.floor(F.col(a) / factor).cast("int"), F.col(f"_last_{a}")).alias(f"_{a}") for a in AXES])
    held = blocks.select("t", *[F.col(a).alias(f"_{a}") for a in AXES], value)
    return at.join(held, ["t", *[f"_{a}" for a in AXES]], "left").select("t", *AXES, value)


def strided(cells: DataFrame, step: int, axes: tuple[str, ...] = ("t", *AXES)) -> DataFrame:
    """Every step-th cell along each axis (a sampling operator)."""
    out = cells
    for a in axes:
        out = out.where(F.pmod(F.col(a), F.lit(step)) == 0)
    return out


def value_rectangle(cells: DataFrame, margin: float = 0.05) -> DataFrame:
    """n0, n1, x0, x1: the range of both channels widened by a margin; a constant channel counts as a tenth of its size wide, or 1; 0, 1 for no cells."""
    ends = cells.agg(*[f(c).alias(f"{n}_{c[0]}") for c in ("neutron", "xray") for n, f in (("min", F.min), ("max", F.max))])
    out = []
    for c in "nx":
        lo, hi = F.col(f"min_{c}"), F.col(f"max_{c}")
        width = F.when(hi > lo, hi - lo).otherwise(F.when(lo != 0, F.abs(lo) * 0.1).otherwise(1.0))
        out += [F.coalesce(lo - width * margin, F.lit(0.0)).alias(f"{c}0"), F.coalesce(hi + width * margin, F.lit(1.0)).alias(f"{c}1")]
    return ends.select(*out)


def overlay(cells: DataFrame, mask: Column, channel: str = "neutron", colour: tuple[int, int, int] = (255, 0, 0), alpha: float = 0.3) -> DataFrame:
    """t, z, y, x, r, g, b of 0 to 255: grey from the finite range of each slice, blended with a colour under a mask. Non-finite cells are black."""
    v = F.when(F.abs(F.col(channel)) < F.lit(math.inf), F.col(channel))
    ends = cells.groupBy("t", "z").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))  # a row for each slice
    lo, hi = F.col("_lo"), F.col("_hi")
    grey = F.coalesce(F.when(hi > lo, F.floor((v - lo) / (hi - lo) * 255)).otherwise(0), F.lit(0))
    cells = cells.join(ends, ["t", "z"])
    rows = cells.select("t", *AXES, grey.alias("grey"), F.coalesce(mask, F.lit(False)).alias("m"))
    blend = lambda c: F.when(F.col("m"), F.floor(F.col("grey") * (1 - alpha) + c * alpha + 1e-9)).otherwise(F.col("grey")).cast("int")
    return rows.select("t", *AXES, *[blend(c).alias(n) for n, c in zip("rgb", colour)])
