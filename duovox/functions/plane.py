"""Column expressions over the plane of two channels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """Neither null, NaN nor infinite. NaN compares as larger than any number, so this test comes first."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(math.inf))


def both_finite(a: str = "neutron", b: str = "xray") -> Column:
    return is_finite(F.col(a)) & is_finite(F.col(b))


@dataclass(frozen=True)
class Grid:
    """A square grid of bins over the value ranges of both channels."""

    n_lo: float
    n_hi: float
    x_lo: float
    x_hi: float
    bins: int

    def neutron_bin(self, value: Column | None = None) -> Column:
        return bin_of(F.col("neutron") if value is None else value, self.n_lo, self.n_hi, self.bins)

    def xray_bin(self, value: Column | None = None) -> Column:
        return bin_of(F.col("xray") if value is None else value, self.x_lo, self.x_hi, self.bins)

    def inside(self) -> Column:
        return F.col("neutron").between(self.n_lo, self.n_hi) & F.col("xray").between(self.x_lo, self.x_hi)

    def neutron_centre(self, index: Column) -> Column:
        return F.lit(self.n_lo) + (index + 0.5) * F.lit((self.n_hi - self.n_lo) / self.bins)

    def xray_centre(self, index: Column) -> Column:
        return F.lit(self.x_lo) + (index + 0.5) * F.lit((self.x_hi - self.x_lo) / self.bins)

    @property
    def area(self) -> float:
        return (self.n_hi - self.n_lo) * (self.x_hi - self.x_lo)


def bin_of(value: Column, lo: float, hi: float, bins: int) -> Column:
    """The bin of a value by the floor rule. The upper edge belongs to the last bin; values outside go to the edge bins."""
    raw = F.floor((value - F.lit(lo)) / F.lit(hi - lo) * bins)
    return F.greatest(F.lit(0), F.least(raw, F.lit(bins - 1))).cast("int")


def in_rectangle(n: Column, x: Column, rectangle: tuple[float, float, float, float]) -> Column:
    """Inclusive on all four sides (neutron low and high, xray low and high)."""
    n0, n1, x0, x1 = rectangle
    return n.between(n0, n1) & x.between(x0, x1)


def in_polygon(n: Column, x: Column, points: list[tuple[float, float]]) -> Column:
    """Non-zero winding number, behind a bounding-box test that a Parquet scan can use."""
    turns = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        left = (bx - ax) * (x - ay) - (n - ax) * (by - ay)
        up = F.when((F.lit(ay) <= x) & (F.lit(by) > x) & (left > 0), 1)
        turns = turns + up.when((F.lit(ay) > x) & (F.lit(by) <= x) & (left < 0), -1).otherwise(0)
    box = (min(p[0] for p in points), max(p[0] for p in points), min(p[1] for p in points), max(p[1] for p in points))
    return in_rectangle(n, x, box) & (turns != 0)


@dataclass(frozen=True)
class Region:
    """A named region of the plane: a rectangle or a polygon. Hidden regions and those for layers only select nothing."""

    name: str
    class_id: int
    rectangle: tuple[float, float, float, float] | None = None
    points: tuple[tuple[float, float], ...] = ()
    visible: bool = True
    layer_only: bool = False

    def __post_init__(self):
        if self.rectangle is not None and not (self.rectangle[0] < self.rectangle[1] and self.rectangle[2] < self.rectangle[3]):
            raise ValueError(f"{self.name}: a rectangle needs positive extents")
        if self.rectangle is None and len(self.points) < 3:
            raise ValueError(f"{self.name}: a polygon needs three points")

    def holds(self, n: str = "neutron", x: str = "xray") -> Column:
        if self.rectangle is not None:
            return in_rectangle(F.col(n), F.col(x), self.rectangle)
        return in_polygon(F.col(n), F.col(x), list(self.points))

    def area(self) -> float:
        if self.rectangle is not None:
            n0, n1, x0, x1 = self.rectangle
            return (n1 - n0) * (x1 - x0)
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(self.points, self.points[1:] + self.points[:1]))) / 2


def segmentable(regions: list[Region]) -> list[Region]:
    return [r for r in regions if r.visible and not r.layer_only]


def in_any(regions: list[Region]) -> Column:
    """The union of the visible regions."""
    used = segmentable(regions)
    if not used:
        raise ValueError("no region to select by")
    out = used[0].holds()
    for r in used[1:]:
        out = out | r.holds()
    return out


def class_of(regions: list[Region]) -> Column:
    """The class of the last visible region that holds the pair, 0 for none."""
    out = F.lit(0)
    for r in segmentable(regions):
        out = F.when(r.holds(), r.class_id).otherwise(out)
    return out
