"""Alignment of two channels: the shift of the second against the first at which their joint histogram tells most, for each timepoint."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duovox.operators.spatial import AXES, _table
from duovox.operators.stencils import TILE, null_for_nan, tiled


def blurred(cells: DataFrame, sigma: float, channels: tuple[str, ...] = ("neutron", "xray"), tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x and the channels after a Gaussian of sigma cells (four of them to each side); past the border values are mirrored. Null near null cells."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def run(arrays, cut):
        out = {}
        for c in channels:
            a = np.pad(arrays[c], cut, "symmetric")
            for axis in range(3):
                n = a.shape[axis] - 2 * radius
                a = sum(w * np.take(a, range(k, k + n), axis) for k, w in enumerate(kernel))
            out[c] = a
        return out

    return null_for_nan(tiled(cells, list(channels), radius, run, ", ".join(f"{c} double" for c in channels), tile), list(channels))


def prepared(cells: DataFrame, bins: int = 32, smoothing: float = 1.0) -> DataFrame:
    """t, z, y, x, a, b: the bins of both channels, smoothed, between their least and largest values at t; values that aren't finite take the median of t."""
    fine = lambda c: F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c))
    rows = cells.select("t", *AXES, fine("neutron").alias("neutron"), fine("xray").alias("xray"))
    if rows.where("neutron IS NULL OR xray IS NULL").limit(1).count():
        middle = rows.groupBy("t").agg(*[F.coalesce(F.percentile_approx(c, 0.5, 10_000), F.lit(0.0)).alias(f"m_{c}") for c in ("neutron", "xray")])  # a row for each t
        rows = rows.join(F.broadcast(middle), "t").select("t", *AXES, *[F.coalesce(c, f"m_{c}").alias(c) for c in ("neutron", "xray")])
    if smoothing > 0:
        rows = _table(blurred(rows, smoothing))
    ends = rows.groupBy("t").agg(*[f(c).alias(f"{n}_{c}") for c in ("neutron", "xray") for n, f in (("lo", F.min), ("hi", F.max))])  # a row for each t
    rows = rows.join(F.broadcast(ends), "t")

    def bin_of(c: str):
        span = F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0))
        return F.coalesce(F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / span * bins), F.lit(bins - 1)), F.lit(0)).cast("int")

    return rows.select("t", *AXES, bin_of("neutron").alias("a"), bin_of("xray").alias("b"))


def shift_information(binned: DataFrame, axis: int, reach: int, margins: tuple[int, int, int], places: DataFrame | None = None) -> DataFrame:
    """t, shift, information (nats) of shifts -reach..reach of b along one axis, on the cells at least a margin inside the extents; places (t, z, y, x): shifts
    along the other axes. One pass: a window gives each cell its neighbours along the axis, one join on the place brings both channels together."""
    along, others = AXES[axis], [a for k, a in enumerate(AXES) if k != axis]
    ends = binned.agg(*[f(a) for a in AXES for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return binned.select("t", F.lit(0).alias("shift"), F.lit(0.0).alias("information")).limit(0)
    inner = F.lit(True)
    for k, (a, m) in enumerate(zip(AXES, margins)):
        inner = inner & F.col(a).between(ends[2 * k] + m, ends[2 * k + 1] - m)
    line = Window.partitionBy("t", *others).orderBy(along)
    # a cell's b moved by s along the axis comes from the cell s before it
    near = [F.when(F.lag(along, s).over(line) == F.col(along) - s, F.lag("b", s).over(line)) if s else F.col("b") for s in range(-reach, reach + 1)]
    moved = binned.select("t", *AXES, F.array(*near).alias("moved"))
    if places is not None:
        at = places.select("t", *[F.lit(0).alias(f"_{a}") if a == along else F.col(a).alias(f"_{a}") for a in AXES])
        moved = moved.join(F.broadcast(at), "t").select("t", *[(F.col(a) + F.col(f"_{a}")).alias(a) for a in AXES], "moved")  # a row for each t
    pairs = binned.where(inner).select("t", *AXES, "a").join(moved, ["t", *AXES]).select("t", "a", F.posexplode("moved").alias("k", "b")).where("b IS NOT NULL")
    joint = pairs.groupBy("t", "k", "a", "b").agg(F.count("*").alias("n"))
    side = lambda *by: F.sum("n").over(Window.partitionBy("t", "k", *by))  # noqa: E731  # at most bins x bins rows for each t and shift
    told = F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("rows") * F.col("columns"))))
    out = joint.withColumns({"total": side(), "rows": side("a"), "columns": side("b")}).groupBy("t", "k").agg(told.alias("information"))
    return out.select("t", (F.col("k") - reach).cast("int").alias("shift"), "information")


@dataclass
class _Search:
    """The state of one timepoint's search: a few numbers."""

    place: list[int]
    known: dict[tuple[int, int, int], float]
    moved: bool = True

    def at(self, axis: int, value: int) -> tuple[int, int, int]:
        return tuple(value if k == axis else p for k, p in enumerate(self.place))


ALIGNED = "t int, shift_z double, shift_y double, shift_x double, supported array<boolean>, correction array<int>, before double, after double, error double, worth boolean"


def alignment(cells: DataFrame, most: int = 4, tolerance: float = 0.01, bins: int = 32, smoothing: float = 1.0) -> DataFrame:
    """t, shift_z, shift_y, shift_x, supported, correction, before, after, error, worth: by how many cells xray must move to lie on neutron.

    Whole shifts of up to `most` cells are searched along one axis after the other, three times at most, all timepoints at once: a pass over the cells for each
    axis, of which the information of each shift comes back (a few numbers for each t). A parabola through the best and its neighbours gives the fraction. An
    axis is supported if two cells off the best the information is lower by more than tolerance of it; else its shift is 0, as for axes too short to
    search. correction: whole cells, from 0.75 on; worth: some of it is not 0 and supported. Ties go to the smaller shift.
    """
    binned = _table(prepared(cells, bins, smoothing))
    spark = cells.sparkSession
    ends = binned.agg(*[f(a) for a in AXES for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return spark.createDataFrame([], ALIGNED)
    margins = tuple(min(most + 2, (ends[2 * k + 1] - ends[2 * k] + 1) // 3) for k in range(3))
    reach = [max(m - 2, 0) for m in margins]
    searches = {r["t"]: _Search([0, 0, 0], {}) for r in binned.select("t").distinct().collect()}

    def look(axis: int, width: int) -> None:
        places = spark.createDataFrame([(t, *s.place) for t, s in searches.items()], "t int, z int, y int, x int")
        for r in shift_information(binned, axis, width, margins, places).collect():
            searches[r["t"]].known[searches[r["t"]].at(axis, r["shift"])] = r["information"]

    for _ in range(3):
        for s in searches.values():
            s.moved = False
        for axis in range(3):
            look(axis, reach[axis])
            for s in searches.values():
                best = max(range(-reach[axis], reach[axis] + 1), key=lambda v: (s.known.get(s.at(axis, v), 0.0), -v))
                s.moved |= best != s.place[axis]
                s.place[axis] = best
        if not any(s.moved for s in searches.values()):
            break
    for axis in range(3):  # two cells beyond the best lie within the margin
        look(axis, min(most + 2, max(margins[axis], 0)))
    rows = []
    for t, s in sorted(searches.items()):
        after, final, supported = s.known.get(tuple(s.place), 0.0), [0.0] * 3, [False] * 3
        for axis in range(3):
            if reach[axis] < 1:
                continue
            step = lambda d, axis=axis: s.known.get(s.at(axis, s.place[axis] + d), 0.0)
            supported[axis] = after > 0 and after - max(step(-2), step(2)) > tolerance * after
            if supported[axis]:
                bend = step(-1) - 2 * after + step(1)
                delta = 0.5 * (step(-1) - step(1)) / bend if bend < 0 else 0.0
                final[axis] = s.place[axis] + min(max(delta, -0.5), 0.5)
        before = s.known.get((0, 0, 0), 0.0)
        correction = [int(np.round(v)) if abs(v) >= 0.75 else 0 for v in final]
        rows.append((t, *map(float, final), supported, correction, before, after, 1 - before / after if after > 0 else 0.0, any(correction) and any(supported)))
    return spark.createDataFrame(rows, ALIGNED)
