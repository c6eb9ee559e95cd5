"""Region files (JSON) and selection files (.bits) as regions and tables. Paths are read by Spark, so they may lie on any file system that it knows.

A region file holds a handful of regions: they go to the driver, since they become literals of filters. Masks of selections may be as large as
a volume: they stay in Spark and become rows of cells.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duovox.functions.plane import Region
from duovox.operators.spatial import AXES


@dataclass(frozen=True)
class Shape:
    """A rectangle (n0, n1, x0, x1) or a polygon that has no name yet."""

    rectangle: tuple[float, float, float, float] | None = None
    points: tuple[tuple[float, float], ...] = ()


@dataclass(frozen=True)
class RegionFile:
    """What a region file holds: the active shape, earlier ones without a name, and named regions."""

    active: Shape | None = None
    pending: tuple[Shape, ...] = ()
    regions: tuple[Region, ...] = ()


def _flat(corners) -> tuple[float, float, float, float]:
    """Corners in a file are low and high points (n, x, n, x)."""
    n0, x0, n1, x1 = map(float, corners)
    return n0, n1, x0, x1


def _corners(r: tuple[float, float, float, float]) -> list[float]:
    return [r[0], r[2], r[1], r[3]]


def _points(points) -> tuple[tuple[float, float], ...]:
    return tuple((float(n), float(x)) for n, x in points)


def _shape(d: dict | None) -> Shape | None:
    kind = (d or {}).get("type")
    return Shape(points=_points(d["points"])) if kind == "polygon" else Shape(_flat(d["bounds"])) if kind == "rectangle" else None


def _shape_dict(s: Shape | None) -> dict:
    return {"type": None} if s is None else {"type": "rectangle", "bounds": _corners(s.rectangle)} if s.rectangle is not None else {"type": "polygon", "points": [list(p) for p in s.points]}


def parsed(text: str) -> RegionFile:
    """The regions of a file's text. Old files are one shape; visible is true and layer_only false where they aren't named. Other keys, such as colours, are ignored."""
    data = json.loads(text)
    if "type" in data:
        return RegionFile(_shape(data))
    named = []
    for e in data.get("named_rois", []):
        where = {"points": _points(e["points"])} if e["roi_type"] == "polygon" else {"rectangle": _flat(e["rectangle"])}
        named.append(Region(str(e["name"]), int(e["class_id"]), **where, visible=bool(e.get("visible", True)), layer_only=bool(e.get("layer_only", False))))
    pending = [s for s in map(_shape, data.get("pending", [])) if s is not None]
    return RegionFile(_shape(data.get("active")), tuple(pending), tuple(named))


def written(file: RegionFile) -> str:
    named = []
    for r in file.regions:
        e = {"name": r.name, "class_id": r.class_id, "visible": r.visible, "layer_only": r.layer_only}
        named.append(e | ({"roi_type": "polygon", "points": [list(p) for p in r.points]} if r.rectangle is None else {"roi_type": "rectangle", "rectangle": _corners(r.rectangle)}))
    return json.dumps({"active": _shape_dict(file.active), "pending": [_shape_dict(s) for s in file.pending], "named_rois": named})


def read_regions(spark: SparkSession, path: str) -> RegionFile:
    """The region file at a path, or in a folder that write_regions made."""
    texts = spark.read.text(path, wholetext=True).where("trim(value) != ''").limit(2).collect()
    if len(texts) != 1:
        raise ValueError(f"{path}: one region file is expected")
    return parsed(texts[0].value)


def write_regions(spark: SparkSession, file: RegionFile, path: str) -> None:
    spark.createDataFrame([(written(file),)], "value string").coalesce(1).write.mode("overwrite").text(path)


_ITEM = "struct<name string, cluster_id int, visible boolean, spatial_mask string, histogram_roi array<array<double>>, color string>"


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    """selection (its place in the file, from 0), name, cluster_id, visible (true if not named), mask (JSON text), roi, color (JSON text) of a .bits file.

    A file without a list of selections is an error; null masks and outlines stay null."""
    text = spark.read.text(path, wholetext=True)
    data = text.select(F.from_json("value", f"struct<selections array<{_ITEM}>>").alias("d"))
    items = data.select(F.when(F.col("d.selections").isNull(), F.raise_error(F.lit("not a .bits file: no list of selections"))).otherwise(F.col("d.selections")).alias("s"))
    rows = items.select(F.posexplode("s").alias("selection", "e"))
    return rows.select("selection", "e.name", "e.cluster_id", F.coalesce("e.visible", F.lit(True)).alias("visible"), F.col("e.spatial_mask").alias("mask"), F.col("e.histogram_roi").alias("roi"), "e.color")


def selection_cells(selections: DataFrame) -> DataFrame:
    """selection, z, y, x, nz, ny, nx: the cells in each mask, with the mask's extents. A flat mask is one slice."""
    deep = F.from_json("mask", "array<array<array<boolean>>>")
    solid = F.coalesce(F.get(F.get(F.get(deep, F.lit(0)), F.lit(0)), F.lit(0)).isNotNull(), F.lit(False))
    mask = F.when(solid, deep).otherwise(F.array(F.from_json("mask", "array<array<boolean>>")))
    rows = selections.where("mask IS NOT NULL").select("selection", mask.alias("m"))
    sizes = [F.size("m").alias("nz"), F.size(F.get("m", F.lit(0))).alias("ny"), F.size(F.get(F.get("m", F.lit(0)), F.lit(0))).alias("nx")]
    slices = rows.select("selection", *sizes, F.posexplode("m").alias("z", "m"))
    lines = slices.select("selection", "nz", "ny", "nx", "z", F.posexplode("m").alias("y", "m"))
    return lines.select("selection", "nz", "ny", "nx", "z", "y", F.posexplode("m").alias("x", "inside")).where("inside").select("selection", *AXES, "nz", "ny", "nx")


def selection_statistics(cells: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics and the skipped selections, for cells (z, y, x, neutron, xray) of one volume, numbered from 0.

    Statistics: selection, name, cluster_id, cells, percent of the volume, and mean, std (population), min and max of both channels. A
    selection without a cell gives no row. Skipped: selection, name of masks whose extents aren't the volume's.
    """
    inside = selection_cells(selections)
    volume = cells.agg(*[(F.max(a) + 1).alias(f"v_{a}") for a in AXES], F.count("*").alias("total"))
    fits = " AND ".join(f"n{a} = v_{a}" for a in AXES)
    both = inside.join(F.broadcast(volume))  # one row
    names = selections.select("selection", "name", "cluster_id")
    each = both.where(fits).select("selection", *AXES, "total").join(cells.select(*AXES, "neutron", "xray"), list(AXES)).groupBy("selection")
    stats = each.agg(F.count("*").alias("cells"), (100 * F.count("*") / F.first("total")).alias("percent"), *[f(c).alias(f"{c}_{n}") for c in ("neutron", "xray") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    skipped = both.where(f"NOT ({fits})").select("selection").distinct().join(names, "selection").select("selection", "name")
    return names.join(stats, "selection"), skipped
