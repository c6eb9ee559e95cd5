"""Neighbour operators on cells with coordinates (z, y, x): adjacency, surfaces, blocks, growing regions, smoothing.

Face neighbours come from window functions along one axis at a time: a partition is one line of cells, so its size is that of an
axis, not of the volume.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.operators.ship import shipped

AXES = ("z", "y", "x")


def next_along(axis: str, value: str) -> Column:
    """The value of the next cell along an axis, null where that cell is missing."""
    others = [a for a in ("t", *AXES) if a != axis]
    order = Window.partitionBy(*others).orderBy(axis)
    return F.when(F.lead(axis).over(order) == F.col(axis) + 1, F.lead(value).over(order))


def face_pairs(cells: DataFrame, value: str) -> DataFrame:
    """t, a, b: the values of every two cells that share a face, once for each face."""
    out = None
    for axis in AXES:
        one = cells.select("t", F.col(value).alias("a"), next_along(axis, value).alias("b"))
        out = one if out is None else out.unionByName(one)
    return out.where("b IS NOT NULL")


def adjacency(cells: DataFrame, label: str = "label") -> DataFrame:
    """k, l, n: faces between labels, unordered pairs in both orders (so faces within one label count twice)."""
    pairs = face_pairs(cells, label).groupBy("a", "b").agg(F.count("*").alias("n"))
    both = pairs.select(F.col("a").alias("k"), F.col("b").alias("l"), "n").union(pairs.select("b", "a", "n"))
    return both.groupBy("k", "l").agg(F.sum("n").alias("n"))


def boundary_cost(counts: DataFrame, labels: int, epsilon: float = 1.0, most: float = 5.0) -> DataFrame:
    """k, l, cost: minus log of the smoothed chance of a neighbour, less a label's cost with itself, made symmetric, clipped to 0..most."""
    index = F.explode(F.sequence(F.lit(0), F.lit(labels - 1)))
    grid = counts.sparkSession.range(labels).select(F.col("id").cast("int").alias("k")).select("k", index.alias("l"))  # labels x labels literals
    full = grid.join(counts, ["k", "l"], "left").select("k", "l", (F.coalesce("n", F.lit(0)) + epsilon).alias("n"))
    raw = full.withColumn("raw", -F.log(F.col("n") / F.sum("n").over(Window.partitionBy("k"))))
    raw = raw.withColumn("raw", F.col("raw") - F.max(F.when(F.col("k") == F.col("l"), F.col("raw"))).over(Window.partitionBy("k")))
    other = raw.select(F.col("l").alias("k"), F.col("k").alias("l"), F.col("raw").alias("back"))
    cost = F.greatest(F.lit(0.0), F.least(F.lit(most), (F.col("raw") + F.col("back")) / 2))
    return raw.join(other, ["k", "l"]).select("k", "l", F.when(F.col("k") == F.col("l"), 0.0).otherwise(cost).alias("cost"))


def surface(cells: DataFrame, mask: str) -> DataFrame:
    """t, faces: faces between cells in and out of a mask; the border of the volume doesn't count."""
    return face_pairs(cells, mask).groupBy("t").agg(F.count_if(F.col("a") != F.col("b")).alias("faces"))


def interface(cells: DataFrame, first: int, second: int, label: str = "label") -> DataFrame:
    """t, faces between two labels."""
    touch = ((F.col("a") == first) & (F.col("b") == second)) | ((F.col("a") == second) & (F.col("b") == first))
    return face_pairs(cells, label).groupBy("t").agg(F.count_if(touch).alias("faces"))


def mass(cells: DataFrame, label: str = "label") -> DataFrame:
    """t, label, n, centre of mass, and the radius of gyration."""
    out = cells.groupBy("t", F.col(label).alias("label")).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"centre_{a}") for a in AXES], F.sqrt(sum(F.var_pop(a) for a in AXES)).alias("gyration"))
    return out


def block_median(cells: DataFrame, factor: int, channel: str = "neutron") -> DataFrame:
    """t, z, y, x of blocks, and the median of a channel in each full block; blocks that lack cells are left out."""
    block = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    out = cells.groupBy("t", *block).agg(F.count("*").alias("n"), F.median(channel).alias("median"))
    return out.where(F.col("n") == factor**3).drop("n")


def block_mask(cells: DataFrame, factor: int, mask: Column) -> DataFrame:
    """t, z, y, x of blocks, and whether any cell of the block is in the mask."""
    block = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    return cells.groupBy("t", *block).agg(F.coalesce(F.bool_or(mask), F.lit(False)).alias("hit"))


def _table(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which ends its lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/duovox-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_cells(cells: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
    """Both tables' columns by place (t, z, y, x). Labels and places take next to nothing in a Parquet file, so Spark would broadcast millions of them
    by the size of that file, through the driver; this join deals both sides out."""
    return cells.join(others.hint("merge"), ["t", *AXES], how)


def near_pairs(cells: DataFrame, value: str, reach: int) -> DataFrame:
    """a, b: the values of every two cells whose places differ by at most 1 on each axis and on at most `reach` axes (1: faces, 2: edges too,
    3: corners too), once for each. One equi-join on the place: each cell asks for its neighbours in one direction."""
    if reach == 1:
        return face_pairs(cells, value).select("a", "b")
    steps = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0) and abs(z) + abs(y) + abs(x) <= reach]
    moves = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(AXES, s)]) for s in steps]))
    asked = cells.select("t", *AXES, F.col(value).alias("a"), moves.alias("m")).select("t", *[(F.col(a) + F.col("m")[a]).alias(a) for a in AXES], "a")
    return with_cells(asked, cells.select("t", *AXES, F.col(value).alias("b"))).select("a", "b")


def tile_components(cells: DataFrame, reach: int, tile: tuple[int, int, int], low: tuple[int, int, int]) -> DataFrame:
    """t, z, y, x, part, comp: components within tiles of cells (t, z, y, x, id, part), named by their least id. A group is one tile."""
    steps = [s for s in product((-1, 0, 1), repeat=3) if s > (0, 0, 0) and sum(map(abs, s)) <= reach]
    number = [F.floor((F.col(a) - lo) / n).cast("int").alias(f"_{a}") for a, lo, n in zip(AXES, low, tile)]

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        at = np.array([f[a] for a in AXES]).T
        at -= at.min(0)
        place = np.full(at.max(0) + 3, -1, np.int64)  # a rim of missing cells
        place[tuple(at.T + 1)] = np.arange(len(f))
        part = pd.factorize(f["part"], use_na_sentinel=False)[0]
        a, b = [], []
        for s in steps:
            other = place[tuple((at + 1 + s).T)]
            here = np.flatnonzero(other >= 0)
            here = here[part[here] == part[other[here]]]
            a.append(here)
            b.append(other[here])
        a, b = np.concatenate(a), np.concatenate(b)
        name = np.arange(len(f))
        while True:  # every name takes the least name that it touches, then that name's own
            new = name.copy()
            least = np.minimum(name[a], name[b])
            np.minimum.at(new, name[a], least)
            np.minimum.at(new, name[b], least)
            while (new[new] != new).any():
                new = new[new]
            new = new[name]
            if (new == name).all():
                break
            name = new
        return f[["t", *AXES, "part"]].assign(comp=f["id"].to_numpy()[name])

    kind = cells.schema["part"].dataType.simpleString()
    return cells.select("t", *AXES, "id", "part", *number).groupBy("t", *[f"_{a}" for a in AXES]).applyInPandas(one, f"t int, z int, y int, x int, part {kind}, comp long")


def merged(links: DataFrame) -> DataFrame:
    """node, root of the nodes of links (a, b): root is the least node of its component. Each round puts the nodes in a new order (a hash), hooks each to its
    first neighbour and then to that one's, and contracts the links by the new names. By a hash a constant share of the names goes in each round, whatever
    the links look like (by the nodes' own order a chain of n nodes would lose two of them), so rounds grow with log n; they are tables in the shared folder."""
    ordered = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()
    edges, jumps = _table(ordered(links, "a", "b")), []
    while edges.limit(1).count():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(jumps)), c).alias("place"), F.col(c).alias("node"))
        first = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(place("b")).alias("first"))
        hook = first.select(F.col("a").alias("node"), F.least(place("a"), "first")["node"].alias("up"))
        jump = _table(hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"))
        jumps.append(jump)
        top = lambda c: jump.select(F.col("node").alias(c), F.col("top").alias(f"t{c}"))
        edges = _table(ordered(edges.join(top("a"), "a").join(top("b"), "b"), "ta", "tb"))
    if not jumps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = jumps[-1]
    for jump in jumps[-2::-1]:  # the last round's names are the fewest
        later = roots.select(F.col("node").alias("top"), F.col("top").alias("_later"))
        roots = jump.join(later, "top", "left").select("node", F.coalesce("_later", "top").alias("top"))
    roots = _table(roots)
    return roots.join(roots.groupBy("top").agg(F.min("node").alias("root")), "top").select("node", "root")


def connected(cells: DataFrame, mask: Column, reach: int = 1, apart: str | None = None, tile: tuple[int, int, int] = (32, 64, 64)) -> DataFrame:
    """t, z, y, x, component of the cells in a mask: components by faces (reach 1), edges (2) or corners (3), named by their least cell: a number
    that counts cells from the least coordinates, negative ones too. apart: a column whose values part components too.

    Components within tiles come first, in one task for each tile. Only cells in the outer layers of tiles look for neighbours in other ones, and their
    links, by component, are merged in rounds that contract them. Without cells in the mask there are no rows.
    """
    spans = cells.agg(*[f(a) for a in ("t", *AXES) for f in (F.min, F.max)]).first()
    if spans[0] is None:
        return cells.select("t", *AXES, F.lit(None).cast("long").alias("component"))
    (t0, _), *ends = [(spans[2 * k], spans[2 * k + 1]) for k in range(4)]
    low, (nz, ny, nx) = tuple(e[0] for e in ends), (e[1] - e[0] + 1 for e in ends)
    at = [F.col(a).cast("long") - lo for a, lo in zip(AXES, low)]
    ident = (((F.col("t").cast("long") - t0) * nz + at[0]) * ny + at[1]) * nx + at[2]
    part = F.lit(0) if apart is None else F.col(apart)
    shipped(cells.sparkSession)
    found = _table(tile_components(cells.where(mask).select("t", *AXES, ident.alias("id"), part.alias("part")), reach, tile, low))
    rest = [F.pmod(F.col(a) - lo, F.lit(n)) for a, lo, n in zip(AXES, low, tile)]
    outer = reduce(lambda p, q: p | q, [(r == 0) | (r == n - 1) for r, n in zip(rest, tile)])
    tiled = F.struct(*[F.floor((F.col(a) - lo) / n).alias(a) for a, lo, n in zip(AXES, low, tile)])
    pairs = near_pairs(found.where(outer).withColumn("_v", F.struct("comp", "part", tiled.alias("tile"))), "_v", reach)
    links = pairs.where("a.tile != b.tile AND a.part <=> b.part").select(F.col("a.comp").alias("a"), F.col("b.comp").alias("b"))
    roots = merged(links)
    named = found.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
    return named.select("t", *AXES, F.coalesce("root", "comp").alias("component"))


def grown(cells: DataFrame, seed: tuple[int, int, int, int], channel: str | tuple[str, ...], tolerance: float | tuple[float, ...], reach: int = 1) -> DataFrame:
    """The cells connected to a seed (t, z, y, x) by cells whose values are within tolerance of the seed's, in one channel or in each of several;
    none for a seed outside or without values. reach: as for connected."""
    channels, tolerances = ((channel,), (tolerance,)) if isinstance(channel, str) else (channel, tolerance)
    at = dict(zip(("t", *AXES), seed))
    here = cells
    for a, v in at.items():
        here = here.where(F.col(a) == v)
    values = here.select(*channels).first()
    if values is None or any(v is None for v in values):
        return cells.select("t", *AXES).limit(0)
    near = F.lit(True)
    for c, v, d in zip(channels, values, tolerances):
        near = near & (F.abs(F.col(c) - v) <= d)
    parts = connected(cells.where(F.col("t") == seed[0]), near, reach)
    own = parts
    for a, v in at.items():
        own = own.where(F.col(a) == v)
    return parts.join(own.select("component"), "component", "left_semi").select("t", *AXES)


def label_components(cells: DataFrame, label: str = "label", reach: int = 1) -> DataFrame:
    """t, label, components, largest_share: how many parts each label has, and its largest part's share of it."""
    parts = with_cells(connected(cells, F.col(label).isNotNull(), reach, label), cells.select("t", *AXES, F.col(label).alias("label")))
    sizes = parts.groupBy("t", "label", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("t", "label").agg(F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("largest_share"))


def label_rows(cells: DataFrame, label: str = "label") -> DataFrame:
    """mass of each label at each t, with surface over volume (border faces don't count) and the drift of its centre since the first t that has it."""
    faces = face_pairs(cells, label).where("a != b").select("t", F.explode(F.array("a", "b")).alias("label")).groupBy("t", "label").agg(F.count("*").alias("faces"))
    rows = mass(cells, label).join(faces, ["t", "label"], "left")
    first = Window.partitionBy("label").orderBy("t")  # a row for each t
    drift = F.sqrt(sum((F.col(f"centre_{a}") - F.first(f"centre_{a}").over(first)) ** 2 for a in AXES))
    return rows.select("t", "label", "n", *[f"centre_{a}" for a in AXES], "gyration", (F.coalesce("faces", F.lit(0)) / F.col("n")).alias("surface_share"), drift.alias("drift"))


def interface_rows(cells: DataFrame, label: str = "label") -> DataFrame:
    """t, first, second, faces of every two labels that touch."""
    return face_pairs(cells, label).where("a != b").groupBy("t", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).agg(F.count("*").alias("faces"))


def _gaps(cells: DataFrame) -> DataFrame:
    """t, z, y, x, axis, gap and last of each face between two cells, with the deviations sn and sx of the channels of t."""
    fine = lambda c: F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c))
    unit = lambda c: F.coalesce(F.nullif(F.stddev_pop(fine(c)), F.lit(0.0)), F.lit(1.0))
    sizes = [(F.max(a) - F.min(a) + 1) for a in AXES]
    volume = sizes[0] * sizes[1] * sizes[2]
    last = sum(F.when(n > 1, volume / n).otherwise(0) for n in sizes)
    scale = cells.groupBy("t").agg(unit("neutron").alias("sn"), unit("xray").alias("sx"), last.alias("last"))  # a row for each t
    faces = None
    for axis in AXES:
        pair = F.struct(fine("neutron").alias("n"), fine("xray").alias("x"))
        one = cells.withColumn("_v", pair).select("t", *AXES, F.lit(axis).alias("axis"), F.col("_v").alias("a"), next_along(axis, "_v").alias("b")).where("b IS NOT NULL")
        faces = one if faces is None else faces.union(one)
    gap = F.sqrt(((F.col("b.n") - F.col("a.n")) / F.col("sn")) ** 2 + ((F.col("b.x") - F.col("a.x")) / F.col("sx")) ** 2)
    return faces.join(F.broadcast(scale), "t").select("t", *AXES, "axis", gap.alias("gap"), "last", "sn", "sx")


def edge_scale(cells: DataFrame) -> DataFrame:
    """t, sn, sx, sigma: the channels' deviations and the mean gap of faces, the units of edge weights (see edge_weights). A row for each t."""
    mean = F.sum("gap") / (F.count("gap") + F.first("last"))
    return _gaps(cells).groupBy("t").agg(F.first("sn").alias("sn"), F.first("sx").alias("sx"), F.greatest(F.coalesce(mean, F.lit(1.0)), F.lit(1e-6)).alias("sigma"))


def edge_weights(cells: DataFrame) -> DataFrame:
    """t, z, y, x, axis, weight of each face between two cells, named by the lower one: exp(-(gap / sigma)^2 / 2), 0 where a value isn't finite.

    gap: joint step of both channels in units of their deviations; sigma: the mean finite gap of t, with the last layer along each axis
    as gap 0 (axes of one layer don't count). Needs a full grid for the count of the last layers: the extents come from the data.
    """
    gaps = _gaps(cells)
    mean = F.sum("gap") / (F.count("gap") + F.first("last"))
    sigma = gaps.groupBy("t").agg(F.greatest(F.coalesce(mean, F.lit(1.0)), F.lit(1e-6)).alias("sigma"))  # a row for each t
    return gaps.join(F.broadcast(sigma), "t").select("t", *AXES, "axis", F.coalesce(F.exp(-0.5 * (F.col("gap") / F.col("sigma")) ** 2), F.lit(0.0)).alias("weight"))


def block_ids(cells: DataFrame, shape: tuple[int, int, int], grid: tuple[int, int, int] = (5, 5, 5)) -> DataFrame:
    """cells with block: contiguous boxes of near equal edges, for validation by blocks."""
    index = [F.least(F.floor(F.col(a) * g / n), F.lit(g - 1)).cast("int") for a, n, g in zip(AXES, shape, grid)]
    return cells.withColumn("block", (index[0] * grid[1] + index[1]) * grid[2] + index[2])


def disagreement(cells: DataFrame, first: Column, second: Column) -> DataFrame:
    """t, both, only_first, only_second, jaccard of two masks (null where both are empty), and how many unlike cells have only unlike face neighbours along x."""
    rows = cells.select("t", *AXES, first.alias("a"), second.alias("b")).withColumn("unlike", (F.col("a") != F.col("b")).cast("int"))
    order = Window.partitionBy("t", "z", "y").orderBy("x")
    near = [F.when(shift("x").over(order) == F.col("x") + d, shift("unlike").over(order)) for shift, d in ((F.lag, -1), (F.lead, 1))]
    rows = rows.withColumn("deep", (F.col("unlike") == 1) & (F.coalesce(near[0], F.lit(1)) == 1) & (F.coalesce(near[1], F.lit(1)) == 1))
    out = rows.groupBy("t").agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(~F.col("a") & F.col("b")).alias("only_second"), F.count_if("deep").alias("deep"))
    return out.withColumn("jaccard", F.try_divide(F.col("both"), F.col("both") + F.col("only_first") + F.col("only_second")))
