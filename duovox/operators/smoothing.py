"""Smoothing of labels: soft or hard messages between face neighbours, with costs by pair of labels and weights by face, in tiles of bounded size.

Tiles carry a halo of one layer for each sweep, and one for the energy, so every cell comes out as from the whole volume.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duovox.functions.plane import Grid, Region, both_finite, class_of
from duovox.operators import materials
from duovox.operators.histograms import moments
from duovox.operators.spatial import AXES, _table, adjacency, boundary_cost, connected, edge_scale, with_cells
from duovox.operators.stencils import TILE, tiled

DAMPING = 0.5
#: Strengths that the automatic search tests at least, and the share of cells below which one more step changes nothing.
STRENGTHS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
SETTLED = 0.002


def uniform_cost(labels: int) -> np.ndarray:
    """Every change of label costs the same."""
    return 1.0 - np.eye(labels)


def learned_cost(cells: DataFrame, label: str, labels: int) -> np.ndarray:
    """Costs of pairs of the labels 0..labels - 1 from how often they touch (see spatial.boundary_cost): labels x labels numbers."""
    known = cells.where(F.col(label).between(0, labels - 1))
    out = np.zeros((labels, labels))
    for r in boundary_cost(adjacency(known, label), labels).collect():
        out[r["k"], r["l"]] = r["cost"]
    return out


def with_unknown(cost: np.ndarray) -> np.ndarray:
    """One more label, for what matches no class, whose changes cost the median of all others: neither free nor prohibitive."""
    k = len(cost)
    other = cost[~np.eye(k, dtype=bool)]
    out = np.full((k + 1, k + 1), float(np.median(other)) if other.size else 1.0)
    out[:k, :k] = cost
    out[k, k] = 0.0
    return out


def faces(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Views of the lower and the upper cells of all faces along an axis."""
    n = a.shape[axis]
    low, high = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    low[axis], high[axis] = slice(0, n - 1), slice(1, n)
    return a[tuple(low)], a[tuple(high)]


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def smoothed(cells: DataFrame, scores: list[str], beta: float, sweeps: int = 5, method: str = "mean_field", cost: np.ndarray | None = None, edges: bool = False, damping: float = DAMPING, tile: tuple[int, int, int] = TILE, scale: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """t, z, y, x, label (the index of a score), energy after so many sweeps over all cells at once.

    mean_field: shares of labels, each sweep by the softmax of a cell's scores less beta times what its neighbours' shares cost, damped. icm: the label of the
    largest such value, neighbours' labels taken as they are. Ties go to the first label. cost: by pair of labels, or alike for all. edges: faces
    weigh exp(-(gap / sigma)^2 / 2) of both channels' steps (see spatial.edge_weights), needs neutron and xray. energy: minus the cell's score and beta times
    the costs of its faces to upper neighbours; its sum is that of the volume. A cell with a null or NaN score takes no part: label and energy are null.
    scale: the cells' edge_scale as a table, where it is known. carry: int columns of cells that come along.
    """
    if method not in ("mean_field", "icm"):
        raise ValueError(f"unknown method {method}")
    k = len(scores)
    cost = uniform_cost(k) if cost is None else np.asarray(cost, float)
    if cost.shape != (k, k):
        raise ValueError("cost must have a row and a column for each score")
    channels = []
    if edges:
        scale = _table(edge_scale(cells)) if scale is None else scale  # else each pass over the cells would find it anew
        scale = F.broadcast(scale.select("t", (F.col("sn") * F.col("sigma")).alias("unit_n"), (F.col("sx") * F.col("sigma")).alias("unit_x")))  # a row for each t
        cells = cells.join(scale, "t").withColumns({"step_n": F.col("neutron") / F.col("unit_n"), "step_x": F.col("xray") / F.col("unit_x")})
        channels = ["step_n", "step_x"]
    halo = sweeps + 1 if beta > 0 else 1

    def run(arrays, cut):
        score = np.stack([arrays[c] for c in scores], -1)
        valid = np.isfinite(score).all(-1)
        score[~valid] = 0
        weights = []
        for axis in range(3):
            w = np.ones(faces(valid, axis)[0].shape)
            if edges:
                steps = [np.subtract(*faces(arrays[c], axis)[::-1]) for c in channels]
                w = np.nan_to_num(np.exp(-0.5 * sum(s * s for s in steps)), nan=0.0)
            low, high = faces(valid, axis)
            weights.append((w * (low & high))[..., None])

        def messages(held):
            total = np.zeros_like(held)
            for axis in range(3):
                (low, high), (to_low, to_high) = faces(held, axis), faces(total, axis)
                to_low += high * weights[axis]
                to_high += low * weights[axis]
            return total @ cost.T

        if method == "mean_field":
            held = softmax(score) * valid[..., None]
            for _ in range(sweeps if beta > 0 else 0):
                new = softmax(score - beta * messages(held))
                held = (damping * new + (1 - damping) * held) * valid[..., None]
            label = held.argmax(-1)
        else:
            label = score.argmax(-1)
            for _ in range(sweeps if beta > 0 else 0):
                label = (score - beta * messages(np.eye(k)[label] * valid[..., None])).argmax(-1)
        energy = -np.take_along_axis(score, label[..., None], -1)[..., 0]
        for axis in range(3):
            low, high = faces(label, axis)
            faces(energy, axis)[0][...] += beta * cost[low, high] * weights[axis][..., 0]
        inner = tuple(slice(halo - a, n - halo + b) for (a, b), n in zip(cut, label.shape))
        return {"label": np.where(valid, label, -1)[inner].astype(np.int32), "energy": np.where(valid, energy, np.nan)[inner], **{c: arrays[c][inner] for c in carry}}

    out = tiled(cells, [*scores, *channels, *carry], halo, run, ", ".join(["label int, energy double", *[f"{c} double" for c in carry]]), tile)
    along = [F.nanvl(c, F.lit(None)).cast("int").alias(c) for c in carry]
    return out.select("t", *AXES, F.when(F.col("label") >= 0, F.col("label")).alias("label"), F.nanvl("energy", F.lit(None)).alias("energy"), *along)


def opened(cells: DataFrame, mask: str, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x, opened: whether a cell of a boolean column lies in its opening by faces (an erosion, then a dilation). Nothing lies beyond the volume."""

    def run(arrays, cut):
        inside = np.pad(np.nan_to_num(arrays["_in"]) > 0, cut)
        for grow in (False, True):
            wide = inside if not grow else ~inside
            kept = wide.copy()
            for axis in range(3):
                low, high = faces(wide, axis)
                to_low, to_high = faces(kept, axis)
                to_low &= high
                to_high &= low
                if not grow:  # the rim has nothing around it
                    edge = np.moveaxis(kept, axis, 0)
                    edge[0] = edge[-1] = False
            inside = kept if not grow else ~kept
        return {"opened": inside[2:-2, 2:-2, 2:-2]}

    rows = cells.withColumn("_in", F.coalesce(F.col(mask), F.lit(False)).cast("int"))
    return tiled(rows, ["_in"], 2, run, "opened boolean", tile)


def thin_parts(cells: DataFrame, mask: str, least: int = 20, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """t, z, y, x, component of the cells of a mask in connected parts (by faces) of `least` cells or more that an opening takes away whole: sheets,
    threads and fresh layers, at most two cells thick."""
    parts = with_cells(connected(cells, F.coalesce(F.col(mask), F.lit(False)), tile=tile), opened(cells, mask, tile))
    thin = parts.groupBy("t", "component").agg(F.count("*").alias("n"), F.bool_or("opened").alias("left")).where((F.col("n") >= least) & ~F.col("left"))
    return parts.drop("opened").join(thin.select("t", "component").hint("merge"), ["t", "component"], "left_semi")


def locked_scores(cells: DataFrame, regions: list[Region], grid: Grid, defined_at: int = 0, floor: float = 1e-4) -> tuple[DataFrame, list[str], list[materials.Material]]:
    """cells (with coordinates) with a score for each class of the regions and for none of them (s0, s1, ...; the last), by bin; null outside the grid.

    Scores are made once for each bin; the table, at most bins x bins rows for each t, goes back to the cells by one join on the bin.
    """
    library = materials.materials(materials.class_library(cells.where(F.col("t") == defined_at), regions), regions)
    names = [f"s{k}" for k in range(len(library) + 1)]
    none = F.lit(-float(np.log(grid.area)) + float(np.log(floor)))
    table = moments(cells, grid).select("t", F.col("iy").alias("_iy"), F.col("ix").alias("_ix"), *[s.alias(n) for s, n in zip([*map(materials.bin_score, library), none], names)])
    inside = both_finite() & grid.inside()
    rows = cells.withColumns({"_iy": F.when(inside, grid.xray_bin()), "_ix": F.when(inside, grid.neutron_bin())})
    return rows.join(table.hint("merge"), ["t", "_iy", "_ix"], "left").select(*cells.columns, *names), names, library


def locked_cost(cells: DataFrame, regions: list[Region], library: list[materials.Material], defined_at: int = 0) -> np.ndarray:
    """Costs learned where the classes were drawn: of the regions' own classes at defined_at, with the label of no class."""
    number = F.lit(None).cast("int")
    for k, m in enumerate(library):
        number = F.when(F.col("_c") == m.class_id, k).otherwise(number)
    drawn = cells.where(F.col("t") == defined_at).withColumn("_c", class_of(regions)).withColumn("_k", number).where("_k IS NOT NULL")
    return with_unknown(learned_cost(drawn, "_k", len(library)))


def named_labels(labels: DataFrame, library: list[materials.Material], column: str = "label") -> DataFrame:
    """A column of labels as class ids; materials.EXCLUDED for cells without scores, UNCLASSIFIED for no class."""
    ids = F.array(*[F.lit(m.class_id) for m in library], F.lit(materials.UNCLASSIFIED))
    return labels.withColumn(column, F.coalesce(F.get(ids, F.col(column)), F.lit(materials.EXCLUDED)))


def locked_smooth(cells: DataFrame, regions: list[Region], grid: Grid, beta: float, defined_at: int = 0, sweeps: int = 5, method: str = "mean_field", edges: bool = True) -> DataFrame:
    """t, z, y, x, label, plain: the locked mode's labels of every cell with smoothing and without it. Cells outside the grid are EXCLUDED."""
    scored, names, library = locked_scores(cells, regions, grid, defined_at)
    first = F.array_position(F.array(*names), F.greatest(*names)).cast("int") - 1
    scored = _table(scored.withColumn("plain", F.when(F.col(names[0]).isNotNull(), first)))
    out = smoothed(scored, names, beta, sweeps, method, locked_cost(cells, regions, library, defined_at), edges, carry=["plain"])
    return named_labels(named_labels(out.drop("energy"), library), library, "plain")


def smooth_report(labels: DataFrame, most_unclassified: float = 0.5, least_kept: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Of locked_smooth: t, label, cells, plain_cells, kept (cells over plain ones) of each class, and the findings of materials.guards."""
    count = lambda c: labels.groupBy("t", F.col(c).alias("label")).agg(F.count("*").alias("cells"))
    both = _table(count("label").join(count("plain").withColumnRenamed("cells", "plain_cells"), ["t", "label"], "full").na.fill(0, ["cells", "plain_cells"]))
    kept = materials.retention(both, both.select("t", "label", F.col("plain_cells").alias("cells")))
    found = materials.guards(materials.budget_report(both), kept, most_unclassified, least_kept)
    return both.withColumn("kept", F.try_divide("cells", "plain_cells")), found


def settled_strength(grid: Sequence[float], fine: Sequence[bool], changed: Sequence[float], share: float) -> tuple[float, str]:
    """The chosen strength and why. Up the grid, past weak settings that a guard refuses, to the first after which the next one changes less than `share` of the
    cells, or to the last before a guard refuses again; 0 where all are refused."""
    chosen, any_fine = 0.0, False
    for k, value in enumerate(grid):
        if not fine[k]:
            if any_fine:
                return chosen, "guard"
            continue
        any_fine, chosen = True, value
        if k + 1 < len(grid) and changed[k + 1] < share:
            return chosen, "settled"
    return chosen, "top" if any_fine else "refused"


def auto_smoothing(cells: DataFrame, regions: list[Region], grid: Grid, strengths: Sequence[float] = STRENGTHS, defined_at: int = 0, sweeps: int = 5, method: str = "mean_field", edges: bool = True, share: float = SETTLED, least_kept: float = 0.2, least_thin: float = 0.8, most_unclassified: float = 0.5, inert: tuple[int, ...] = (), most_shift: float = 0.05, extensions: int = 2) -> tuple[float, str, DataFrame]:
    """The smoothing at which labels settle within the guards, the reason, and t, strength, worst_kept, worst_thin, worst_shift, unclassified, changed, fine of each setting.

    All settings share one table of scores and costs. Guards, at every t of cells: what a class keeps, what its thin parts keep, how far inert classes move, and
    cells without a class. While the top setting passes and labels still change by `share` or more, the grid grows by doubling, at most `extensions` times.
    """
    scored, names, library = locked_scores(cells, regions, grid, defined_at)
    scored, cost = _table(scored), locked_cost(cells, regions, library, defined_at)
    scale = _table(edge_scale(scored)) if edges else None
    levels = sorted({0.0, *map(float, strengths)})
    base = before = thin = None
    rows, fine, changes, k = [], [], [], 0
    while k < len(levels):
        labels = _table(named_labels(smoothed(scored, names, levels[k], sweeps, method, cost, edges, scale=scale), library).drop("energy"))
        if base is None:
            base = before = labels
            for m in library:
                one = thin_parts(labels.withColumn("_m", F.col("label") == m.class_id), "_m").select("t", *AXES, F.lit(m.class_id).alias("thin"))
                thin = one if thin is None else thin.union(one)
            thin = _table(thin)
        joined = with_cells(with_cells(with_cells(labels, before.withColumnRenamed("label", "was")), base.withColumnRenamed("label", "plain")), thin, "left")
        sums = [F.count_if(F.col("label") != materials.EXCLUDED).alias("valid"), F.count_if((F.col("label") != F.col("was")) & (F.col("label") != materials.EXCLUDED)).alias("moved"), F.count_if(F.col("label") == materials.UNCLASSIFIED).alias("none")]
        for m in library:
            i = m.class_id
            sums += [F.count_if(F.col("label") == i).alias(f"n{i}"), F.count_if(F.col("plain") == i).alias(f"p{i}"), F.count_if(F.col("thin") == i).alias(f"t{i}"), F.count_if((F.col("thin") == i) & (F.col("label") == i)).alias(f"k{i}")]
        for r in sorted(joined.groupBy("t").agg(*sums).collect(), key=lambda r: r["t"]):  # a row for each t
            kept = {m.class_id: r[f"n{m.class_id}"] / r[f"p{m.class_id}"] if r[f"p{m.class_id}"] else 1.0 for m in library}
            worst_thin = min((r[f"k{m.class_id}"] / r[f"t{m.class_id}"] for m in library if r[f"t{m.class_id}"]), default=1.0)
            shift = max((abs(kept[i] - 1) for i in inert), default=0.0)
            none = r["none"] / max(r["valid"], 1)
            ok = min(kept.values()) >= least_kept and worst_thin >= least_thin and shift <= most_shift and none <= most_unclassified
            rows.append((r["t"], levels[k], min(kept.values()), worst_thin, shift, none, r["moved"] / max(r["valid"], 1), ok))
        mine = [x for x in rows if x[1] == levels[k]]
        fine.append(all(x[-1] for x in mine))
        changes.append(max((x[6] for x in mine), default=0.0))
        before, k = labels, k + 1
        if k == len(levels) and fine[-1] and levels[-1] > 0 and changes[-1] >= share and extensions > 0:
            levels.append(2 * levels[-1])
            extensions -= 1
    chosen, why = settled_strength(levels, fine, changes, share)
    return chosen, why, cells.sparkSession.createDataFrame(rows, "t int, strength double, worst_kept double, worst_thin double, worst_shift double, unclassified double, changed double, fine boolean")
