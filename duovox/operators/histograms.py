"""Two-dimensional histograms on a shared grid, what derives from them, and how they change over time.

A histogram is a table (t, iy, ix, count) of occupied bins: at most bins x bins rows for each t, whatever the number of cells.
Everything below groups cells once, with partial sums on the map side, and goes on with such small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.functions.plane import Grid, both_finite
from duovox.operators.spatial import _table

EPSILON = 1e-12


def plane_grid(cells: DataFrame, bins: int = 64) -> Grid:
    """The grid over the finite pairs' ranges, by one aggregate; its four numbers become literals of later plans. A constant channel is padded by a millionth of its size, half a unit at least."""
    low_high = cells.where(both_finite()).agg(F.min("neutron"), F.max("neutron"), F.min("xray"), F.max("xray")).first()
    if low_high[0] is None:
        raise ValueError("no finite pairs")
    n0, n1, x0, x1 = low_high
    if n0 == n1:
        n0, n1 = n0 - max(abs(n0) * 1e-6, 0.5), n1 + max(abs(n1) * 1e-6, 0.5)
    if x0 == x1:
        x0, x1 = x0 - max(abs(x0) * 1e-6, 0.5), x1 + max(abs(x1) * 1e-6, 0.5)
    return Grid(n0, n1, x0, x1, bins)


def binned(cells: DataFrame, grid: Grid, outside: str = "clamp") -> DataFrame:
    """Finite pairs with iy (xray) and ix (neutron). outside: 'clamp' into the edge bins, or 'drop'."""
    rows = cells.where(both_finite())
    if outside == "drop":
        rows = rows.where(grid.inside())
    return rows.withColumns({"iy": grid.xray_bin(), "ix": grid.neutron_bin()})


def histogram(cells: DataFrame, grid: Grid, by: tuple[str, ...] = ("t",), outside: str = "clamp") -> DataFrame:
    return binned(cells, grid, outside).groupBy(*by, "iy", "ix").agg(F.count("*").alias("count"))


def marginals(hist: DataFrame) -> DataFrame:
    """t, modality, bin, share: both one-dimensional histograms of each t, as shares, from one pass over hist."""
    sides = F.explode(F.array(F.struct(F.lit("neutron").alias("modality"), F.col("ix").alias("bin")), F.struct(F.lit("xray").alias("modality"), F.col("iy").alias("bin"))))
    one = hist.select("t", "count", sides.alias("s")).groupBy("t", "s.modality", "s.bin").agg(F.sum("count").alias("n"))
    return one.select("t", "modality", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("t", "modality"))).alias("share"))


def dense(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """table with a row (value 0) for each t and key that occurs at any t. T is small: it's a literal list, so no join of t and keys. The table is
    written once, so that its times don't cost another scan of the cells."""
    table = _table(table)
    times = sorted(r[0] for r in table.select("t").distinct().collect())
    wide = table.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("t", value))).alias("m"))
    every = wide.select(*keys, "m", F.explode(F.array(*map(F.lit, times))).alias("t"))
    return every.select("t", *keys, F.coalesce(F.try_element_at("m", F.col("t")), F.lit(0)).alias(value))


def against(value: str, keys: list[str], reference: str) -> Column:
    """A value at the first t, or at the one before, of the same key."""
    order = Window.partitionBy(*keys).orderBy("t")
    return F.first(value).over(order) if reference == "first" else F.lag(value).over(order)


def log_differences(hist: DataFrame, reference: str = "first") -> DataFrame:
    """t, iy, ix, log_difference: log10(count + 1) less that of the reference, for all t but the first and all bins occupied at any t."""
    full = dense(hist, ["iy", "ix"], "count")
    first = F.min("t").over(Window.partitionBy("iy", "ix"))  # all bins have all t
    logs = full.withColumn("v", F.log10(F.col("count") + 1)).withColumns({"r": against("v", ["iy", "ix"], reference), "first": first})
    return logs.where("t > first").select("t", "iy", "ix", (F.col("v") - F.col("r")).alias("log_difference"))


def marginal_changes(hist: DataFrame, reference: str = "first") -> DataFrame:
    """t, modality, bin, log2_change: log2 of the share over the reference's, null where either is 0."""
    full = dense(marginals(hist), ["modality", "bin"], "share").withColumn("r", against("share", ["modality", "bin"], reference))
    change = F.when((F.col("share") > 0) & (F.col("r") > 0), F.log2(F.col("share") / F.col("r")))
    return full.select("t", "modality", "bin", change.alias("log2_change"))


def shares(hist: DataFrame) -> DataFrame:
    full = dense(hist, ["iy", "ix"], "count")
    return full.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("t")))


def evolution(hist: DataFrame) -> DataFrame:
    """t, cells, total_variation against the first t, and the largest gain and loss of log10(count + 1)."""
    full = shares(hist).withColumn("q", against("p", ["iy", "ix"], "first")).withColumn("c0", against("count", ["iy", "ix"], "first"))
    step = F.log10(F.col("count") + 1) - F.log10(F.col("c0") + 1)
    return full.groupBy("t").agg(F.sum("count").alias("cells"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"), F.max(step).alias("max_gain"), F.min(step).alias("max_loss"))


def divergence(hist: DataFrame) -> DataFrame:
    """t, jensen_shannon (bits) against the first t, and mutual_bits: the mutual information of the channels at t."""
    full = shares(hist).withColumn("q", against("p", ["iy", "ix"], "first"))
    row, column = Window.partitionBy("t", "iy"), Window.partitionBy("t", "ix")
    full = full.withColumns({"pr": F.sum("p").over(row), "pc": F.sum("p").over(column)})
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / mid)).otherwise(0.0)
    mutual = F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / (F.col("pr") * F.col("pc")))).otherwise(0.0)
    return full.groupBy("t").agg(F.sum((part("p") + part("q")) / 2).alias("jensen_shannon"), F.sum(mutual).alias("mutual_bits"))


def correlation(hist: DataFrame, bins: int) -> DataFrame:
    """t, pearson: how the shares of all bins x bins bins, empty ones too, correlate with those of the first t; null where either is even."""
    full = shares(hist).withColumn("q", against("p", ["iy", "ix"], "first"))
    spread = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / bins**2
    both = spread("p", "p") * spread("q", "q")
    return full.groupBy("t").agg(F.when(both > 0, spread("p", "q") / F.sqrt(both)).alias("pearson"))


def robust_grid(cells: DataFrame, bins: int = 64, tail: float = 0.0005) -> Grid:
    """The grid between two quantiles, `tail` from either end, of each channel over all t: outliers don't stretch it. Both are exact, over all finite pairs."""
    from duovox.operators.quantiles import exact_quantiles

    side = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in ("neutron", "xray")]))
    ends = {r["channel"]: r["q"] for r in exact_quantiles(cells.where(both_finite()).select(side.alias("s")).select("s.*"), ["channel"], "v", [tail, 1 - tail]).collect()}
    if not ends:
        raise ValueError("no finite pairs")
    return Grid(*ends["neutron"], *ends["xray"], bins)


def mutual_information(hist: DataFrame) -> DataFrame:
    """t, mutual_nats of each t's own histogram."""
    full = hist.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("t")))
    full = full.withColumns({"pr": F.sum("p").over(Window.partitionBy("t", "iy")), "pc": F.sum("p").over(Window.partitionBy("t", "ix"))})
    return full.groupBy("t").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pr") * F.col("pc")))).alias("mutual_nats"))


def shape_metrics(hist: DataFrame, grid: Grid) -> DataFrame:
    """t, s_h, s_v, s_d, a_x, delta_n. Variances run over all bins of a row or column, empty ones too, so they come from sums and the number of bins."""
    n = grid.bins
    d = hist.withColumn("d", F.col("count") / F.sum("count").over(Window.partitionBy("t")))
    d = d.withColumns({"nc": grid.neutron_centre(F.col("ix")), "xc": grid.xray_centre(F.col("iy"))})

    def spread(axis: str) -> DataFrame:
        one = d.groupBy("t", axis).agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
        var = F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n)
        return one.groupBy("t").agg(F.max(var).alias(f"max_{axis}"), (F.sum(var) / n).alias(f"mean_{axis}"))

    m = d.groupBy("t").agg(
        F.sum(F.col("d") * F.col("nc")).alias("n1"), F.sum(F.col("d") * F.col("xc")).alias("x1"), F.sum(F.col("d") * F.col("nc") * F.col("xc")).alias("nx"),
        F.sum(F.col("d") * F.col("nc") * F.col("nc")).alias("n2"), F.sum(F.col("d") * F.col("xc") * F.col("xc")).alias("x2"),
    )
    rows = d.groupBy("t", "iy", "xc").agg(F.sum("count").alias("c"))
    running = F.sum("c").over(Window.partitionBy("t").orderBy("iy")) / F.sum("c").over(Window.partitionBy("t"))
    median = rows.withColumn("cum", running).where("cum >= 0.5").groupBy("t").agg(F.min("xc").alias("median"))
    joined = spread("iy").join(spread("ix"), "t").join(m, "t").join(median, "t")
    sigma_n, sigma_x = F.sqrt(F.greatest(F.col("n2") - F.col("n1") * F.col("n1"), F.lit(0.0))), F.sqrt(F.greatest(F.col("x2") - F.col("x1") * F.col("x1"), F.lit(0.0)))
    first = F.first("n1").over(Window.orderBy("t"))  # a row for each t: small
    return joined.select(
        "t", (F.col("max_iy") / (F.col("mean_ix") + EPSILON)).alias("s_h"), (F.col("max_ix") / (F.col("mean_iy") + EPSILON)).alias("s_v"),
        ((F.col("nx") - F.col("n1") * F.col("x1")) / (sigma_n * sigma_x + EPSILON)).alias("s_d"), ((F.col("x1") - F.col("median")) / (sigma_x + EPSILON)).alias("a_x"), (F.col("n1") - first).alias("delta_n"),
    )


def kymograph(hist: DataFrame, cells: int, bins: int) -> DataFrame:
    """t, gy, gx, share, log2_ratio: the histogram in coarse cells, against the first t; null where either share is 0."""
    width = bins // cells
    coarse = hist.groupBy("t", F.floor(F.col("iy") / width).cast("int").alias("gy"), F.floor(F.col("ix") / width).cast("int").alias("gx")).agg(F.sum("count").alias("n"))
    full = dense(coarse, ["gy", "gx"], "n").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("t")))
    full = full.withColumn("r", against("share", ["gy", "gx"], "first"))
    return full.select("t", "gy", "gx", "share", F.when((F.col("share") > 0) & (F.col("r") > 0), F.log2(F.col("share") / F.col("r"))).alias("log2_ratio"))


def variable_bins(hist: DataFrame, least: int = 20, top: int = 10) -> DataFrame:
    """iy, ix, spread: the bins whose share varies most over t, of those that hold `least` cells at some t."""
    each = shares(hist).groupBy("iy", "ix").agg((F.max("p") - F.min("p")).alias("spread"), F.max("count").alias("most"))
    return each.where(F.col("most") >= least).orderBy(F.desc("spread"), "iy", "ix").limit(top).select("iy", "ix", "spread")


def moments(cells: DataFrame, grid: Grid, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """t (or by), iy, ix, c and the sums sn, sx, snn, sxx, snx of each occupied bin: all that later scoring needs. Pairs outside the grid are left out."""
    n, x = F.col("neutron"), F.col("xray")
    return binned(cells, grid, "drop").groupBy(*by, "iy", "ix").agg(
        F.count("*").alias("c"), F.sum(n).alias("sn"), F.sum(x).alias("sx"), F.sum(n * n).alias("snn"), F.sum(x * x).alias("sxx"), F.sum(n * x).alias("snx"),
    )
