"""Statistics of selections, validity and coverage reports, profiles and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.functions.plane import Region, both_finite, in_any, is_finite, segmentable
from duovox.operators.quantiles import exact_quantiles, meet


def channel_stats() -> list[Column]:
    """Mean, population deviation, least and largest value of both channels."""
    return [f(c).alias(f"{c}_{name}") for c in ("neutron", "xray") for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]


def region_stats(cells: DataFrame, regions: list[Region]) -> DataFrame:
    """t, region, n and channel statistics of each visible region, overlaps counted in each; one pass over the cells."""
    hits = F.explode(F.array_compact(F.array(*[F.when(r.holds(), r.name) for r in segmentable(regions)])))
    return cells.where(both_finite() & in_any(regions)).withColumn("region", hits).groupBy("t", "region").agg(F.count("*").alias("n"), *channel_stats())


def selection_stats(cells: DataFrame, selected: Column) -> DataFrame:
    """t, selected, total, percentage, and the channel statistics of the selection (null where it is empty)."""
    flag = cells.withColumn("hit", F.coalesce(selected, F.lit(False)))
    only = flag.withColumns({c: F.when(F.col("hit"), F.col(c)) for c in ("neutron", "xray")})
    return only.groupBy("t").agg(F.count_if("hit").alias("selected"), F.count("*").alias("total"), (100.0 * F.count_if("hit") / F.count("*")).alias("percentage"), *channel_stats())


def temporal_stats(cells: DataFrame) -> DataFrame:
    """t and the means and deviations of both channels, without any filter."""
    return cells.groupBy("t").agg(*[f(c).alias(f"{c}_{name}") for c in ("neutron", "xray") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def has_data(channel: str, missing: tuple[float, ...] = (0.0,)) -> Column:
    return is_finite(F.col(channel)) & ~F.col(channel).isin(*missing)


def valid(missing: tuple[float, ...] = (0.0,), floors: tuple[float | None, float | None] = (None, None), both: bool = True) -> Column:
    """Finite in both channels, no missing-value mark in either (or, with both=False, not in both), and at least the floors."""
    marks = [has_data(c, missing) for c in ("neutron", "xray")]
    out = both_finite() & (marks[0] & marks[1] if both else marks[0] | marks[1])
    for c, floor in zip(("neutron", "xray"), floors):
        if floor is not None:
            out = out & (F.col(c) >= floor)
    return out


def coverage(cells: DataFrame) -> DataFrame:
    """t and how many cells have data in both channels, one of them or none."""
    n, x = has_data("neutron"), has_data("xray")
    return cells.groupBy("t").agg(F.count_if(n & x).alias("both"), F.count_if(n & ~x).alias("neutron_only"), F.count_if(~n & x).alias("xray_only"), F.count_if(~n & ~x).alias("neither"))


def validity_report(cells: DataFrame, floors: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """t, total, valid, rejected, non_finite, missing, rejected_share."""
    ok = F.coalesce(valid(floors=floors), F.lit(False))
    marked = both_finite() & ~(has_data("neutron") & has_data("xray"))
    return cells.groupBy("t").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"), F.count_if(~both_finite()).alias("non_finite"),
        F.count_if(marked).alias("missing"), (F.count_if(~ok) / F.count("*")).alias("rejected_share"),
    )


def acquisition_steps(report: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """t, step: where the rejected share jumps by more than tolerance against the timepoint before. A row for each t: one small window."""
    step = F.col("rejected_share") - F.lag("rejected_share").over(Window.orderBy("t"))
    return report.select("t", step.alias("step")).where(F.abs("step") > tolerance)


def auto_floor(cells: DataFrame, quantile: float = 0.001, sigma: float = 3.0) -> DataFrame:
    """channel, floor: a low quantile less sigma robust deviations, in two passes: quantiles, then those of the distances to the median."""
    rows = cells.where(both_finite()).select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in ("neutron", "xray")])).alias("s")).select("s.*")
    first = exact_quantiles(rows, ["channel"], "v", [quantile, 0.5])
    marks = {r["channel"]: r["q"] for r in first.collect()}  # two rows
    if not marks:
        return first.select("channel", F.lit(None).cast("double").alias("floor"))
    middle = F.when(F.col("channel") == "neutron", marks["neutron"][1]).otherwise(marks["xray"][1])
    low = F.when(F.col("channel") == "neutron", marks["neutron"][0]).otherwise(marks["xray"][0])
    spread = exact_quantiles(rows.select("channel", F.abs(F.col("v") - middle).alias("v")), ["channel"], "v", [0.5])
    return spread.select("channel", (low - sigma * 1.4826 * F.col("q")[0]).alias("floor"))


def axial_profile(cells: DataFrame, axis: str = "z", statistic: str = "mean") -> DataFrame:
    """axis, n and a mean or median with the deviation for each slice, over finite pairs."""
    rows = cells.where(both_finite())
    out = rows.groupBy(axis).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{name}") for c in ("neutron", "xray") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    if statistic == "mean":
        return out
    both = rows.select(axis, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in ("neutron", "xray")])).alias("s")).select(axis, "s.*")
    middle = exact_quantiles(both, [axis, "channel"], "v", [0.5]).groupBy(axis)
    medians = middle.agg(*[F.max(F.when(F.col("channel") == c, F.col("q")[0])).alias(f"{c}_{statistic}") for c in ("neutron", "xray")])
    return meet(out, medians, [axis]).select(axis, "n", *[f"{c}_{name}" for c in ("neutron", "xray") for name in (statistic, "std")])


def in_box(z: tuple[int, int], y: tuple[int, int], x: tuple[int, int]) -> Column:
    """Half-open ranges on all axes, as comparisons that a scan can push down."""
    out = F.lit(True)
    for name, (lo, hi) in zip("zyx", (z, y, x)):
        out = out & (F.col(name) >= lo) & (F.col(name) < hi)
    return out


def trends(series: DataFrame, value: str) -> DataFrame:
    """name, slope, intercept, mean, std, low, high, mean_change, std_change of a value over t; names with one timepoint have none."""
    change = F.col(value) - F.lag(value).over(Window.partitionBy("name").orderBy("t"))
    rows = series.withColumn("change", change).groupBy("name")
    out = rows.agg(
        F.count("*").alias("n"), F.regr_slope(value, F.col("t").cast("double")).alias("slope"), F.regr_intercept(value, F.col("t").cast("double")).alias("intercept"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg("change").alias("mean_change"), F.stddev_pop("change").alias("std_change"),
    )
    return out.where("n >= 2").drop("n")


def change_events(series: DataFrame, value: str, percent: float) -> DataFrame:
    """name, t, change, pct_change, kind where a value changes by more than percent of the value before. The divisor keeps its sign, so negative values give no event."""
    before = F.lag(value).over(Window.partitionBy("name").orderBy("t"))
    rows = series.withColumns({"change": F.col(value) - before, "before": before})
    rows = rows.withColumn("pct_change", F.when(F.col("before") != 0, 100 * F.abs("change") / F.nullif("before", F.lit(0.0))).otherwise(0.0))
    return rows.where(F.col("pct_change") > percent).select("name", "t", "change", "pct_change", F.when(F.col("change") > 0, "increase").otherwise("decrease").alias("kind"))


def presence_runs(present: DataFrame) -> DataFrame:
    """name, first_t, last_t: runs of consecutive timepoints in (name, t)."""
    island = F.col("t") - F.row_number().over(Window.partitionBy("name").orderBy("t"))
    runs = present.withColumn("island", island).groupBy("name", "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return runs.drop("island")


def with_total(cells: DataFrame) -> DataFrame:
    """scope, t, n, neutron_mean: a row for each t and one over all, by one rollup."""
    rows = cells.where(both_finite()).rollup("t").agg(F.count("*").alias("n"), F.avg("neutron").alias("neutron_mean"), F.grouping("t").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "global").otherwise("timepoint").alias("scope"), F.coalesce("t", F.lit(-1)).alias("t"), "n", "neutron_mean")


def pair_features(cells: DataFrame) -> DataFrame:
    """cells with ratio, total, difference and magnitude of the pair; 0 where a feature isn't finite."""
    n, x = F.col("neutron"), F.col("xray")
    made = {"ratio": F.try_divide(n, x + 1e-6), "total": n + x, "difference": n - x, "magnitude": F.hypot(n, x)}
    return cells.withColumns({k: F.when(is_finite(v), v).otherwise(0.0) for k, v in made.items()})


def region_trend(cells: DataFrame, regions: list[Region]) -> DataFrame:
    """t, region, n, fraction of the timepoint's finite pairs, its ratio to the region's first timepoint, and the centroid."""
    rows = cells.where(both_finite())
    hits = F.explode(F.array_compact(F.array(*[F.when(r.holds(), r.name) for r in segmentable(regions)])))
    each = rows.where(in_any(regions)).select("t", "neutron", "xray", hits.alias("region")).groupBy("t", "region").agg(F.count("*").alias("n"), F.avg("neutron").alias("neutron_mean"), F.avg("xray").alias("xray_mean"))
    share = each.join(rows.groupBy("t").agg(F.count("*").alias("all")), "t").withColumn("fraction", F.col("n") / F.col("all"))
    first = F.first("fraction").over(Window.partitionBy("region").orderBy("t"))
    return share.select("t", "region", "n", "fraction", (F.col("fraction") / first).alias("relative"), "neutron_mean", "xray_mean")


def long_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value: one row for each metric of a wide table."""
    rest = [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in rest]).unpivot(keys, rest, "metric", "value")


def quantile_bands(values: DataFrame, by: str, value: str, quantiles: tuple[float, float] = (0.16, 0.84)) -> DataFrame:
    """by, low, middle, high of a value."""
    return exact_quantiles(values, [by], value, [quantiles[0], 0.5, quantiles[1]]).select(by, *[F.col("q")[k].alias(n) for k, n in enumerate(("low", "middle", "high"))])
