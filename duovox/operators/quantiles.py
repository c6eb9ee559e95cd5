"""Exact quantiles by counts: no task holds the values of a group, however many distinct ones it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.operators.spatial import _table

#: Intervals of more rows are cut again before their values are listed.
MOST = 100_000
ACCURACY = 10_000
#: Tables of cuts and ranks are broadcast for so many groups at most: a few MB. Beyond that the values are joined by group.
GROUPS = 10_000


def meet(left: DataFrame, right: DataFrame, keys: list[str], more: Column | None = None, how: str = "inner", small: bool = False) -> DataFrame:
    """left with the columns of right, by keys (nulls are equal) and a further condition. small: right is known to be fit for a broadcast;
    else Spark picks the join by the sizes that it sees, and splits hot keys."""
    on = F.lit(True) if more is None else more
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(F.broadcast(right) if small else right, on, how).drop(*[f"_r_{k}" for k in keys])


def _inside(values: DataFrame, state: DataFrame, by: list[str], small: bool) -> DataFrame:
    """The values in the open intervals of the state, with the lower bound _a, which tells a group's disjoint intervals apart."""
    within = (F.col("_a").isNull() | (F.col("_v") > F.col("_a"))) & (F.col("_b").isNull() | (F.col("_v") < F.col("_b")))
    return meet(values, state.select(*by, "_a", "_b").distinct(), by, within, small=small).drop("_b")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: list[float], most: int = MOST) -> DataFrame:
    """by, q: for each group the array of quantiles of a value, interpolated like percentile; nulls are ignored.

    A sketch of bounded size gives each group cuts near the quantiles. Counts by bin (on a cut, or between two) then tell
    exactly which bin holds each rank: on a cut the value is known; between cuts only that bin's rows are looked at again,
    and cut again while they are over `most`. Each round takes at least the cuts out, so it ends. What is left is
    grouped by value with running counts. A bad sketch costs rounds, never exactness.
    """
    near = [min(max(q + d, 0.0), 1.0) for q in quantiles for d in (-2 / ACCURACY, 2 / ACCURACY)]
    marks = sorted({*near, *(k / 8 for k in range(1, 8))})
    values, at = rows.select(*by, F.col(value).cast("double").alias("_v")), [*by, "_a"]
    place = lambda q: (F.col("_n") - 1) * q
    state = groups = None
    while True:
        if state is None:
            inside = values.withColumn("_a", F.lit(None).cast("double"))
        else:
            busy = state.where(F.col("_open") & (F.col("_rows") > most))
            if busy.isEmpty():
                break
            inside = _inside(values, busy, by, few)
        cuts = _table(inside.groupBy(*at).agg(F.count("_v").alias("_n"), F.array_sort(F.array_distinct(F.percentile_approx("_v", marks, ACCURACY))).alias("_p")))
        if state is None:
            groups = cuts.select(*by, "_n")
            few = not by or cuts.count() <= GROUPS
            ranks = F.array_distinct(F.array(*[f(place(q)).cast("long") for q in quantiles for f in (F.floor, F.ceil)]))
            targets = cuts.where("_n > 0").select(*at, F.lit(None).cast("double").alias("_b"), F.explode(ranks).alias("_rank")).withColumn("_k", F.col("_rank"))
        else:
            targets = busy.select(*at, "_b", "_rank", "_k")
        below = sum(F.coalesce((F.get("_p", F.lit(i)) < F.col("_v")).cast("int") + (F.get("_p", F.lit(i)) <= F.col("_v")).cast("int"), F.lit(0)) for i in range(len(marks)))
        counts = meet(inside.where("_v IS NOT NULL"), cuts.select(*at, "_p"), at, small=few).groupBy(*at, below.alias("_bin")).agg(F.count("*").alias("_rows"))
        ends = counts.withColumn("_end", F.sum("_rows").over(Window.partitionBy(*at).orderBy("_bin")))  # a row for each bin
        held = meet(meet(ends, targets, at, F.col("_k").between(F.col("_end") - F.col("_rows"), F.col("_end") - 1), small=few), cuts.select(*at, "_p"), at, small=few)
        i, between = F.floor(F.col("_bin") / 2).cast("int"), F.col("_bin") % 2 == 0
        found = held.select(
            *by, F.coalesce(F.get("_p", i - 1), "_a").alias("_a"), F.coalesce(F.get("_p", i), "_b").alias("_b"), "_rank", (F.col("_k") - F.col("_end") + F.col("_rows")).alias("_k"),
            "_rows", between.alias("_open"), F.when(~between, F.get("_p", i)).alias("_x"),
        )
        state = _table(found if state is None else found.union(state.where(~F.col("_open") | (F.col("_rows") <= most))))
    rest = state.where("_open")
    listed = _inside(values, rest, by, few).groupBy(*at, "_v").agg(F.count("*").alias("_c"))
    ends = listed.withColumn("_end", F.sum("_c").over(Window.partitionBy(*at).orderBy("_v")))  # at most `most` rows
    last = meet(ends, rest.select(*at, "_rank", "_k"), at, F.col("_k").between(F.col("_end") - F.col("_c"), F.col("_end") - 1), small=few).select(*by, "_rank", F.col("_v").alias("_x"))
    known = state.where(~F.col("_open")).select(*by, "_rank", "_x").union(last)
    out = meet(groups, known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_m")), by, how="left", small=few)  # two ranks for each quantile

    def mixed(q: float) -> Column:
        low, high = F.floor(place(q)).cast("long"), F.ceil(place(q)).cast("long")
        a, b = F.col("_m")[low], F.col("_m")[high]
        return F.when(a == b, a).otherwise((high - place(q)) * a + (place(q) - low) * b)

    return out.select(*by, F.when(F.col("_n") > 0, F.array(*[mixed(q) for q in quantiles])).alias("q"))
