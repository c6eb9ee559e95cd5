"""Checks of a finished series before its numbers are used. Everything here is a row for each timepoint and class, counted before."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.operators import materials
from duovox.operators.spatial import _table

COLUMNS = ("finding", "status", "class_id", "t", "value")


def _rows(df: DataFrame, finding: str | Column, status: str | Column, class_id: str | None = None, t: str | None = None, value: str | Column | None = None) -> DataFrame:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    known = lambda c, kind: (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(kind)
    made = text(finding), text(status), known(class_id, "int"), known(t, "int"), known(value, "double")
    return df.select(*[c.alias(n) for c, n in zip(made, COLUMNS)])


def _or_pass(bad: DataFrame, finding: str, value: DataFrame) -> DataFrame:
    """The bad rows, or one that passes, with the value of a table of one row (value)."""
    none = bad.groupBy().agg(F.count("*").alias("n")).where("n = 0").drop("n")
    return bad.union(_rows(none.join(F.broadcast(value)), finding, "pass", value="value"))  # one row meets one row


def health(
    counts: DataFrame, classes: Sequence[int], controls: Sequence[int] = (), born: dict[int, int] | None = None, predicted: Sequence[int] = (), dropped: Sequence[int] = (),
    one_sided: DataFrame | None = None, mixing: DataFrame | None = None, smoothing: tuple[float, bool] | None = None,
    most_unclassified: float = 0.05, control_tolerance: float = 0.02, coverage_step: float = 0.02, most_one_sided: float = 0.01,
) -> DataFrame:
    """finding, status ('pass', 'warn' or 'fail'), class_id, t, value.

    counts: t, label, cells, plain_cells of smoothing.smooth_report (a class, 0 for none, materials.EXCLUDED); plain_cells may be missing, then nothing is
    said of smoothing. classes: those that should be there; born: the t at which a class that comes later was defined; predicted: classes
    without a region, looked for from where they are first found; dropped: classes that could not be fitted. one_sided: t, share of cells that
    only one channel measures. mixing: t, class_id, accepted of mixels.verified. smoothing: a strength, and whether the search for it settled.

    - classes defined: fails for each dropped class. nothing segmented: fails where counts are empty, and is then the only other row.
    - classes present: fails for each class at the first t, from its birth on, without a cell of it; 'lost by smoothing' where it
      has cells there without smoothing, else 'lost'. Passes if none is lost. A predicted class that is never found is a warning.
    - appears: passes for a class born after the first t; value: earlier t without it.
    - controls: fails for a control whose cells vary by more than a share of their mean (value) over all t; a warning if there are none.
    - unclassified: the largest share of the measured cells without a class, at the first t that has it.
    - budget: the first t whose cells with smoothing don't add up to those without it.
    - usable data: a warning at the first t whose measured share differs from the one before by more than a step; else the mean share.
    - field of view, mixed boundaries, smoothing strength: as above, given what they look at.
    """
    spark = counts.sparkSession
    born = dict(born or {})
    plain = F.coalesce("plain_cells", F.lit(0)) if "plain_cells" in counts.columns else F.lit(0)
    each = _table(counts.groupBy("t", "label").agg(F.sum(F.coalesce("cells", F.lit(0))).alias("cells"), F.sum(plain).alias("plain")))
    one = spark.range(0, 1, 1, 1)
    out = [_rows(one.select(F.explode(F.array(*[F.lit(k) for k in dropped])).alias("k")), "classes defined", "fail", "k")] if dropped else []
    times = [r.t for r in each.select("t").distinct().orderBy("t").collect()]  # a row for each timepoint
    if not times:
        return reduce(DataFrame.union, [*out, _rows(one, "nothing segmented", "fail")])
    first = times[0]

    # every class at every timepoint
    grid = each.select("t").distinct().select("t", F.explode(F.array(*map(F.lit, classes))).alias("label"))
    full = grid.join(each, ["t", "label"], "left").na.fill(0, ["cells", "plain"])
    seen = F.min(F.when(F.col("cells") > 0, F.col("t"))).over(Window.partitionBy("label"))
    since = F.create_map(*[F.lit(v) for k in classes for v in (k, born.get(k, first))])
    full = _table(full.withColumn("since", F.when(F.col("label").isin(list(predicted)), seen).otherwise(since[F.col("label")])))
    gone = full.where("cells = 0 AND t >= since").groupBy("label").agg(F.min(F.struct("t", "plain")).alias("at")).select("label", "at.t", "at.plain")
    lost = _rows(gone, F.when(F.col("plain") > 0, "lost by smoothing").otherwise("lost"), "fail", "label", "t", F.col("plain"))
    out.append(_or_pass(lost, "classes present", one.select(F.lit(float(len(classes))).alias("value"))))
    out.append(_rows(full.where("since IS NULL").select("label").distinct(), "predicted class not found", "warn", "label"))
    later = full.where(F.col("since") > first).groupBy("label", "since").agg(F.count_if((F.col("t") < F.col("since")) & (F.col("cells") == 0)).alias("before"))
    out.append(_rows(later, "appears", "pass", "label", "since", "before"))

    # controls
    held = [k for k in controls if k in classes]
    if held:
        steady = full.where(F.col("label").isin(held)).groupBy("label").agg(F.coalesce(F.try_divide(F.stddev_pop("cells"), F.abs(F.avg("cells"))), F.lit(0.0)).alias("change"))
        moved = _rows(steady.where(F.col("change") > control_tolerance), "controls", "fail", "label", value="change")
        out.append(_or_pass(moved, "controls", steady.agg(F.max("change").alias("value"))))
    else:
        out.append(_rows(one, "no controls", "warn"))

    # accounts of each timepoint
    report = materials.budget_report(each)
    worst = report.orderBy(F.desc(F.coalesce("unclassified_share", F.lit(0.0))), "t").limit(1)
    share = F.coalesce("unclassified_share", F.lit(0.0))
    out.append(_rows(worst, "unclassified", F.when(share > most_unclassified, "fail").otherwise("pass"), t="t", value=share))
    if "plain_cells" in counts.columns:
        sums = each.groupBy("t").agg((F.sum("cells") - F.sum("plain")).alias("gap"))
        leak = sums.where("gap <> 0").orderBy("t").limit(1)
        out.append(_or_pass(_rows(leak, "budget", "fail", t="t", value="gap"), "budget", one.select(F.lit(0.0).alias("value"))))
    usable = report.select("t", F.try_divide("valid", "total").alias("share"))
    order = Window.orderBy("t")  # a row for each timepoint
    step = usable.withColumn("step", F.abs(F.col("share") - F.lag("share").over(order))).where(F.col("step") > coverage_step).orderBy("t").limit(1)
    out.append(_or_pass(_rows(step, "usable data", "warn", t="t", value="step"), "usable data", usable.agg(F.avg("share").alias("value"))))
    if one_sided is not None:
        most = one_sided.orderBy(F.desc("share"), "t").limit(1)
        out.append(_rows(most.where(F.col("share") > most_one_sided), "field of view", "warn", t="t", value="share"))
    if mixing is not None:
        out.append(_rows(mixing.where("NOT accepted"), "mixed boundaries", "warn", "class_id", "t"))
    if smoothing is not None:
        out.append(_rows(one, "smoothing strength", "pass" if smoothing[1] else "warn", value=F.lit(smoothing[0])))
    return reduce(DataFrame.union, out)
