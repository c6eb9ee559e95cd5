"""Mixed cells: fractions along the line between two fitted classes, and which classes are such lines."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.operators.mixtures import LOG_2PI, Anchored


@dataclass(frozen=True)
class Mixel:
    """A class that lies between two others; noise: the deviation that mixing adds, or a share of the parents' own."""

    class_id: int
    first: int
    second: int
    steps: int = 10
    noise: float | None = None


def steps(mixel: Mixel) -> Column:
    return F.array(*[F.lit((k + 0.5) / mixel.steps) for k in range(mixel.steps)])


def ladder(mixel: Mixel, model: Anchored) -> Column:
    """The log density of a bin's mean at each step of a mixel's ladder, from a row with the bin's sums and the fitted parameters.

    The ladder: Gaussians in `steps` equal steps from the second parent to the first, whose means and covariances mix as those of the parents do.
    """
    index = {m.class_id: k for k, m in enumerate(model.library)}
    p, q = index[mixel.first], index[mixel.second]
    a, b = ({c: F.col(f"{c}{k}") for c in "nxado"} for k in (p, q))
    noise = 0.25 * F.least((a["a"] + a["d"]) / 2, (b["a"] + b["d"]) / 2) if mixel.noise is None else F.lit(float(mixel.noise) ** 2)
    noise = F.greatest(noise, F.lit(1e-12))

    def density(s: Column) -> Column:
        t = 1 - s
        va, vd, vo = s * s * a["a"] + t * t * b["a"] + noise, s * s * a["d"] + t * t * b["d"] + noise, s * s * a["o"] + t * t * b["o"]
        dn, dx = F.col("sn") / F.col("c") - (s * a["n"] + t * b["n"]), F.col("sx") / F.col("c") - (s * a["x"] + t * b["x"])
        det = va * vd - vo * vo
        return -0.5 * (2 * LOG_2PI + F.log(det) + (vd * dn * dn - 2 * vo * dn * dx + va * dx * dx) / det)

    return F.transform(steps(mixel), density)


def fractions(bins: DataFrame, parameters: DataFrame, model: Anchored, mixels: list[Mixel]) -> DataFrame:
    """bins with class_id, fraction and log_density of each mixel whose parents were fitted (see mixtures.fitted); maps of cells by a join on the bin."""
    known = {m.class_id for m in model.library}
    used = [m for m in mixels if m.first in known and m.second in known]
    rows = bins.join(F.broadcast(parameters), "t")  # a row of parameters for each t
    if not used:
        return rows.select(*bins.columns, F.lit(0).alias("class_id"), F.lit(0.0).alias("fraction"), F.lit(0.0).alias("log_density")).limit(0)
    # in stages: a lambda would compute what it names anew for each step
    rows = rows.withColumns({f"_l{i}": ladder(m, model) for i, m in enumerate(used)})
    rows = rows.withColumns({f"_t{i}": F.array_max(f"_l{i}") for i in range(len(used))})
    over = lambda top: lambda v: F.exp(v - F.col(top))
    rows = rows.withColumns({f"_w{i}": F.transform(f"_l{i}", over(f"_t{i}")) for i in range(len(used))})
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumns({f"_s{i}": total(F.col(f"_w{i}")) for i in range(len(used))})
    each = F.array(*[
        F.struct(F.lit(m.class_id).alias("class_id"), (total(F.zip_with(f"_w{i}", steps(m), lambda w, s: w * s)) / F.col(f"_s{i}")).alias("fraction"), (F.col(f"_t{i}") + F.log(f"_s{i}") - math.log(m.steps)).alias("log_density"))
        for i, m in enumerate(used)
    ])
    return rows.select(*bins.columns, F.inline(each))


def line_angles(classes: DataFrame) -> DataFrame:
    """t, class_id, first, second, elongation, angle, position of every class and two others (first < second): the ratio of its axes, the angle in degrees of its long axis
    to the line between the others' means (null where it has no long axis), and where its mean lies along that line, 0 at the second, 1 at the first.

    classes: the rows of mixtures.class_rows, a few for each t, which join by t.
    """
    a, d, o = F.col("sigma_n") ** 2, F.col("sigma_x") ** 2, F.col("cov")
    root = F.sqrt((a - d) ** 2 / 4 + o * o)
    long_, short = (a + d) / 2 + root, F.greatest((a + d) / 2 - root, F.lit(0.0))
    axis = F.when(o != 0, F.atan2(long_ - a, o)).otherwise(F.when(a >= d, 0.0).otherwise(math.pi / 2))
    stretch = F.when(short > 0, F.sqrt(long_ / short)).otherwise(F.when(long_ > 0, math.inf).otherwise(1.0))
    real = classes.where("class_id != 0")
    own = real.select("t", "class_id", "neutron", "xray", stretch.alias("elongation"), axis.alias("axis"))
    side = lambda name: real.select("t", F.col("class_id").alias(name), F.col("neutron").alias(f"n_{name}"), F.col("xray").alias(f"x_{name}"))
    rows = own.join(side("first"), "t").join(side("second"), "t").where("first < second AND class_id != first AND class_id != second")
    dn, dx = F.col("n_first") - F.col("n_second"), F.col("x_first") - F.col("x_second")
    size = F.hypot(dn, dx)
    angle = F.degrees(F.acos(F.least(F.abs(F.cos("axis") * dn + F.sin("axis") * dx) / size, F.lit(1.0))))
    place = ((F.col("neutron") - F.col("n_second")) * dn + (F.col("xray") - F.col("x_second")) * dx) / F.nullif(size * size, F.lit(0.0))
    return rows.select("t", "class_id", "first", "second", "elongation", F.when((F.col("elongation") >= 1.05) & (size > 0), angle).alias("angle"), place.alias("position"))


def mixing_lines(angles: DataFrame, elongation: float = 1.5, tolerance: float = 15.0, pairs: int = 1) -> DataFrame:
    """The rows of line_angles that look like mixing lines: long enough, along the line of two others and between them; the `pairs` best of each class, by angle."""
    order = Window.partitionBy("t", "class_id").orderBy("angle", "first", "second")  # a few rows
    fine = angles.where((F.col("elongation") >= elongation) & (F.col("angle") <= tolerance) & F.col("position").between(0, 1))
    return fine.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= pairs).drop("_place")


def verified(angles: DataFrame, mixels: list[Mixel], tolerance: float = 15.0) -> DataFrame:
    """t, class_id, first, second, elongation, angle, accepted, reason of each declared mixel at each t."""
    spark = angles.sparkSession
    told = spark.createDataFrame([(m.class_id, min(m.first, m.second), max(m.first, m.second)) for m in mixels], "class_id int, first int, second int")
    rows = angles.select("t").distinct().join(F.broadcast(told)).join(angles, ["t", "class_id", "first", "second"], "left")  # a few declared rows
    reason = F.when(F.col("elongation").isNull(), "not fitted").when(F.col("angle").isNull(), "no long axis").when(F.col("angle") > tolerance, "off the line").otherwise("aligned")
    return rows.select("t", "class_id", "first", "second", "elongation", "angle", (reason == "aligned").alias("accepted"), reason.alias("reason"))
