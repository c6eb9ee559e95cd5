"""Validation by spatial blocks: Gaussian classes fitted without a block judge its cells, for all blocks at once; and what each feature is worth to them.

Leaving a block out is a subtraction: the sums of a class over all cells less those of the block. So all folds come from one pass over the cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.operators.spatial import _table

LOG_2PI = math.log(2 * math.pi)


def fold_models(cells: DataFrame, label: str = "label", block: str = "block") -> DataFrame:
    """block, models: for each block the classes fitted to the cells of all others, as an array of (label, w, n, x, a, d, o): weight, means, sample variances, covariance.

    A class needs three training cells outside of the block; a block whose training cells hold fewer than two classes is left out. Blocks x labels rows.
    """
    n, x = F.col("neutron"), F.col("xray")
    parts = {"c": F.count("*").cast("double"), "sn": F.sum(n), "sx": F.sum(x), "snn": F.sum(n * n), "sxx": F.sum(x * x), "snx": F.sum(n * x)}
    own = cells.groupBy(F.col(block).alias("block"), F.col(label).alias("label")).agg(*[v.alias(k) for k, v in parts.items()])
    total = own.groupBy("label").agg(*[F.sum(k).alias(f"t_{k}") for k in parts])
    every = own.select("block").distinct().join(total).join(own, ["block", "label"], "left")  # blocks x labels
    rest = every.select("block", "label", *[(F.col(f"t_{k}") - F.coalesce(k, F.lit(0.0))).alias(k) for k in parts]).where("c >= 3")
    mn, mx, less = F.col("sn") / F.col("c"), F.col("sx") / F.col("c"), F.col("c") - 1
    a, d, o = (F.col("snn") - F.col("sn") * mn) / less, (F.col("sxx") - F.col("sx") * mx) / less, (F.col("snx") - F.col("sn") * mx) / less
    floor = F.greatest(1e-6 * F.greatest((a + d) / 2, F.lit(0.0)), F.lit(1e-9))
    more = F.when((a * d - o * o <= 0) | (a <= 0) | (d <= 0), floor).otherwise(0.0)
    share = F.col("c") / F.sum("c").over(Window.partitionBy("block"))
    one = rest.select("block", F.struct("label", share.alias("w"), mn.alias("n"), mx.alias("x"), (a + more).alias("a"), (d + more).alias("d"), o.alias("o")).alias("m"))
    return one.groupBy("block").agg(F.array_sort(F.collect_list("m")).alias("models")).where(F.size("models") >= 2)


def judged(cells: DataFrame, models: DataFrame, block: str = "block") -> DataFrame:
    """cells with prediction: the likeliest class of the models of their own block, the first of equals. Cells of blocks without models are left out."""

    def score(m: Column) -> Column:
        det = m["a"] * m["d"] - m["o"] * m["o"]
        dn, dx = F.col("neutron") - m["n"], F.col("xray") - m["x"]
        value = F.log(m["w"]) - 0.5 * (2 * LOG_2PI + F.log(det) + (m["d"] * dn * dn - 2 * m["o"] * dn * dx + m["a"] * dx * dx) / det)
        return F.struct(value.alias("v"), (-m["label"]).alias("order"), m["label"].alias("label"))

    rows = cells.join(F.broadcast(models.withColumnRenamed("block", block)), block)  # one row for each block of the grid
    return rows.withColumn("prediction", F.array_max(F.transform("models", score))["label"]).drop("models")


def agreement_of(matrix: DataFrame, by: list[str]) -> DataFrame:
    """by, cells, accuracy, kappa of confusion rows (by, truth, prediction, n); kappa is null where chance alone would agree always."""
    sides = F.inline(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("r"), F.lit(0).cast("long").alias("c")), F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("r"), F.col("n").alias("c"))))
    margins = matrix.select(*by, sides).groupBy(*by, "label").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).groupBy(*by).agg(F.sum(F.col("r") * F.col("c")).cast("double").alias("chance"))
    hits = matrix.groupBy(*by).agg(F.sum("n").alias("cells"), F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hits"))
    rows = hits.join(margins, by) if by else hits.join(margins)
    accuracy, chance = F.col("hits") / F.col("cells"), F.col("chance") / (F.col("cells") * F.col("cells"))
    return rows.select(*by, "cells", accuracy.alias("accuracy"), F.when(chance < 1, (accuracy - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"))


def block_validation(cells: DataFrame, label: str = "label", block: str = "block") -> DataFrame:
    """block, cells, accuracy, kappa: each block judged by classes fitted without it; the row of block null is all of them. Cells with a null label or a channel that isn't finite
    take no part."""
    fine = cells.where(F.col(label).isNotNull() & (F.abs("neutron") < float("inf")) & (F.abs("xray") < float("inf")))
    rows = judged(fine, _table(fold_models(fine, label, block)), block)
    matrix = _table(rows.groupBy(F.col(block).alias("block"), F.col(label).alias("truth"), "prediction").agg(F.count("*").alias("n")))
    whole = agreement_of(matrix.groupBy("truth", "prediction").agg(F.sum("n").alias("n")), [])
    return agreement_of(matrix, ["block"]).unionByName(whole.withColumn("block", F.lit(None).cast(matrix.schema["block"].dataType)))


def permuted(cells: DataFrame, column: str, order: Column, by: str = "block") -> DataFrame:
    """cells with a column's values dealt anew among the cells of each block, by the given order (a seeded hash of the place, say): a block is a bounded box, sorted in one task."""
    at = Window.partitionBy(by).orderBy(*[c for c in ("t", "z", "y", "x") if c in cells.columns])
    mixed = Window.partitionBy(by).orderBy(order, *[c for c in ("t", "z", "y", "x") if c in cells.columns])
    numbered = cells.withColumn("_at", F.row_number().over(at))
    dealt = cells.select(by, F.col(column).alias("_new"), F.row_number().over(mixed).alias("_at"))
    return numbered.join(dealt, [by, "_at"]).withColumn(column, F.col("_new")).select(*cells.columns)


def importance(cells: DataFrame, order: Column, label: str = "label", block: str = "block") -> DataFrame:
    """feature, accuracy, drop: what the folds' accuracy loses when one channel is permuted within blocks; models are those of the cells as they are."""
    fine = cells.where(F.col(label).isNotNull() & (F.abs("neutron") < float("inf")) & (F.abs("xray") < float("inf")))
    models = _table(fold_models(fine, label, block))
    right = lambda rows: judged(rows, models, block).agg(F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"))
    out = right(fine).select(F.lit("none").alias("feature"), "accuracy")
    for c in ("neutron", "xray"):
        out = out.union(right(permuted(fine, c, order, block)).select(F.lit(c).alias("feature"), "accuracy"))
    rows = _table(out)
    plain = rows.where("feature = 'none'").select(F.col("accuracy").alias("plain"))
    return rows.join(F.broadcast(plain)).select("feature", "accuracy", (F.col("plain") - F.col("accuracy")).alias("drop"))
