"""Paired measurements as DataFrames: (t, neutron, xray), or (t, z, y, x, neutron, xray) where cells have coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paired_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each line item: quantity and extended price, by ship year. Only three columns are read."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select((F.year("l_shipdate") - 1995).alias("t"), F.col("l_quantity").alias("neutron"), F.col("l_extendedprice").alias("xray"))


def grid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells of a grid of 20 x 20 columns and rows: value, and the number k of the properties. Incomplete slabs are kept."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    cell = F.col("event_id")
    return rows.select(
        F.lit(0).alias("t"),
        F.floor(cell / 400).cast("int").alias("z"),
        F.pmod(F.floor(cell / 20), F.lit(20)).cast("int").alias("y"),
        F.pmod(cell, F.lit(20)).cast("int").alias("x"),
        F.col("value").alias("neutron"),
        F.get_json_object("props", "$.k").cast("double").alias("xray"),
    )


def grid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of grid_events as a series: five slabs make a timepoint."""
    return grid_events(spark, sf_dir).withColumns({"t": F.floor(F.col("z") / 5).cast("int"), "z": F.pmod(F.col("z"), F.lit(5))})


def with_labels(cells: DataFrame, steps: tuple[float, ...] = (34.0, 67.0)) -> DataFrame:
    """cells with an int label: how many of steps the second channel has reached."""
    return cells.withColumn("label", sum((F.col("xray") >= s).cast("int") for s in steps))
