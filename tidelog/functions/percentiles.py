"""Percentiles as load tools report them: a value that occurs, at index min(n - 1, floor(p / 100 * n)) of the sorted ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentile(values: Sequence[float], p: int) -> float:
    return sorted(values)[min(len(values) - 1, p * len(values) // 100)]


def percentiles(rows: DataFrame, name: str, value: str, ps: Sequence[int]) -> DataFrame:
    """(name, p, value) for each group; equal values stand in any order."""
    own = Window.partitionBy(name)
    placed = rows.select(name, value, (F.row_number().over(own.orderBy(value)) - 1).alias("_i"), F.count("*").over(own).alias("_n"))
    every = placed.withColumn("p", F.explode(F.array(*(F.lit(p).cast("long") for p in ps))))
    return every.where(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.col("p") * F.col("_n") / 100))).select(name, "p", value)
