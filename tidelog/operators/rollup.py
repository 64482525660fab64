"""Minute and hour summaries: additive counts by (bucket_start, service, level); the attribute index: by (kv, hour)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.predicates import key_hash
from tidelog.functions.timebins import bin_start

KEY = ("bucket_start", "service", "level")


def minutes_of(logs: DataFrame) -> DataFrame:
    start = bin_start(F.col("timestamp"), "1m").alias("bucket_start")
    return logs.groupBy(start, "service", "level").agg(F.count("*").alias("cnt"))


def hours_of(minutes: DataFrame) -> DataFrame:
    """From minutes, not rows: sixty times fewer at most."""
    start = bin_start(F.col("bucket_start"), "1h").alias("hour_start")
    return minutes.groupBy(start, "service", "level").agg(F.sum("cnt").alias("cnt")).withColumnRenamed("hour_start", "bucket_start")


def keys_of(logs: DataFrame) -> DataFrame:
    """Which attribute values stand in which hour, and how often."""
    pairs = logs.select("timestamp", F.explode("attributes").alias("k", "v"))
    return pairs.groupBy(key_hash(F.col("k"), F.col("v")).alias("kv"), bin_start(F.col("timestamp"), "1h").alias("bucket_start")).agg(F.count("*").alias("cnt"))


def summed(deltas: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per key from the deltas of many batches."""
    return deltas.groupBy(*key).agg(F.sum("cnt").alias("cnt"))


def tiers_of(logs: DataFrame) -> dict[str, DataFrame]:
    minutes = minutes_of(logs)
    return {"minute": minutes, "hour": hours_of(minutes)}
