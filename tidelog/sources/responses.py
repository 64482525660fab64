"""Rows as the JSON objects that queries answer with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timebins import iso_millis, iso_short, iso_text


def list_entries(rows: DataFrame) -> DataFrame:
    """id as text, timestamp to the millisecond."""
    return rows.select(F.col("id").cast("string").alias("id"), iso_millis(F.col("timestamp")).alias("timestamp"), "level", "service", "message", "attributes")


def list_entry(row: Mapping) -> dict:
    """The same for a row that the driver holds, its time in microseconds."""
    return {"id": str(row["id"]), "timestamp": iso_text(row["time_us"])} | {n: row[n] for n in ("level", "service", "message", "attributes")}


def bucket_entries(buckets: DataFrame) -> DataFrame:
    return buckets.select(iso_short(F.col("start")).alias("start"), "group", "count")


def bucket_entry(row: Mapping) -> dict:
    return {"start": iso_text(row["start_us"]).replace(".000Z", "Z"), "group": row["group"], "count": row["count"]}
