"""Exact counts by time bucket, from summaries where they suffice."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.predicates import keep, matches, same, time_range
from tidelog.functions.timebins import bin_start
from tidelog.plans.segments import Segment, plan, summaries_suffice
from tidelog.plans.specs import AggregateSpec


def _group(spec: AggregateSpec) -> Column:
    return F.col(spec.group_by) if spec.group_by else F.lit(None).cast("string")


def _binned(rows: DataFrame, time: str, spec: AggregateSpec, count: Column) -> DataFrame:
    return rows.groupBy(bin_start(F.col(time), spec.bucket).alias("start"), _group(spec).alias("group")).agg(count.alias("count"))


def _ordered(buckets: DataFrame) -> DataFrame:
    return buckets.orderBy("start", F.asc_nulls_first("group"))


def from_rows(logs: DataFrame, spec: AggregateSpec, ordered: bool = True) -> DataFrame:
    """Counts of rows; empty buckets are left out, the group is null where none is asked for."""
    found = _binned(keep(logs, matches(logs, spec.filters.within(spec.since, spec.until))), "timestamp", spec, F.count("*"))
    return _ordered(found) if ordered else found


def _part(segment: Segment, logs: DataFrame, tiers: Mapping[str, DataFrame], spec: AggregateSpec) -> DataFrame:
    raw = segment.source == "raw"
    rows, time = (logs, "timestamp") if raw else (tiers[segment.source], "bucket_start")
    rows = keep(rows, time_range(rows, segment.since, segment.until, time) + same(rows, spec.filters))
    return _binned(rows, time, spec, F.count("*") if raw else F.sum("cnt"))


def aggregate(logs: DataFrame, tiers: Mapping[str, DataFrame], spec: AggregateSpec, ordered: bool = True) -> DataFrame:
    """(start, group, count) ordered, unless a caller sorts the few rows itself. Text and attribute filters read rows; else every
    segment of the window is counted from its source and the counts of a bucket are added up."""
    if not summaries_suffice(spec.filters):
        return from_rows(logs, spec, ordered)
    segments = plan(spec.since, spec.until, spec.bucket)
    if not segments:
        return from_rows(logs, spec, ordered).limit(0)
    parts = [_part(s, logs, tiers, spec) for s in segments]
    found = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("start", "group").agg(F.sum("count").alias("count"))
    return _ordered(found) if ordered else found
