"""Filters as columns. No user text becomes SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tidelog.functions.timebins import at, utc_day
from tidelog.plans.cursor import Cursor
from tidelog.plans.specs import Filters
from tidelog.schema import DAY


def _days(df: DataFrame, since: int | None, until: int | None) -> list[Column]:
    """Bounds on the partition column that follow from bounds on time: without them no directory is skipped."""
    if "day" not in df.columns:
        return []
    day = lambda us: F.lit(utc_day(us).isoformat()).cast("date")
    low = [F.col("day") >= day(since)] if since is not None else []
    return low + ([F.col("day") <= day(until)] if until is not None else [])


def _without_zone(df: DataFrame, time: str) -> bool:
    return isinstance(df.schema[time].dataType, TimestampNTZType)


def time_range(df: DataFrame, since: int | None, until: int | None, time: str = "timestamp") -> list[Column]:
    """since <= time < until, in forms that reach the Parquet scan."""
    ntz = _without_zone(df, time)
    bounds = [F.col(time) >= at(since, ntz)] if since is not None else []
    bounds += [F.col(time) < at(until, ntz)] if until is not None else []
    return bounds + _days(df, since, until)


def same(df: DataFrame, filters: Filters) -> list[Column]:
    """Service and level, which rows and summaries both have."""
    return [F.col(n) == F.lit(v) for n, v in (("service", filters.service), ("level", filters.level)) if v is not None]


def matches(df: DataFrame, filters: Filters) -> list[Column]:
    """All filters on rows. Text is found as a plain substring in lower case; an attribute that a
    row lacks matches nothing."""
    out = time_range(df, filters.since, filters.until) + same(df, filters)
    out += [F.col("attributes")[F.lit(k)] == F.lit(v) for k, v in filters.attributes.items()]
    if filters.q is not None:
        out.append(F.contains(F.lower("message"), F.lower(F.lit(filters.q))))
    return out


#: Ranges that a filter spells out; where there are more it names their days alone.
MOST_RANGES = 100


def in_ranges(df: DataFrame, ranges: list[tuple[int, int]]) -> list[Column]:
    """Times in one of the ranges [since, until), for pruning: with MOST_RANGES or more of them whole days pass."""
    days = sorted({utc_day(t) for a, b in ranges for t in range(a, b, DAY)} | {utc_day(b - 1) for _, b in ranges})
    out = [F.col("day").isin(days)] if "day" in df.columns else []
    if len(ranges) < MOST_RANGES:
        out.append(reduce(lambda x, y: x | y, ((F.col("timestamp") >= at(a)) & (F.col("timestamp") < at(b)) for a, b in ranges)))
    return out


def key_hash(key: Column, value: Column) -> Column:
    """What the attribute index knows a pair by."""
    return F.xxhash64(key, value)


def after(df: DataFrame, cursor: Cursor | None) -> list[Column]:
    """(timestamp, id) below the cursor's, as two bounds of which the first is pushed down."""
    if cursor is None:
        return []
    t = at(cursor.time, _without_zone(df, "timestamp"))
    return [F.col("timestamp") <= t, (F.col("timestamp") < t) | (F.col("id") < F.lit(cursor.id)), *_days(df, None, cursor.time)]


def keep(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
