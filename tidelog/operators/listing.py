"""Newest-first pages of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidelog.functions.predicates import after, keep, matches
from tidelog.functions.timebins import utc_day
from tidelog.plans.cursor import Cursor, encode
from tidelog.plans.specs import ListSpec
from tidelog.schema import DAY, HOUR

#: Windows tried before the whole table, newest first.
PROBES = (HOUR, DAY)


def page(logs: DataFrame, spec: ListSpec) -> DataFrame:
    """At most `limit` rows by (timestamp, id) descending: a bounded top-k, never a full sort."""
    rows = keep(logs, matches(logs, spec.filters) + after(logs, spec.cursor))
    rows = rows.select("id", "timestamp", "level", "service", "message", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(spec.limit)


def probes(spec: ListSpec, now: int, newest: int | None = None) -> list[ListSpec]:
    """Narrow windows worth trying first. Text and attribute filters read every row in range, so
    without a lower bound the last hour, then day, is tried: rows outside are older than all
    inside, so a full page from a window is the page. Windows hang from the cursor, `until` or now, but not
    later than the newest data."""
    if not spec.filters.needs_rows or spec.filters.since is not None:
        return []
    anchor = spec.cursor.time if spec.cursor else spec.filters.until if spec.filters.until is not None else now
    anchor = anchor if newest is None else min(anchor, newest)
    return [ListSpec(spec.filters.within(since=anchor - span), spec.limit, spec.cursor) for span in PROBES]


def search(logs: DataFrame, spec: ListSpec, now: int, newest: int | None = None, days: set | None = None) -> DataFrame:
    """The page, by way of the probes; `days`, if known, spares probes of days that hold nothing."""
    for probe in probes(spec, now, newest):
        if days is not None and not any(d >= utc_day(probe.filters.since) for d in days):
            continue
        found = page(logs, probe)
        held = found.collect()  # at most `limit` rows
        if len(held) == spec.limit:
            return logs.sparkSession.createDataFrame(held, found.schema).orderBy(F.desc("timestamp"), F.desc("id"))
    return page(logs, spec)


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: str | None


def held(found: DataFrame) -> DataFrame:
    """The columns of a page that the driver collects, the time in microseconds: reading it depends on no zone."""
    time = F.unix_micros("timestamp") if found.schema["timestamp"].dataType.simpleString() == "timestamp" else F.unix_micros(F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), F.current_timezone()))
    return found.select("id", time.alias("time_us"), "level", "service", "message", "attributes")


def paged(rows: list[Row], limit: int) -> Page:
    """Rows and the next cursor, which there is exactly if the page is full."""
    return Page(rows, encode(Cursor(rows[-1]["time_us"], rows[-1]["id"])) if len(rows) == limit else None)


def collect(found: DataFrame, limit: int) -> Page:
    return paged(held(found).collect(), limit)


def in_steps(step: Callable[[ListSpec, list | None], list[Row]], spec: ListSpec, windows: list[tuple[tuple[int, int], list | None]]) -> Page:
    """The page from windows that lie one before the other, newest first: each is read once, by one job, and reading ends when the page is full.
    `step` is given the window's own spec and, where only parts of it can hold rows, these."""
    rows: list[Row] = []
    for (low, high), parts in windows:
        rows += step(ListSpec(spec.filters.within(low, high), spec.limit - len(rows), spec.cursor), parts)
        if len(rows) == spec.limit:
            break
    return paged(rows, spec.limit)
