"""Epoch-anchored time bins and ISO text, all in UTC whatever the session's zone."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import BUCKETS

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def micros(t: datetime) -> int:
    """Microseconds since the epoch; a time without a zone is UTC."""
    t = t if t.tzinfo else t.replace(tzinfo=UTC)
    return (t - EPOCH) // timedelta(microseconds=1)


FIRST, LAST = micros(datetime.min), micros(datetime.max)


def moment(us: int) -> datetime:
    """The nearest one that the calendar has."""
    return EPOCH + timedelta(microseconds=min(max(us, FIRST), LAST))


def utc_day(us: int) -> date:
    return moment(us).date()


def at(us: int, ntz: bool = False) -> Column:
    """A timestamp literal, of a column that has a zone or of one that has none."""
    exact = F.timestamp_micros(F.lit(us))
    if not ntz:
        return exact
    return F.lit(moment(us).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def bin_start(ts: Column, bucket: str) -> Column:
    """Start of the bucket that holds `ts`, counted from the epoch, also before 1970."""
    return F.window(ts, BUCKETS[bucket][1])["start"]


def utc_date(ts: Column) -> Column:
    """The day in UTC of a timestamp that has a zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / float(BUCKETS["1d"][0])).cast("int"))


def floor_to(us: int, width: int) -> int:
    return us // width * width


def ceil_to(us: int, width: int) -> int:
    return -(-us // width) * width


def iso_text(us: int) -> str:
    """`iso_millis` of microseconds, on the driver."""
    return moment(us).replace(tzinfo=None).isoformat(timespec="milliseconds") + "Z"


def iso_millis(ts: Column) -> Column:
    """2026-03-01T10:00:00.000Z; needs a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_short(ts: Column) -> Column:
    """As `iso_millis`, without milliseconds that are zero."""
    return F.regexp_replace(iso_millis(ts), r"\.000Z$", "Z")

