"""Which summary answers which part of a time window.

The window's whole hours come from the hour summary, whole minutes on either side of them from the minute
summary, what remains at the ends from the rows. Found from the inside out: the coarsest width
with a whole cell gives the core, and each finer one adds what it can at both ends."""

from __future__ import annotations

from dataclasses import dataclass

from tidelog.functions.timebins import ceil_to, floor_to
from tidelog.plans.specs import Filters
from tidelog.schema import HOUR, MINUTE

WIDTHS = {"hour": HOUR, "minute": MINUTE, "raw": 1}


@dataclass(frozen=True)
class Segment:
    source: str
    since: int
    until: int


def summaries_suffice(filters: Filters) -> bool:
    return not filters.needs_rows


def coarsest(bucket: str) -> str:
    """The widest summary whose cells never straddle a bucket's edge."""
    return "hour" if bucket in ("1h", "1d") else "minute"


def plan(since: int, until: int, bucket: str) -> list[Segment]:
    """Segments in time order that cover [since, until) exactly: 5 at most, 2 of them raw. None for an empty window."""
    names = list(WIDTHS)
    found: list[Segment] = []
    for name in names[names.index(coarsest(bucket)) :]:
        low, high = ceil_to(since, WIDTHS[name]), floor_to(until, WIDTHS[name])
        if low >= high:
            continue
        if not found:
            found = [Segment(name, low, high)]
            continue
        if low < found[0].since:
            found.insert(0, Segment(name, low, found[0].since))
        if high > found[-1].until:
            found.append(Segment(name, found[-1].until, high))
    return found

