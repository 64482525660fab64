"""In which steps a page of newest rows is looked for: windows that hold little first, then ever more."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from datetime import date, datetime

from tidelog.functions.timebins import floor_to, micros
from tidelog.plans.specs import ListSpec
from tidelog.schema import DAY, HOUR, MINUTE

#: Bytes that the first window holds, about; each next one holds GROWTH times as many.
FIRST_BYTES, GROWTH = 256 << 20, 8

Window = tuple[int | None, int | None]


def day_start(day: date) -> int:
    return micros(datetime.combine(day, datetime.min.time()))


def _bounds(spec: ListSpec) -> tuple[int | None, int | None]:
    """The times that the page can lie in; a cursor's own instant is still in."""
    f, cursor = spec.filters, spec.cursor
    high = [t for t in (f.until, cursor.time + 1 if cursor else None) if t is not None]
    return f.since, min(high, default=None)


def windows(spec: ListSpec, sizes: Mapping[date, int], first: int = FIRST_BYTES, growth: int = GROWTH) -> list[Window]:
    """Disjoint windows [since, until), newest first, that cover all rows of the page's range in a store whose days hold
    `sizes` bytes. Days without rows are in none. Small days share a window; a day that holds more than a
    window may is cut into even slices, a minute at least, so a page of common rows reads a slice whatever the size of a day."""
    low, high = _bounds(spec)
    held = sorted((d for d in sizes if (low is None or day_start(d) + DAY > low) and (high is None or day_start(d) < high)), reverse=True)
    out: list[Window] = []
    room, budget = first, first

    def add(since: int, until: int, size: int, joins: bool) -> None:
        nonlocal room, budget
        if joins and out and out[-1][0] == until and size <= room:
            out[-1] = (since, out[-1][1])
        else:
            if out:
                budget *= growth
            room = budget
            out.append((since, until))
        room -= size

    for i, day in enumerate(held):
        start, size = day_start(day), sizes[day]
        end = start + DAY if i == 0 else out[-1][0]  # days without rows cost nothing, so windows touch
        if size <= max(room, budget * growth if out else budget):
            add(start, end, size, True)
            continue
        until = end
        while until > start:
            width = max(MINUTE, floor_to(int(DAY * (budget * (growth if out else 1)) / size), MINUTE))
            since = max(start, min(until, start + DAY) - width)
            add(since, until, int(size * (min(until, start + DAY) - since) / DAY), False)
            until = since
    if low is not None and out:
        out[-1] = (max(low, out[-1][0]), out[-1][1])
    if high is not None and out:
        out[0] = (out[0][0], min(high, out[0][1]))
    return out


def within_hours(found: list[Window], hours: Collection[int]) -> list[tuple[Window, list[Window]]]:
    """The windows that meet some of `hours` (their starts), each cut to those, and the ranges of hours in it, neighbours joined."""
    out = []
    for low, high in found:
        parts: list[Window] = []
        for h in sorted(hours):
            a, b = max(low, h), min(high, h + HOUR)
            if a < b:
                if parts and parts[-1][1] == a:
                    parts[-1] = (parts[-1][0], b)
                else:
                    parts.append((a, b))
        if parts:
            out.append(((parts[0][0], parts[-1][1]), parts))
    return out
