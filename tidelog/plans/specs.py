"""What a query asks for, and the parsing of request parameters into it."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime

from tidelog.errors import BadRequest
from tidelog.functions.timebins import micros
from tidelog.plans.cursor import Cursor, decode
from tidelog.schema import BUCKETS, GROUPS, LEVELS

#: The limits, and below the messages of the request contract.
DEFAULT_LIMIT, MOST_LIMIT, MOST_TEXT, MOST_BUCKETS = 100, 1000, 512, 100_000


@dataclass(frozen=True)
class Filters:
    """Conjunction of what is given; times in microseconds, `until` exclusive."""

    service: str | None = None
    level: str | None = None
    since: int | None = None
    until: int | None = None
    q: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)

    @property
    def needs_rows(self) -> bool:
        """Whether text or attributes are asked for, which summaries don't hold."""
        return self.q is not None or bool(self.attributes)

    def within(self, since: int | None = None, until: int | None = None) -> Filters:
        return replace(self, since=self.since if since is None else since, until=self.until if until is None else until)


@dataclass(frozen=True)
class ListSpec:
    filters: Filters = Filters()
    limit: int = DEFAULT_LIMIT
    cursor: Cursor | None = None


@dataclass(frozen=True)
class AggregateSpec:
    since: int
    until: int
    bucket: str
    group_by: str | None = None
    filters: Filters = Filters()


def given(params: Mapping[str, object], name: str) -> str | None:
    """A parameter's text; of a repeated one the last that isn't empty."""
    value = params.get(name)
    if isinstance(value, (list, tuple)):
        return next((v for v in reversed(value) if isinstance(v, str) and v), None)
    if isinstance(value, bool):
        return str(value).lower()
    return value if value is None or isinstance(value, str) else str(value)


def parse_time(text: str, name: str) -> int:
    """ISO 8601; without a zone it is UTC."""
    try:
        return micros(datetime.fromisoformat(text))
    except (ValueError, OverflowError):
        raise BadRequest(f"invalid {name}: '{text}'") from None


def _one_of(params: Mapping[str, object], name: str, known) -> str | None:
    value = given(params, name)
    if value is not None and value not in known:
        raise BadRequest(f"invalid {name}: '{value}'")
    return value


def _attributes(params: Mapping[str, object]) -> dict[str, str]:
    out = {}
    for name in params:
        if name.startswith("attr."):
            if name == "attr.":
                raise BadRequest(f"invalid attribute filter: '{name}'")
            value = given(params, name)
            if value is None:
                raise BadRequest(f"missing value for '{name}'")
            out[name.removeprefix("attr.")] = value
    return out


def parse_filters(params: Mapping[str, object]) -> Filters:
    service = given(params, "service")
    if service == "":
        raise BadRequest("service must be non-empty")
    level = _one_of(params, "level", LEVELS)
    times = {n: parse_time(t, n) for n in ("since", "until") if (t := given(params, n)) is not None}
    if len(times) == 2 and times["until"] < times["since"]:
        raise BadRequest("until must be greater than or equal to since")
    q = given(params, "q")
    if q is not None and not 1 <= len(q) <= MOST_TEXT:
        raise BadRequest("q exceeds maximum length" if q else "q must be non-empty")
    return Filters(service, level, times.get("since"), times.get("until"), q, _attributes(params))


def parse_list(params: Mapping[str, object]) -> ListSpec:
    filters, limit, cursor = parse_filters(params), DEFAULT_LIMIT, None
    if (text := given(params, "limit")) is not None:
        if not re.fullmatch(r"[0-9]+", text):
            raise BadRequest(f"invalid limit: '{text}'")
        limit = int(text.lstrip("0")[:5] or 0)  # five digits tell
        if not 1 <= limit <= MOST_LIMIT:
            raise BadRequest(f"limit must be between 1 and {MOST_LIMIT}")
    if (text := given(params, "cursor")) is not None and (cursor := decode(text)) is None:
        raise BadRequest("invalid cursor")
    return ListSpec(filters, limit, cursor)


def parse_aggregate(params: Mapping[str, object]) -> AggregateSpec:
    """`limit` and `cursor` are ignored, as is any unknown parameter."""
    filters = parse_filters(params)
    for name in ("since", "until"):
        if getattr(filters, name) is None:
            raise BadRequest(f"{name} is required")
    if (bucket := _one_of(params, "bucket", BUCKETS)) is None:
        raise BadRequest("bucket is required")
    group_by = _one_of(params, "group_by", GROUPS)
    if filters.until - filters.since > MOST_BUCKETS * BUCKETS[bucket][0]:
        raise BadRequest(f"aggregation window produces too many buckets for bucket={bucket}")
    return AggregateSpec(filters.since, filters.until, bucket, group_by, filters)
