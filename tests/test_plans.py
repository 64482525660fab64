"""Request parsing, cursors and segment plans: plain Python."""

import base64
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelog.errors import BadRequest, NotFound, Overloaded, response
from tidelog.functions.timebins import ceil_to, floor_to, micros
from tidelog.plans.cursor import Cursor, decode, encode
from tidelog.plans.segments import Segment, coarsest, plan, summaries_suffice
from tidelog.plans.specs import Filters, ListSpec, parse_aggregate, parse_list, parse_time
from tidelog.operators.listing import probes
from tidelog.schema import DAY, HOUR, MINUTE

WINDOW = {"since": "2027-03-01T00:00:00Z", "until": "2027-03-02T00:00:00Z", "bucket": "1h"}


def at(text):
    return parse_time(text, "t")


def test_list_defaults_and_bounds():
    assert parse_list({}) == ListSpec(Filters(), 100, None)
    assert parse_list({"limit": "1000"}).limit == 1000 and parse_list({"limit": "1"}).limit == 1
    assert parse_list({"unknown": "x"}) == ListSpec()


@pytest.mark.parametrize(
    ("params", "message"),
    [
        ({"limit": "0"}, "limit must be between 1 and 1000"), ({"limit": "1001"}, "limit must be between 1 and 1000"), ({"limit": "ten"}, "invalid limit: 'ten'"), ({"limit": "-1"}, "invalid limit: '-1'"),
        ({"level": "critical"}, "invalid level: 'critical'"), ({"service": ""}, "service must be non-empty"), ({"since": "soon"}, "invalid since: 'soon'"), ({"until": "13:00"}, "invalid until: '13:00'"),
        ({"since": "2027-03-02", "until": "2027-03-01"}, "until must be greater than or equal to since"), ({"q": ""}, "q must be non-empty"), ({"q": "x" * 513}, "q exceeds maximum length"),
        ({"attr.": "x"}, "invalid attribute filter: 'attr.'"), ({"attr.k": []}, "missing value for 'attr.k'"), ({"cursor": "!!"}, "invalid cursor"),
    ],
)
def test_list_faults(params, message):
    with pytest.raises(BadRequest, match="^" + message.replace("(", r"\(")) as e:
        parse_list(params)
    assert response(e.value) == (400, {}, {"error": message})


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"since": None}, "since is required"), ({"until": None}, "until is required"), ({"bucket": None}, "bucket is required"), ({"bucket": "2h"}, "invalid bucket: '2h'"), ({"group_by": "host"}, "invalid group_by: 'host'"),
        ({"since": None, "until": None, "bucket": None}, "since is required"), ({"until": "2027-06-01T00:00:00Z", "bucket": "1m"}, "aggregation window produces too many buckets for bucket=1m"),
    ],
)
def test_aggregate_faults(change, message):
    with pytest.raises(BadRequest) as e:
        parse_aggregate(WINDOW | change)
    assert str(e.value) == message


def test_aggregate_edges():
    spec = parse_aggregate(WINDOW | {"group_by": "level", "limit": "0", "cursor": "?"})
    assert (spec.bucket, spec.group_by, spec.until - spec.since) == ("1h", "level", DAY)
    most = {"since": "2027-01-01T00:00:00Z", "bucket": "1m"}
    edge = at("2027-01-01T00:00:00Z") + 100_000 * MINUTE
    assert edge == at("2027-03-11T10:40:00Z")
    parse_aggregate(most | {"until": "2027-03-11T10:40:00Z"})
    with pytest.raises(BadRequest):
        parse_aggregate(most | {"until": "2027-03-11T10:40:00.001Z"})
    parse_aggregate(WINDOW | {"until": WINDOW["since"]})


def test_parameters():
    spec = parse_list({"service": ["a", "b", ""], "attr.k": "", "attr.n": 3, "attr.t": True, "q": "x" * 512, "since": "2027-03-01"})
    assert spec.filters.service == "b" and spec.filters.attributes == {"k": "", "n": "3", "t": "true"}
    assert spec.filters.since == at("2027-03-01T00:00:00Z") == at("2027-03-01T02:00:00+02:00")


def test_errors():
    assert response(Overloaded()) == (503, {"Retry-After": "1"}, {"error": "service temporarily unable to accept writes"})
    assert response(NotFound("not found"))[0] == 404
    assert response(ValueError("secret")) == (500, {}, {"error": "internal error"})


@given(st.integers(-(10**15), 10**17), st.integers(0, 2**63 - 1))
def test_cursor_round_trip(time, number):
    assert decode(encode(Cursor(time, number))) == Cursor(time, number)


def coded(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


@pytest.mark.parametrize("text", ["", "x" * 513, "%%%", "bm90anNvbg", coded([]), coded({"t": "never", "i": "1"}), coded({"t": "2027-01-01T00:00:00Z", "i": "-1"}), coded({"t": "2027-01-01T00:00:00Z", "i": 1}), coded({"i": "1"}), coded(None), "é"])
def test_no_cursor(text):
    assert decode(text) is None


def test_cursor_of_milliseconds():
    assert decode(coded({"t": "2027-04-09T01:02:03.000Z", "i": "88"})) == Cursor(at("2027-04-09T01:02:03Z"), 88)


def test_plan_of_five():
    a, b = at("2027-09-05T06:41:09Z"), at("2027-09-06T20:17:33Z")
    cuts = [a, at("2027-09-05T06:42:00Z"), at("2027-09-05T07:00:00Z"), at("2027-09-06T20:00:00Z"), at("2027-09-06T20:17:00Z"), b]
    assert plan(a, b, "1d") == [Segment(s, *c) for s, c in zip(["raw", "minute", "hour", "minute", "raw"], zip(cuts, cuts[1:]))]
    assert [s.source for s in plan(a, b, "5m")] == ["raw", "minute", "raw"]


def test_plan_of_little():
    a = at("2027-03-01T10:00:10Z")
    assert plan(a, a, "1h") == []
    assert plan(a, a + 90_000_000, "1h") == [Segment("raw", a, a + 90_000_000)]
    assert plan(floor_to(a, HOUR), ceil_to(a, HOUR), "1d") == [Segment("hour", floor_to(a, HOUR), ceil_to(a, HOUR))]


def test_plans_cover_their_windows():
    r = random.Random(1)
    for _ in range(3000):
        a = r.randrange(-(10**15), 10**15)
        b = a + r.choice([r.randrange(3 * MINUTE), r.randrange(3 * HOUR), r.randrange(5 * DAY)])
        bucket = r.choice(["1m", "5m", "1h", "1d"])
        found = plan(a, b, bucket)
        assert len(found) <= 5 and sum(s.source == "raw" for s in found) <= 2
        assert [s.since for s in found] + [b] * bool(found) == [a] * bool(found) + [s.until for s in found]
        assert bool(found) == (a < b)
        for s in found:
            width = {"hour": HOUR, "minute": MINUTE, "raw": 1}[s.source]
            assert s.since < s.until and s.since % width == s.until % width == 0
            assert s.source != "raw" or s.until - s.since < 2 * MINUTE


def test_routing():
    assert summaries_suffice(Filters(service="a", level="info")) and not summaries_suffice(Filters(q="x")) and not summaries_suffice(Filters(attributes={"k": ""}))
    assert [coarsest(b) for b in ("1m", "5m", "1h", "1d")] == ["minute", "minute", "hour", "hour"]


def test_probes():
    now = at("2027-03-01T00:00:00Z")
    assert probes(ListSpec(), now) == [] and probes(ListSpec(Filters(q="x", since=0)), now) == []
    assert [now - p.filters.since for p in probes(ListSpec(Filters(q="x")), now)] == [HOUR, DAY]
    assert probes(ListSpec(Filters(q="x"), cursor=Cursor(now - 5, 1)), now)[0].filters.since == now - 5 - HOUR
    assert probes(ListSpec(Filters(q="x", until=now - 7)), now)[0].filters.since == now - 7 - HOUR
    assert probes(ListSpec(Filters(q="x")), now, newest=now - DAY)[0].filters.since == now - DAY - HOUR


def test_micros_without_zone_is_utc():
    from datetime import datetime

    assert micros(datetime(1970, 1, 1, 0, 0, 1)) == 1_000_000
