"""Validation of entries, one rule after the other."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidelog.errors import BadRequest
from tidelog.functions.numbers import plain_number
from tidelog.operators.validate import accepted, rejected, validate
from tidelog.plans.specs import parse_time
from tidelog.sources.envelope import bodies, check_body, exploded

NOW = parse_time("2031-02-11T15:00:00Z", "now")
GOOD = {"timestamp": "2031-02-11T14:08:51.250Z", "level": "error", "service": "ledger", "message": "disk nearly full"}

CASES = [
    ({}, "timestamp is required"), ("text", "timestamp is required"), (None, "timestamp is required"), (GOOD | {"timestamp": None}, "invalid timestamp: null"), (GOOD | {"timestamp": "yesterday"}, 'invalid timestamp: "yesterday"'),
    (GOOD | {"timestamp": "2031-02-11"}, 'invalid timestamp: "2031-02-11"'), (GOOD | {"timestamp": "2031-02-11T14:00:00"}, 'invalid timestamp: "2031-02-11T14:00:00"'), (GOOD | {"timestamp": 5}, "invalid timestamp: 5"),
    (GOOD | {"timestamp": "2031-02-30T00:00:00Z"}, 'invalid timestamp: "2031-02-30T00:00:00Z"'), (GOOD | {"timestamp": "2031-02-11T15:10:00Z"}, "timestamp is more than five minutes in the future"),
    (GOOD | {"timestamp": "2031-02-11T15:01:00Z"}, None), (GOOD | {"timestamp": "2031-02-11T15:05:00Z"}, None), (GOOD | {"timestamp": "2031-02-11T17:04:00+02:00"}, None), (GOOD | {"timestamp": "1969-12-31T23:59:59Z"}, None),
    (GOOD | {"level": "critical"}, 'invalid level: "critical"'), (GOOD | {"level": 3}, "invalid level: 3"), (GOOD | {"level": "ERROR"}, 'invalid level: "ERROR"'), ({k: v for k, v in GOOD.items() if k != "level"}, "level is required"),
    ({k: v for k, v in GOOD.items() if k != "message"}, "message must be a non-empty string"), (GOOD | {"message": ""}, "message must be a non-empty string"), (GOOD | {"message": 123}, "message must be a non-empty string"),
    ({k: v for k, v in GOOD.items() if k != "service"}, "service must be a non-empty string"), (GOOD | {"service": {"a": 1}}, "service must be a non-empty string"),
    (GOOD | {"message": "a\0b"}, "message contains a NUL character"), (GOOD | {"service": "a\0b"}, "service contains a NUL character"), (GOOD | {"attributes": {"k": "a\0b"}}, "attribute value contains a NUL character"),
    (GOOD | {"message": "top\nbottom\tright\\x\r"}, None), (GOOD | {"attributes": {"n": {"a": 1}}}, "attributes: unsupported value type"), (GOOD | {"attributes": {"n": [1, 2]}}, "attributes: unsupported value type"),
    (GOOD | {"attributes": {"n": None}}, "attributes: unsupported value type"), (GOOD | {"attributes": [1]}, "attributes: unsupported value type"), (GOOD | {"attributes": "x"}, "attributes: unsupported value type"), (GOOD | {"attributes": None}, None),
    (GOOD | {"attributes": {}}, None), (GOOD | {"attributes": {str(i): i for i in range(128)}}, None), (GOOD | {"attributes": {str(i): i for i in range(129)}}, "attributes has more than 128 keys"),
    (GOOD | {"attributes": {"k" * 129: 1}}, "attribute key exceeds 128 characters"), (GOOD | {"attributes": {"k": "v" * 4096}}, None), (GOOD | {"attributes": {"k": "v" * 4097}}, "attribute value exceeds 4096 characters"),
]


def checked(spark, entries):
    return validate(exploded(bodies(spark, [json.dumps({"logs": entries})])), NOW)


def test_reasons(spark):
    rows = checked(spark, [e for e, _ in CASES])
    assert [(r.pos, r.reason) for r in rows.orderBy("pos").collect()] == [(i, why) for i, (_, why) in enumerate(CASES)]
    assert [(r["index"], r.reason) for r in rejected(rows).orderBy("index").collect()] == [(i, why) for i, (_, why) in enumerate(CASES) if why]
    assert rejected(rows).columns == ["index", "reason"]


def test_values(spark):
    extra = {"host": "h7", "tries": 3, "warm": True, "off": False, "f": 1.0, "e": 1e21, "t": "a\tb\n\\", "big": 12345678901234567890, "": "empty key"}
    row = accepted(checked(spark, [GOOD | {"attributes": extra}])).first()
    want = {"host": "h7", "tries": "3", "warm": "true", "off": "false", "f": "1", "e": "1e+21", "t": "a\tb\n\\", "": "empty key"}
    assert {k: v for k, v in row.attributes.items() if k != "big"} == want
    assert row.timestamp.microsecond == 250000 and row.level == "error" and row.service == "ledger"


def test_last_of_repeated_keys(spark):
    body = '{"logs": [%s]}' % json.dumps(GOOD).replace('"level": "error"', '"level": "nope", "level": "warn"')
    assert accepted(validate(exploded(bodies(spark, [body])), NOW)).first().level == "warn"


def test_bodies_without_entries(spark):
    assert exploded(bodies(spark, ["", "[]", "{", '{"logs": 3}', '{"logs": []}', '{"other": [1]}'])).count() == 0


@pytest.mark.parametrize(
    ("value", "text"),
    [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (100.0, "100"), (1e7, "10000000"), (12345678.9, "12345678.9"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (0.001, "0.001"), (0.00012, "0.00012"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-2.5e-10, "-2.5e-10"), (0.1 + 0.2, "0.30000000000000004"), (123456789012.0, "123456789012")],
)
def test_plain_numbers(spark, value, text):
    assert spark.range(1).select(plain_number(F.lit(value))).first()[0] == text
    assert float(text) == value and not math.isnan(value)


@pytest.mark.parametrize(
    ("body", "message"),
    [("[]", "request body must be a JSON object with a 'logs' array"), ("null", "request body must be a JSON object with a 'logs' array"), ("{}", "'logs' must be an array"), ('{"logs": {}}', "'logs' must be an array"), ('{"logs": []}', "'logs' must contain at least one entry"), ('{"logs": [1,2,3]}', "batch too large: 3 > 2"), ('{"logs": [1], "x": "%s"}' % ("x" * 100), "request body too large")],
)
def test_envelopes(body, message):
    with pytest.raises(BadRequest) as e:
        check_body(body, most_entries=2, most_bytes=90)
    assert str(e.value) == message


def test_malformed_json():
    with pytest.raises(BadRequest, match="malformed JSON"):
        check_body("{")
