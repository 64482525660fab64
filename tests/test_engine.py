"""The store and the requests, end to end."""

import json
import random
from datetime import date

import pytest

from tidelog.engine import Engine
from tidelog.errors import BadRequest, Overloaded
from tidelog.functions.predicates import keep, matches
from tidelog.operators.aggregate import aggregate, from_rows
from tidelog.operators.listing import page, search
from tidelog.operators.rollup import tiers_of
from tidelog.plans.cursor import Cursor
from tidelog.plans.specs import AggregateSpec, Filters, ListSpec, parse_time
from tidelog.schema import DAY, HOUR, MINUTE
from tidelog.sources import fixtures
from tidelog.sources.envelope import bodies
from tidelog.sources.store import LogStore
from tidelog.streaming.ingest import drain, read_bodies, start, store_batch
from tests.conftest import DATA

SMALL = str(DATA / "sf0.001")
NOW = parse_time("2026-03-05T00:00:00Z", "now")


def entry(time, service="auth", level="info", message="m", **attributes):
    return {"timestamp": time, "level": level, "service": service, "message": message, "attributes": attributes}


SCENE = [entry("2026-02-27T21:13:05Z")] * 3 + [entry("2026-02-27T21:14:30Z", level="error")] * 2 + [entry("2026-02-27T21:14:50Z", "checkout")]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    assert e.ready()
    assert e.ingest(json.dumps({"logs": SCENE[:4]}), NOW) == {"accepted": 4, "rejected": []}
    bad = entry("2026-02-27T21:15:00Z", level="bogus")
    assert e.ingest(json.dumps({"logs": [SCENE[4], bad, SCENE[5]]}), NOW) == {"accepted": 2, "rejected": [{"index": 1, "reason": 'invalid level: "bogus"'}]}
    ties = [entry("2026-03-02T08:00:00.123456Z", "ties", message=f"Payment DECLINED 100%_ {i}" if i % 2 else "succeeded", region="eu" if i < 3 else "us") for i in range(5)]
    assert e.ingest(json.dumps({"logs": ties}), NOW)["accepted"] == 5
    return e


def test_counts(engine):
    window = {"since": "2026-02-27T21:13:02Z", "until": "2026-02-27T21:15:00Z", "bucket": "1m"}
    buckets = lambda **more: [(b["start"][11:16], b["group"], b["count"]) for b in engine.aggregate(window | more)["buckets"]]
    assert buckets(group_by="service") == [("21:13", "auth", 3), ("21:14", "auth", 2), ("21:14", "checkout", 1)]
    assert buckets(group_by="level", since="2026-02-27T21:13:00Z") == [("21:13", "info", 3), ("21:14", "error", 2), ("21:14", "info", 1)]
    assert buckets(service="checkout") == [("21:14", None, 1)]
    assert buckets(q="nothing") == [] and buckets(until=window["since"]) == []
    assert engine.aggregate(window)["buckets"][0]["start"] == "2026-02-27T21:13:00Z"


def test_pages(engine):
    first = engine.search({"limit": "2", "service": "ties"}, NOW)
    second = engine.search({"limit": "2", "service": "ties", "cursor": first["next_cursor"]}, NOW)
    third = engine.search({"limit": "2", "service": "ties", "cursor": second["next_cursor"]}, NOW)
    got = [int(r["id"]) for p in (first, second, third) for r in p["logs"]]
    assert got == sorted(got, reverse=True) and len(set(got)) == 5 and third["next_cursor"] is None
    row = first["logs"][0]
    assert row["timestamp"] == "2026-03-02T08:00:00.123Z" and row["attributes"] == {"region": "us"} and isinstance(row["id"], str)
    full = engine.search({"limit": "5", "service": "ties"}, NOW)
    assert full["next_cursor"] and engine.search({"limit": "5", "service": "ties", "cursor": full["next_cursor"]}, NOW) == {"logs": [], "next_cursor": None}


def test_filters(engine):
    found = engine.search({"q": "declined 100%_", "attr.region": "eu"}, NOW)["logs"]
    assert [r["message"] for r in found] == ["Payment DECLINED 100%_ 1"]
    assert engine.search({"attr.none": "x"}, NOW)["logs"] == [] and engine.search({"q": "%"}, NOW)["logs"] != []
    assert len(engine.search({"until": "2026-03-02T00:00:00Z"}, NOW)["logs"]) == 6


def test_ids_are_dense(engine):
    assert sorted(r.id for r in engine.store.logs().collect()) == list(range(1, 12))


def test_refusals(engine, spark):
    with pytest.raises(BadRequest) as e:
        engine.ingest(json.dumps({"logs": [{}, 3]}), NOW)
    assert e.value.result["accepted"] == 0 and [r["index"] for r in e.value.result["rejected"]] == [0, 1]
    small = Engine(spark, engine.store.path, most_waiting=1)
    with pytest.raises(Overloaded):
        small.ingest(json.dumps({"logs": SCENE}), NOW)


def counts(store):
    return {n: sorted((r.bucket_start, r.service, r.level, r.cnt) for r in t.select("bucket_start", "service", "level", "cnt").collect()) for n, t in store.tiers().items()}


def test_batches_replay_compact_rebuild_and_expire(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    given = bodies(spark, [json.dumps({"logs": SCENE}), json.dumps({"logs": [entry("2026-01-15T23:59:59.9Z"), entry("2026-02-27T00:00:00Z")]})])
    done = store_batch(store, given, 0, NOW)
    rows, tiers = sorted(map(tuple, store.logs().drop("attributes").collect())), counts(store)
    assert done["rows"] == 8 and store_batch(store, given, 0, NOW + DAY) == done
    store.folder.delete("batches/0.done.json")  # as if the run had ended before its marker
    assert store.logs().count() == 0 and store.tiers()["hour"].count() == 0
    assert store_batch(store, given, 0, NOW + 99 * DAY) == done
    assert (sorted(map(tuple, store.logs().drop("attributes").collect())), counts(store)) == (rows, tiers)
    store_batch(store, bodies(spark, [json.dumps({"logs": SCENE[:2]})]), 1, NOW)
    assert sorted(r.id for r in store.logs().collect()) == list(range(1, 11))
    assert store.compact(date(2026, 2, 28)) is not None and store.compact(date(2026, 2, 28)) is None
    assert sorted(r.id for r in store.logs().collect()) == list(range(1, 11))
    assert sum(r.cnt for r in store.tiers()["minute"].collect()) == 10
    before = counts(store)
    store.rebuild()
    assert counts(store) == before
    store_batch(store, bodies(spark, [json.dumps({"logs": SCENE[:1]})]), 2, NOW)
    assert max(r.id for r in store.logs().collect()) == 11
    edge = parse_time("2026-01-16T00:00:00Z", "t") + 30 * DAY
    assert store.sweep(edge - 1) == [] and store.sweep(edge) == [date(2026, 1, 15)]
    days = {d: {r.day for r in t.select("day").collect()} for d, t in (("facts", store.logs()), *store.tiers().items())}
    assert days == dict.fromkeys(("facts", "minute", "hour"), {date(2026, 2, 27)})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = LogStore(spark, str(tmp_path / "s"))
    for part in (SCENE[:4], SCENE[4:] + [{}]):
        (tmp_path / "in" / f"{len(part)}.json").write_text(json.dumps({"logs": part}, indent=1))
        drain(start(store, read_bodies(spark, str(tmp_path / "in"), max_files=1), str(tmp_path / "c")))
    assert store.logs().count() == 6 and sum(r.cnt for r in store.tiers()["hour"].collect()) == 6
    assert [(r["index"], r.reason) for r in spark.read.parquet(f"{store.path}/rejected").collect()] == [(2, "timestamp is required")]


def test_days_are_pruned(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    store_batch(store, bodies(spark, [json.dumps({"logs": [entry(f"2026-03-0{d}T01:00:00Z") for d in range(1, 5)]})]), 0, NOW)
    found = keep(store.logs(), matches(store.logs(), Filters(since=parse_time("2026-03-03T00:00:00Z", "t"), service="auth")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in plan and "EqualTo(service,auth)" in plan
    assert found.count() == 2


def test_tiered_counts_are_raw_counts(spark):
    logs, r = fixtures.logs(spark, SMALL).cache(), random.Random(2)
    tiers = {k: t.cache() for k, t in tiers_of(logs).items()}
    low = parse_time("2024-01-01", "t")
    for _ in range(6):
        a = low + r.randrange(20 * DAY)
        spec = AggregateSpec(a, a + r.choice([r.randrange(MINUTE * 3), r.randrange(HOUR * 9), r.randrange(DAY * 9)]), r.choice(["1m", "5m", "1h", "1d"]), r.choice([None, "service", "level"]), Filters(service=r.choice([None, "auth"])))
        assert aggregate(logs, tiers, spec).collect() == from_rows(logs, spec).collect()
    logs.unpersist()


def test_walking_pages_is_one_sort(spark):
    for logs in (fixtures.order_logs(spark, SMALL), fixtures.logs(spark, SMALL)):
        logs = logs.cache()
        want = [r.id for r in logs.orderBy("timestamp", "id", ascending=False).limit(400).collect()]
        got, cursor = [], None
        while len(got) < 400:
            rows = page(logs, ListSpec(limit=100, cursor=cursor)).collect()
            got += [r.id for r in rows]
            cursor = Cursor(parse_time(rows[-1].timestamp.isoformat(), "t"), rows[-1].id)
        assert got == want
        logs.unpersist()


def test_ladder_is_the_whole_search(spark):
    logs = fixtures.logs(spark, SMALL)
    now = parse_time("2024-01-30T23:58:00", "now")
    for spec in (ListSpec(Filters(q="user"), 3), ListSpec(Filters(q="user"), 20), ListSpec(Filters(attributes={"k": "7"}), 50)):
        assert search(logs, spec, now).collect() == page(logs, spec).collect()
