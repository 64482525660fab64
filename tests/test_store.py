"""The store under many writers, upkeep beside them, and crashes at every step."""

import json
import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelog.engine import Engine, time_limit
from tidelog.errors import BadRequest, Busy, Overloaded, TimedOut, response
from tidelog.operators.listing import page
from tidelog.plans import windows as steps
from tidelog.plans.cursor import Cursor
from tidelog.plans.specs import Filters, ListSpec, parse_list, parse_time
from tidelog.schema import DAY, HOUR
from tidelog.sources.envelope import bodies
from tidelog.sources.files import Folder
from tidelog.sources.intake import Intake
from tidelog.sources.store import CALLERS, REWRITES, LogStore
from tidelog.streaming.ingest import store_batch

NOW = parse_time("2025-05-20T00:00:00Z", "now")


def entries(n, day=3, service="api", **attributes):
    return [{"timestamp": f"2025-05-{day:02d}T{i % 24:02d}:{i % 60:02d}:07.5Z", "level": "warn", "service": service, "message": f"row {i}", "attributes": attributes | {"i": i}} for i in range(n)]


def body(*parts):
    return json.dumps({"logs": [e for p in parts for e in p]})


def counts(store):
    return {name: sorted(map(tuple, t.groupBy("bucket_start", "service", "level").agg(F.sum("cnt")).collect())) for name, t in store.tiers().items()}


def pairs(store):
    return sorted(map(tuple, store.keys().groupBy("kv", "bucket_start").agg(F.sum("cnt")).collect()))


def test_create_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: folder.create("a/one.json", {"by": i}), range(24)))
    assert sum(won) == 1 and folder.read("a/one.json") == {"by": won.index(True)}
    assert folder.names("a") == ["one.json"] and folder.names("none") == []


@pytest.mark.parametrize("linger", [0.0, 0.2])
def test_callers_beside_each_other(spark, tmp_path, linger):
    engine = Engine(spark, str(tmp_path), linger=linger)
    with ThreadPoolExecutor(6) as pool:
        results = list(pool.map(lambda i: engine.ingest(body(entries(10, 1 + i % 3, f"s{i}"), [{}]), NOW), range(6)))
    assert results == [{"accepted": 10, "rejected": [{"index": 10, "reason": "timestamp is required"}]}] * 6
    rows = engine.store.logs().collect()
    assert sorted(r.id for r in rows) == list(range(1, 61))
    assert {(r.service, r.message) for r in rows} == {(f"s{i}", f"row {k}") for i in range(6) for k in range(10)}
    assert sum(r.cnt for r in engine.store.tiers()["hour"].collect()) == 60
    batches = engine.store.batches()
    assert all(b >= CALLERS for b in batches) and (len(batches) < 6 if linger else len(batches) <= 6)


def test_stores_of_several_programs(spark, tmp_path):
    """Writers that share nothing but the folder."""
    engines = [Engine(spark, str(tmp_path), writers=1) for _ in range(3)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: engines[i % 3].ingest(body(entries(5, 2, f"s{i}")), NOW), range(6)))
        list(pool.map(lambda i: store_batch(engines[i].store, bodies(spark, [body(entries(4, 2, f"t{i}"))]), i, NOW), range(2)))
    assert sorted(r.id for r in engines[0].store.logs().collect()) == list(range(1, 39))


def test_one_refused_caller_harms_no_other(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), linger=0.3)

    def ask(text):
        try:
            return engine.ingest(text, NOW)
        except BadRequest as e:
            return e.result

    with ThreadPoolExecutor(3) as pool:
        good, bad, more = pool.map(ask, [body(entries(3)), body([{}, 4]), body(entries(2))])
    assert (good["accepted"], bad["accepted"], more["accepted"]) == (3, 0, 2) and [r["index"] for r in bad["rejected"]] == [0, 1]
    assert engine.store.logs().count() == 5


def test_intake_bounds_and_drains():
    started, go, sizes = threading.Event(), threading.Event(), []

    def write(batch):
        started.set()
        go.wait(10)
        sizes.append([w.rows for w in batch])
        return [w.body for w in batch]

    intake = Intake(write, most_waiting=20, batch_rows=6, linger=0.01, writers=1)
    with ThreadPoolExecutor(8) as pool:
        first = pool.submit(intake.submit, "a", 9)
        assert started.wait(5)
        rest = []
        for name, n in (("b", 3), ("c", 3), ("d", 5)):
            rest.append(pool.submit(intake.submit, name, n))
            time.sleep(0.05)
        with pytest.raises(Overloaded):
            intake.submit("e", 1)
        go.set()
        intake.drain()
        assert first.result() == "a" and [r.result() for r in rest] == ["b", "c", "d"] and sizes == [[9], [3, 3], [5]]
    with pytest.raises(Overloaded):
        intake.submit("f", 1)


def test_a_failing_write_is_run_again(spark, tmp_path, monkeypatch):
    engine, plain, calls = Engine(spark, str(tmp_path)), LogStore._write, []

    def weak(self, name, *args):
        calls.append(name)
        if len(calls) == 3:
            raise OSError("disk")
        return plain(self, name, *args)

    monkeypatch.setattr(LogStore, "_write", weak)
    assert engine.ingest(body(entries(4)), NOW)["accepted"] == 4
    assert sorted(r.id for r in engine.store.logs().collect()) == [1, 2, 3, 4] and len(engine.store.batches()) == 1
    monkeypatch.setattr(LogStore, "_write", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.ingest(body(entries(4)), NOW)
    monkeypatch.setattr(LogStore, "_write", plain)
    assert engine.ingest(body(entries(2)), NOW)["accepted"] == 2 and engine.store.logs().count() == 6


@pytest.fixture
def filled(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    for i in range(3):
        store_batch(store, bodies(spark, [body(entries(30, 3, f"s{i}", k=i), entries(5, 4 + i, "x"))]), i, NOW)
    return store


def state(store):
    return sorted((r.id, r.service, r.message) for r in store.logs().collect()), counts(store), pairs(store)


@pytest.mark.parametrize("upkeep", ["compact", "rebuild"])
def test_a_batch_that_commits_during_upkeep(spark, filled, monkeypatch, upkeep):
    """Its files are written before the rewrite reads and its marker comes after; or the whole batch comes in between."""
    late, plain_create = [], Folder.create
    plain_write = LogStore._write_all

    def beside(self, parts, batch_id, sizes):
        if batch_id >= REWRITES and batch_id < CALLERS:
            late.append(store_batch(LogStore(spark, self.path), bodies(spark, [body(entries(7, 3, "late"))]), 8, NOW))
        plain_write(self, parts, batch_id, sizes)

    def hold(self, name, value):
        return name == "batches/7.done.json" or plain_create(self, name, value)

    monkeypatch.setattr(Folder, "create", hold)
    monkeypatch.setattr(Folder, "read", lambda self, name, read=Folder.read: {} if name == "batches/7.done.json" else read(self, name))
    store_batch(filled, bodies(spark, [body(entries(5, 3, "slow"))]), 7, NOW)
    monkeypatch.setattr(LogStore, "_write_all", beside)
    run = (lambda: filled.compact(date(2025, 5, 10), grace=0)) if upkeep == "compact" else lambda: filled.rebuild(grace=0)
    assert run() is not None and len(late) == 1
    assert filled.logs().count() == 105 + 7
    monkeypatch.setattr(Folder, "create", plain_create)
    filled.folder.create("batches/7.done.json", {"rows": 5, "days": ["2025-05-03"]})
    rows, tiers, keys = state(filled)
    assert len(rows) == 117 == len({r[0] for r in rows})
    assert sum(r[3] for r in tiers["minute"]) == sum(r[3] for r in tiers["hour"]) == 117
    filled.rebuild(grace=0)
    assert state(filled) == (rows, tiers, keys)


@pytest.mark.parametrize("upkeep", ["compact", "rebuild"])
def test_upkeep_ends_at_any_step(filled, monkeypatch, upkeep):
    """Every file operation of upkeep fails once; what readers see stays, and the next round finishes."""
    want = state(filled)
    run = (lambda: filled.compact(date(2025, 5, 10), grace=0)) if upkeep == "compact" else lambda: filled.rebuild(grace=0)
    plain = {"create": Folder.create, "delete": Folder.delete, "write": LogStore._write}
    for what, at in [("write", 0), ("write", 2), ("create", 1), ("create", 2), ("delete", 0), ("delete", 1), ("create", 3)]:
        seen = []

        def weak(self, *args, what=what, at=at):
            if what != "delete" or "batch_id=" in args[0]:
                seen.append(args)
                if len(seen) == at + 1:
                    raise OSError("crash")
            return plain[what](self, *args)

        owner = LogStore if what == "write" else Folder
        monkeypatch.setattr(owner, "_write" if what == "write" else what, weak)
        try:
            run()
        except OSError:
            pass
        monkeypatch.setattr(owner, "_write" if what == "write" else what, plain[what])
        assert state(filled) == want, (what, at)
    run()
    assert state(filled) == want and not filled.seen().replaced


def test_replaced_rows_stay_for_running_queries(filled):
    want, before = state(filled), filled.logs()
    assert filled.compact(date(2025, 5, 10)) is not None
    assert before.count() == 105 and state(filled) == want
    assert filled.compact(date(2025, 5, 10), grace=0) is None
    assert state(filled) == want and len(filled.folder.names("facts/day=2025-05-03")) == 1


def test_upkeep_runs_alone(filled):
    with filled._alone():
        for task in (filled.sweep, filled.rebuild, filled.fold, lambda: filled.compact(date(2025, 5, 10))):
            with pytest.raises(Busy):
                task()
    assert filled.sweep(NOW) == [] and response(Busy("x"))[0] == 409


def test_folded_markers(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    for i in range(6):
        store_batch(store, bodies(spark, [body(entries(2, 1 + i % 2, f"s{i}"))]), i, NOW)
    store.folder.delete("batches/1.done.json")
    want = state(store)
    assert store.fold(2) > 0 and store.fold(2) == 0
    assert state(store) == want and store.batches() == [4, 5]
    store_batch(store, bodies(spark, [body(entries(2))]), 0, NOW)  # folded: it changes nothing
    assert state(store) == want
    store_batch(store, bodies(spark, [body(entries(2, 2, "s1"))]), 1, NOW)  # still open: it ends now
    store_batch(store, bodies(spark, [body(entries(2))]), 6, NOW)
    assert sorted(r.id for r in store.logs().collect()) == list(range(1, 15))
    for i in range(7, 9):
        store_batch(store, bodies(spark, [body(entries(2))]), i, NOW)
    want = state(store)
    assert store.fold(2) > 0 and state(store) == want and store.claim(0, NOW)[0] == 9


def test_rounds_of_upkeep(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    for day in (3, 3, 18):
        engine.ingest(body(entries(4, day)), NOW)
    engine.start_upkeep(every=0.05)
    end = time.time() + 60
    while time.time() < end and len(engine.store.seen().done) < 4:
        time.sleep(0.1)
    engine.drain()
    engine.keep_up(NOW + 40 * DAY)
    assert engine.store.days() == set()


def test_row_ids_of_stalled_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidelog.sources.store.CHAIN", 3)
    store, plain = LogStore(spark, str(tmp_path)), Folder.create
    for b in range(12):
        assert store.reserve(b, 5) == 1 + 5 * b == store.reserve(b, 5)
    assert len(store._chain()) <= 7
    monkeypatch.setattr(LogStore, "_chain", lambda self, n=iter([[2], [2, 3, 11]]), real=LogStore._chain: next(n, None) or real(self))
    store.folder.create("ids/2.json", {"next_id": 16})
    assert store.reserve(99, 5) == 61 and not store.folder.exists("ids/3.json")


def test_no_longer_than_it_may(spark):
    slow = spark.range(0, 4000, 1, 4).selectExpr("id", "java_method('java.lang.Thread', 'sleep', id % 7 + 10) AS x")
    began = time.time()
    with pytest.raises(TimedOut) as e, time_limit(spark, 0.5):
        slow.write.format("noop").mode("overwrite").save()
    assert time.time() - began < 8
    assert response(e.value)[0] == 500
    with time_limit(spark, 60):
        assert spark.range(5).count() == 5


# Pages in steps


def test_windows_cover_what_is_asked():
    r = random.Random(4)
    days = [date(2025, 5, d) for d in range(1, 29)]
    for _ in range(400):
        sizes = {d: r.choice([0, 1, 50, 400, 9_000]) for d in r.sample(days, r.randrange(1, 20))}
        low, high = sorted(steps.day_start(date(2025, 4, 25)) + r.randrange(40 * DAY) for _ in range(2))
        f = Filters(since=r.choice([None, low]), until=r.choice([None, high]))
        spec = ListSpec(f, 10, r.choice([None, Cursor(low + r.randrange(HOUR), 4)]))
        found = steps.windows(spec, sizes, first=100, growth=4)
        assert all(x[0] == y[1] for x, y in zip(found, found[1:]))
        top = [t for t in (f.until, spec.cursor and spec.cursor.time + 1) if t is not None]
        for d in sizes:
            for t in (steps.day_start(d), steps.day_start(d) + r.randrange(DAY), steps.day_start(d) + DAY - 1):
                wanted = (f.since is None or t >= f.since) and (not top or t < min(top))
                assert wanted == any(a <= t < b for a, b in found) or not wanted
    assert steps.windows(ListSpec(), {d: 10 for d in days}, first=1000) == [(steps.day_start(days[0]), steps.day_start(days[-1]) + DAY)]
    assert len(steps.windows(ListSpec(), {d: 10**6 for d in days}, first=10**4, growth=8)) < 12
    assert steps.windows(ListSpec(), {}) == []
    hours = [steps.day_start(days[0]) + h * HOUR for h in (1, 2, 5)]
    first, last = (hours[0] + 7, hours[1] + HOUR), (hours[2], hours[2] + 9)
    assert steps.within_hours([(hours[2] + HOUR, hours[2] + DAY), (hours[0] + 7, hours[2] + 9)], hours) == [((hours[0] + 7, hours[2] + 9), [first, last])]


@pytest.mark.parametrize(("first", "ranges"), [(1, 100), (3000, 2), (1 << 30, 100)])
def test_search_in_steps_is_the_whole_search(spark, tmp_path, monkeypatch, first, ranges):
    monkeypatch.setattr("tidelog.functions.predicates.MOST_RANGES", ranges)
    monkeypatch.setattr("tidelog.engine.windows", lambda spec, sizes: steps.windows(spec, sizes, first, 3))
    engine = Engine(spark, str(tmp_path))
    for day in (2, 9, 10):
        engine.ingest(body(entries(40, day, f"s{day}", region="north" if day == 9 else "south")), NOW)
    logs = engine.store.logs()
    for params in ({"limit": "7"}, {"limit": "50"}, {"attr.region": "north", "limit": "60"}, {"attr.region": "north", "attr.i": "3"}, {"attr.region": "east"}, {"q": "ROW 3", "limit": "5"}, {"since": "2025-05-09T03:00:00Z", "until": "2025-05-10T04:04:07.5Z", "service": "s9"}, {"until": "0001-01-01T00:30:00Z", "q": "x"}, {"since": "2025-05-09", "until": "2025-05-09"}):
        want = [str(r.id) for r in page(logs, parse_list(params)).collect()]
        found = engine.search(params)
        assert [r["id"] for r in found["logs"]] == want
        assert (found["next_cursor"] is None) == (len(want) < int(params.get("limit", 100)))
    got, cursor = [], None
    while True:
        found = engine.search({"limit": "33"} | ({"cursor": cursor} if cursor else {}))
        got += [int(r["id"]) for r in found["logs"]]
        if not (cursor := found["next_cursor"]):
            break
    assert got == [r.id for r in logs.orderBy("timestamp", "id", ascending=False).collect()]


def test_files_by_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidelog.sources.store.FILE_ROWS", 10)
    store = LogStore(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join files that are this small
    try:
        store_batch(store, bodies(spark, [body(entries(90, 3), entries(4, 4))]), 0, NOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lambda d: len([n for n in store.folder.names(f"facts/day=2025-05-{d}/batch_id=0") if n.endswith("parquet")])
    assert files("04") == 1 < files("03") <= 9 and store.logs().count() == 94
