"""The store's requests as calls: ingest, search, aggregate, ready."""

from __future__ import annotations

import json
import logging
import threading
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import BadRequest, Busy, TimedOut
from tidelog.functions.predicates import in_ranges, keep, key_hash
from tidelog.functions.timebins import utc_day
from tidelog.operators.aggregate import aggregate
from tidelog.operators.listing import held, in_steps, page
from tidelog.operators.validate import accepted, validate
from tidelog.plans.specs import ListSpec, parse_aggregate, parse_list
from tidelog.plans.windows import Window, windows, within_hours
from tidelog.sources.envelope import bodies, check_body, exploded
from tidelog.sources.intake import MOST_WAITING, Intake, Waiting
from tidelog.sources.responses import bucket_entry, list_entry
from tidelog.sources.store import CALLERS, LogStore, now_us

#: Seconds that a query may run, and between two rounds of upkeep.
QUERY_SECONDS, UPKEEP_SECONDS = 30.0, 300.0


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the jobs that this thread starts inside, those that it starts later too, once `seconds` are over, and raise TimedOut."""
    tag, over, ended = f"tidelog-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not ended.wait(wait):
            over.set()
            spark.sparkContext.cancelJobsWithTag(tag)
            wait = 0.1

    spark.sparkContext.setInterruptOnCancel(True)
    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise TimedOut(f"query ran longer than {seconds:g} s") from e
        raise
    finally:
        ended.set()
        spark.sparkContext.removeJobTag(tag)


class Engine:
    """Calls may come from any number of threads."""

    def __init__(self, spark: SparkSession, path: str, most_waiting: int = MOST_WAITING, query_seconds: float = QUERY_SECONDS, **intake):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.store, self.query_seconds = spark, LogStore(spark, path), query_seconds
        self.intake = Intake(self._store, most_waiting, **intake)
        self._upkeep: threading.Event | None = None

    def ready(self) -> bool:
        """Whether the store can be reached."""
        self.store.seen()
        return True

    # Ingest

    def ingest(self, body: str | bytes, now: int | None = None) -> dict:
        """Store one body's valid entries; answers after they are committed. Raises BadRequest for a
        wrong shape or, with the result as its `result`, when no entry is valid. Bodies that come together are stored as one batch."""
        logs = check_body(body)
        return self.intake.submit(body if isinstance(body, str) else body.decode(), len(logs), now)

    def _store(self, batch: list[Waiting]) -> list:
        """One answer for each body. What fails is run once more; the batch id makes that safe."""
        now = now_us() if batch[0].now is None else batch[0].now
        given = bodies(self.spark, [w.body for w in batch])
        checked = validate(exploded(given), now).drop("entry").persist()
        try:
            said = checked.groupBy("source").agg(F.count_if(F.col("reason").isNull()).alias("ok"), F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(F.col("pos").cast("long").alias("index"), "reason"))).alias("no"))
            found = {int(r["source"]): r for r in said.collect()}  # a body has MOST_ENTRIES at most
            results = [_result(w, found.get(i)) for i, w in enumerate(batch)]
            if any(r["accepted"] for r in results):
                mine, record = self.store.claim(CALLERS, now)
                try:
                    self.store.append(mine, accepted(checked), record)
                except Exception:
                    logging.getLogger(__name__).warning("batch %d is written again", mine, exc_info=True)
                    self.store.append(mine, accepted(checked), record)
        finally:
            checked.unpersist()
        return [r if r["accepted"] else _refused(r) for r in results]

    def drain(self) -> None:
        """Refuse further bodies and return when all that were taken are stored; upkeep ends too."""
        if self._upkeep:
            self._upkeep.set()
        self.intake.drain()

    # Queries

    def search(self, params: Mapping[str, object], now: int | None = None) -> dict:
        """A page. `now` is not needed: windows hang from the newest rows that there are."""
        spec = parse_list(params)
        with time_limit(self.spark, self.query_seconds):
            found = in_steps(self._page, spec, self._windows(spec))
        return {"logs": [list_entry(r) for r in found.rows], "next_cursor": found.next_cursor}

    def _page(self, spec: ListSpec, ranges: list[Window] | None) -> list[Row]:
        f = spec.filters
        logs = self.store.logs(utc_day(f.since), utc_day(f.until - 1))
        return held(page(keep(logs, in_ranges(logs, ranges)) if ranges else logs, spec)).collect()

    def _windows(self, spec: ListSpec) -> list[tuple[Window, list[Window] | None]]:
        """Steps by the days' sizes; where there are several and attributes are asked for, only hours in which the
        index has them all."""
        steps = windows(spec, self.store.sizes())
        if len(steps) < 2 or not spec.filters.attributes:
            return [(w, None) for w in steps]
        keys = self.store.keys(utc_day(steps[-1][0]), utc_day(steps[0][1] - 1))
        asked = [key_hash(F.lit(k), F.lit(v)) for k, v in spec.filters.attributes.items()]
        hours = keys.where(F.col("kv").isin(asked)).groupBy("bucket_start").agg(F.countDistinct("kv").alias("n"))
        return within_hours(steps, [r[0] for r in hours.where(F.col("n") == len(asked)).select(F.unix_micros("bucket_start")).collect()])

    def aggregate(self, params: Mapping[str, object]) -> dict:
        spec = parse_aggregate(params)
        days = utc_day(spec.since), utc_day(spec.until)
        with time_limit(self.spark, self.query_seconds):
            found = aggregate(self.store.logs(*days), self.store.tiers(*days), spec, ordered=False)
            rows = found.select(F.unix_micros("start").alias("start_us"), "group", "count").collect()
        rows.sort(key=lambda r: (r["start_us"], (r["group"] or "").encode()))  # 100,000 buckets at most; in code point order
        return {"buckets": [bucket_entry(r) for r in rows]}

    # Upkeep

    def keep_up(self, now: int | None = None) -> None:
        """One round: expire, join the batches of days that are over, fold markers. Skipped while another runs; faults are
        logged, since the next round tries again."""
        at = now_us() if now is None else now
        for step in (lambda: self.store.sweep(at), lambda: self.store.compact(utc_day(at) - timedelta(days=1)), self.store.fold):
            try:
                step()
            except Busy:
                return
            except Exception:
                logging.getLogger(__name__).exception("upkeep failed")

    def start_upkeep(self, every: float = UPKEEP_SECONDS) -> None:
        """Rounds of upkeep in a thread of their own, the first at once, until `drain`."""
        stop = self._upkeep = threading.Event()

        def run() -> None:
            while True:
                self.keep_up()
                if stop.wait(every):
                    return

        threading.Thread(target=run, daemon=True).start()


def _result(asked: Waiting, found: Row | None) -> dict:
    rejected = sorted((r.asDict() for r in found["no"]), key=lambda r: r["index"]) if found else []
    accepted = found["ok"] if found else 0
    if accepted + len(rejected) != asked.rows:
        raise RuntimeError(f"{asked.rows} entries were given and {accepted + len(rejected)} read")
    return {"accepted": accepted, "rejected": rejected}


def _refused(result: dict) -> BadRequest:
    error = BadRequest(json.dumps(result))
    error.result = result
    return error
