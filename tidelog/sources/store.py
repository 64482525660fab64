"""The log store: rows, two summaries and an attribute index as Parquet by day and batch, and markers for each batch.

    facts/day=…/batch_id=…   minute/…   hour/…   keys/…
    batches/<id>.begin.json   batches/<id>.ids.json   batches/<id>.done.json   batches/<id>.gone.json   ids/<n>.json

Every marker is created once and whole, and creating one that exists fails, so of many writers one gets a batch id and
one gets a range of row ids. A batch is written under its own id, each dataset replacing what an earlier
attempt left, and counts once its done marker is there; so a batch can be run again at any point. Its clock is recorded
before the first write and its first row id before rows are written, so that a replay decides and numbers alike. Summaries
are additive deltas; reading sums them.

Upkeep never changes what is there. A rewrite (compaction, rebuild) reads the directories of batches that were done
when it began, writes a batch of its own and names in its done marker, for each dataset and day, the batches that it
stands for: with that one file readers change from the old ones to the new. The old directories go after a grace period, so
queries that are running end undisturbed, and batches that commit meanwhile are not touched. One upkeep task
runs at a time. Markers that need not be told apart any more are folded into one record.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.errors import Busy
from tidelog.functions.timebins import bin_start, utc_date, utc_day
from tidelog.operators.rollup import hours_of, keys_of, minutes_of, summed
from tidelog.schema import DAY, KEYS, LOGS, TIER, stored
from tidelog.sources.files import Folder

DATASETS = {"facts": LOGS, "minute": TIER, "hour": TIER, "keys": KEYS}
TIMES = {"facts": "timestamp", "minute": "bucket_start", "hour": "bucket_start", "keys": "bucket_start"}
#: Batch ids: of streams below, of rewrites from here on, of direct callers from there on. A stream has 2^32 ids.
REWRITES, CALLERS, STREAM = 1 << 40, 1 << 41, 1 << 32
RETENTION_DAYS = 30
#: Rows that a file of a batch and day holds, about.
FILE_ROWS = 1 << 20
#: Entries of the chain of row ids that stay, and done batches that stay unfolded.
CHAIN, UNFOLDED = 256, 64
#: Seconds that replaced directories stay for running queries, and after which a lock counts as left behind.
GRACE, LOCKED = 900, 6 * 3600


def now_us() -> int:
    return time.time_ns() // 1000


def day_name(day: date) -> str:
    """The directory label of a day, which sorts as days do."""
    return f"day={day.isoformat()}"


@dataclass
class Seen:
    """The markers at one moment: what has begun and what is done, and for each dataset and day what is replaced."""

    begun: set[int] = field(default_factory=set)
    done: set[int] = field(default_factory=set)
    gone: set[int] = field(default_factory=set)
    folded: dict = field(default_factory=lambda: {"floors": {}, "open": [], "version": -1})
    replaced: dict[str, dict[date, set[int]]] = field(default_factory=dict)

    def _floor(self, b: int) -> int:
        return self.folded["floors"].get(str(_kind(b)), 0)

    def committed(self, b: int) -> bool:
        return b in self.done or (b < self._floor(b) and b not in self.folded["open"])

    def open(self) -> list[int]:
        return sorted(b for b in self.begun | set(self.folded["open"]) if not self.committed(b))

    def visible(self, name: str, day: date, b: int) -> bool:
        return self.committed(b) and b not in self.replaced.get(name, {}).get(day, ())


def _kind(b: int) -> int:
    return CALLERS if b >= CALLERS else REWRITES if b >= REWRITES else b // STREAM * STREAM


class LogStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    # Batches

    def seen(self) -> Seen:
        """All markers by one listing; only the records of rewrites whose old directories still stand are read."""
        out, versions = Seen(), []
        for n in self.folder.names("batches"):
            head, kind, *_ = n.split(".")
            if n.endswith(".json") and kind in ("begin", "done", "gone"):
                getattr(out, {"begin": "begun"}.get(kind, kind)).add(int(head))
            elif n.endswith(".json") and head.startswith("state-"):
                versions.append(int(head.removeprefix("state-")))
        if versions:
            out.folded = self.folder.read(f"batches/state-{max(versions)}.json") | {"version": max(versions)}
        for b in sorted(x for x in out.done - out.gone if _kind(x) == REWRITES):
            for name, days in self.folder.read(f"batches/{b}.done.json")["replaces"].items():
                for d, ids in days.items():
                    out.replaced.setdefault(name, {}).setdefault(date.fromisoformat(d), set()).update(ids)
        return out

    def batches(self) -> list[int]:
        """Committed batches that are not folded."""
        return sorted(self.seen().done)

    def begin(self, batch_id: int, now: int | None = None) -> dict:
        """The batch's record: as an earlier attempt left it, or a new one."""
        name = f"batches/{batch_id}.begin.json"
        if not self.folder.exists(name):
            self.folder.create(name, {"now": now_us() if now is None else now})
        return self.folder.read(name)

    def claim(self, kind: int, now: int | None = None) -> tuple[int, dict]:
        """A batch id that no other writer has, and its record."""
        seen = self.seen()
        b = max([kind, seen.folded["floors"].get(str(kind), 0), *(x + 1 for x in seen.begun | seen.done if _kind(x) == kind)])
        record = {"now": now_us() if now is None else now}
        while not self.folder.create(f"batches/{b}.begin.json", record):
            b += 1
        return b, record

    def reserve(self, batch_id: int, n: int) -> int:
        """The first of `n` row ids that only this batch has; a replay gets the ones it had. Ids follow each other without a gap, unless
        a writer ends between its two markers."""
        own = f"batches/{batch_id}.ids.json"
        if self.folder.exists(own):
            return self.folder.read(own)["first_id"]
        while True:
            chain = self._chain()
            last = chain[-1] if chain else -1
            first = self.folder.read(f"ids/{last}.json")["next_id"] if chain else 1
            if not self.folder.create(f"ids/{last + 1}.json", {"batch": batch_id, "next_id": first + n}):
                continue
            chain = self._chain()
            if chain[-1] - (last + 1) >= CHAIN:  # read before a long halt: its successors may be gone
                self.folder.delete(f"ids/{last + 1}.json")
                continue
            for old in [i for i in chain if i < last + 1 - 2 * CHAIN]:
                self.folder.delete(f"ids/{old}.json")
            self.folder.create(own, {"first_id": first})
            return first

    def _chain(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("ids") if n.count(".") == 1)

    def append(self, batch_id: int, rows: DataFrame, record: dict, order: tuple[str, str] = ("source", "pos")) -> dict:
        """Write validated rows as one batch; the same batch again leaves what is there.

        Ids follow (source, position): dense within a source, sources one after the other by
        their counts, so numbering needs no task that sees all rows. `rows` are read several times; persist them where that is dear."""
        done = f"batches/{batch_id}.done.json"
        if self.folder.exists(done):
            return self.folder.read(done)
        if self.seen().committed(batch_id):
            return {"days": [], "folded": True}
        sizes = {r.day: r.n for r in rows.groupBy(utc_date(F.col("timestamp")).alias("day")).agg(F.count("*").alias("n")).collect()}
        n = sum(sizes.values())
        source, pos = order
        counts = rows.groupBy(source).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1))
        starts = counts.select(source, F.coalesce(before, F.lit(0)).alias("before"))
        within = F.row_number().over(Window.partitionBy(source).orderBy(pos))
        facts = rows.withColumn("n", within).join(starts, source).withColumn("id", F.lit(self.reserve(batch_id, n) - 1) + F.col("before") + F.col("n"))
        minutes = minutes_of(rows)
        self._write_all({"facts": facts.select(*LOGS.names), "minute": minutes, "hour": hours_of(minutes), "keys": keys_of(rows)}, batch_id, sizes)
        self.folder.create(done, {"rows": n, "days": sorted(map(str, sizes))})
        return self.folder.read(done)

    def _write_all(self, parts: dict[str, DataFrame], batch_id: int, sizes: dict[date, int]) -> None:
        """The datasets side by side: they are independent, and small batches leave most cores idle."""
        with ThreadPoolExecutor(len(parts)) as pool:
            for f in [pool.submit(self._write, name, batch_id, rows, sizes) for name, rows in parts.items()]:
                f.result()

    def _write(self, name: str, batch_id: int, rows: DataFrame, sizes: dict[date, int]) -> None:
        """A day of rows is dealt to as many files as its count asks for, each in the order that reading prunes by."""
        when = TIMES[name]
        rows = rows.withColumn("day", utc_date(F.col(when))).withColumn("batch_id", F.lit(batch_id).cast("long"))
        order = {"facts": ["day", F.desc(when), F.desc("id")], "keys": ["day", "kv", when]}.get(name, ["day", when])
        if name in ("facts", "keys"):
            deal = F.lit(0)
            for d, n in sizes.items():
                if n > FILE_ROWS:
                    deal = F.when(F.col("day") == F.lit(d), F.pmod(F.xxhash64("id" if name == "facts" else "kv"), F.lit(-(-n // FILE_ROWS)))).otherwise(deal)
            dealt = rows.repartition("day", deal)
        else:
            dealt = rows.repartition("day")
        writer = dealt.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if name == "keys":
            writer = writer.option("parquet.bloom.filter.enabled#kv", "true")
        writer.partitionBy("day", "batch_id").parquet(f"{self.path}/{name}")

    # Reading

    def _load(self, name: str, paths: list[str]) -> DataFrame:
        schema = stored(DATASETS[name])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/{p}" for p in paths))

    def _seen(self, name: str, low: date | None = None, high: date | None = None) -> DataFrame:
        """Committed rows that nothing replaces, of days from `low` to `high`: no other day is even listed."""
        seen, days = self.seen(), [d for d in sorted(self.days(name)) if (low is None or d >= low) and (high is None or d <= high)]
        rows = self._load(name, [day_name(d) for d in days])
        if open_ := seen.open():
            rows = rows.where(~F.col("batch_id").isin(open_))
        alike: dict[frozenset[int], list[date]] = {}
        for d in days:
            if ids := seen.replaced.get(name, {}).get(d):
                alike.setdefault(frozenset(ids), []).append(d)
        for ids, on in alike.items():
            rows = rows.where(~(F.col("day").isin(on) & F.col("batch_id").isin(sorted(ids))))
        return rows

    def logs(self, low: date | None = None, high: date | None = None) -> DataFrame:
        """All committed rows, with `day` for pruning."""
        return self._seen("facts", low, high)

    def tiers(self, low: date | None = None, high: date | None = None) -> dict[str, DataFrame]:
        """Summaries by name; deltas, so count with sum(cnt)."""
        return {name: self._seen(name, low, high) for name in ("minute", "hour")}

    def keys(self, low: date | None = None, high: date | None = None) -> DataFrame:
        """The attribute index: (kv, bucket_start, cnt) by hour, deltas."""
        return self._seen("keys", low, high)

    def days(self, name: str = "facts") -> set[date]:
        """Days that have a directory."""
        return {date.fromisoformat(n.removeprefix("day=")) for n in self.folder.names(name) if n.startswith("day=")}

    def sizes(self) -> dict[date, int]:
        """Bytes of rows by day."""
        return {d: self.folder.size(f"facts/{day_name(d)}") for d in self.days()}

    # Upkeep

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """Hold the store's one upkeep lock, or raise Busy."""
        name, mine = "upkeep.json", {"at": now_us(), "by": uuid.uuid4().hex}
        if not self.folder.create(name, mine):
            if self.folder.read(name)["at"] > now_us() - LOCKED * 1_000_000:
                raise Busy("upkeep of this store is running")
            self.folder.delete(name)
            if not self.folder.create(name, mine):
                raise Busy("upkeep of this store is running")
        try:
            yield
        finally:
            self.folder.delete(name)

    def _held(self, name: str, day: date, seen: Seen) -> list[int]:
        found = (int(n.removeprefix("batch_id=")) for n in self.folder.names(f"{name}/{day_name(day)}") if n.startswith("batch_id="))
        return sorted(b for b in found if seen.visible(name, day, b))

    def _of(self, name: str, replaces: dict[date, list[int]]) -> DataFrame:
        return self._load(name, [f"{day_name(d)}/batch_id={b}" for d, ids in replaces.items() for b in ids])

    def _rewrite(self, parts: dict[str, DataFrame], replaces: dict[str, dict[date, list[int]]], sizes: dict[date, int], grace: float) -> int:
        batch, _ = self.claim(REWRITES)
        self._write_all(parts, batch, sizes)
        said = {name: {str(d): ids for d, ids in days.items() if ids} for name, days in replaces.items()}
        self.folder.create(f"batches/{batch}.done.json", {"replaces": said, "at": now_us()})
        self._clean(grace)
        return batch

    def compact(self, before: date, grace: float = GRACE) -> int | None:
        """Write the batches of each day earlier than `before` as one; None if there is nothing to join."""
        with self._alone():
            seen = self.seen()
            days = [d for d in sorted(self.days()) if d < before and len(self._held("facts", d, seen)) > 1]
            if not days:
                self._clean(grace)
                return None
            old = {name: {d: self._held(name, d, seen) for d in days} for name in DATASETS}
            facts = self._of("facts", old["facts"])
            sizes = {r.day: r.n for r in facts.groupBy("day").agg(F.count("*").alias("n")).collect()}
            parts = {"facts": facts.select(*LOGS.names)} | {name: summed(self._of(name, old[name])) for name in ("minute", "hour")}
            parts["keys"] = summed(self._of("keys", old["keys"]), KEYS.names[:-1])
            return self._rewrite(parts, old, sizes, grace)

    def rebuild(self, grace: float = GRACE) -> int | None:
        """Both summaries and the index anew from the rows; None if there are none."""
        with self._alone():
            seen = self.seen()
            facts_of = {d: ids for d in sorted(self.days()) if (ids := self._held("facts", d, seen))}
            if not facts_of:
                return None
            facts = self._of("facts", facts_of)
            sizes = {r.day: r.n for r in facts.groupBy("day").agg(F.count("*").alias("n")).collect()}
            # Only batches whose rows were read are replaced: one that commits meanwhile keeps its own deltas.
            old = {name: {d: self._held(name, d, seen) for d in self.days(name)} for name in ("minute", "hour", "keys")}
            minutes = minutes_of(facts)
            return self._rewrite({"minute": minutes, "hour": hours_of(minutes), "keys": keys_of(facts)}, old, sizes, grace)

    def _clean(self, grace: float) -> None:
        """Delete the directories that rewrites older than `grace` seconds stand for; then the marker says so."""
        seen = self.seen()
        for b in sorted(x for x in seen.done - seen.gone if _kind(x) == REWRITES):
            held = self.folder.read(f"batches/{b}.done.json")
            if held["at"] > now_us() - grace * 1_000_000:
                continue
            for name, days in held["replaces"].items():
                for d, ids in days.items():
                    for old in ids:
                        self.folder.delete(f"{name}/day={d}/batch_id={old}")
            self.folder.create(f"batches/{b}.gone.json", {"at": now_us()})

    def fold(self, unfolded: int = UNFOLDED) -> int:
        """Replace the markers of all but the newest batches of each kind by one record of what is still open, so that
        listings stay short however many batches there were. The number of files that went."""
        with self._alone():
            seen, gone = self.seen(), 0
            floors = dict(seen.folded["floors"])
            for kind in {_kind(b) for b in seen.begun}:
                known = sorted(b for b in seen.begun if _kind(b) == kind)
                pending = [b for b in known if kind == REWRITES and b in seen.done and b not in seen.gone]
                if known[:-unfolded]:
                    floors[str(kind)] = max(floors.get(str(kind), 0), min([known[-unfolded], *pending]))
            open_ = [b for b in seen.open() if b < floors.get(str(_kind(b)), 0)]
            version = seen.folded["version"] + 1
            if floors == seen.folded["floors"] or not self.folder.create(f"batches/state-{version}.json", {"floors": floors, "open": open_}):
                return 0
            for n in self.folder.names("batches"):
                head, *_ = n.split(".")
                if n == f"state-{version - 1}.json" or head.isdigit() and int(head) < floors.get(str(_kind(int(head))), 0) and int(head) not in open_:
                    self.folder.delete(f"batches/{n}")
                    gone += 1
            return gone

    def sweep(self, now: int | None = None, keep_days: int = RETENTION_DAYS) -> list[date]:
        """Drop days that ended `keep_days` or more ago, the same ones from all datasets."""
        cutoff = (now_us() if now is None else now) - keep_days * DAY
        with self._alone():
            gone = sorted(d for d in self.days() if d + timedelta(days=1) <= utc_day(cutoff))
            for name in reversed(DATASETS):
                for d in gone:
                    self.folder.delete(f"{name}/{day_name(d)}")
            return gone
