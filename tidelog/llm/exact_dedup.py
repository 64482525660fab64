"""Exact deduplication with an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import dropped, given_rows, keep_rows, lookup, numbered, spare, stored

#: Deleted before texts are compared: the characters of [\x20\x09-\x0D].
BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of text that a task holds while it collapses copies.
HELD = 32 << 20
#: Leaves of the directory, at most but for chains.
LEAVES = 1 << 16


@dataclass(frozen=True)
class Leaf:
    """A bucket: the keys whose top `depth` bits are `prefix`."""

    prefix: int
    depth: int
    entries: int
    chain: bool = False

    @property
    def low(self) -> int:
        return self.prefix << (64 - self.depth)


class Directory:
    """Leaves in key order. A bucket is a range of keys; its number is its place."""

    def __init__(self, leaves: list[Leaf]):
        self.leaves = sorted(leaves, key=lambda x: x.low)
        self.lows = np.array([x.low for x in self.leaves], np.uint64)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, keys, "right") - 1

    def owner(self, key: int) -> Leaf:
        return self.leaves[bisect_right(self.lows.tolist(), key) - 1]


def _prefix(depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.expr(f"shiftrightunsigned(key, {64 - depth})")


def directory(entries: DataFrame, total: int, capacity: int) -> Directory:
    """Starts as deep as even hashes need and doubles wherever a bucket is overfull, by counts of
    key prefixes. A bucket of one key can't be split and becomes a chain. `capacity` rises with
    the table so that the driver holds about LEAVES leaves."""
    capacity = max(capacity, total // LEAVES)
    depth = max(0, (max(1, total) // capacity).bit_length())
    counted = entries.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
    found = {r.p: r for r in counted.collect()}
    leaves = [Leaf(p, depth, found[p].n if p in found else 0) for p in range(1 << depth)]
    while over := [x for x in leaves if x.entries > capacity and not x.chain]:
        leaves = [x for x in leaves if x not in set(over)]
        split = [x for x in over if found[x.prefix].a != found[x.prefix].b and x.depth < 64]
        leaves += [Leaf(x.prefix, x.depth, x.entries, True) for x in over if x not in split]
        if not split:
            break
        inside = entries.where(_prefix(depth).isin([x.prefix for x in split]))
        depth += 1
        found = {r.p: r for r in inside.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()}
        leaves += [Leaf(p, depth, found[p].n if p in found else 0) for x in split for p in (x.prefix * 2, x.prefix * 2 + 1)]
    return Directory(leaves)


def normal(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANK)


def _hash(norm: bytes) -> int:
    return xxhash.xxh3_64_intdigest(norm)


def _signed(keys) -> pa.Array:
    return pa.array(np.array(keys, np.uint64).view(np.int64))


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, key, row): more code points, then the smaller key (null last), then the earlier row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    return min(a, b, key=rank)


def exact_dedup(docs: DataFrame, capacity: int = 4096, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Rows (row, key, keep_id, group_size, kept, text_sha256), one per row of `docs`.

    Texts are equal when they are byte for byte after deleting BLANK; of equal ones the row with
    the most code points, then the smallest key, then the earliest row stays.

    1. Index entries (row, key, 64-bit hash, SHA-256, code points), without texts, go to a
       shared file. 2. The directory is grown from counts of the prefixes of distinct hashes. 3. Each task
       collapses the copies that it reads, so a group that holds a third of all rows costs one row per task,
       and sends the texts to the owner of their bucket, which reads its key range in order, chains
       the texts of equal hash and compares bytes. 4. Entries get their group's result; groups
       with over a thousandth of the rows are broadcast, the others joined by hash.

    A null text counts as empty, and all empty texts are equal. Ties go as above; of repeated
    rows exactly one is kept. Null keys come after all others. An empty table gives an empty
    one; other columns are not read. `row` is the number in the column of that name, or else one
    that is given here; both steps that read texts read them with the stored numbers."""
    given = given_rows(docs, row, F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            norms = [normal(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), _signed([_hash(x) for x in norms]), pa.array([hashlib.sha256(x).digest() for x in norms], pa.binary()), pa.array([len(t or "") for t in texts], pa.int64())], ["row", "id", "key", "sha", "n_chars"]
            )

    entries = stored(given.mapInArrow(enter, f"row long, id {kind}, key long, sha binary, n_chars long"), "index")
    total = entries.count()
    keys = stored(entries.select("key").distinct(), "keys")  # copies collapse before buckets see them, so a large group is one entry
    index = directory(keys, keys.count(), capacity)
    dropped(keys)
    shape = f"bucket int, key long, norm binary, n long, n_chars long, id {kind}, row long"

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held, arrow = 0, None

        def flush() -> pa.RecordBatch:
            norms = list(seen)
            keys = np.array([_hash(x) for x in norms], np.uint64)
            best = [v[1] for v in seen.values()]
            arrays = [pa.array(index.bucket(keys), pa.int32()), _signed(keys), pa.array(norms, pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64())]
            arrays += [pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], arrow), pa.array([b[2] for b in best], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "key", "norm", "n", "n_chars", "id", "row"])

        for b in batches:
            arrow = b.column(1).type
            for row, name, t in zip(*(c.to_pylist() for c in b.columns)):
                norm, this = normal(t), (len(t or ""), name, row)
                if old := seen.get(norm):
                    old[0] += 1
                    old[1] = _better(old[1], this)
                else:
                    seen[norm] = [1, this]
                    held += len(norm)
                if held > HELD:
                    yield flush()
                    held = 0
        if seen:
            yield flush()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain, arrow = None, [], None

        def groups(chain: list[list], out: list[tuple]) -> None:
            out.extend((at, hashlib.sha256(norm).digest(), best[1], best[2], n) for norm, n, best in chain)

        for b in batches:
            arrow, out = b.column(5).type, []
            for _, k, norm, n, n_chars, name, row in zip(*(c.to_pylist() for c in b.columns)):
                if k != at:
                    groups(chain, out)
                    at, chain = k, []
                this = (n_chars, name, row)
                for link in chain:
                    if link[0] == norm:  # bytes, not hashes, decide
                        link[1] += n
                        link[2] = _better(link[2], this)
                        break
                else:
                    chain.append([norm, n, this])
            yield _groups(out, arrow)
        if chain:
            out = []
            groups(chain, out)
            yield _groups(out, arrow)

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(index.leaves) // 64)
    dealt = given.mapInArrow(collapse, shape).repartition(parts, "bucket").sortWithinPartitions("bucket", "key")
    groups = stored(dealt.mapInArrow(own, f"key long, sha binary, keep_id {kind}, keep_row long, group_size long"), "groups")
    found = lookup(entries, groups, ["key", "sha"], "group_size", total)
    return found.select("row", F.col("id").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _groups(rows: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.binary(), arrow, pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "sha", "keep_id", "keep_row", "group_size"])


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with their columns."""
    row = spare(docs, "row")
    whole = numbered(docs, row)
    return keep_rows(whole, exact_dedup(whole, row=row, **options).where("kept"), row)
