"""Bounded-space online packing of token ids into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import pieces
from tidelog.llm.shared import stored
from tidelog.llm.textscan import chunks

#: Ids that a worker keeps for pre-tokens, at most.
POOL = 1 << 23
#: Partitions, then groups, whose leftovers one task merges.
FAN = 64
SHAPE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class Ids:
    """Token ids of whole texts; a worker process keeps the ids of pre-tokens that it has met."""

    def __init__(self, file: bytes):
        self.encoder, self.special = pieces.encoder(file)
        self.memory = pieces.Memory(self.work)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def work(self, piece: str) -> int:
        ids = self.encoder.encode_ordinary(piece)
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : end] = ids
        at, self.used = self.used, end
        return at << 24 | len(ids)

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids) of each text, in order."""
        parts, owner, mark = pieces.split_special(texts, self.special)
        whole: list[np.ndarray] = []
        for first, end, cps, bounds in chunks(parts):
            if self.used > POOL:
                self.used = 0
                self.memory.forget()
            start = pieces.piece_starts(cps, bounds)
            value = self.memory.of(cps, start, np.append(start[1:], len(cps)))
            at, size = value >> 24, value & 0xFFFFFF
            ends = np.cumsum(size)
            ids = self.pool[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
            edge = np.append(0, ends)[np.searchsorted(start, bounds)]
            for k in range(first, end):
                if k and owner[k] != owner[k - 1]:
                    yield int(owner[k - 1]), whole[0] if len(whole) == 1 else np.concatenate(whole)
                    whole = []
                if mark[k] >= 0:
                    whole.append(np.array([mark[k]], np.uint32))
                whole.append(ids[edge[k - first] : edge[k - first + 1]])
        if len(texts):
            yield int(owner[-1]), whole[0] if len(whole) == 1 else np.concatenate(whole)


@cache
def encoder(file: bytes) -> Ids:
    return Ids(file)


class Windows:
    """At most `most` open windows. A document's remainder goes to the window that it fills best;
    if it fits none, a new one is opened, or, when all are open, the fullest takes as much as it
    holds and is emitted."""

    def __init__(self, capacity: int, most: int, number: int):
        self.capacity, self.most, self.number = capacity, most, number
        self.open: list[list] = []  # [tokens, sequence id, rows]

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of sequences that are now full."""
        at, total, cap = 0, len(ids), self.capacity
        while total - at >= cap:
            yield self.row(key, ids, at, cap, self.next(), 0)
            at += cap
        while at < total:
            need = total - at
            fits = [w for w in self.open if w[0] + need <= cap]
            if fits:
                window = max(fits, key=lambda w: w[0])
                take = need
            elif len(self.open) < self.most:
                window = [0, self.next(), []]
                self.open.append(window)
                take = need
            else:
                window = max(self.open, key=lambda w: w[0])
                take = cap - window[0]
            window[2].append((key, ids, at, take, window[0]))
            window[0] += take
            at += take
            if window[0] == cap:
                self.open.remove(window)
                for k, x, start, n, offset in window[2]:
                    yield self.row(k, x, start, n, window[1], offset)

    def next(self) -> int:
        self.number += 1
        return self.number - 1

    @staticmethod
    def row(key, ids: np.ndarray, at: int, n: int, sequence: int, offset: int) -> tuple:
        return key, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), len(ids), sequence, offset

    def left(self) -> Iterator[tuple]:
        """Rows of the windows still open, each with its ids."""
        for _, sequence, rows in sorted(self.open, key=lambda w: w[1]):
            for key, ids, at, n, offset in rows:
                yield (*self.row(key, ids, at, n, sequence, offset), ids[at : at + n].astype("<u4").tobytes())


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, windows: int = 32, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every document.

    Each partition packs its documents online with `windows` open windows; full windows are
    emitted as they fill. What is left in the open windows of FAN partitions is laid end to end
    by one task, level by level, so a single sequence of the whole table has padding. A task holds
    `windows` windows, a merging one FAN * windows: both are independent of the input.

    A null or empty text is the end id alone. Very long texts are cut, none is shortened; equal
    rows are packed each for itself; an empty table gives an empty one; other columns are not
    read. Sequence ids come from partition and order, so a repeated task gives the same."""
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType
    shape = f"key {kind.simpleString()}, {SHAPE}"

    def batch(rows: list[tuple], part: int, arrow: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 8
        ids = cols[7] if len(cols) == 8 else [None] * len(rows)
        arrays = [pa.array(cols[0], arrow), *(pa.array(c, pa.int64()) for c in cols[1:7])]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int64()), pa.array(ids, pa.binary())], ["key", *(x.split()[0] for x in SHAPE.split(", "))])

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, arrow = encoder(file.value), TaskContext.get().partitionId(), None
        packer = Windows(capacity, windows, part << 32)
        for given in batches:
            arrow, keys, rows = given.column(0).type, given.column(0).to_pylist(), []
            for i, ids in own.of(given.column(1).to_pylist()):
                rows.extend(packer.add(keys[i], np.append(ids, np.uint32(end_id))))
            yield batch(rows, part, arrow)
        if arrow is not None:
            yield batch(list(packer.left()), part, arrow)

    def merge(level: int, last: bool):
        def of(group: tuple, given: pa.Table) -> pa.Table:
            """Pieces of some partitions laid end to end and cut anew."""
            part = group[0].as_py()
            number, offset, rows, waiting = level << 56 | part << 32, 0, [], []
            for r in given.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
                at, ids = 0, np.frombuffer(r["ids"], "<u4")
                while at < len(ids):
                    n = min(len(ids) - at, capacity - offset)
                    cut = ids[at : at + n].tobytes()
                    waiting.append((r["key"], r["start"] + at, n, zlib.crc32(cut), r["doc_tokens"], number, offset, cut))
                    at, offset = at + n, offset + n
                    if offset == capacity:
                        rows += [(*w[:7], None) for w in waiting]
                        number, offset, waiting = number + 1, 0, []
            rows += [(*w[:7], None) for w in waiting] if last else waiting
            return pa.Table.from_batches([batch(rows, part, given.column("key").type)])

        return of

    done = stored(docs.select(F.col(key).alias("key"), text).mapInArrow(online, shape), "packed")
    parts = (done.agg(F.max("part")).first()[0] or 0) + 1
    results, level = [done.where("ids is null")], 0
    while True:
        level, parts = level + 1, -(-parts // FAN)
        merged = done.where("ids is not null").withColumn("group", F.expr(f"part div {FAN}")).groupBy("group")
        done = merged.applyInArrow(merge(level, parts == 1), shape)
        if parts == 1:
            results.append(done)
            break
        done = stored(done, "merged")
        results.append(done.where("ids is null"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.drop("part", "ids").withColumnRenamed("key", key)
