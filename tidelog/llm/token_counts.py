"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import pieces
from tidelog.llm.textscan import chunks, per_doc


class Counter:
    def __init__(self, file: bytes):
        ids, self.pairs, self.special = pieces.vocabulary(file)
        self.symbol = [ids[bytes([b])] for b in range(256)]
        self.memory = pieces.Memory(self.work)

    def work(self, piece: str) -> int:
        symbol = self.symbol
        return pieces.merged([symbol[b] for b in piece.encode("utf-8", "replace")], self.pairs)

    def count(self, texts: list[str | None]) -> np.ndarray:
        parts, owner, mark = pieces.split_special(texts, self.special)
        out = np.bincount(owner, np.array(mark) >= 0, len(texts)).astype(np.int64)
        for first, end, cps, bounds in chunks(parts):
            start = pieces.piece_starts(cps, bounds)
            value = self.memory.of(cps, start, np.append(start[1:], len(cps)))
            np.add.at(out, owner[first:end], per_doc(value, start, bounds))
        return out


@cache
def counter(file: bytes) -> Counter:
    """One for each worker process, which keeps it between tasks."""
    return Counter(file)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit), one per row of `docs`, in one pass with no shuffle.

    `tokenizer` is the path of a byte-level BPE .json; the driver reads it and sends its bytes,
    whose size is fixed. A null text counts as empty: 0 bytes, 0 tokens. Special strings in a
    text are one token, as the library has it. Very long texts are counted whole; equal rows are
    counted alike, an empty table gives an empty one, other columns are not read."""
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(file.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = own.count(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(key, text).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
