"""A quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.labelled import held_out, training_rows
from tidelog.llm.textscan import LETTER, NUMBER, OTHER, SPACE, chunks, classes, lower, mix, per_doc, prefix_hash, span_hash

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 40_000
FEATURES = [
    "log_words", "word_length", "long_words", "upper", "digits", "marks", "hash_marks", "bars", "bangs", "stops",
    "commas", "capital_words", "repeats", "distinct", "line_repeats", "log_line_words",
]


@cache
def _upper() -> np.ndarray:
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def _distinct(doc: np.ndarray, key: np.ndarray, docs: int) -> np.ndarray:
    """Number of distinct keys of each document."""
    both = np.sort(doc.astype(np.uint64) << np.uint64(44) | key >> np.uint64(20))
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    return np.bincount((both[first] >> np.uint64(44)).astype(np.int64), minlength=docs)


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a share, drawn in by half a case so that short texts stay moderate."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The transformed statistics FEATURES of each document of a chunk, over its whole text."""
    n, docs = len(cps), len(bounds) - 1
    if not n:  # only empty texts, which are measured beside any other
        return statistics(np.array([120], np.uint32), np.append(bounds, 1))[:-1]
    cls, low = classes()[cps], lower()[cps]
    of = np.repeat(np.arange(docs), np.diff(bounds))
    count = lambda mask: np.bincount(of[mask], minlength=docs).astype(float)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = cls != SPACE
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    sums = prefix_hash(low)
    word, at, size = span_hash(sums, start, end), of[start], end - start
    words = np.bincount(at, minlength=docs).astype(float)
    again = np.zeros(len(start), bool)
    again[1:] = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
    brk = cps == 10
    line_start = np.union1d(bounds[:-1], np.flatnonzero(brk) + 1)
    line_start = line_start[line_start < n]
    line_end = np.append(line_start[1:], n)
    full = line_end - line_start > 1
    line_start, line_end = line_start[full], line_end[full]
    strip = line_end - brk[line_end - 1]
    lines = np.bincount(of[line_start], minlength=docs).astype(float)
    letters, chars = count(cls == LETTER), np.maximum(np.diff(bounds), 1).astype(float)
    marks = cls == OTHER
    hashes = np.isin(cps, [ord(c) for c in "#$%&*@^~_=+<>"])
    return np.column_stack([
        np.log1p(words),
        np.log1p(letters / np.maximum(words, 1)),
        _logit(np.bincount(at, size > 12, docs), words),
        _logit(count(_upper()[cps]), letters),
        _logit(count(cls == NUMBER), chars),
        _logit(count(marks), chars),
        _logit(count(hashes), chars),
        _logit(count(cps == ord("|")), chars),
        _logit(count(cps == ord("!")), chars),
        _logit(count(cps == ord(".")), words),
        _logit(count(cps == ord(",")), words),
        _logit(np.bincount(at, _upper()[cps[start]], docs), words),
        _logit(np.bincount(at, again, docs), words),
        _logit(_distinct(at, word, docs), words) / np.maximum(1, np.log(words + 2)),
        _logit(lines - _distinct(of[line_start], mix(span_hash(sums, line_start, strip)), docs), lines),
        np.log1p(words / np.maximum(lines, 1)),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Gaussian densities of two classes; `factors` are Cholesky factors of the inverse covariances."""

    prior: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pool: float = 0.1, ridge: float = 0.1) -> Discriminant | None:
        """Class covariances drawn by `pool` to the pooled one, then by `ridge` to its diagonal.
        None without rows of both classes."""
        if len(x) == 0 or len(np.unique(y)) < 2:
            return None
        parts = [x[y == k] for k in (0, 1)]
        means = np.array([p.mean(0) for p in parts])
        scatter = [(p - m).T @ (p - m) for p, m in zip(parts, means)]
        pooled = sum(scatter) / len(x)
        floor = np.diag(np.diag(pooled) + 1e-3)
        factors, dets = [], []
        for s, p in zip(scatter, parts):
            cov = (1 - ridge) * ((1 - pool) * s / len(p) + pool * pooled) + ridge * floor
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            dets.append(2 * np.log(np.diag(low)).sum())
        prior = np.log(np.array([len(p) for p in parts]) / len(x))
        return cls(prior, means, np.array(factors), np.array(dets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: log densities by Mahalanobis distance, each a product with a cached factor."""
        logs = [self.prior[k] - 0.5 * ((((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) + self.log_dets[k]) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, end, cps, bounds in chunks(b.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(list(statistics(cps, bounds)), pa.list_(pa.float64())), b.column(1).slice(first, end - first)], ["x", "label"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> Discriminant | None:
    """The model of labelled, not held out rows; statistics come from whole texts, on the executors."""
    rows = training_rows(docs, labels, label, most, key, text).select("text", F.col("label").cast("int").alias("label"))
    got = rows.mapInArrow(_measured, "x array<double>, label int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return Discriminant.fit(x, np.array(got.column("label").to_pylist()))


def score_quality(docs: DataFrame, model: Discriminant | None, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, score, predicted), one per row of `docs`, in one pass with no shuffle.

    Null and empty texts have the statistics of no words, and a score like any other. With no
    model (labels empty or of one class) every score is 0.5. Very long texts are scored whole,
    repeated rows alike, an empty table gives an empty one, other columns are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, cps, bounds in chunks(b.column(1)):
                s = model.score(statistics(cps, bounds)) if model else np.full(end - first, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

    out = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
    return out.select(key, held_out(key).alias("held_out"), "score", "predicted")
