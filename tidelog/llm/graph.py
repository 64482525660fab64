"""Connected components of a link table, kept in tables throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import stored

#: Links that one task contracts to stars, about.
CONTRACT = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as (node, least node of its component there)."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, b_ = top(u), top(v)
            if a != b_:
                root[max(a, b_)] = min(a, b_)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the ends of `links` (u, v); label is the least node of its component.

    Links are first contracted to stars, about CONTRACT of them in a task. Rounds then join the
    stars: each takes the least label that a label's stars have elsewhere, then the label of that
    label, so the rounds grow with the logarithm of the longest chain of stars. Every round ends in a table of the
    shared folder; hot labels are Spark's skewed joins."""
    links = stored(links.select("u", "v").where("u <> v"), "links")
    parts = -(-links.count() // CONTRACT) or 1
    now = stored(links.repartition(parts).mapInArrow(_stars, "node long, label long"), "stars")
    if parts == 1:
        return now
    ties = stored(now.where("node <> label").distinct(), "ties")
    both = ties.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(ties.select(F.col("label").alias("u"), F.col("node").alias("v")))
    now = stored(now.groupBy("node").agg(F.min("label").alias("label")), "labels")
    while True:
        around = both.join(now, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("least"))
        near = stored(now.join(around, "node", "left").select("node", "label", F.least("label", F.coalesce("least", "label")).alias("next")), "near")
        far = near.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = stored(near.join(far, "next").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "labels")
        now = after.select("node", "label")
        if not after.where("moved").limit(1).count():
            return now
