"""Intermediate tables in the folder that all executors share, and joins that a hot key does not hurt."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.scratch import shared_base

#: A key with more than this share of all rows is hot, so there are at most this many hot keys.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below `spark.checkpoint.dir`; where that is unset, which only a local master allows, a temporary one."""
    return f"{shared_base(spark)}/tidelog-{spark.sparkContext.applicationId}"


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def made() -> Iterator[list[str]]:
    """The paths of the tables that `stored` writes inside."""
    paths: list[str] = []
    token = _MADE.set(paths)
    try:
        yield paths
    finally:
        _MADE.reset(token)


def forget(paths: list[str], *keep: DataFrame) -> list[str]:
    """Delete tables by their paths, other than those that `keep` reads, which are returned."""
    held = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in keep for f in df.inputFiles()}
    left = [p for p in paths if p.rsplit("/", 1)[-1] in held]
    for p in set(paths) - set(left):
        _delete(keep[0].sparkSession, p)
    return left


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that are still to be computed may read
    them, so write those first."""
    _delete(spark, shared_dir(spark))


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave and nothing reads any more, so that the disk holds one step's tables and not all."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/tidelog-{df.sparkSession.sparkContext.applicationId}/" in path:
                _delete(df.sparkSession, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends here, so a lost
    executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _MADE.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """`name`, or with underscores as many as make it no column of `df`."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a number for each row in column `name`, from the shared folder. A scan's numbers depend on
    its splits, and these on the executors there are when it is planned, so rows are numbered in one
    scan and every later step reads the numbers back."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def given_rows(docs: DataFrame, row: str | None, *columns: Column) -> DataFrame:
    """(row, columns) of `docs`, which column `row` numbers; with None they are numbered here, and only `columns` are stored."""
    if row is not None:
        return docs.select(F.col(row).alias("row"), *columns)
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "numbered")


def keep_rows(docs: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """The rows of `docs` whose number in column `row` stands in `rows` (row), without the number."""
    return docs.join(rows.select(F.col("row").alias(row)).hint("merge"), row, "left_semi").drop(row)


def lookup(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join `rows` with `keyed`, which holds one row per key and in `count` the number of
    rows with this key. Keys with over 1/HOT_PARTS of `total` rows are at most HOT_PARTS, so
    they are broadcast; the rest has no hot key and is joined by a shuffle. Keys are not null."""
    floor = max(1, total // HOT_PARTS)
    hot = F.broadcast(keyed.where(F.col(count) > floor).withColumn("__hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    near = marked.where(F.col("__hot")).drop("__hot")
    far = marked.where(F.col("__hot").isNull()).select(*rows.columns)
    return near.unionByName(far.join(keyed.where(F.col(count) <= floor), keys, "left"))


def matched(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """`lookup` of the rows whose key stands in `keyed` alone: an inner join."""
    floor = max(1, total // HOT_PARTS)
    near = rows.join(F.broadcast(keyed.where(F.col(count) > floor)), keys)
    return near.unionByName(rows.join(keyed.where(F.col(count) <= floor), keys))
