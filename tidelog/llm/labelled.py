"""The labelled rows that a model may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of labelled documents that are not held out: all, or where there are
    more than `most`, those whose id hashes into that share. An id counts once, however often it
    stands in either table, so that about `most` rows are the bound."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(key, F.col(label).alias("label"))
    n = known.agg(F.approx_count_distinct(key)).first()[0]
    if n > most:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most / n))
    known = known.groupBy(key).agg(F.max("label").alias("label"))
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), key)
    return rows.groupBy(key).agg(F.max(F.struct("text", "label")).alias("r")).select(key, "r.text", "r.label")
