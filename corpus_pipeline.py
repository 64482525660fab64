"""Documents to packed training sequences, in five stages of the operators in tidelog.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. When a stage
begins, what the one before it left in the shared folder goes: its result is written by then, and a stage
that is handed a DataFrame which still reads such tables leaves them alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tidelog.llm.queries import TOKENIZER
from tidelog.llm.shared import forget, made, stored

#: Toxicity scores and the packing can't be had from SQL.
ORACLE_SQL = None
#: Tables that the last stage left, by application.
_LEFT: dict[str, list[str]] = {}


def _alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """`stage`, with the tables of the stage before deleted and its own remembered."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = forget(_LEFT.pop(app, []), docs)
        with made() as paths:
            out = stage(spark, docs, sf_dir)
        _LEFT[app] = left + paths
        return out

    return run


@_alone
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 by a grammar fitted on the labelled ones."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_alone
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest."""
    return exact_dedup.keep_first(docs)


@_alone
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs)


@_alone
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mixed(docs)


@_alone
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    app = spark.sparkContext.applicationId
    for name, stage in STAGES:
        with made() as paths:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        _LEFT[app] += paths  # the stage's result, once the next one's is written
    forget(_LEFT.pop(app), docs)  # the result is the caller's
    return docs
