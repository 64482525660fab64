"""Driver tables seen as logs. The same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL = "CASE event_type WHEN 'view' THEN 'debug' WHEN 'purchase' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'info' END"
SERVICE = (
    "CASE user_id % 6 WHEN 0 THEN 'auth' WHEN 1 THEN 'checkout' WHEN 2 THEN 'orders' "
    "WHEN 3 THEN 'catalog' WHEN 4 THEN 'payments' ELSE 'gateway' END"
)
MESSAGE = "concat(CASE event_type WHEN 'error' THEN 'Payment DECLINED 100%_' ELSE event_type END, ' user ', cast(user_id as {text}))"


def logs_sql(duckdb: bool = True) -> str:
    """A query over `events` with the columns of a log row; attribute k alone, as text, in DuckDB."""
    text = "varchar" if duckdb else "string"
    attributes = "json_extract_string(props, '$.k') AS k" if duckdb else "from_json(props, 'map<string,string>') AS attributes"
    time = "ts AS \"timestamp\"" if duckdb else "ts AS `timestamp`"
    return f"SELECT event_id AS id, {time}, {LEVEL} AS level, {SERVICE} AS service, {MESSAGE.format(text=text)} AS message, {attributes} FROM events"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as rows of the log schema; times have no zone."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.expr(LEVEL).alias("level"), F.expr(SERVICE).alias("service"),
        F.expr(MESSAGE.format(text="string")).alias("message"), F.from_json("props", "map<string,string>").alias("attributes"),
    )


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as logs: many rows share a time."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    none = F.create_map().cast("map<string,string>")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"), F.lit("info").alias("level"), F.lit("orders").alias("service"), F.col("o_orderpriority").alias("message"), none.alias("attributes"))


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as logs at one instant: long accented messages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.create_map().cast("map<string,string>")
    return docs.select(F.col("doc_id").alias("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"), F.lit("info").alias("level"), F.col("source").alias("service"), F.col("text").alias("message"), none.alias("attributes"))
