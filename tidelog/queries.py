"""The driver's queries over the log fixtures, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.engine import Engine
from tidelog.errors import NotFound, Overloaded, response
from tidelog.functions.percentiles import percentiles
from tidelog.functions.predicates import in_ranges, keep, key_hash
from tidelog.functions.timebins import micros
from tidelog.operators.aggregate import aggregate, from_rows
from tidelog.operators.listing import collect, held, in_steps, page, search
from tidelog.operators.rollup import hours_of, minutes_of, summed, tiers_of
from tidelog.operators.validate import accepted, rejected, validate
from tidelog.plans.cursor import Cursor, encode
from tidelog.plans.specs import AggregateSpec, Filters, ListSpec, parse_aggregate, parse_list
from tidelog.plans.windows import windows, within_hours
from tidelog.schema import BUCKETS, DAY
from tidelog.sources import fixtures, generator
from tidelog.sources.envelope import check_body, exploded
from tidelog.sources.responses import bucket_entries, list_entries
from tidelog.sources.scratch import scratch
from tidelog.sources.store import LogStore
from tidelog.streaming.ingest import drain, start, store_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SINCE, UNTIL = "2024-01-05 10:00:15", "2024-01-20 11:30:40"
NOW = "2024-02-01 00:00:00"


def us(text: str) -> int:
    return micros(datetime.fromisoformat(text))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("LOGS", f"({fixtures.logs_sql()})")
        return f

    return register


# Counts by time


def _buckets(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("start").alias("bucket_start"), F.col("group").alias("grp"), F.col("count").alias("cnt"))


def _count_sql(bucket: str, group: str | None, where: str = "true", since: str = SINCE, until: str = UNTIL) -> str:
    width = BUCKETS[bucket][1].upper()
    return (
        f"SELECT time_bucket(INTERVAL '{width}', \"timestamp\", TIMESTAMP '1970-01-01') AS bucket_start, {group or 'CAST(NULL AS VARCHAR)'} AS grp, count(*) AS cnt "
        f"FROM LOGS l WHERE \"timestamp\" >= TIMESTAMP '{since}' AND \"timestamp\" < TIMESTAMP '{until}' AND {where} GROUP BY 1, 2"
    )


def _spec(bucket: str, group: str | None, since: str = SINCE, until: str = UNTIL, **filters) -> AggregateSpec:
    return AggregateSpec(us(since), us(until), bucket, group, Filters(**filters))


def _counted(name: str, bucket: str, group: str | None, where: str = "true", tiered: bool = False, since: str = SINCE, until: str = UNTIL, **filters) -> None:
    @query(name, _count_sql(bucket, group, where, since, until))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs, spec = fixtures.logs(spark, sf_dir), _spec(bucket, group, since, until, **filters)
        return _buckets(aggregate(logs, tiers_of(logs), spec) if tiered else from_rows(logs, spec))


_counted("agg_1m_service", "1m", "service")
_counted("agg_5m_level", "5m", "level")
_counted("agg_1h_service", "1h", "service")
_counted("agg_1d_none", "1d", None)
_counted("agg_tiered_unaligned", "1d", "level", tiered=True)
_counted("agg_tiered_hours", "1h", "service", tiered=True)
_counted("agg_tiered_minutes", "5m", None, tiered=True)
_counted("agg_one_segment", "1d", "service", tiered=True, since="2024-01-05 00:00:00", until="2024-01-20 00:00:00")
_counted("agg_filtered_service", "1h", "level", "service = 'checkout'", tiered=True, service="checkout")
_counted("agg_filtered_level", "1d", "service", "level = 'error'", tiered=True, level="error")
_counted("agg_q", "1h", "service", "message ILIKE '%declined%'", tiered=True, q="DECLINED")
_counted("agg_attr", "1d", "level", "k = '42'", tiered=True, attributes={"k": "42"})
_counted("agg_q_attr_service", "1d", None, "message ILIKE '%user%' AND k = '7' AND service = 'auth'", tiered=True, q="user", attributes={"k": "7"}, service="auth")
_counted("agg_empty_window", "1h", "service", tiered=True, since=SINCE, until=SINCE)
_counted("agg_30d_1h_level", "1h", "level", tiered=True, since="2024-01-01 00:00:00", until="2024-01-31 00:00:00")


@query("agg_response", f"SELECT strftime(bucket_start, '%Y-%m-%dT%H:%M:%SZ') AS start, grp AS \"group\", cnt AS \"count\" FROM ({_count_sql('1h', 'service')})")
def agg_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_entries(from_rows(fixtures.logs(spark, sf_dir), _spec("1h", "service")))


@query("rollup_minute", "SELECT date_trunc('minute', \"timestamp\") AS bucket_start, service, level, count(*) AS cnt FROM LOGS l GROUP BY ALL")
def rollup_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes_of(fixtures.logs(spark, sf_dir))


@query("rollup_hour", "SELECT date_trunc('hour', \"timestamp\") AS bucket_start, service, level, count(*) AS cnt FROM LOGS l GROUP BY ALL")
def rollup_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours_of(minutes_of(fixtures.logs(spark, sf_dir)))


@query("rollup_merge", "SELECT date_trunc('minute', \"timestamp\") AS bucket_start, service, level, count(*) AS cnt FROM LOGS l GROUP BY ALL")
def rollup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of two batches, added up at reading."""
    logs = fixtures.logs(spark, sf_dir)
    odd = F.coalesce(F.pmod("id", F.lit(2)), F.lit(0)) == 1
    return summed(minutes_of(logs.where(~odd)).unionByName(minutes_of(logs.where(odd))))


# Pages


def _rows(found: DataFrame) -> DataFrame:
    return found.select("id", "timestamp", "level", "service", "message", F.col("attributes")["k"].alias("k"))


def _list_sql(where: str = "true", limit: int = 100) -> str:
    return f'SELECT id, "timestamp", level, service, message, k FROM LOGS l WHERE {where} ORDER BY "timestamp" DESC, id DESC LIMIT {limit}'


def _listed(name: str, where: str = "true", limit: int = 100, cursor: Cursor | None = None, ladder: bool = False, **filters) -> None:
    @query(name, _list_sql(where, limit))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs, spec = fixtures.logs(spark, sf_dir), ListSpec(Filters(**filters), limit, cursor)
        return _rows(search(logs, spec, us("2024-01-30 23:58:00")) if ladder else page(logs, spec))


_RANGE = f"\"timestamp\" >= TIMESTAMP '{SINCE}' AND \"timestamp\" < TIMESTAMP '{UNTIL}'"
_listed("list_default")
_listed("list_service_level", "service = 'auth' AND level = 'error'", service="auth", level="error")
_listed("list_range", _RANGE, 1000, since=us(SINCE), until=us(UNTIL))
_listed("list_attr", f"k = '42' AND {_RANGE}", since=us(SINCE), until=us(UNTIL), attributes={"k": "42"})
_listed("list_q_escaped", "message ILIKE '%declined 100!%!_%' ESCAPE '!'", q="declined 100%_", since=0)
_listed("list_q_attr_service", "message ILIKE '%view%' AND k = '5' AND service = 'orders'", q="VIEW", attributes={"k": "5"}, service="orders", since=0)
_listed("list_page2", "(\"timestamp\", id) < (TIMESTAMP '2024-01-18 06:30:00.123456', 500)", 50, Cursor(us("2024-01-18 06:30:00.123456"), 500))
_listed("list_probe_sparse", "k = '42'", 1000, ladder=True, attributes={"k": "42"})
_listed("list_probe_full", "message ILIKE '%user%'", 5, ladder=True, q="user")


@query("list_q_unicode", "SELECT doc_id AS id, source AS service, length(text) AS n FROM documents WHERE text ILIKE '%éaux%' ORDER BY doc_id DESC LIMIT 1000")
def list_q_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page(fixtures.document_logs(spark, sf_dir), ListSpec(Filters(q="ÉAUX"), 1000))
    return found.select("id", "service", F.length("message").cast("long").alias("n"))


@query(
    "list_ties_page2",
    "SELECT o_orderkey AS id, o_orderdate AS \"timestamp\", o_orderpriority AS message FROM orders "
    "WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-09-17', 9000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
)
def list_ties_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page(fixtures.order_logs(spark, sf_dir), ListSpec(limit=50, cursor=Cursor(us("1996-09-17"), 9000)))
    return found.select("id", "timestamp", "message")


@query("list_response", f"SELECT id::VARCHAR AS id, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%gZ') AS \"timestamp\", level, service, message, k FROM ({_list_sql()})")
def list_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_entries(page(fixtures.logs(spark, sf_dir), ListSpec())).withColumn("k", F.col("attributes")["k"]).drop("attributes")


# Ingest: bodies of up to a hundred entries made from `events`, some with a fault

#: (remainder of event_id by 13, reason) of entries with a fault.
FAULTS = {
    0: "timestamp is required",
    1: 'invalid timestamp: "yesterday"',
    2: "timestamp is more than five minutes in the future",
    3: 'invalid level: "critical"',
    4: "message must be a non-empty string",
    5: "service must be a non-empty string",
    6: "attributes: unsupported value type",
    7: "message contains a NUL character",
}


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 13

    def but(fault: int, odd: Column, usual: Column) -> Column:
        return F.when(kind == fault, odd).otherwise(usual)

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    stamp = quoted(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    parts = [
        F.concat(F.lit('"timestamp":'), but(1, F.lit('"yesterday"'), but(2, F.lit('"2024-02-01T00:05:01Z"'), stamp))),
        F.concat(F.lit('"level":'), but(3, F.lit('"critical"'), quoted(F.expr(fixtures.LEVEL)))),
        F.concat(F.lit('"service":'), but(5, F.lit('""'), quoted(F.expr(fixtures.SERVICE)))),
        F.when(kind != 4, F.concat(F.lit('"message":"event\\t'), F.col("event_id").cast("string"), but(7, F.lit('\\u0000"'), F.lit('"')))),
        F.concat(F.lit('"attributes":'), but(6, F.lit('{"a":{"b":1}}'), F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"f":1.50,"b":true,"e":1e21}')))),
    ]
    entry = but(0, F.lit("{}"), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    held = events.groupBy(F.floor(F.col("event_id") / 100).alias("n")).agg(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))).alias("es"))
    body = F.concat(F.lit('{"logs":['), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]}"))
    return held.select(F.lpad(F.col("n").cast("string"), 9, "0").alias("source"), body.alias("body"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(exploded(_bodies(spark, sf_dir)), us(NOW))


_GOOD = "SELECT * FROM events WHERE event_id % 13 > 7"
_GOOD_LOGS = f"(SELECT event_id, ts, {fixtures.LEVEL} AS level, {fixtures.SERVICE} AS service, props FROM ({_GOOD}))"


@query(
    "ingest_accepted",
    "SELECT epoch_us(ts) AS time_us, level, service, 'event' || chr(9) || event_id AS message, json_extract_string(props, '$.k') AS k, "
    f"'1.5' AS f, 'true' AS b, '1e+21' AS e, 4 AS n_attributes FROM {_GOOD_LOGS}",
)
def ingest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, a = accepted(_checked(spark, sf_dir)), F.col("attributes")
    return rows.select(F.unix_micros("timestamp").alias("time_us"), "level", "service", "message", *(a[n].alias(n) for n in "kfbe"), F.size("attributes").alias("n_attributes"))


_REASON = "CASE event_id % 13 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items()) + " END"


@query(
    "ingest_rejected",
    f"SELECT * FROM (SELECT row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS \"index\", {_REASON} AS reason FROM events) WHERE reason IS NOT NULL",
)
def ingest_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(_checked(spark, sf_dir))


def _filled(spark: SparkSession, sf_dir: str) -> LogStore:
    store = LogStore(spark, scratch(spark, "store"))
    store_batch(store, _bodies(spark, sf_dir), 0, us(NOW))
    return store


@query("store_ids_dense", f"SELECT count(*) AS n, count(DISTINCT event_id) AS ids, 1::BIGINT AS low, count(*) AS high FROM ({_GOOD})")
def store_ids_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).logs().agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("store_aggregate", f"SELECT epoch_us(date_trunc('hour', ts)) AS start_us, service AS grp, count(*) AS cnt FROM {_GOOD_LOGS} WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' GROUP BY 1, 2")
def store_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    found = aggregate(store.logs(), store.tiers(), _spec("1h", "service"))
    return found.select(F.unix_micros("start").alias("start_us"), F.col("group").alias("grp"), F.col("count").alias("cnt"))


@query("retention_kept", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS cnt FROM ({_GOOD}) WHERE CAST(ts AS DATE) + 1 > DATE '2024-01-16' GROUP BY 1")
def retention_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.sweep(us("2024-01-16 12:00:00") + 30 * DAY)
    return store.tiers()["hour"].groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("cnt").alias("cnt"))


@query("stream_rollup_equals_batch", f"SELECT epoch_us(date_trunc('minute', ts)) AS start_us, service, level, count(*) AS cnt FROM {_GOOD_LOGS} GROUP BY ALL")
def stream_rollup_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as files, streamed in micro-batches."""
    path = scratch(spark, "stream")
    bodies = _bodies(spark, sf_dir)
    bodies.select("body").repartition(6).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/lines")
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 3).text(f"{path}/lines")
    store = LogStore(spark, f"{path}/store")
    given = lines.select(F.concat(F.col("_metadata.file_path"), F.lit(":"), F.xxhash64("value").cast("string")).alias("source"), F.col("value").alias("body"))
    drain(start(store, given, f"{path}/checkpoint", now=us(NOW)))
    return summed(store.tiers()["minute"]).select(F.unix_micros("bucket_start").alias("start_us"), "service", "level", "cnt")


@query("generator_shape", "SELECT 5000::BIGINT AS n, 0::BIGINT AS faults, 6::BIGINT AS services, 4::BIGINT AS levels, 4::BIGINT AS regions")
def generator_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generator.entries(spark, 5000, us(NOW)).select(F.parse_json("value").alias("entry"), F.lit(0).alias("pos"))
    rows = validate(made, us(NOW))
    distinct = lambda c, n: F.countDistinct(c).alias(n)
    return rows.agg(F.count("*").alias("n"), F.count("reason").alias("faults"), distinct("service", "services"), distinct("level", "levels"), distinct(F.col("attributes")["region"], "regions"))


# Requests: parameters, cursors, envelopes, errors

#: (number, call, parameters, status, message): what each set of parameters is answered with.
REQUESTS: list[tuple[int, str, dict, int, str]] = [
    (1, "list", {}, 200, "limit 100"),
    (2, "list", {"limit": "1000"}, 200, "limit 1000"),
    (3, "list", {"limit": "0"}, 400, "limit must be between 1 and 1000"),
    (4, "list", {"limit": "9" * 5000}, 400, "limit must be between 1 and 1000"),
    (5, "list", {"limit": "ten"}, 400, "invalid limit: 'ten'"),
    (6, "list", {"service": ["a", "b", ""]}, 200, "service b"),
    (7, "list", {"service": ""}, 400, "service must be non-empty"),
    (8, "list", {"level": "fatal"}, 400, "invalid level: 'fatal'"),
    (9, "list", {"since": "soon"}, 400, "invalid since: 'soon'"),
    (10, "list", {"until": "0001-01-01T00:30:00Z", "q": "x"}, 200, "limit 100"),
    (11, "list", {"since": "2024-01-02", "until": "2024-01-01"}, 400, "until must be greater than or equal to since"),
    (12, "list", {"since": "2024-01-02", "until": "2024-01-02T00:00:00Z"}, 200, "limit 100"),
    (13, "list", {"q": ""}, 400, "q must be non-empty"),
    (14, "list", {"q": "x" * 513}, 400, "q exceeds maximum length"),
    (15, "list", {"attr.": "x"}, 400, "invalid attribute filter: 'attr.'"),
    (16, "list", {"attr.k": []}, 400, "missing value for 'attr.k'"),
    (17, "list", {"attr.k": ""}, 200, "attr k="),
    (18, "list", {"cursor": "nonsense"}, 400, "invalid cursor"),
    (19, "list", {"cursor": encode(Cursor(0, 1 << 63))}, 400, "invalid cursor"),
    (20, "list", {"cursor": encode(Cursor(1_704_100_000_123_456, 77))}, 200, "cursor 1704100000123456 77"),
    (21, "list", {"unknown": "x"}, 200, "limit 100"),
    (22, "aggregate", {"until": "2024-01-02"}, 400, "since is required"),
    (23, "aggregate", {"since": "2024-01-01"}, 400, "until is required"),
    (24, "aggregate", {"since": "2024-01-01", "until": "2024-01-02"}, 400, "bucket is required"),
    (25, "aggregate", {"since": "2024-01-01", "until": "2024-01-02", "bucket": "2h"}, 400, "invalid bucket: '2h'"),
    (26, "aggregate", {"since": "2024-01-01", "until": "2024-01-02", "bucket": "1h", "group_by": "host"}, 400, "invalid group_by: 'host'"),
    (27, "aggregate", {"since": "2024-01-01", "until": "2024-03-10T10:40:00Z", "bucket": "1m"}, 200, "bucket 1m"),
    (28, "aggregate", {"since": "2024-01-01", "until": "2024-03-10T10:40:00.001Z", "bucket": "1m"}, 400, "aggregation window produces too many buckets for bucket=1m"),
    (29, "aggregate", {"since": "2024-01-01", "until": "2024-01-02", "bucket": "1d", "limit": "0", "cursor": "?"}, 200, "bucket 1d"),
    (30, "body", {"body": "{"}, 400, "malformed JSON"),
    (31, "body", {"body": "[]"}, 400, "request body must be a JSON object with a 'logs' array"),
    (32, "body", {"body": '{"logs": {}}'}, 400, "'logs' must be an array"),
    (33, "body", {"body": '{"logs": []}'}, 400, "'logs' must contain at least one entry"),
    (34, "body", {"body": '{"logs": [%s]}' % ",".join("1" * 10_001)}, 400, "batch too large: 10001 > 10000"),
    (35, "body", {"body": '{"logs": [1], "x": "%s"}' % ("x" * (5 << 20))}, 400, "request body too large"),
    (36, "body", {"body": '{"logs": [%s]}' % ",".join("1" * 10_000)}, 200, "entries 10000"),
    (37, "error", {"of": NotFound("not found")}, 404, "not found"),
    (38, "error", {"of": Overloaded()}, 503, "service temporarily unable to accept writes; Retry-After 1"),
    (39, "error", {"of": ValueError("inner")}, 500, "internal error"),
]


def _asked(call: str, params: dict) -> str:
    if call == "error":
        raise params["of"]
    if call == "body":
        return f"entries {len(check_body(params['body']))}"
    if call == "aggregate":
        return f"bucket {parse_aggregate(params).bucket}"
    spec = parse_list(params)
    if spec.cursor:
        return f"cursor {spec.cursor.time} {spec.cursor.id}"
    if spec.filters.service:
        return f"service {spec.filters.service}"
    return " ".join(f"attr {k}={v}" for k, v in spec.filters.attributes.items()) or f"limit {spec.limit}"


_SAID = ", ".join(f"({n}, {status}, '{said.replace(chr(39), chr(39) * 2)}')" for n, _, _, status, said in REQUESTS)


@query("requests", f"SELECT n::BIGINT AS n, status::BIGINT AS status, said FROM (VALUES {_SAID}) v(n, status, said)")
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter sets through the parsers, bodies through the guards, errors through the mapping."""
    out = []
    for n, call, params, _, _ in REQUESTS:
        try:
            status, said = 200, _asked(call, params)
        except Exception as e:
            status, headers, body = response(e)
            said = body["error"].split(":")[0] if body["error"].startswith("malformed") else body["error"]
            said += "".join(f"; {k} {v}" for k, v in headers.items())
        out.append((n, status, said))
    return spark.createDataFrame(out, "n long, status long, said string")


@query(
    "pages_walked",
    'SELECT (p - 1) // 300 + 1 AS "page", (p - 1) % 300 + 1 AS place, id, epoch_us("timestamp") AS time_us, p % 300 = 0 AS has_next '
    'FROM (SELECT id, "timestamp", row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS p FROM LOGS l) WHERE p <= 900',
)
def pages_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages, each found by the encoded cursor of the one before."""
    logs, out, cursor = fixtures.logs(spark, sf_dir), [], None
    for number in (1, 2, 3):
        found = collect(page(logs, parse_list({"limit": "300"} | ({"cursor": cursor} if cursor else {}))), 300)
        cursor = found.next_cursor
        out += [(number, i + 1, r["id"], r["time_us"], i == 299 and cursor is not None) for i, r in enumerate(found.rows)]
    return spark.createDataFrame(out, "page long, place long, id long, time_us long, has_next boolean")


# Order: rows are numbered as they come


def _placed(found: DataFrame, *columns: str) -> DataFrame:
    return found.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(found.select(*columns).collect())], T.StructType([T.StructField("place", T.LongType()), *found.select(*columns).schema.fields]))


@query("list_in_order", f"SELECT row_number() OVER (ORDER BY \"timestamp\" DESC, id DESC) AS place, id, message FROM ({_list_sql('true', 500)})")
def list_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(page(fixtures.logs(spark, sf_dir), ListSpec(limit=500)), "id", "message")


@query("agg_in_order", f"SELECT row_number() OVER (ORDER BY bucket_start, grp) AS place, bucket_start, grp, cnt FROM ({_count_sql('1h', 'level')})")
def agg_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = fixtures.logs(spark, sf_dir)
    return _placed(_buckets(aggregate(logs, tiers_of(logs), _spec("1h", "level"))), "bucket_start", "grp", "cnt")


_counted("agg_whole_unaligned", "1h", "service", tiered=True, since="1999-12-31 23:59:59.999999", until="2038-01-19 03:14:07.000001")
_counted("agg_whole_minutes", "5m", "level", tiered=True, since="2023-12-31 23:59:58.5", until="2024-01-31 00:00:01.25")
_counted("agg_one_tier", "1m", None, tiered=True, since="2024-01-10 10:00:10.5", until="2024-01-12 23:01:40.25")


@query("list_no_attributes", f"SELECT id, \"timestamp\", message, CASE WHEN id % 7 = 0 THEN 0 ELSE 1 END AS n FROM ({_list_sql('true', 200)})")
def list_no_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose attributes are null are given with none."""
    logs = fixtures.logs(spark, sf_dir)
    logs = logs.withColumn("attributes", F.when(F.col("id") % 7 != 0, F.col("attributes")))
    return page(logs, ListSpec(limit=200)).select("id", "timestamp", "message", F.size("attributes").alias("n"))


@query(
    "latency_percentiles",
    "WITH o AS (SELECT o_orderpriority AS name, o_totalprice AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)), "
    "p AS (SELECT unnest([50, 95, 99, 100])::BIGINT AS p) SELECT name, p, v FROM o, p WHERE i = least(n - 1, floor(p / 100.0 * n))",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("v"))
    return percentiles(orders, "name", "v", (50, 95, 99, 100))


# The store under other loads: sizes, thin faults, replays, upkeep, many callers

_SIZED = "CASE event_id % 5 WHEN 0 THEN 128 WHEN 1 THEN 129 ELSE 1 END"


@query(
    "ingest_limits",
    "SELECT event_id AS id, CASE event_id % 5 WHEN 1 THEN 'attributes has more than 128 keys' WHEN 3 THEN 'attribute key exceeds 128 characters' "
    f"WHEN 4 THEN 'attribute value exceeds 4096 characters' END AS reason, CASE WHEN event_id % 5 IN (1, 3, 4) THEN 0 ELSE {_SIZED} END AS n FROM events WHERE event_id < 200",
)
def ingest_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes at and above the limits on their number and on the lengths of keys and values."""
    kind = F.col("event_id") % 5
    keys = F.transform(F.sequence(F.lit(1), F.expr(_SIZED)), lambda i: F.concat(F.lit("k"), i.cast("string")))
    keys = F.when(kind == 2, F.array(F.repeat(F.lit("k"), F.lit(128)))).when(kind == 3, F.array(F.repeat(F.lit("k"), F.lit(129)))).otherwise(keys)
    value = F.repeat(F.lit("v"), F.when(kind == 4, 4097).otherwise(F.when(kind == 2, 4096).otherwise(1)))
    attributes = F.map_from_arrays(keys, F.transform(keys, lambda _: value))
    entry = F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("info").alias("level"), F.lit("s").alias("service"), F.lit("m").alias("message"), attributes.alias("attributes"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 200")
    given = events.select(F.col("event_id").alias("id"), F.lit(0).alias("pos"), F.parse_json(F.to_json(entry)).alias("entry"))
    return validate(given, us(NOW)).select("id", "reason", F.when(F.col("reason").isNull(), F.size("attributes")).otherwise(0).alias("n"))


def _thin(spark: SparkSession, sf_dir: str, parts: int = 3) -> list[DataFrame]:
    """All events as bodies, every 97th with a fault, dealt to batches."""
    held = fixtures.logs(spark, sf_dir).withColumn("level", F.when(F.col("id") % 97 == 5, F.lit("loud")).otherwise(F.col("level")))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    entry = F.to_json(F.struct(stamp, "level", "service", "message", "attributes"))
    rows = held.groupBy(F.floor(F.col("id") / 100).alias("b")).agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))).alias("es"))
    body = F.concat(F.lit('{"logs":['), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]}"))
    rows = rows.select("b", F.lpad(F.col("b").cast("string"), 9, "0").alias("source"), body.alias("body"))
    return [rows.where(F.col("b") % parts == i).select("source", "body") for i in range(parts)]


_THIN_GOOD = f"(SELECT event_id, ts, {fixtures.LEVEL} AS level, {fixtures.SERVICE} AS service, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 97 <> 5)"
_HOURS_SQL = f"SELECT epoch_us(date_trunc('hour', ts)) AS start_us, service, level, count(*) AS cnt FROM {_THIN_GOOD} GROUP BY ALL"


def _thin_store(spark: SparkSession, sf_dir: str) -> LogStore:
    store = LogStore(spark, scratch(spark, "thin"))
    for i, given in enumerate(_thin(spark, sf_dir)):
        store_batch(store, given, i, us(NOW))
    return store


def _hours(store: LogStore) -> DataFrame:
    return summed(store.tiers()["hour"]).select(F.unix_micros("bucket_start").alias("start_us"), "service", "level", "cnt")


@query("store_replayed", _HOURS_SQL)
def store_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch is run twice, one of them after its marker was lost."""
    store = _thin_store(spark, sf_dir)
    store.folder.delete("batches/1.done.json")
    for i, given in enumerate(_thin(spark, sf_dir)):
        store_batch(store, given, i, us(NOW) + DAY)
    return _hours(store)


@query("store_rebuilt", _HOURS_SQL)
def store_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _thin_store(spark, sf_dir)
    store.rebuild(grace=0)
    return _hours(store)


@query("store_after_compaction", f"SELECT epoch_us(ts) AS time_us, level, service, k, 1::BIGINT AS copies FROM {_THIN_GOOD}")
def store_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after the batches of each day were joined and the old directories deleted; ids stay unique."""
    store = _thin_store(spark, sf_dir)
    store.compact(datetime(2024, 1, 31).date(), grace=0)
    store.fold(1)
    rows = store.logs().select("id", F.unix_micros("timestamp").alias("time_us"), "level", "service", F.col("attributes")["k"].alias("k"))
    return rows.withColumn("copies", F.count("*").over(Window.partitionBy("id"))).drop("id")


@query("store_search", f"SELECT epoch_us(ts) AS time_us, service, level FROM {_THIN_GOOD} WHERE k = '42' AND service = 'auth' ORDER BY ts DESC LIMIT 1000")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse search in small steps, by way of the attribute index."""
    store = _thin_store(spark, sf_dir)
    spec = parse_list({"attr.k": "42", "service": "auth", "limit": "1000"})
    steps = windows(spec, store.sizes(), first=1 << 16)
    pair = key_hash(F.lit("k"), F.lit("42"))
    hours = store.keys().where(F.col("kv") == pair).select(F.unix_micros("bucket_start")).distinct().collect()
    logs = store.logs()
    found = in_steps(lambda s, parts: held(page(keep(logs, in_ranges(logs, parts)), s)).collect(), spec, within_hours(steps, [r[0] for r in hours]))
    return spark.createDataFrame([(r["time_us"], r["service"], r["level"]) for r in found.rows], "time_us long, service string, level string")


@query("ingest_by_many", f"SELECT service, level, count(*) AS cnt, count(*) FILTER (WHERE k = '7') AS sevens FROM {_THIN_GOOD} WHERE event_id < 1000 GROUP BY ALL")
def ingest_by_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten callers at once."""
    engine = Engine(spark, scratch(spark, "many"))
    held_ = [r.body for part in _thin(spark, sf_dir, 1) for r in part.where("source < '000000010'").collect()]
    with ThreadPoolExecutor(len(held_)) as pool:
        list(pool.map(lambda b: engine.ingest(b, us(NOW)), held_))
    engine.drain()
    return engine.store.logs().groupBy("service", "level").agg(F.count("*").alias("cnt"), F.count_if(F.col("attributes")["k"] == "7").alias("sevens"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by service, from summaries and the unaligned edges' rows."""
    logs = fixtures.logs(spark, sf_dir)
    return _buckets(aggregate(logs, tiers_of(logs), _spec("1h", "service")))
