"""Fixed schemas, levels and bucket widths."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = ("debug", "info", "warn", "error")
MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
#: Bucket name: (width in microseconds, window duration).
BUCKETS = {"1m": (MINUTE, "1 minute"), "5m": (5 * MINUTE, "5 minutes"), "1h": (HOUR, "1 hour"), "1d": (DAY, "1 day")}
GROUPS = ("service", "level")

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType(), False), True),
    ]
)
TIER = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("cnt", T.LongType(), False),
    ]
)
#: The attribute index: a hash of key and value, the hour, and how many rows have them.
KEYS = T.StructType([T.StructField("kv", T.LongType(), False), T.StructField("bucket_start", T.TimestampType(), False), T.StructField("cnt", T.LongType(), False)])
PARTITIONS = T.StructType([T.StructField("day", T.DateType(), False), T.StructField("batch_id", T.LongType(), False)])


def stored(schema: T.StructType) -> T.StructType:
    """A dataset's schema with the columns that its directories stand for."""
    return T.StructType(schema.fields + PARTITIONS.fields)
