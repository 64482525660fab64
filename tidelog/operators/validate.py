"""Entries to typed rows or reasons for rejecting them, as one projection.

Rules are checked in the order of RULES and the first that fails gives the reason. Choices where
nothing prescribes one: null attributes count as absent, a null attribute value is an unsupported
type, exactly five minutes ahead is accepted, integers keep all their digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.numbers import plain_number
from tidelog.functions.timebins import at
from tidelog.schema import LEVELS, MINUTE

AHEAD = 5 * MINUTE
MOST_KEYS, LONGEST_KEY, LONGEST_VALUE = 128, 128, 4096
ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}:\d{2})$"
NUL = "\u0000"


def _field(name: str) -> tuple[Column, Column]:
    """(kind, text) of an entry's field; no kind where it is missing or the entry isn't an object."""
    value = F.try_variant_get("entry", f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    return kind, F.when(kind == "STRING", F.try_variant_get("entry", f"$.{name}", "string"))


def _text(value: Column) -> Column:
    """An attribute's value as text: strings as they are, true and false, numbers the plain way."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "string")
    return F.when(kind.isin("STRING", "BOOLEAN", "BIGINT"), whole).otherwise(plain_number(F.try_variant_get(value, "$", "double")))


def validate(entries: DataFrame, batch_now: int) -> DataFrame:
    """`entries` has a VARIANT column `entry`; the result adds `reason` (null: accepted) and the
    typed columns timestamp, level, service, message, attributes. `batch_now` is the batch's own
    clock, so that a replay decides alike."""
    time_kind, time = _field("timestamp")
    level_kind, level = _field("level")
    _, service = _field("service")
    _, message = _field("message")
    given = F.try_variant_get("entry", "$.attributes", "variant")
    kind = F.schema_of_variant(given)
    held = given.try_cast("map<string,variant>")
    typed = entries.select(
        "*",
        time_kind.alias("_time_kind"), time.alias("_time"), F.when(time.rlike(ISO), F.replace(time, F.lit(","), F.lit(".")).try_cast("timestamp")).alias("timestamp"),
        level_kind.alias("_level_kind"), F.to_json(F.try_variant_get("entry", "$.level", "variant")).alias("_level_json"), level.alias("level"),
        service.alias("service"), message.alias("message"),
        kind.alias("_attr_kind"), held.alias("_held"),
    )
    typed = typed.withColumn("_odd", F.exists(F.map_values("_held"), lambda v: v.isNull() | F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)")))
    values = F.transform_values("_held", lambda k, v: _text(v))
    empty = F.create_map().cast("map<string,string>")
    typed = typed.withColumn("attributes", F.when(F.col("_held").isNull() | F.col("_odd"), empty).otherwise(values))
    absent = F.col("_attr_kind").isNull() | (F.col("_attr_kind") == "VOID")
    too_long = F.exists(F.map_values("attributes"), lambda v: F.length(v) > LONGEST_VALUE)
    rules: list[tuple[Column, Column]] = [
        (F.col("_time_kind").isNull(), F.lit("timestamp is required")),
        (F.col("timestamp").isNull(), F.concat(F.lit("invalid timestamp: "), F.to_json(F.try_variant_get("entry", "$.timestamp", "variant")))),
        (F.col("timestamp") > at(batch_now + AHEAD), F.lit("timestamp is more than five minutes in the future")),
        (F.col("_level_kind").isNull(), F.lit("level is required")),
        (F.col("level").isNull() | ~F.col("level").isin(*LEVELS), F.concat(F.lit("invalid level: "), F.col("_level_json"))),
        (F.coalesce(F.length("service"), F.lit(0)) == 0, F.lit("service must be a non-empty string")),
        (F.coalesce(F.length("message"), F.lit(0)) == 0, F.lit("message must be a non-empty string")),
        (F.contains("service", F.lit(NUL)), F.lit("service contains a NUL character")),
        (F.contains("message", F.lit(NUL)), F.lit("message contains a NUL character")),
        (~absent & ~F.col("_attr_kind").startswith("OBJECT"), F.lit("attributes: unsupported value type")),
        (F.col("_odd"), F.lit("attributes: unsupported value type")),
        (F.size("attributes") > MOST_KEYS, F.lit(f"attributes has more than {MOST_KEYS} keys")),
        (F.exists(F.map_keys("attributes"), lambda k: F.length(k) > LONGEST_KEY), F.lit(f"attribute key exceeds {LONGEST_KEY} characters")),
        (too_long, F.lit(f"attribute value exceeds {LONGEST_VALUE} characters")),
        (F.exists(F.map_values("attributes"), lambda v: F.contains(v, F.lit(NUL))), F.lit("attribute value contains a NUL character")),
    ]
    reason = F.coalesce(*(F.when(fails, why) for fails, why in rules))
    kept = [*entries.columns, "timestamp", "level", "service", "message", "attributes"]
    return typed.select(*kept, reason.alias("reason"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("reason is null")


def rejected(checked: DataFrame) -> DataFrame:
    """(index, reason), the index counted from 0 within its batch."""
    return checked.where("reason is not null").select(F.col("pos").cast("long").alias("index"), "reason")
