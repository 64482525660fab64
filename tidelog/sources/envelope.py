"""Request bodies to entries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import BadRequest

#: The limits, and below the messages of the request contract.
MOST_ENTRIES = 10_000
MOST_BYTES = 5 << 20


def check_body(body: str | bytes, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> list:
    """The entries of one request body, or BadRequest. This is the driver-side guard of a single
    request; files and streams go through `exploded` alone."""
    raw = body.encode() if isinstance(body, str) else body
    if len(raw) > most_bytes:
        raise BadRequest("request body too large")
    try:
        held = json.loads(raw, parse_constant=_no_json)
    except ValueError as e:
        raise BadRequest(f"malformed JSON: {e}") from None
    if not isinstance(held, dict):
        raise BadRequest("request body must be a JSON object with a 'logs' array")
    logs = held.get("logs")
    if not isinstance(logs, list):
        raise BadRequest("'logs' must be an array")
    if not logs:
        raise BadRequest("'logs' must contain at least one entry")
    if len(logs) > most_entries:
        raise BadRequest(f"batch too large: {len(logs)} > {most_entries}")
    return logs


def _no_json(text: str):
    """NaN and the infinities, which Python reads."""
    raise ValueError(f"unexpected {text}")


def bodies(spark: SparkSession, texts: list[str], source: str = "") -> DataFrame:
    """(source, body) from texts that the driver holds."""
    return spark.createDataFrame([(f"{source}{i:06d}", t) for i, t in enumerate(texts)], "source string, body string")


def exploded(given: DataFrame) -> DataFrame:
    """(source, pos, entry) of every entry in bodies (source, body). Entries stay VARIANT, so that
    a field's own type can be checked; of a repeated key the last counts. A body that isn't JSON
    or has no array `logs` gives no entries."""
    given.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    logs = F.try_variant_get(F.try_parse_json("body"), "$.logs", "variant")
    held = given.select("source", logs.try_cast("array<variant>").alias("logs"))
    return held.select("source", F.posexplode("logs").alias("pos", "entry"))
