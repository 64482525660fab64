"""Folders for tables that live as long as the application, in the store that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset, which only a local master allows, as in tests, a temporary
    folder: on a cluster each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidelog-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
