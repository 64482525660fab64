import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.sql.maxMetadataStringLength": "5000", "spark.driver.host": "127.0.0.1",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def same_as_sql():
    """Assert that a query's rows are those of its SQL over the tables of a folder."""
    import duckdb

    def check(rows, sql, folder):
        con = duckdb.connect()
        for t in TABLES:
            if (Path(folder) / f"{t}.parquet").exists():
                con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        found = con.sql(sql)
        columns = sorted(found.columns)
        assert sorted(rows.columns) == columns
        place = [found.columns.index(c) for c in columns]
        want = sorted(repr(tuple(r[i] for i in place)) for r in found.fetchall())
        got = sorted(repr(tuple(r)) for r in rows.select(*columns).collect())
        assert got == want

    return check
