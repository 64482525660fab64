"""Every registered log query against its SQL."""

import subprocess
import sys

import pytest

import __spark_entry__
from tests.conftest import DATA, ROOT
from tidelog import queries

SMALL = str(DATA / "sf0.001")


def test_each_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, same_as_sql, name):
    same_as_sql(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


def test_merge_counts_every_id(spark, monkeypatch):
    rows = [(i, "auth", "error") for i in (None, -3, -2, -1, 0, 1, 2)]
    logs = spark.createDataFrame(rows, "id long, service string, level string").selectExpr("*", "timestamp '2024-01-05 10:00:15' AS `timestamp`")
    monkeypatch.setattr(queries.fixtures, "logs", lambda *_: logs)
    assert [r.cnt for r in queries.QUERIES["rollup_merge"](spark, SMALL).collect()] == [len(rows)]


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["bucket_start", "grp", "cnt"] and rows.count() > 0


def test_entry_without_llm(tmp_path):
    """The module imports, and has the log queries, where llm and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "tidelog", tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'agg_1m_service' in n and not any(x.startswith('op') for x in n) and 'pipeline' not in n; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def test_what_llm_needs_is_not_optional(tmp_path):
    """A package that is missing is an error, not a shorter list of queries."""
    import shutil

    shutil.copytree(ROOT / "tidelog", tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "tidelog" / "llm").mkdir()
    (tmp_path / "tidelog" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidelog" / "llm" / "queries.py").write_text("import no_such_package\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode and "no_such_package" in done.stderr

