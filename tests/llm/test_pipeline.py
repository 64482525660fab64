"""The corpus pipeline, stage by stage, and its registration."""

import os

import __spark_entry__
import corpus_pipeline
from tests.conftest import DATA
from tests.llm.conftest import ROWS
from tidelog.llm import shared


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) == 10
    assert set(__spark_entry__.oracle_sql()) <= names


def test_stages(spark, tmp_path):
    folder = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first, names = docs.columns, []
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        names.append(name)
        counts.append(docs.count())
        if name != "pack":
            assert docs.columns == first
    assert names == ["toxicity", "exact dedup", "near dedup", "mix sources", "pack"]
    assert counts[0] >= counts[1] > counts[2] >= counts[3]
    lengths = {}
    for r in docs.collect():
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert sum(n < 1024 for n in lengths.values()) <= 1


def test_toxic_documents_go(spark):
    folder = str(DATA / "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).select("doc_id").collect()}
    marked = [{r.doc_id for r in labels.join(docs.select("doc_id"), "doc_id", "left_semi").where(f"toxic = {k}").collect()} for k in (0, 1)]
    assert len(marked[1]) > 20 and len(kept) < docs.count()
    assert len(marked[1] - kept) > 0.8 * len(marked[1]) and len(marked[0] & kept) > 0.97 * len(marked[0])


def test_run_leaves_its_result_alone(spark):
    """Run twice, on a table with few labels: of all intermediate tables only the results stay, the first one too."""
    folder = str(DATA / "sf0.001")
    shared.release(spark)
    runs = [corpus_pipeline.run(spark, folder) for _ in range(2)]
    got = [sorted(r.asDict().items() for r in out.drop("sequence_id", "offset").collect()) for out in runs]
    assert got[0] == got[1] and len(got[0]) > 100
    assert len(os.listdir(shared.shared_dir(spark))) == 2


def test_pipeline_edges(spark, folder):
    """Odd rows, a table without rows, texts that are null, columns with the operators' own names."""
    labels = [(1, 1, 0), (3, 1, 1), (6, 0, 0)]
    for rows in (ROWS, [], [(1, None, None), (None, None, "a")], [(5, "one two three", "s")]):
        path = folder(rows, labels)
        docs = spark.read.parquet(f"{path}/documents.parquet")
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = kept.count()
            kept = shared.stored(stage(spark, kept, path), "kept")
            assert kept.columns == docs.columns and (name == "mix sources" or kept.count() <= before)
        assert (corpus_pipeline.run(spark, path).select("doc_id", "length").count() > 0) == any((t or "").split() for _, t, _ in rows)
    assert shared.stored(corpus_pipeline.drop_toxic(spark, docs, path), "kept").count() == 1


def test_stages_chained_without_writing(spark):
    folder = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chained = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, docs, folder), folder)
    assert 0 < chained.count() < docs.count()
