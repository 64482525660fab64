import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 8000
#: (doc_id, text, source): nulls, empty and very long texts, ties, repeated rows.
ROWS = [
    (1, "", "a"), (2, None, "a"), (3, "alpha beta gamma delta epsilon zeta", "a"), (3, "alpha beta gamma delta epsilon zeta", "a"),
    (4, " alpha beta gamma\ndelta epsilon zeta", "b"), (5, "alphabetagammadelta epsilonzeta", None), (None, "alpha beta gamma delta epsilon zeta", "b"),
    (6, LONG, "b"), (7, LONG + "tail", "b"), (8, "x", ""), (9, "   ", "c"), (10, "don't <|endoftext|> you're　日本語 १२३ 🙂", "c"), (None, None, None), (11, "é" * 3000, "c"),
    (12, "one two", "d"), (13, "one two", "d"), (14, "one two three", "e"),
]
CLASHES = ["row", "__row", "size", "kept", "n", "key", "id", "taken", "bucket", "score", "label", "count", "part", "words"]


@pytest.fixture
def folder(tmp_path):
    """A folder of tables from rows: documents with extra columns whose names the operators use inside."""

    def make(rows=ROWS, labels=(), vectors=(), turns=()):
        ids, texts, sources = list(zip(*rows)) if rows else ([], [], [])
        base = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None] * len(rows), pa.string()), "source": pa.array(sources, pa.string())}
        base["n_chars"] = pa.array([len(t) if t else None for t in texts], pa.int64())
        extra = {c: pa.array([-1] * len(rows), pa.int32()) for c in CLASHES}
        pq.write_table(pa.table(base | extra), tmp_path / "documents.parquet")
        cols = list(zip(*labels)) if labels else ([], [], [])
        pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "quality", "toxic"), cols, (pa.int64(), pa.int32(), pa.int32()))}), tmp_path / "labels.parquet")
        cols = list(zip(*vectors)) if vectors else ([], [])
        pq.write_table(pa.table({"vec_id": pa.array(cols[0], pa.int64()), "embedding": pa.array(cols[1], pa.list_(pa.float32())), "row": pa.array([0] * len(vectors))}), tmp_path / "embeddings.parquet")
        cols = list(zip(*turns)) if turns else ([], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(("conv_id", "turn", "role", "text"), cols, kinds)}), tmp_path / "conversations.parquet")
        return str(tmp_path)

    return make


@pytest.fixture
def rng():
    return np.random.default_rng(5)
