"""Token counts and packing against the tokenizers library."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ROWS
from tidelog.llm import packing, pieces, queries
from tidelog.llm.token_counts import Counter

PATH = public_tokenizers.path("byte_bpe_50k.json")
FILE = Path(PATH).read_bytes()
LIBRARY = Tokenizer.from_file(PATH)
COUNTER, IDS = Counter(FILE), packing.Ids(FILE)
ODD = ["", " ", "  ", "a  b", "it's 'tis don't we'll 'll  'll \n\n'sx you're I've'd x'", "a<|endoftext|><|endoftext|> b", "!'t !!'s", "\n\n\nabc \n d", "ab " * 300 + " ", "'", " '", "\x1c a", "a\xa0b"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_odd_texts():
    assert COUNTER.count(ODD).tolist() == [len(ids(t)) for t in ODD]
    assert [x.tolist() for _, x in IDS.of(ODD)] == [ids(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab's tre \n\t.,1é½日!　🙂"), max_size=40), max_size=6))
def test_any_texts(texts):
    assert COUNTER.count(texts).tolist() == [len(ids(t)) for t in texts]
    assert [x.tolist() for _, x in IDS.of(texts)] == [ids(t) for t in texts]


def test_merging_is_the_definition():
    """Brute force: scan for the lowest rank, leftmost, and merge, until none is left."""
    byte, pairs, _ = pieces.vocabulary(FILE)
    for word in (b" international", b"aaaaaaaaab", b"zzqx", b""):
        s = [byte[bytes([b])] for b in word]
        start = s[:]
        while found := [(pairs[a << 20 | b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a << 20 | b in pairs]:
            p, i = min(found)
            s[i : i + 2] = [p & 0xFFFFF]
        assert pieces.merged(start, pairs) == len(s)


def test_memory_is_bounded_and_right_after_eviction(monkeypatch):
    monkeypatch.setattr(pieces, "SLOTS", 4)
    small, texts = Counter(FILE), [f"word{i} other{i % 7}" for i in range(300)]
    assert small.count(texts).tolist() == [len(ids(t)) for t in texts]
    assert len(small.memory.keys) == 16


def test_counts(spark, folder):
    rows = queries.op5(spark, folder()).collect()
    want = sorted(((i or -1), len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t, _ in ROWS)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert queries.op5(spark, folder([])).count() == 0


def check_packed(rows, texts, most=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        want, at = [*ids(text), 0], 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : at], "<u4").tobytes())
        assert at == len(want)
    short = 0
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= most
        short += at < most
    assert short <= 1


def test_packing(spark, folder):
    texts = {i: t for i, t, _ in ROWS if i not in (3, None)}
    path = folder([r for r in ROWS if r[0] in texts])
    check_packed(queries.op8(spark, path).collect(), texts)
    assert queries.op8(spark, folder([])).count() == 0
    repeated = queries.op8(spark, folder()).collect()
    assert sum(r.length for r in repeated) == sum(len(ids(t)) + 1 for _, t, _ in ROWS)


def test_packing_of_many_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    rows = [(i, f"word{i} " * (i % 37)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(14).write.parquet(str(tmp_path / "d"))
    docs = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = packing.pack(docs, PATH, windows=2).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    check_packed(found, dict(rows))


@pytest.mark.parametrize("sizes", [[1024], [700, 700, 700], [5000, 1, 1], [1] * 2000])
def test_windows_stay_bounded(sizes):
    w, done = packing.Windows(1024, 4, 0), []
    for i, n in enumerate(sizes):
        done += list(w.add(i, np.arange(n, dtype=np.uint32)))
        assert len(w.open) <= 4
    assert sum(r[2] for r in [*done, *w.left()]) == sum(sizes)
