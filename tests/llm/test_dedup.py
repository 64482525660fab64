"""Exact and near deduplication, and what they are made of."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import DATA
from tests.llm.conftest import ROWS
from tidelog.llm import exact_dedup, graph, mixing, near_dedup, neighbours, queries, shared
from tidelog.llm.textscan import chunks


def test_exact_is_its_sql(spark, folder, same_as_sql):
    unique = list({r[0]: r for r in ROWS if r[0] is not None}.values())
    for path in (folder(unique), folder([]), str(DATA / "sf0.001")):
        same_as_sql(queries.op9(spark, path), queries.OP9_SQL, path)


def test_exact_repeats_nulls_and_ties(spark, folder):
    rows = queries.op9(spark, folder()).collect()
    assert len(rows) == len(ROWS)
    alpha = [r for r in rows if r.group_size == 5 and r.keep_id == 4]
    assert sum(r.kept for r in alpha) == 1 and [r.doc_id for r in alpha if r.kept] == [4]
    empty = [r for r in rows if r.doc_id in (1, 2, 9)]
    assert {r.keep_id for r in empty} == {9}
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})


def test_exact_keeps_columns(spark, folder):
    docs = spark.read.parquet(folder() + "/documents.parquet")
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in ROWS})


def test_bytes_decide_where_hashes_collide(spark, folder, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_hash", lambda norm: len(norm) % 2)
    rows = [(i, f"text {i % 7}", "s") for i in range(40)]
    docs = spark.read.parquet(folder(rows) + "/documents.parquet")
    found = [r for part in [exact_dedup.exact_dedup(docs, capacity=2).collect()] for r in part]
    assert {r.doc_id: r.keep_id for r in found} == {i: i % 7 for i in range(40)}


@pytest.mark.parametrize("keys", [[], [5], list(range(100)), [7] * 500 + [2**63 - 1, -1], [random.Random(1).randrange(-(2**63), 2**63) for _ in range(800)]])
def test_directory(spark, keys):
    entries = spark.createDataFrame([(k,) for k in keys], "key long")
    d = exact_dedup.directory(entries, len(keys), 16)
    unsigned = np.array(keys, np.int64).view(np.uint64)
    held = Counter(d.bucket(unsigned).tolist())
    for i, leaf in enumerate(d.leaves):
        assert held.get(i, 0) == leaf.entries
        assert leaf.entries <= 16 or leaf.chain
        assert all(int(k) >> (64 - leaf.depth) == leaf.prefix if leaf.depth else True for k, b in zip(unsigned, d.bucket(unsigned)) if b == i)
        assert d.owner(leaf.low) is leaf
    assert sum(2.0**-x.depth for x in d.leaves) == 1


@pytest.mark.parametrize("contract", [1_000_000, 9])
def test_components(spark, monkeypatch, contract):
    monkeypatch.setattr(graph, "CONTRACT", contract)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)} | {201: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lookup_of_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(1 if i % 3 else i,) for i in range(300)], "k long")
    counts = rows.groupBy("k").count()
    out = shared.lookup(rows, counts, ["k"], "count", 300).collect()
    assert Counter(r.k for r in out) == {r.k: r["count"] for r in out}


def test_release(spark):
    kept = shared.stored(spark.range(5), "five")
    assert kept.count() == 5
    shared.release(spark)
    with pytest.raises(Exception, match="FILE|exist"):
        spark.read.parquet(kept.inputFiles()[0])
    assert shared.stored(spark.range(5), "five").count() == 5


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(texts, similar=0.8):
    """Classes by plain comparison of all pairs that share a shingle, all weights of rare shingles being equal."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    having, seen = defaultdict(list), set()
    for i, s in enumerate(sets):
        for g in s:
            for j in having[g]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    if sum((sets[i] & sets[j]).values()) >= similar * sum((sets[i] | sets[j]).values()):
                        root[top(i)] = top(j)
            having[g].append(i)
    out = defaultdict(set)
    for i in range(len(texts)):
        out[top(i)].add(i)
    return {frozenset(x) for x in out.values()}


def classes(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.class_id].add(r.doc_id)
    assert all(r.class_size == len(out[r.class_id]) and r.class_id == min(out[r.class_id]) for r in rows)
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(out)
    return {frozenset(x) for x in out.values()}


def test_near_documents(spark):
    folder = str(DATA / "sf0.001")
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id)
    want = {frozenset(docs[i].doc_id for i in c) for c in brute([d.text for d in docs])}
    assert classes(queries.op10(spark, folder).collect()) == want


def test_near_edges(spark, folder):
    rows = queries.op10(spark, folder()).collect()
    assert len(rows) == len(ROWS)
    alpha = [r for r in rows if r.class_size == 4]
    assert {r.doc_id for r in alpha} == {3, 4, None} and sum(r.kept for r in alpha) == 1 and {r.class_id for r in alpha} == {3}
    assert [r.class_id for r in rows if r.doc_id in (12, 13)] == [12, 12] and [r.class_id for r in rows if r.doc_id == 14] == [14]
    assert {r.class_size for r in rows if r.doc_id in (1, 2, 9)} == {1}
    assert {r.class_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert queries.op10(spark, folder([])).count() == 0
    docs = spark.read.parquet(folder() + "/documents.parquet")
    assert near_dedup.keep_one(docs).columns == docs.columns


def idf_brute(texts, similar=0.8):
    """Classes by weights from exact document counts, over all pairs."""
    sets = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for t in texts]
    seen = Counter(g for s in sets for g in s)
    weight = {g: np.log1p(len(texts) / max(n, len(texts) / near_dedup.RARE)) for g, n in seen.items()}
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j]:
            both = sum(weight[g] * n for g, n in (sets[i] & sets[j]).items())
            if both >= similar * sum(weight[g] * n for g, n in (sets[i] | sets[j]).items()):
                root[top(i)] = top(j)
    out = defaultdict(set)
    for i in range(len(texts)):
        out[top(i)].add(i)
    return {frozenset(x) for x in out.values()}


def test_idf_decides_classes(spark, folder):
    """A passage of most texts: pairs that share little else are alike by plain counts and not by weights; pairs that share rare words
    and differ in a part of the passage the other way round."""
    r = random.Random(8)
    own = lambda n: [f"r{r.randrange(10**9)}" for _ in range(n)]
    passage = own(100)
    texts = [" ".join(own(200) + passage + own(200)) for _ in range(120)]
    common = [" ".join(passage + own(9)) for _ in range(2)]
    rare = own(60)
    apart = [" ".join(rare + passage[:30]), " ".join(rare)]
    texts += common + apart
    plain, want = brute(texts), idf_brute(texts)
    a, b = frozenset({120, 121}), frozenset({122, 123})
    assert a in plain and b not in plain and a not in want and b in want
    assert classes(queries.op10(spark, folder([(i, t, "s") for i, t in enumerate(texts)])).collect()) == want


def made(group, others, seed=3):
    """`group` near copies of one text, and unlike texts that share a passage with it."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(group):
        t = base[:]
        t[r.randrange(120)] = f"c{i}"
        out.append(" ".join(t))
    for i in range(others):
        out.append(" ".join([f"o{r.randrange(10**6)}" for _ in range(60)] + base[:25]))
    return out


def test_near_large_group(spark, folder, monkeypatch):
    """Small limits, so that every way of splitting large buckets runs."""
    texts = made(120, 120)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    want = brute(texts)
    assert classes(queries.op10(spark, folder(rows)).collect()) == want
    monkeypatch.setattr(near_dedup, "TOGETHER", 3)  # also the pairs of a leader in a lot
    monkeypatch.setattr(near_dedup, "LEVELS", [(1, 9), (1, 9)])
    got = classes(queries.op10(spark, folder(rows)).collect())
    assert {c for c in got if len(c) > 1} == {c for c in want if len(c) > 1}


def test_sampling_estimates_weighted_jaccard(rng):
    h = rng.integers(0, 1 << 44, 300).astype(np.uint64)
    h.sort()
    w = rng.uniform(0.5, 8, 300)
    other = w * rng.uniform(0.6, 1.4, 300)
    a, b = (near_dedup.samples(h, x, np.array([0]), range(4000)) for x in (w, other))
    true = np.minimum(w, other).sum() / np.maximum(w, other).sum()
    assert abs((a == b).mean() - true) < 0.04
    assert near_dedup.similarity((h, w), (h, other)) == pytest.approx(true)


def test_shingles_of_a_chunk():
    texts = ["", "One two", "one, TWO", "a b c d e f a b c d e f", "!!", "a b c d e"]
    ((_, _, cps, bounds),) = chunks(texts)
    doc, h, times = near_dedup.shingles(cps, bounds)
    sets = [dict(zip(h[doc == i].tolist(), times[doc == i].tolist())) for i in range(len(texts))]
    assert sets[0] == sets[4] == {} and sets[1] == sets[2] and len(sets[1]) == 1
    assert sum(sets[3].values()) == 8 and sorted(sets[3].values()) == [1] * 4 + [2, 2] and set(sets[5]) < set(sets[3])


def test_numbers_hold_when_splits_change(spark, folder, monkeypatch):
    """Every table that is stored changes the splits of the scans after it, as a lost executor does."""
    rows = [(i, f"text {i % 45} " * 20 + " ".join(f"w{i % 45}x{k}" for k in range(30)), f"s{i % 3}") for i in range(400)]
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    path = folder(rows, vectors=vectors)
    for t in ("documents", "embeddings"):
        given = pq.read_table(f"{path}/{t}.parquet")
        pq.write_table(given, f"{path}/{t}.parquet", row_group_size=8, compression="none", use_dictionary=False)
    docs = spark.read.parquet(path + "/documents.parquet")
    runs = {
        "op9": lambda: queries.op9(spark, path), "op10": lambda: queries.op10(spark, path), "op1": lambda: queries.op1(spark, path).orderBy("query_id", "rank"),
        "keep_first": lambda: exact_dedup.keep_first(docs), "keep_one": lambda: near_dedup.keep_one(docs), "mixed": lambda: mixing.mixed(docs),
    }
    want = {k: sorted(map(repr, f().collect())) for k, f in runs.items()}
    sizes, plain = itertools.cycle(["4k", "40k", "9k"]), shared.stored

    def moving(df, name):
        out = plain(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    for m in (shared, exact_dedup, near_dedup, neighbours, mixing, graph):
        monkeypatch.setattr(m, "stored", moving)
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        wrong = []
        for k, f in runs.items():
            try:
                if sorted(map(repr, f().collect())) != want[k]:
                    wrong.append(k)
            except Exception as e:  # a row that is not found again
                wrong.append(f"{k}: {str(e)[:80]}")
        assert not wrong
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
