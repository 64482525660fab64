"""Quality, toxicity and search: accuracy on what was held out, and edges."""

import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm.conftest import ROWS
from tidelog.llm import labelled, neighbours, quality, queries, toxicity
from tidelog.llm.textscan import WHITE, chunks


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def check_scores(rows, n):
    assert len(rows) == n
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == held("" if r.doc_id is None else r.doc_id)


def accuracy(spark, rows, label, sf):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(str(DATA / sf / "labels.parquet")).collect()}
    found = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return np.mean([a == b for a, b in found]), np.mean([a for a, b in found if b == 1])


def test_quality_held_out(spark):
    rows = queries.op2(spark, str(DATA / "sf0.01")).collect()
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    right, _ = accuracy(spark, rows, "quality", "sf0.01")
    assert right > 0.97


def test_toxicity_held_out(spark):
    rows = queries.op6(spark, str(DATA / "sf0.1")).collect()
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    right, recall = accuracy(spark, rows, "toxic", "sf0.1")
    assert right > 0.97 and recall > 0.8


@pytest.mark.parametrize("f", [queries.op2, queries.op6])
def test_score_edges(spark, folder, f):
    labels = [(1, 1, 0), (3, 1, 1), (3, 1, 1), (6, 0, None), (8, None, 0), (None, 1, 1), (10, 0, 1), (77, 1, 0), (12, 0, 0)]
    check_scores(f(spark, folder(labels=labels)).collect(), len(ROWS))
    check_scores(f(spark, folder()).collect(), len(ROWS))
    assert f(spark, folder([], labels)).count() == 0


def test_training_rows(spark, folder):
    path = folder([(i, f"t{i}", "s") for i in range(3000)] + [(5, "again", "s")] * 50, [(i, i % 2, 0) for i in range(3000)] * 2)
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    every = labelled.training_rows(docs, labels, "quality", 10_000).collect()
    assert sorted(r.doc_id for r in every) == [i for i in range(3000) if not held(i)]
    assert 100 < labelled.training_rows(docs, labels, "quality", 300).count() < 500


def test_discriminant_is_the_gaussian_formula(rng):
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], [200, 300])
    m = quality.Discriminant.fit(x, y, pool=0.0, ridge=0.0)
    logs = []
    for k, share in ((0, 0.4), (1, 0.6)):
        p = x[y == k]
        cov = np.cov(p.T, bias=True)
        d = x - p.mean(0)
        logs.append(np.log(share) - 0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_do_not_depend_on_the_chunk():
    texts = [t for _, t, _ in ROWS] + ["A!! B!!\nA!! B!!\n"]
    whole = np.concatenate([quality.statistics(c, b) for _, _, c, b in chunks(texts)])
    alone = np.concatenate([quality.statistics(c, b) for t in texts for _, _, c, b in chunks([t])])
    assert np.allclose(whole, alone) and np.isfinite(whole).all()


def measured(text):
    """The sixteen statistics in plain Python."""
    cat = [unicodedata.category(c)[0] for c in text]
    white = [ord(c) in WHITE for c in text]
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans, at = [], None
    for i in range(len(text) + 1):
        if i < len(text) and not white[i]:
            at = i if at is None else at
        elif at is not None:
            spans.append((at, i))
            at = None
    words, chars, letters = [low[a:b] for a, b in spans], max(len(text), 1), sum(k == "L" and not w for k, w in zip(cat, white))
    lines = [x.rstrip("\n") for x in re.findall(r"[^\n]*\n|[^\n]+", low) if len(x) > 1]
    n, m = len(words), len(lines)
    share = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    return [
        math.log1p(n), math.log1p(letters / max(n, 1)), share(sum(len(w) > 12 for w in words), n), share(sum(c.isupper() for c in text), letters), share(cat.count("N"), chars),
        share(sum(k not in "LN" and not w for k, w in zip(cat, white)), chars), share(sum(c in "#$%&*@^~_=+<>" for c in text), chars), share(text.count("|"), chars), share(text.count("!"), chars), share(text.count("."), n), share(text.count(","), n),
        share(sum(text[a].isupper() for a, _ in spans), n), share(sum(a == b for a, b in zip(words, words[1:])), n), share(len(set(words)), n) / max(1, math.log(n + 2)), share(m - len(set(lines)), m), math.log1p(n / max(m, 1)),
    ]


def test_statistics_are_what_they_say():
    r = random.Random(12)
    bits = ["a", "Ab", "the the", " ", "\n", "\n\n", ".", ", ", "!", "|", "#$", "12", "３", "Ünïcode", "日本語", "🙂", "\u3000", "\t", "\x00", "longer-than-twelve", "İ", "ß", "\u2028"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300)] + [t or "" for _, t, _ in ROWS]
    found = np.concatenate([quality.statistics(c, b) for _, _, c, b in chunks(texts)])
    assert np.allclose(found, [measured(t) for t in texts])


def test_fit_on_huge_texts(spark, folder):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(90)], k=300_000 if i in (3, 8) else 40)) + (". you vrutz" if i % 2 else ". fine"), "s") for i in range(120)]
    out = queries.op6(spark, folder(rows, [(i, 1, i % 2) for i in range(120)])).collect()
    assert [x.doc_id % 2 for x in out] == [x.predicted for x in out] and len(out) == 120


def grammar(*insults):
    k = np.sort(toxicity._hashes(list(insults)))
    fixed = [(s, w) for s, line in toxicity.WORDS.items() for w in line.split()]
    keys, first = np.unique(np.concatenate([k, toxicity._hashes([w for _, w in fixed])]), return_index=True)
    symbols = np.array([toxicity.INSULT] * len(k) + [s for s, _ in fixed], np.int8)
    return toxicity.Grammar(keys, symbols[first], np.ones(len(keys)))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("what a gronk", "insult"), ("What a GRONK!", "insult"), ("you are a gronk", "insult at a target"), ("not a gronk", "insult, negated"), ("not one of the many gronk", "insult"),
        ("it said gronk", "insult, reported"), ("not so. gronk", "insult"), ("they said. gronk", "insult"), ("kill", "threat"), ("kill you", "threat at a target"), ("not kill", "threat, negated"), ("gronky", None), ("", None), ("you not said", None),
    ],
)
def test_clauses(text, kind):
    found = np.zeros(len(toxicity.KINDS))
    for _, _, cps, bounds in chunks([text]):
        found = grammar("gronk").matches(cps, bounds)[0]
    assert [k for k, v in zip(toxicity.KINDS, found) if v] == ([kind] if kind else [])


def acceptor(clause):
    """Kinds of a clause by regular expressions over one letter a word."""
    letters = "".join({"gronk": "i", "kill": "h", "you": "t", "not": "n", "said": "r"}.get(w, "p") for w in clause)
    at = len(toxicity.KINDS) // 2 * ("t" in letters)
    out = set()
    for m in re.finditer("[ih]", letters):
        before = letters[: m.start()]
        how = 2 if "r" in before else 1 if re.search("n.?.?$", before) else 0
        out.add(toxicity.KINDS[at + 3 * (m[0] == "h") + how])
    return out


def test_grammar_is_the_acceptor():
    r, g = random.Random(3), grammar("gronk")
    texts = [[[r.choice(["gronk", "kill", "you", "not", "said", "word", "more"]) for _ in range(r.randrange(1, 9))] for _ in range(r.randrange(1, 4))] for _ in range(800)]
    found = np.concatenate([g.matches(cps, bounds) for _, _, cps, bounds in chunks([". ".join(" ".join(c) for c in t) for t in texts])])
    for t, row in zip(texts, found):
        want = [kind for c in t for kind in acceptor(c)]
        assert {k for k, v in zip(toxicity.KINDS, row) if v} == set(want)


def test_transducers_read_each_other():
    _, writes, parts = toxicity.compose(toxicity.negations, toxicity.reports, toxicity.targets)
    assert {p[1] for p in parts} == {0, 1} and set(writes.ravel().tolist()) == set(range(10))
    alone, *_ = toxicity.compose(toxicity.reports)
    assert len(alone) == 2 < len(parts)


def spoken(r, n):
    """Texts of which a quarter holds an insult, and one in ten of the others one that is negated or reported."""
    common = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        said = ["you {0}", "you are a {0}", "what a {0}"] if i % 4 == 0 else ["not a {0}", "you are no {0}", "they said {0}", "he called her {0} loudly"]
        filler = [" ".join(r.choices(common, k=6)) for _ in range(4)]
        if i % 4 == 0 or i % 13 == 1:
            filler.insert(2, r.choice(said).format(r.choice(["vrutz", "gronk", "blarg"])))
        out.append((". ".join(filler), int(i % 4 == 0)))
    return out


def test_the_grammar_changes_verdicts(rng):
    """An ablation: with the transducers the same lexicon tells insults from negated and reported ones; sums of its words can't."""
    r = random.Random(6)
    texts, toxic = zip(*spoken(r, 3000))
    g = toxicity.learn(list(texts), np.array(toxic))
    new, truth = zip(*spoken(r, 1500))
    truth = np.array(truth)
    x = toxicity._matched(list(new), g)
    by_clauses = g.score(x) >= 0.7
    words_only = x.sum(1)
    best = max(((words_only >= t) == truth).mean() for t in np.unique(words_only))
    assert (by_clauses == truth).mean() > 0.98 > 0.95 > best


def test_learned_targets_and_threats():
    r = random.Random(9)
    common = [f"word{i}" for i in range(80)]
    texts, toxic = [], []
    for i in range(900):
        c = [" ".join(r.choices(common, k=7)) for _ in range(3)]
        if i % 3 == 0:
            c.insert(1, r.choice(["zorgs {0} vrutz", "we will snarf {0} zorgs"]).format(r.choice(common)) if i % 2 else "snarf you now")
        texts.append(". ".join(c))
        toxic.append(int(i % 3 == 0))
    g = toxicity.learn(texts, np.array(toxic))
    of = dict(zip(g.keys.tolist(), g.symbols.tolist()))
    key = lambda w: int(toxicity._hashes([w])[0])
    assert of[key("vrutz")] == toxicity.INSULT and of[key("snarf")] in (toxicity.INSULT, toxicity.THREAT)
    assert key("word3") not in of


def test_fit_on_executors_is_the_fit_on_the_driver(spark):
    folder = str(DATA / "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted(labelled.training_rows(docs, labels, "toxic", 10**6).collect(), key=lambda r: r.doc_id)
    a, b = toxicity.fit(docs, labels), toxicity.learn([r.text for r in rows], np.array([r.label for r in rows]))
    assert (a.keys == b.keys).all() and (a.symbols == b.symbols).all() and np.allclose(a.loads, b.loads)
    assert np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias)


def test_lexicon_learns_words_and_beginnings(rng):
    common = [f"word{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(600):
        w = list(rng.choice(common, 30))
        if i % 5 == 0:
            w[3] = f"vrutz{'abcdefgh'[i % 8]}x{i % 8}"
        texts.append(" ".join(w))
        toxic.append(i % 5 == 0)
    g = toxicity.learn(texts, np.array(toxic))
    ((_, _, cps, bounds),) = chunks(["a vrutzgg word1", "a word2"])
    a, b = g.score(g.matches(cps, bounds))
    assert a > 0.7 > 0.3 > b


def test_clean_documents_stay_as_they_are(spark, folder):
    docs = spark.read.parquet(folder([(1, "you gronk", "s"), (2, "fine", None), (3, None, "s")]) + "/documents.parquet")
    model = grammar("gronk")
    model.weights = model.weights * 10
    assert sorted(toxicity.keep_clean(docs, model).collect()) == sorted(docs.where("doc_id > 1").collect())


def brute_nearest(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(good):
        if i % 100 == 0:
            out.setdefault(i, []).append(sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for n, (j, w) in enumerate(good) if n != at)[:k])
    return out


def test_search_edges(spark, folder, rng):
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0] * 7 + [None]), (304, [1.0] * 7 + [float("nan")]), (305, [float("inf")] * 8), (306, [1.0] * 9), (None, [1.0] * 8), (100, rows[100][1])]
    want = brute_nearest(rows)
    got = {}
    for r in queries.op1(spark, folder(vectors=rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == set(want) == {0, 100, 200, 1000}
    for q, lists in want.items():
        near = sorted(x for x in got[q])
        assert len(near) == 10 * len(lists)
        assert sorted(i for _, _, i in near) == sorted(i for one in lists for _, i in one)
    assert [i for _, _, i in sorted(got[0])] == list(range(1000, 1010))
    assert queries.op1(spark, folder(vectors=[])).count() == 0
    assert queries.op1(spark, folder(vectors=[(0, None)])).count() == 0
    assert [r.vec_id for r in queries.op1(spark, folder(vectors=rows[:3])).orderBy("rank").collect()] == [i for _, i in brute_nearest(rows[:3])[0][0]]


def test_search_recall(spark):
    folder = str(DATA / "sf0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = total = 0
    got = {}
    for r in queries.op1(spark, folder).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        true = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + len(set(true.tolist()) & set(got[ids[q]])), total + 10
    assert hits / total >= 0.9


@pytest.mark.parametrize("odd", [1e20, 3e37, 1e-20, 1e-40])
def test_search_beside_odd_sizes(spark, folder, rng, odd):
    """A few huge or tiny finite vectors leave the shortlists of the others as good as they were, and are found themselves."""
    x = (rng.normal(size=(40, 8)).repeat(40, 0) + 0.1 * rng.normal(size=(1600, 8))).astype(np.float32)
    x[[5, 700, 800]] *= np.float32(odd)
    x[900, 3] = np.float32(odd)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute_nearest(rows), {}
    docs = spark.read.parquet(folder(vectors=rows) + "/embeddings.parquet")
    for r in neighbours.nearest(docs, docs.vec_id % 100 == 0, shortlist=40, books=8).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {i for _, i in near}) for q, (near,) in want.items()]
    assert sum(hits) >= 0.97 * 10 * len(want) and len(want) == 16


@pytest.mark.parametrize(("part", "block", "vectors", "queries"), [(64, 3, 1 << 21, 5), (50, 128, 100, 1 << 13)])
def test_search_does_not_depend_on_the_deal(spark, folder, rng, monkeypatch, part, block, vectors, queries):
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    docs = spark.read.parquet(folder(vectors=rows) + "/embeddings.parquet")
    run = lambda: neighbours.nearest(docs, docs.vec_id % 20 == 0, shortlist=30, books=8).orderBy("query_id", "rank").collect()
    want = run()
    for name, n in (("PART", part), ("BLOCK", block), ("VECTORS", vectors), ("QUERIES", queries)):
        monkeypatch.setattr(neighbours, name, n)
    assert run() == want and len(want) == 10 * 60


def test_search_beside_clashing_columns(spark, rng):
    names = ["row", "id", "v", "asks", "part", "group", "split", "side", "block", "ask", "near", "rank", "score", "query_id", "uses"]
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    run = lambda df: df.orderBy("query_id", "rank").collect()
    wide = plain.selectExpr("*", *(f"-1 AS {n}" for n in names))
    want = run(neighbours.nearest(plain, plain.vec_id % 10 == 0, k=3, books=4))
    assert run(neighbours.nearest(wide, wide.vec_id % 10 == 0, k=3, books=4)) == want and len(want) == 9


def test_lengths_of_any_size():
    x = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [-5e-324, 0.0]])
    assert np.allclose(neighbours.lengths(x)[:3] / [5e200, 5e-200, 5], 1) and neighbours.lengths(x)[3] == 5e-324


def test_encoding_finds_sums_of_words(rng):
    x = rng.normal(size=(600, 16)).astype(np.float32)
    c = neighbours.Codebooks.fit(x, books=6, words=16, rounds=2)
    error = [((x - c.decode(c.encode(x, beam))) ** 2).sum() for beam in (1, 8)]
    assert error[1] <= error[0] < 0.9 * (x**2).sum()
    codes = c.encode(x)
    norms = (c.decode(codes) ** 2).sum(1)
    direct = ((x[5] - c.decode(codes)) ** 2).sum(1) - (x[5] ** 2).sum()
    assert np.allclose(neighbours.lookups(c.tables(x[5:6])[0], codes, norms), direct, atol=1e-3)
