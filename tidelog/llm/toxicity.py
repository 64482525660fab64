"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insults, and threats and targets beside short lists, by a lexicon learned from labels; negations and
reported speech by short lists. Three transducers are composed, each reading what the one before wrote: the first turns
insults and threats after a negation into negated ones, the second those after a word of saying into reported ones, the third
ends in a state that says whether the clause names a target. A clause matches the patterns of what it
holds, each with one weight however many words there are, and a logistic model over the documents' matched clauses gives the score.
A clause whose insult or threat names no target is a pattern of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.labelled import held_out, training_rows
from tidelog.llm.shared import stored
from tidelog.llm.textscan import LETTER, chunks, classes, lower, mix, prefix_hash, runs, span_hash

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 8_000
#: Word beginnings that may become entries, in code points; whole words always may.
STEMS = (4, 5, 6, 7)
#: Least log odds of an entry. Its log likelihood ratio must also exceed what the best of as many
#: candidates as there are would reach by chance.
LEAST_ODDS = 2.0
#: Of a learned word's places the share, and of these the number, right before a target from which on it is a threat.
BEFORE_TARGET, LEAST_PLACES = 0.5, 5
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: What the transducers write for insults and threats.
NEGATED_INSULT, NEGATED_THREAT, REPORTED_INSULT, REPORTED_THREAT = range(6, 10)

#: Words that threaten, name a target, negate, or report speech, in four languages.
WORDS = {
    THREAT: "kill hurt destroy strangle stab burn punish töte töten umbringen vernichten schlagen tuer tuerai frapper détruire matar mataré golpear destruir",
    TARGET: "you your yours he she they him her them du dich dir ihr euch sie er tu toi te vous ton votre il elle ils tú ti vosotros usted ustedes él ella ellos",
    NEGATION: "not no never neither nor isn't without nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin",
    REPORT: "said says say saying wrote claimed called quoted according sagte sagt schrieb behauptete zitiert dit disait écrit affirme selon dijo dice escribió afirma según",
}
#: Code points that end a clause.
ENDS = np.array([ord(c) for c in ".!?;:\n…"], np.uint32)


@dataclass(frozen=True)
class Transducer:
    """States from 0; `arcs[state, symbol]` is (next state, symbol written). Without an arc the symbol is written as it is, and
    the state is that of the arc for PLAIN, or stays."""

    arcs: dict[tuple[int, int], tuple[int, int]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        if arc := self.arcs.get((state, symbol)):
            return arc
        return self.arcs.get((state, PLAIN), (state, PLAIN))[0], symbol


_STRONG = {INSULT: (NEGATED_INSULT, REPORTED_INSULT), THREAT: (NEGATED_THREAT, REPORTED_THREAT)}
#: A negation holds for the three words after it.
negations = Transducer(
    {(s, NEGATION): (3, NEGATION) for s in range(4)} | {(s, PLAIN): (s - 1, PLAIN) for s in (1, 2, 3)} | {(s, x): (s - 1, to) for s in (1, 2, 3) for x, (to, _) in _STRONG.items()}
)
#: After a word of saying, the rest of the clause is someone's words, negated or not.
reports = Transducer({(0, REPORT): (1, REPORT)} | {(1, x): (1, to) for own, (negated, to) in _STRONG.items() for x in (own, negated)})
targets = Transducer({(0, TARGET): (1, TARGET)})


def compose(*machines: Transducer) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """One machine that writes what the last writes when each reads what the one before writes: next state and symbol written
    by (state, symbol read), and what each state is made of."""
    states, moves, writes = [(0,) * len(machines)], [], []
    for state in states:  # grows
        row, out = [], []
        for symbol in range(6):
            after = []
            for m, s in zip(machines, state):
                s, symbol = m.step(s, symbol)
                after.append(s)
            if tuple(after) not in states:
                states.append(tuple(after))
            row.append(states.index(tuple(after)))
            out.append(symbol)
        moves.append(row)
        writes.append(out)
    return np.array(moves), np.array(writes), states


MOVES, WRITES, PARTS = compose(negations, reports, targets)
MOVES_L, WRITES_L = MOVES.tolist(), WRITES.tolist()
#: The patterns of a clause: insult or threat, plain, negated or reported; each without and with a target.
KINDS = [f"{what}{how}{to}" for to in ("", " at a target") for what in ("insult", "threat") for how in ("", ", negated", ", reported")]
#: Places in KINDS of what is written, without a target.
PLACE = {INSULT: 0, NEGATED_INSULT: 1, REPORTED_INSULT: 2, THREAT: 3, NEGATED_THREAT: 4, REPORTED_THREAT: 5}
#: The logistic weights that hold where labels say nothing; the fit is drawn to them. Negation and report take off.
PRIOR = np.array([1.5, -0.5, -0.5, 0.5, -0.5, -0.5, 2.0, -0.5, -0.5, 1.5, -0.5, -0.5])
BIAS = -4.0


def _hashes(words: list[str]) -> np.ndarray:
    cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return span_hash(prefix_hash(cps), ends - [len(w) for w in words], ends) if words else np.zeros(0, np.uint64)


_STEM = np.uint64(0x5851F42D4C957F2D)


def _stem(h: np.ndarray) -> np.ndarray:
    """Keys of word beginnings, other than those of whole words."""
    return mix(h ^ _STEM)


@dataclass
class Grammar:
    """Lexicon keys in order with their symbols and weights, and the logistic model."""

    keys: np.ndarray
    symbols: np.ndarray
    loads: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = BIAS

    def __post_init__(self):
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `h` that are entries, and which."""
        hit = np.flatnonzero(self.sieve[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[hit]), max(0, len(self.keys) - 1))
        same = self.keys[at] == h[hit] if len(self.keys) else np.zeros(0, bool)
        return hit[same], at[same]

    def symbols_of(self, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, weight and entry (or -1) of each word: of its entries that of the greatest weight."""
        symbol, load, entry = np.zeros(len(start), np.int8), np.zeros(len(start)), np.full(len(start), -1)
        for where, h in keys(start, end, sums):
            hit, at = self.look(h)
            hit = hit if where is None else where[hit]
            better = (self.loads[at] > load[hit]) | (symbol[hit] == PLAIN)
            hit, at = hit[better], at[better]
            symbol[hit], load[hit], entry[hit] = self.symbols[at], self.loads[at], at
        return symbol, load, entry

    def matches(self, cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Matched clauses by KINDS for each document of a chunk. A clause counts for a pattern with one minus the product of what its
        words' weights leave, so for one at most."""
        out = np.zeros((len(bounds) - 1, len(KINDS)))
        start, end, sums = words(cps, bounds)
        if not len(start):
            return out
        symbol, load, _ = self.symbols_of(start, end, sums)
        strong = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(strong):
            return out
        doc, clause = clauses(cps, bounds, start)
        held = np.flatnonzero(np.isin(clause, clause[strong]))
        now, state, left, of = None, 0, {}, 0
        for c, s, w, d in zip(clause[held].tolist(), symbol[held].tolist(), load[held].tolist(), doc[held].tolist()):
            if c != now:
                self.close(out, of, state, left)
                now, state, left, of = c, 0, {}, d
            if (kind := PLACE.get(WRITES_L[state][s])) is not None:
                left[kind] = left.get(kind, 1.0) * (1 - w)
            state = MOVES_L[state][s]
        self.close(out, of, state, left)
        return out

    @staticmethod
    def close(out: np.ndarray, doc: int, state: int, left: dict[int, float]) -> None:
        target = PARTS[state][2] == 1
        for kind, rest in left.items():
            out[doc, kind + 6 * target] += 1 - rest

    def score(self, matched: np.ndarray) -> np.ndarray:
        z = np.log1p(matched) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def words(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and hash sums of the lower-cased text."""
    start, end = runs(classes()[cps], bounds, LETTER)
    return start, end, prefix_hash(lower()[cps])


def clauses(cps: np.ndarray, bounds: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and clause of each word; clauses are numbered upwards and end with their documents."""
    stop = np.cumsum(np.isin(cps, ENDS))
    doc = np.searchsorted(bounds, start, "right") - 1
    return doc, stop[start] + doc


def keys(start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """Keys of whole words, then of their beginnings of each length: (words that have one, keys)."""
    yield None, span_hash(sums, start, end)
    for n in STEMS:
        long = np.flatnonzero(end - start > n)
        yield long, _stem(span_hash(sums, start[long], start[long] + n))


def _pairs(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places, in order of `h` and then `key`, of the first of each pair."""
    order = np.lexsort((key, h))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
    return order[first]


def least_hashes(texts: list[str]) -> np.ndarray:
    """(n, 2): the two least hashes of each text's five-word runs; zeros where it has no two. Near copies share one."""
    out = np.zeros((len(texts), 2), np.int64)
    for first, _, cps, bounds in chunks(texts):
        start, end, sums = words(cps, bounds)
        edge = np.searchsorted(start, bounds)
        for i in range(len(bounds) - 1):
            a, b = edge[i], edge[i + 1]
            if b - a >= 6 and len(least := np.unique(span_hash(sums, start[a : b - 4], end[a + 4 : b]))[:2]) == 2:
                out[first + i] = least.view(np.int64)
    return out


def first_of_copies(least: np.ndarray) -> np.ndarray:
    """Which rows share no least hash with an earlier one, so that a group of near copies teaches its words once."""
    seen: set[int] = set()
    stay = np.ones(len(least), bool)
    for i, pair in enumerate(least.tolist()):
        if any(pair):
            stay[i] = not seen.intersection(pair)
            seen.update(pair)
    return stay


def word_counts(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, toxic texts, clean texts) that hold each word or beginning."""
    parts = []
    for first, last, cps, bounds in chunks(texts):
        start, end, sums = words(cps, bounds)
        of = np.searchsorted(bounds, start, "right") - 1
        every = [(of if w is None else of[w], h) for w, h in keys(start, end, sums)]
        doc, h = np.concatenate([d for d, _ in every]), np.concatenate([k for _, k in every])
        at = _pairs(doc, h)
        bad = toxic[first:last][doc[at]].astype(np.int64)
        parts.append((h[at], bad, 1 - bad))
    return _added(parts)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables (key, a, b) as one, summed by key."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    k, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return (k, *(np.bincount(back, np.concatenate([p[i] for p in parts]), len(k)) for i in (1, 2)))


def clause_counts(texts: list[str], grammar: Grammar) -> np.ndarray:
    """(n, 2): clauses of each text with an insult or threat, and others."""
    out = []
    for _, _, cps, bounds in chunks(texts):
        start, end, sums = words(cps, bounds)
        symbol, *_ = grammar.symbols_of(start, end, sums)
        doc, clause = clauses(cps, bounds, start)
        strong = np.isin(clause, clause[(symbol == INSULT) | (symbol == THREAT)])
        one = np.unique(clause, return_index=True)[1]
        out.append(np.column_stack([np.bincount(doc[one][strong[one] == x], minlength=len(bounds) - 1) for x in (True, False)]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def company(texts: list[str], grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, clauses with an insult or threat, other clauses) that hold each whole word that is no entry."""
    parts = []
    for _, _, cps, bounds in chunks(texts):
        start, end, sums = words(cps, bounds)
        symbol, _, entry = grammar.symbols_of(start, end, sums)
        _, clause = clauses(cps, bounds, start)
        strong = np.isin(clause, clause[(symbol == INSULT) | (symbol == THREAT)])
        free = np.flatnonzero(entry < 0)
        h = span_hash(sums, start[free], end[free])
        at = _pairs(clause[free], h)
        parts.append((h[at], strong[free[at]].astype(np.int64), (~strong[free[at]]).astype(np.int64)))
    return _added(parts)


def places(texts: list[str], grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, places, places right before a target) of the insults that stand in the texts."""
    parts = []
    for _, _, cps, bounds in chunks(texts):
        start, end, sums = words(cps, bounds)
        symbol, _, entry = grammar.symbols_of(start, end, sums)
        _, clause = clauses(cps, bounds, start)
        before = np.append((symbol[1:] == TARGET) & (clause[1:] == clause[:-1]), False) if len(start) else np.zeros(0, bool)
        at = np.flatnonzero(symbol == INSULT)
        parts.append((entry[at].astype(np.uint64), np.ones(len(at)), before[at].astype(np.int64)))
    return _added(parts)


def _odds(a, b, bad: int, clean: int):
    return np.log((a + 0.5) / (bad + 1)) - np.log((b + 0.5) / (clean + 1))


def strange(a: np.ndarray, b: np.ndarray, bad: int, clean: int, candidates: int) -> np.ndarray:
    """Which counts, `a` of `bad` cases and `b` of `clean` ones, differ by more than the best of so many candidates would by chance."""
    share = (a + b) / (bad + clean)
    ratio = 2 * (a * np.log(np.maximum(a, 1e-9) / (share * bad)) + b * np.log(np.maximum(b, 1e-9) / (share * clean)))
    return (_odds(a, b, bad, clean) >= LEAST_ODDS) & (ratio >= 2 * np.log(max(2, candidates)) + 6)


class Held:
    """Texts to learn from that the driver holds."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.texts, self.toxic = texts, np.asarray(toxic, np.int64)

    def each(self, f) -> np.ndarray:
        """`f`'s row for each text."""
        return f(self.texts)

    def sums(self, f, bad: int = 0, clean: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """`f`'s table; with `bad` and `clean` only keys of at least two cases and odds enough, and how many had two."""
        k, a, b = f(self.texts, self.toxic)
        if not bad:
            return k, a, b, len(k)
        good = (a > 1) & (_odds(a, b, bad, clean) >= LEAST_ODDS)
        return k[good], a[good], b[good], int((a > 1).sum())

    def only(self, stay: np.ndarray) -> Held:
        return Held([t for t, s in zip(self.texts, stay) if s], self.toxic[stay])


def _of(b: pa.RecordBatch, ids: np.ndarray) -> pa.RecordBatch:
    return b.filter(pa.array(np.isin(b.column(0).to_numpy(zero_copy_only=False), ids)))


class Stored:
    """The same of a table (key, text, label) of bounded rows: texts stay on the executors, whatever their length, and counts come to
    the driver. `ids` are the keys in order, `toxic` their labels."""

    def __init__(self, rows: DataFrame, ids: np.ndarray, toxic: np.ndarray):
        self.rows, self.ids, self.toxic = rows, ids, toxic

    def each(self, f) -> np.ndarray:
        ids = self.ids
        kind = self.rows.schema[0].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = _of(b, ids)
                if b.num_rows:
                    found = f(b.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([found.dtype.str] * len(found), pa.string())], ["k", "v", "t"])

        got = self.rows.mapInArrow(run, f"k {kind}, v binary, t string").toArrow().sort_by("k")
        return np.array([np.frombuffer(v, t) for v, t in zip(got.column("v").to_pylist(), got.column("t").to_pylist())])

    def sums(self, f, bad: int = 0, clean: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        ids = self.ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = _of(b, ids)
                if b.num_rows:
                    k, a, c = f(b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.uint64).view(np.int64)), pa.array(a.astype(np.int64)), pa.array(c.astype(np.int64))], ["k", "a", "b"])

        table = self.rows.mapInArrow(run, "k long, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        n = None
        if bad:
            table = stored(table.where("a > 1"), "counts")
            n = table.count()
            table = table.where(F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("b") + 0.5) / (clean + 1)) >= LEAST_ODDS)
        got = table.toArrow().sort_by("k")
        k, a, b = (got.column(c).to_numpy() for c in "kab")
        return k.view(np.uint64), a.astype(float), b.astype(float), len(k) if n is None else n

    def only(self, stay: np.ndarray) -> Stored:
        return Stored(self.rows, self.ids[stay], self.toxic[stay])


def _with_words(k: np.ndarray, loads: np.ndarray, symbols: np.ndarray) -> Grammar:
    """Learned entries and the fixed lists, which hold where a word is in both: a target in many insults is still a target."""
    fixed = [(s, w) for s, line in WORDS.items() for w in line.split()]
    own = _hashes([w for _, w in fixed])
    every, first = np.unique(np.concatenate([own, k]), return_index=True)
    symbols = np.concatenate([np.array([s for s, _ in fixed]), symbols]).astype(np.int8)
    return Grammar(every, symbols[first], np.concatenate([np.full(len(own), 0.5), loads])[first])


def learned(rows: Held | Stored) -> Grammar:
    """The lexicon: insults are words and beginnings that toxic documents have far more often, with their log odds over the highest as
    weights; threats those of them that mostly stand right before a target; targets words that keep insults company far more
    often than other clauses. Then the logistic weights by Newton steps, drawn to PRIOR."""
    rows = rows.only(first_of_copies(rows.each(least_hashes)))
    bad, clean = int(rows.toxic.sum()), int(len(rows.toxic) - rows.toxic.sum())
    none = _with_words(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int8))
    if not bad or not clean:
        return none
    k, a, b, n = rows.sums(word_counts, bad, clean)
    good = strange(a, b, bad, clean, n)
    if not good.any():
        return none
    k, odds = k[good], _odds(a[good], b[good], bad, clean)
    loads, symbols = odds / odds.max(), np.full(len(k), INSULT, np.int8)
    grammar = _with_words(k, loads, symbols)
    inside, outside = (int(x) for x in rows.each(lambda texts: clause_counts(texts, grammar)).sum(0))
    if inside and outside:
        t, a, b, n = rows.sums(lambda texts, _: company(texts, grammar), inside, outside)
        t = t[strange(a, b, inside, outside, n)]
        grammar = _with_words(np.concatenate([k, t]), np.concatenate([loads, np.full(len(t), 0.5)]), np.concatenate([symbols, np.full(len(t), TARGET, np.int8)]))
    e, a, b, _ = rows.sums(lambda texts, _: places(texts, grammar))
    grammar.symbols[e[(a >= LEAST_PLACES) & (b >= BEFORE_TARGET * a)].astype(np.int64)] = THREAT
    x = np.log1p(rows.each(lambda texts: _matched(texts, grammar)))
    x1 = np.column_stack([x, np.ones(len(x))])
    prior, pull = np.append(PRIOR, BIAS), np.append(np.full(len(PRIOR), 0.1), 0.01)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (p - rows.toxic) + pull * (w - prior)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull), slope)
        w -= step * min(1, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    for bare in (PLACE[INSULT], PLACE[THREAT]):  # a target never takes off
        w[bare + 6] = max(w[bare + 6], w[bare])
    grammar.weights, grammar.bias = w[:-1], float(w[-1])
    return grammar


def _matched(texts: list[str], grammar: Grammar) -> np.ndarray:
    found = [grammar.matches(cps, bounds) for _, _, cps, bounds in chunks(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(KINDS)))


def learn(texts: list[str], toxic: np.ndarray) -> Grammar:
    """The grammar of texts that the driver holds."""
    return learned(Held(texts, toxic))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> Grammar:
    """The grammar of labelled, not held out rows, about `most` of them, in order of id. Their texts are read by executors alone."""
    rows = stored(training_rows(docs, labels, label, most, key, text), "training")
    got = rows.select(key, F.col("label").cast("long")).toArrow().sort_by(key)
    return learned(Stored(rows, got.column(0).to_numpy(), got.column(1).to_numpy()))


def score_toxicity(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, score, predicted, matches), one per row of `docs`, in one pass with no
    shuffle; `matches` are the matched clauses by KINDS.

    Null and empty texts match nothing and get the score of that. With no labels the lexicon holds
    no insults and threats alone count. Very long texts are scored whole, repeated rows alike, an
    empty table gives an empty one, other columns are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, cps, bounds in chunks(b.column(1)):
                m = grammar.matches(cps, bounds)
                s = grammar.score(m)
                arrays = [b.column(0).slice(first, end - first), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(list(m), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, [key, "score", "predicted", "matches"])

    out = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int, matches array<double>")
    return out.select(key, held_out(key).alias("held_out"), "score", "predicted", "matches")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold, with their columns, in one pass."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = [grammar.score(grammar.matches(cps, bounds)) < threshold for _, _, cps, bounds in chunks(b.column(at))]
            yield b.filter(pa.array(np.concatenate(stay))) if stay else b

    return docs.mapInArrow(run, docs.schema)
