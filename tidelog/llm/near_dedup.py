"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles, in bands,
verified by weighted Jaccard similarity.

A shingle is five words of letters and digits in lower case; a text of one to four words is one
shingle. Its weight in a text is how often it stands there times ln(1 + N / documents that have it).
Document counts come from all documents, by a count-min sketch of fixed size, and are raised to
N / RARE at least, whatever the size of the table. The floor has two reasons: what two copies share stands in two documents and what sets them
apart in one, which must not by itself make them less alike; and it lies well above the sketch's error, about words a
document / 2^19 of N. What stands in more documents weighs
the less the more they are, so texts that share a passage of many texts are not alike for that. Copies would make the words of a large group look common;
a document therefore counts for 1/n where n documents have a least hash in common with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.graph import components
from tidelog.llm.shared import HOT_PARTS, dropped, given_rows, keep_rows, lookup, matched, numbered, spare, stored
from tidelog.llm.textscan import LETTER, NUMBER, chunks, classes, lower, mix, prefix_hash, runs, span_hash

WORDS = 5
SIMILAR = 0.8
RARE = 128
#: Two rows of so many counters; parts in which tasks hand them on.
WIDTH, PARTS = 1 << 19, 64
UNIT = 1 << 16
#: (rows, bands) of the first banding, and of the one for rows that the leaders of the first leave open.
#: At similarity 0.8 they miss 1.6, then 0.1 of a thousand pairs.
LEVELS = [(3, 9), (7, 40)]
#: Rows that one task compares with each other, and that one copy of a leader's text is held against, at most.
TOGETHER = 1024
_MUL = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1) for i in range(16)]


def shingles(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, times) of a chunk, in order of document, then shingle; 44-bit shingles."""
    kind = np.array([0, 1, 1, 0], np.uint8)[classes()[cps]]
    start, end = runs(kind, bounds, 1)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none.astype(np.uint64), none
    word = span_hash(prefix_hash(lower()[cps]), start, end)
    edge = np.searchsorted(start, bounds)
    size = np.diff(edge)
    doc = np.repeat(np.arange(len(size)), size)
    left = np.repeat(edge[1:], size) - np.arange(len(start))  # words from here to the document's end
    full = np.flatnonzero(left >= WORDS)
    h = np.zeros(len(full), np.uint64)
    for i in range(WORDS):
        h += word[full + i] * _MUL[i]
    of = doc[full]
    short = np.flatnonzero((size > 0) & (size < WORDS))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for i in range(WORDS - 1):
            has = size[short] > i
            few[has] += word[edge[short[has]] + i] * _MUL[i]
        h, of = np.concatenate([h, few]), np.concatenate([of, short])
    both = np.sort(of.astype(np.uint64) << np.uint64(44) | mix(h) >> np.uint64(20))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    times = np.diff(np.append(first, len(both)))
    return (both[first] >> np.uint64(44)).astype(np.int64), both[first] & np.uint64((1 << 44) - 1), times


def _starts(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and where theirs begin."""
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    return doc[at], at


def _least(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Three least hashes of each document, by independent orders."""
    return np.column_stack([np.minimum.reduceat(mix(h ^ _MUL[8 + i]), at) for i in range(3)]).view(np.int64)


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = mix(h)
    return (z & np.uint64(WIDTH - 1)).astype(np.int64), (z >> np.uint64(40) & np.uint64(WIDTH - 1)).astype(np.int64) + WIDTH


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies by the sketch's counters."""

    counts: np.ndarray
    documents: float

    def of(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        a, b = _cells(h)
        seen = np.minimum(self.counts[a], self.counts[b])
        return times * np.log1p(self.documents / np.maximum(seen, self.documents / RARE))


@cache
def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1), its logarithm and Uniform(0, 1) at 2^16 even steps."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return lo.astype(np.float32), np.log(lo).astype(np.float32), p.astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray, at: np.ndarray, rows: range) -> np.ndarray:
    """Improved consistent weighted sampling: for each document and row, the least ln(a). With r
    and c from Gamma(2, 1) and beta uniform, all by shingle and row, t = floor(ln w / r + beta),
    ln y = r (t - beta) and ln a = ln c - ln y - r. Two texts agree in a row with the probability
    of their weighted Jaccard similarity; the least value stands for its shingle and t."""
    gamma, log_gamma, uniform = _quantiles()
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(at), len(rows)), np.float32)
    low = np.uint64(0xFFFF)
    for k, row in enumerate(rows):
        z = mix(h + np.uint64(row + 1) * np.uint64(0xA24BAED4963EE407 & 0xFFFFFFFFFFFF))
        r, beta = gamma[z & low], uniform[z >> np.uint64(32) & low]
        t = np.floor(log_w / r + beta)
        out[:, k] = np.minimum.reduceat(log_gamma[z >> np.uint64(16) & low] - r * (t - beta) - r, at)
    return out


def _bands(values: np.ndarray, rows: int, level: int) -> np.ndarray:
    bits = values.view(np.uint32).astype(np.uint64).reshape(len(values), -1, rows)
    keys = np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(level)
    for i in range(rows):
        keys = mix(keys + (bits[:, :, i] + np.uint64(1)) * _MUL[i])
    return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (shingles in order, weights): sum of minima over sum of maxima."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _vectors(texts: list[str] | pa.Array, weights: Weights) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and weights of each text."""
    for _, _, cps, bounds in chunks(texts):
        doc, h, times = shingles(cps, bounds)
        w, edge = weights.of(h, times), np.searchsorted(doc, np.arange(len(bounds)))
        for i in range(len(bounds) - 1):
            yield h[edge[i] : edge[i + 1]], w[edge[i] : edge[i + 1]]


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], [n for n, _ in schema])


def document_weights(rows: DataFrame, total: int) -> Weights:
    """Document counts of all shingles of `rows` (row, text). Least hashes that more than a thousandth of the
    rows share are HOT_PARTS times three at most; only these come to the driver."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, cps, bounds in chunks(b.column(0)):
                doc, h, _ = shingles(cps, bounds)
                _, at = _starts(doc)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(_least(h, at).ravel())], ["least"])

    many = rows.select("text").mapInArrow(least, "least long").groupBy("least").count().where(F.col("count") > max(1, total // HOT_PARTS)).collect()
    hot = np.array(sorted((r["least"], r["count"]) for r in many), np.int64).reshape(-1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = np.zeros(2 * WIDTH, np.int64), 0
        for b in batches:
            for _, _, cps, bounds in chunks(b.column(0)):
                doc, h, _ = shingles(cps, bounds)
                own, at = _starts(doc)
                if not len(at):
                    continue
                share = np.full(len(at), UNIT, np.int64)
                if len(hot):
                    keys = _least(h, at)
                    place = np.minimum(np.searchsorted(hot[:, 0], keys), len(hot) - 1)
                    n = np.where(hot[place, 0] == keys, hot[place, 1], 1).max(1)
                    share = np.maximum(1, UNIT // n)
                documents += int(share.sum())
                each = np.repeat(share, np.diff(np.append(at, len(doc))))
                for cell in _cells(h):
                    counts += np.bincount(cell, each, 2 * WIDTH).astype(np.int64)
        blocks = counts.reshape(PARTS, -1)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), -1], pa.int32()), pa.array([*(blocks[i].tobytes() for i in used), np.int64(documents).tobytes()], pa.binary())], ["part", "counts"])

    def add(given: pa.Table) -> pa.Table:
        held = sum(np.frombuffer(x, np.int64) for x in given.column("counts").to_pylist())
        return pa.table({"part": given.column("part")[:1], "counts": pa.array([held.tobytes()], pa.binary())})

    parts = rows.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    counts, documents = np.zeros((PARTS, 2 * WIDTH // PARTS)), 0.0
    for r in parts:
        held = np.frombuffer(bytes(r["counts"]), np.int64) / UNIT
        if r["part"] < 0:
            documents = float(held[0])
        else:
            counts[r["part"]] = held
    return Weights(counts.ravel().astype(np.float32), documents)


def signatures(rows: DataFrame, weights, level: int) -> DataFrame:
    """(row, id, mark, shingles, bands): `mark` stands for the weighted set; texts without words have no bands."""
    n, bands = LEVELS[level]
    first = sum(a * b for a, b in LEVELS[:level])
    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, cps, bounds in chunks(b.column(2)):
                doc, h, times = shingles(cps, bounds)
                own, at = _starts(doc)
                keys = [None] * (high - low)
                mark, size = np.zeros(high - low, np.uint64), np.zeros(high - low, np.int64)
                if len(at):
                    found = _bands(samples(h, weights.value.of(h, times), at, range(first, first + n * bands)), n, level)
                    for i, k in zip(own.tolist(), found):
                        keys[i] = k
                    mark[own] = np.add.reduceat(mix(h + (times.astype(np.uint64) << np.uint64(44))), at)
                    size[own] = np.diff(np.append(at, len(doc)))
                arrays = [b.column(0).slice(low, high - low), b.column(1).slice(low, high - low), pa.array(mark.view(np.int64)), pa.array(size), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "mark", "shingles", "bands"])

    return rows.select("row", "id", "text").mapInArrow(sign, f"row long, id {kind}, mark long, shingles long, bands array<long>")


def buckets(signed: DataFrame, own_order: bool) -> DataFrame:
    """(bucket, row, leader, n) of buckets of n rows, several; buckets with the same members count once.
    The leader is the first row in a shuffled order, the same for all buckets or one of each bucket."""
    rows = stored(signed.where("bands is not null").select("row", F.explode("bands").alias("bucket")), "bands")
    order = F.xxhash64("row", "bucket") if own_order else F.xxhash64("row")
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row", F.lit(7)).cast("decimal(20,0)")).alias("members"), F.min(F.struct(order.alias("o"), "row"))["row"].alias("leader"))
    many = stored(sums.where("n > 1").groupBy("n", "members").agg(F.min(F.struct("bucket", "leader")).alias("b")).select("n", "b.bucket", "b.leader"), "many")
    members = stored(matched(rows, many, ["bucket"], "n", rows.count()).select("bucket", "row", "leader", "n"), "members")
    dropped(rows, many)
    return members


def verified(members: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """(row, leader, apart) of members and their leaders: one minus weighted Jaccard similarity. A bucket's pairs are dealt to lots of about TOGETHER,
    each with a copy of the leader's text, so a leader of a third of all rows spreads over tasks like any other."""
    pairs = members.where("row <> leader").groupBy("row", "leader").agg(F.max(F.ceil(F.col("n") / float(TOGETHER))).cast("int").alias("lots"))
    pairs = stored(pairs.withColumn("lot", F.pmod(F.xxhash64("row"), "lots").cast("int")), "pairs")
    heads = pairs.groupBy("leader").agg(F.max("lots").alias("lots")).select("leader", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    heads = heads.join(texts.select(F.col("row").alias("leader"), F.col("text").alias("head")).hint("merge"), "leader")
    both = pairs.join(texts.hint("merge"), "row").join(heads.hint("merge"), ["leader", "lot"]).select("row", "leader", "text", "head")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for b in batches:
            rows, leaders, heads = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
            out = np.zeros(len(rows))
            for i, v in enumerate(_vectors(b.column(2), weights.value)):
                if leaders[i] != now:
                    now, head = leaders[i], next(_vectors([heads[i].as_py()], weights.value))
                out[i] = 1 - similarity(v, head)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["row", "leader", "apart"])

    checked = stored(both.mapInArrow(verify, "row long, leader long, apart double"), "checked")
    dropped(pairs)
    return checked


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): the least row that each is linked to or itself, and the same of that. Rows of
    one label are in one component; one component may still have several."""
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("to")))
    first = stored(ends.groupBy("node").agg(F.min(F.least("node", "to")).alias("to")), "labels")
    up = first.select(F.col("node").alias("to"), F.col("to").alias("far"))
    return first.join(up, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"))


def _left_over(members: DataFrame, checked: DataFrame, labels: DataFrame, most: float) -> DataFrame:
    """(bucket, row, apart, label, size) of what its leader doesn't settle in a bucket.

    Rows within `most` of the leader are linked through it; the others are open unless their
    label is one of those. Distance is a metric, so an open row can be linked only to rows whose
    distance to the leader differs from its own by `most` at most: rows nearer to the leader than any open row allows are left out."""
    rows = members.where("row <> leader").join(checked, ["row", "leader"]).select("bucket", "row", "apart")
    rows = rows.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    rows = stored(rows.select("bucket", "row", "apart", "label"), "apart")
    far = F.col("apart") > most
    stats = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.when(far, F.col("apart"))).alias("nearest"), F.min(F.when(~far, F.col("label"))).alias("head"), F.min("label").alias("a"), F.max("label").alias("b"))
    stats = stored(stats.where("nearest is not null and a <> b").select("bucket", "n", "nearest", "head"), "stats")
    open_ = matched(rows, stats, ["bucket"], "n", rows.count()).where(far | (F.col("apart") >= F.col("nearest") - most))
    open_ = stored(open_.withColumn("label", F.when(~far, F.col("head")).otherwise(F.col("label"))).select("bucket", "row", "apart", "label"), "left")
    sizes = open_.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("members"), F.min("label").alias("a"), F.max("label").alias("b"))
    once = stored(sizes.where("a <> b").groupBy("size", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "once")
    left = stored(matched(open_, once, ["bucket"], "size", open_.count()), "rest")
    dropped(rows, stats, open_, once)
    return left


def _compared(rows: DataFrame, texts: DataFrame, weights, most: float) -> DataFrame:
    """Links (u, v) between the two sides of each group (bucket, one, two), a group in one task:
    rows (bucket, one, two, side, row, apart, label), side 0 before side 1. Rows of one component, and those that
    distances to the leader or their total weights rule out, are not compared."""
    group_by = ["bucket", "one", "two"]
    dealt = rows.join(texts.hint("merge"), "row").select(*group_by, "side", "apart", "row", "label", "text").repartition(*group_by).sortWithinPartitions(*group_by, "side", "apart", "row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, root = None, [], {}
        schema = [("u", pa.int64()), ("v", pa.int64())]

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            out: list[tuple[int, int]] = []
            cols = [c.to_pylist() for c in b.columns[:-1]]
            for *group, side, apart, row, label, vector in zip(*cols, _vectors(b.column(7), weights.value)):
                if group != now:
                    now, held, root = group, [], {}
                whole = float(vector[1].sum())
                if side:
                    for other_apart, other, other_label, other_whole, other_vector in held:
                        if abs(apart - other_apart) > most or min(whole, other_whole) < (1 - most) * max(whole, other_whole):
                            continue
                        if row != other and top(label) != top(other_label) and 1 - similarity(vector, other_vector) <= most:
                            root[top(other_label)] = top(label)
                            out.append((other, row))
                if side != 1:
                    held.append((apart, row, label, whole, vector))
            yield _batch(schema, out)

    return dealt.mapInArrow(compare, "u long, v long")


def _together(left: DataFrame) -> DataFrame:
    """Buckets of TOGETHER rows at most as groups in which every row meets those before it (side 2)."""
    return left.where(F.col("size") <= TOGETHER).select("bucket", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(2).alias("side"), "row", "apart", "label")


def _in_blocks(large: DataFrame) -> DataFrame:
    """Larger buckets as pairs of blocks: all rows (side 0) against those that are not in the
    bucket's most frequent component (side 1)."""
    counts = large.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    main = counts.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("most"))
    half = TOGETHER / 2
    main = main.select("bucket", F.col("most.label").alias("main"), F.ceil(F.col("n") / half).cast("int").alias("ones"), F.ceil((F.col("n") - F.col("most.k")) / half).cast("int").alias("twos"))
    rows = large.select("bucket", "row", "apart", "label").join(main.where("twos > 0"), "bucket")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    columns = ["bucket", "one", "two", "side", "row", "apart", "label"]
    every = rows.withColumn("side", F.lit(0)).withColumn("one", own(F.col("ones"))).withColumn("two", spread(F.col("twos")))
    other = rows.where(F.col("label") != F.col("main")).withColumn("side", F.lit(1)).withColumn("two", own(F.col("twos"))).withColumn("one", spread(F.col("ones")))
    return every.select(*columns).unionByName(other.select(*columns))


def near_links(texts: DataFrame, signed: DataFrame, weights, similar: float) -> DataFrame:
    """Links (u, v) from which the classes of rows at least `similar` follow. The rule is one for buckets of every size.

    In every bucket all rows are held against one leader. Rows that can still link two components of a bucket
    are banded anew, with more rows a band, and held against the leaders of these buckets. What is then still open in a
    bucket is compared with each other: in one task up to TOGETHER rows, else block by block, which finds the same links."""
    most, links = 1 - similar + 1e-12, None
    for level in range(len(LEVELS)):
        members = buckets(signed, own_order=level > 0)
        near = stored(texts.join(members.select("row").distinct().hint("merge"), "row", "left_semi"), "texts")
        checked = verified(members, near, weights)
        found = checked.where(F.col("apart") <= most).select(F.col("row").alias("u"), F.col("leader").alias("v"))
        links = stored(found if links is None else links.unionByName(found), "links")
        left = _left_over(members, checked, _labels(links), most)
        dropped(members, checked)
        texts = stored(near.join(left.select("row").distinct().hint("merge"), "row", "left_semi"), "texts")
        dropped(near)
        if not left.limit(1).count():
            return links
        if level + 1 < len(LEVELS):
            signed = signatures(texts.withColumn("id", F.lit(None).cast("long")), weights, level + 1)
    large = left.where(F.col("size") > TOGETHER)
    links = links.unionByName(_compared(_together(left), texts, weights, most))
    if large.limit(1).count():
        links = links.unionByName(_compared(_in_blocks(large), texts, weights, most))
    return stored(links, "links")


def near_dedup(docs: DataFrame, similar: float = SIMILAR, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Rows (row, key, class_id, class_size, kept), one per row of `docs`.

    Classes are the connected components of links of similarity `similar` or more; of each class
    the row with the smallest key, then the earliest row, is kept and its key is the class id.
    Texts of equal shingles are collapsed first. Null, empty and wordless texts are classes of their own. Very long texts are
    sampled whole. Repeated rows fall in one class, null keys come after others, an empty table
    gives an empty one, other columns are not read. `row` is the number in the column of that name,
    or else one that is given here; all steps that read texts read them with the stored numbers."""
    spark = docs.sparkSession
    rows = given_rows(docs, row, F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.count()
    weights = spark.sparkContext.broadcast(document_weights(rows, total))
    signed = stored(signatures(rows, weights, 0), "signatures")
    alike = signed.where("bands is not null").groupBy("mark", "shingles").agg(F.count("*").alias("n"), F.min(F.struct("row", "bands")).alias("f"))
    alike = stored(alike.select("mark", "shingles", "n", F.col("f.row").alias("first"), "f.bands"), "alike")
    ones = alike.select(F.col("first").alias("row"), "bands")
    named = components(near_links(rows.select("row", "text"), ones, weights, similar))
    of = alike.select("mark", "shingles", "n", "first").join(named.withColumnRenamed("node", "first"), "first", "left")
    of = stored(of.select("mark", "shingles", "n", F.coalesce("label", "first").alias("label")), "classes")
    every = signed.select("row", "id", "mark", "shingles", F.col("bands").isNull().alias("alone"))
    placed = lookup(every.where("not alone"), of, ["mark", "shingles"], "n", total).select("row", "id", "label")
    placed = placed.unionByName(every.where("alone").select("row", "id", F.col("row").alias("label")))
    placed = stored(placed, "placed")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    classes_ = stored(placed.groupBy("label").agg(F.count("*").alias("class_size"), best), "kept")
    out = lookup(placed, classes_, ["label"], "class_size", total)
    return out.select("row", F.col("id").alias(key), F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `near_dedup` keeps, with their columns."""
    row = spare(docs, "row")
    whole = numbered(docs, row)
    return keep_rows(whole, near_dedup(whole, row=row, **options).where("kept"), row)
