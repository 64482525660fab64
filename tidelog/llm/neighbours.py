"""Approximate nearest neighbours by additive quantisation: beam-search encoding over full-dimensional
residual codebooks, stored norms, lookup-table scoring, then exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import given_rows, lookup, stored

#: Vectors that the codebooks are fitted on, at most.
FIT_ROWS = 8192
#: Vectors in a part of the index, and queries whose tables are held at once.
PART, BLOCK = 1 << 16, 128
#: Vectors and queries of one task, at most about: its queries stay, with their shortlists, and the parts of its vectors pass.
VECTORS, QUERIES = 1 << 21, 1 << 13


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty cell moves to a row
            centres[n == 0] = x[rng.integers(0, len(x), (n == 0).sum())]
    return centres


@dataclass(frozen=True)
class Codebooks:
    """`books` (M, K, d): a vector is near the sum of one word of each book."""

    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, books: int = 24, words: int = 256, rounds: int = 2, beam: int = 4, seed: int = 7) -> Codebooks:
        """Books by k-means of residuals, one after the other; then encoding by beam search and
        moving each book's words to the means of what the others leave take turns."""
        x, rng = x.astype(np.float32), np.random.default_rng(seed)
        rest, found = x.copy(), []
        for _ in range(books):
            c = _kmeans(rest, words, 5, rng)
            found.append(c)
            rest = rest - c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
        self = cls(np.array(found))
        for _ in range(rounds):
            codes = self.encode(x, beam)
            words_of, rest = self.books.copy(), x - self.decode(codes)
            for _ in range(3):
                for b in range(books):
                    n = np.bincount(codes[:, b], minlength=words)
                    sums = np.zeros_like(words_of[b])
                    np.add.at(sums, codes[:, b], rest)
                    change = sums / np.maximum(n, 1)[:, None]
                    words_of[b] += change
                    rest = rest - change[codes[:, b]]
            self = cls(words_of)
        return self

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """Codes (n, M): at each book the `beam` best sums so far are kept. With r the residual of
        a sum, adding word c changes its error by |c|^2 - 2 r.c."""
        m, k, d = self.books.shape
        out = np.empty((len(x), m), np.uint8 if k <= 256 else np.uint16)
        norms = (self.books**2).sum(2)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048].astype(np.float32)
            n = len(part)
            rest, error, codes = part[:, None, :], (part**2).sum(1)[:, None], np.zeros((n, 1, 0), np.int64)
            for b in range(m):
                e = error[:, :, None] + norms[b] - 2 * (rest.reshape(-1, d) @ self.books[b].T).reshape(n, -1, k)
                e = e.reshape(n, -1)
                keep = min(beam, e.shape[1]) if b + 1 < m else 1
                best = np.argpartition(e, keep - 1, 1)[:, :keep] if keep < e.shape[1] else np.argsort(e, 1)
                which, word = best // k, best % k
                error = np.take_along_axis(e, best, 1)
                rest = np.take_along_axis(rest, which[:, :, None], 1) - self.books[b][word]
                codes = np.concatenate([np.take_along_axis(codes, which[:, :, None], 1), word[:, :, None]], 2)
            out[at : at + n] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(q, M, K): -2 times the products of queries and words."""
        return -2 * np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.books)


def lookups(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Scores (n) of one query: the stored norm plus M table entries, that is the squared distance
    to the decoded vector less the query's own square."""
    score = norms.copy()
    for b in range(len(tables)):
        score += tables[b][codes[:, b]]
    return score


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths without overflow or underflow of squares."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def scores(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray, sizes: np.ndarray, length: float) -> np.ndarray:
    """Squared distances of one query of unit length times `length` to vectors that were coded at unit length and have `sizes`:
    |q|^2 + |v|^2 - 2 q.v in double precision, whatever the sizes; only the products of unit vectors are single. What the exact
    measure can't tell apart beside a far longer query, this can't either, so ties go to the same ids."""
    return length * length + sizes * (sizes * norms + length * lookups(tables, codes, np.zeros(len(codes), np.float32)))


def best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` least scores in order, ties to the smaller id."""
    at = np.arange(len(score))
    if len(score) > most:
        at = np.flatnonzero(score <= np.partition(score, most - 1)[most - 1])
    return at[np.lexsort((ids[at], score[at]))][:most]


def usable(vector: Column, size: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, shortlist: int = 400, books: int = 24, beam: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, key, score): the k nearest found of each query row by Euclidean distance
    in double precision, against every other row, ties to the smaller key.

    1. Codebooks are fitted on about FIT_ROWS vectors of unit length. 2. Every vector is coded at unit length; codes, the
    norms of what they decode to and the vectors' own lengths go to an index in the shared folder, so vectors of any finite size
    are coded equally well. 3. A task holds up to QUERIES queries, with a shortlist each, and lets the parts of up to
    VECTORS vectors pass; lookup tables score every vector and the `shortlist` best are kept. 4. Those
    are scored again on the original vectors.

    Rows whose vector is null, zero, holds a null or non-finite component, or has another length than most,
    take no part. Rows are numbered once, in a stored table that all steps read. Repeated rows are candidates like others; a query row is never its own. Null keys take no part.
    With fewer than k candidates all are returned, none from an empty table. Other columns are not read."""
    spark = vectors.sparkSession
    rows = given_rows(vectors, None, F.col(key).alias("id"), F.col(vector).alias("v"), queries.alias("asks"))
    dims = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    shape = f"query_id long, rank int, {key} long, score double"
    if dims is None:
        return spark.createDataFrame([], shape)
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"), dims["d"]))
    total, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    if not total:
        return spark.createDataFrame([], shape)
    some = rows if total <= FIT_ROWS else rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / total))
    sample = _matrix(some.select("row", "v").toArrow().sort_by("row").column("v").combine_chunks())
    model = spark.sparkContext.broadcast(Codebooks.fit(sample / lengths(sample)[:, None], books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def part() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(columns[0][0])]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["part", "rows", "ids", "codes", "norms", "sizes"])

        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(2))
                size = lengths(x)
                codes = model.value.encode(x / size[:, None], beam)
                norms = (model.value.decode(codes) ** 2).sum(1).astype(np.float32)
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), codes, norms, size))
            if sum(len(h[0]) for h in held) >= PART:
                yield part()
        if held:
            yield part()

    columns = ["rows", "ids", "codes", "norms", "sizes"]
    index = stored(rows.select("row", "id", "v").mapInArrow(encode, "part long, " + ", ".join(f"{c} binary" for c in columns)), "codes")
    blocks = -(-asked // BLOCK) or 1
    groups = -(-asked // QUERIES) or 1
    splits = min(-(-total // PART), max(-(-total // VECTORS), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def gather(given: pa.Table) -> pa.Table:
        given = given.sort_by("row")
        v = _matrix(given.column("v").combine_chunks())
        size = lengths(v)
        values = given.column("row").to_numpy(), size, (v / size[:, None]).astype(np.float32)
        return pa.table({"block": given.column("block")[:1]} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(columns, values)})

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    asks = rows.where("asks").select(block, "row", "v").groupBy("block").applyInArrow(gather, "block int, rows binary, ids binary, codes binary")
    none = [F.lit(None).cast("binary").alias(c) for c in columns[3:]]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asks.select(F.pmod("block", F.lit(groups)).alias("group"), every(splits).alias("split"), F.lit(0).alias("side"), F.col("block").cast("long").alias("part"), *columns[:3], *none)
    parts = index.select(every(groups).alias("group"), F.pmod(F.xxhash64("part"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("side"), "part", *columns)
    met = asks.unionByName(parts).repartition(min(groups * splits, 100_000), "group", "split").sortWithinPartitions("group", "split", "side", "part")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, short = None, [], {}

        def found() -> Iterator[pa.RecordBatch]:
            for own, _, _ in asking:
                out = [(np.full(len(short[a][0]), a), *short[a]) for a in own.tolist() if a in short]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["ask", "row", "id", "near"])

        for b in batches:
            for i in range(b.num_rows):
                group, split, side, _, *held = (c[i].as_py() for c in b.columns)
                if (group, split) != now:
                    yield from found()
                    now, asking, short = (group, split), [], {}
                if side == 0:
                    own = np.frombuffer(held[0], np.int64)
                    asking.append((own, np.frombuffer(held[1]), np.frombuffer(held[2], np.float32).reshape(len(own), -1)))
                    continue
                row, ids, norms, sizes = np.frombuffer(held[0], np.int64), np.frombuffer(held[1], np.int64), np.frombuffer(held[3], np.float32), np.frombuffer(held[4])
                codes = np.asfortranarray(np.frombuffer(held[2], np.uint8).reshape(len(row), -1).astype(np.intp))
                for own, length, unit in asking:
                    tables = model.value.tables(unit)
                    for q, ask in enumerate(own.tolist()):
                        s = scores(tables[q], codes, norms, sizes, length[q])
                        s[row == ask] = np.inf
                        at = best(s, ids, shortlist)
                        at = at[row[at] != ask]
                        if ask in short:
                            joined = [np.concatenate(x) for x in zip(short[ask], (row[at], ids[at], s[at]))]
                            top = best(joined[2], joined[1], shortlist)
                            short[ask] = tuple(x[top] for x in joined)
                        else:
                            short[ask] = (row[at], ids[at], s[at])
        yield from found()

    def first(rows: DataFrame, by: str, n: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(by, "id", "row"))).where(F.col("rank") <= n)

    short = stored(first(met.mapInArrow(score, "ask long, row long, id long, near double"), "near", shortlist).select("ask", "row", "id"), "shortlist")
    uses = short.groupBy("row").agg(F.count("*").alias("uses")).join(rows.select("row", "v"), "row")
    pairs = lookup(short, stored(uses, "originals"), ["row"], "uses", short.count())
    pairs = pairs.join(rows.where("asks").select(F.col("row").alias("ask"), F.col("id").alias("query_id"), F.col("v").alias("q")), "ask")
    square = F.aggregate(F.zip_with("q", "v", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    out = first(pairs.select("ask", "row", "id", "query_id", F.sqrt(square).alias("score")), "score", k)
    return out.select(F.col("query_id").cast("long"), "rank", F.col("id").cast("long").alias(key), "score")
