"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import lookup, numbered, spare, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a range whose running sums one task works out, about.
RANGE = 1 << 18


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(skey, source_size, n_docs, target) of each source. Sources take `weights` in turn, in
    code point order with null last, and share `share` of all words; a target stops at `most`
    times its source's size and the excess goes to the others by weight.

    That ends where every unfilled source gets weight * level. With sources in order of the level
    that fills them, the level is what the filled ones leave, over the weights that remain."""
    table = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    table = table.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    table = table.withColumn("most", F.col("source_size") * float(most)).withColumn("full_at", F.col("most") / F.col("weight"))
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumn("place", F.row_number().over(by)).withColumn("filled", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    table = table.withColumn("open", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("budget", F.sum("source_size").over(whole) * float(share))
    table = table.withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open")).withColumn("is_full", F.col("most") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("is_full"), F.struct("place", "level"))).over(whole)["level"]
    return table.select("skey", "source_size", "n_docs", F.when(F.col("is_full"), F.col("most")).otherwise(first * F.col("weight")).alias("target"))


def running(rows: DataFrame, order: list[Column | str], value: str, out: str, total: int, group: str | None = None) -> DataFrame:
    """`rows` with the sum of `value` through each row in `order`, all of it or within each `group`, in column `out`.

    Rows are sorted into ranges of about RANGE by everything that orders them, so neither a large group nor equal keys meet in one
    task as long as the order ends in something unique. Each range sums by itself; what lies before it is a
    running sum over one row for each range (and group in it)."""
    parts = max(1, -(-total // RANGE), min(total // 4096, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    by = ([group] if group else []) + order
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    keys = ["range"] + ([group] if group else [])
    sums = ranged.groupBy(*keys).agg(F.sum(value).alias("words"))
    earlier = Window.partitionBy(*([group] if group else [])).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(out, F.sum(value).over(inside)).join(sums, keys).withColumn(out, F.col(out) + F.col("earlier")).drop("earlier", "range")


def queue(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: str, text: str, key: str, row: str | None = None) -> DataFrame:
    """Every entry of the queue: row, key, size, source_size, target, round, its `part` that is taken, and `place`, the words before it.

    In each source's shuffled order `upto` is the source's words through a document; its virtual finish time is that, and the
    source's size for each round before, over the source's target. Entries are range-sorted by finish time, and the
    running sum of their sizes truncates the queue at the budget."""
    turn = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, 16)
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    sizes = stored(docs.select(number.alias("row"), F.col(key).alias("id"), "source", skey.alias("skey"), size.alias("size"), turn.alias("turn")), "sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    aims = stored(targets(sizes, weights, share, most), "targets")
    rows = lookup(sizes, aims, ["skey"], "n_docs", n)
    rows = running(rows, ["turn", "size", "id", "row"], "size", "upto", n, "skey")
    entries = rows.withColumn("round", F.explode(F.array(*(F.lit(i) for i in range(most)))))
    finish = F.when(F.col("size") > 0, (F.col("source_size") * F.col("round") + F.col("upto")) / F.col("target"))
    entries = entries.select("row", "id", "size", "source_size", "target", "turn", "upto", "round", finish.alias("finish"))
    entries = running(entries, ["finish", "turn", "upto", "round", "row"], "size", "through", n * most)
    place = F.col("through") - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.lit(int(total * share)).cast("long") - place))
    return entries.select("row", "id", "size", "source_size", "target", "round", place.alias("place"), part.alias("part"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, seed: str = "mix", text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Rows (row, key, size, source_size, target, taken), one per row of `docs`.

    Weighted fair queueing: in each source's shuffled order a document's virtual finish time is
    the source's words through it, divided by the source's target. A source is queued `most`
    times over, so that a target above its size repeats documents. All entries are range-sorted by
    finish time, then shuffle key, and the queue is truncated when the budget of `share` times all words is taken; the
    entry at the cut is taken in part.

    The size of a null text is 0, and documents of size 0 take 0 words. A null source is a source
    of its own, ordered last. Repeated rows are queued each for itself; ties in shuffle key go
    by size, key and row, so rows that share a key, or have none, spread over tasks as others do. Texts of any length are counted whole. An empty table gives an empty one.
    Other columns, of whatever name, are not read. `row` is the number in the column of that name, or
    else one given in the only scan of `docs`."""
    entries = queue(docs, weights, share, most, seed, text, key, row)
    same = [F.first(c).alias(c) for c in ("id", "size", "source_size", "target")]
    out = entries.groupBy("row").agg(*same, F.sum("part").alias("taken"))
    return out.select("row", F.col("id").alias(key), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """The mix itself, in the order of the queue: each document as often as it is taken whole, and the first words of the one
    at the cut, with the columns of `docs`; `n_chars`, if there, is that of the text. Edge cases are those of `mix`."""
    at, all_, taken, place = (spare(docs, n) for n in ("mix_row", "mix_size", "mix_taken", "mix_place"))
    whole_rows = numbered(docs, at)
    entries = queue(whole_rows, weights, share, most, seed, text, key, at).where("part > 0")
    entries = entries.select(F.col("row").alias(at), F.col("size").alias(all_), F.col("part").alias(taken), F.col("place").alias(place))
    rows = whole_rows.join(entries.hint("merge"), at)
    whole = F.col(taken) == F.col(all_)
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), 0), F.lit(1), F.col(taken).cast("int")), "")
    rows = rows.withColumn(text, F.when(whole, F.col(text)).otherwise(head))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return rows.repartitionByRange(F.col(place)).sortWithinPartitions(place).select(*docs.columns)


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS turn
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS t FROM sizes GROUP BY source),
w AS (SELECT *, CASE t WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s),
o AS (SELECT *, row_number() OVER b AS place, coalesce(sum(most) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
      FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST)),
l AS (SELECT *, (budget - filled) / open AS level, most <= (budget - filled) / open * weight AS is_full FROM o),
a AS (SELECT source, source_size, budget, CASE WHEN is_full THEN most ELSE (SELECT min_by(level, place) FROM l WHERE NOT is_full) * weight END AS target FROM l),
q AS (SELECT row_number() OVER () AS row, doc_id, size, source_size, target, turn, budget,
        (sum(size) OVER (PARTITION BY sizes.source ORDER BY turn, size, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM sizes JOIN a ON sizes.source IS NOT DISTINCT FROM a.source),
e AS (SELECT *, (source_size * round + upto) / target AS finish FROM q, (VALUES (0), (1)) r(round) WHERE size > 0),
p AS (SELECT row, least(size, greatest(0, floor(budget)::BIGINT - ((sum(size) OVER (ORDER BY finish, turn, upto, round ROWS UNBOUNDED PRECEDING))::BIGINT - size))) AS part FROM e),
k AS (SELECT row, sum(part)::BIGINT AS taken FROM p GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN k USING (row)
"""
