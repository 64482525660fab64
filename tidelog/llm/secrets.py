"""Secret scans with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUE = r"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGNED = (":", "=")
#: (kind, role, pattern, group whose length counts, least length, texts of which any match holds one). The first three are reported
#: wherever they stand; the others are weak. A group is repeated possessively: Java's matcher recurses
#: once per repeat of another one of varying length, and long texts overflow its stack. A run that could start at any of its
#: characters is tried at its first one alone.
KINDS = [
    ("assign", "secret", rf"(?i:password|passwd|secret|token|api_?key){VALUE}([A-Za-z0-9+/_.=-]+)", 1, 6, ASSIGNED),
    ("access", "id", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    ("hex", "secret", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, ()),
    ("id", "id", rf"(?i:access_?key_?id|client_?id|account_?id|user_?name|login){VALUE}[A-Za-z0-9+/_.@-]{{3,}}|(?:ASIA|AROA|AIDA)[A-Z0-9]{{12,}}", 0, 0, (*ASSIGNED, "ASIA", "AROA", "AIDA")),
    ("key", "secret", rf"(?i:pwd|passphrase|credential|private_?key){VALUE}[A-Za-z0-9+/_.=-]{{6,}}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{40,}}={{0,2}}", 0, 0, ()),
    ("endpoint", "endpoint", rf"(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D\"'<>]+|(?i:host|hostname|endpoint|server){VALUE}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++(?::[0-9]+)?", 0, 0, ASSIGNED),
]
BASE = 3
#: Characters at most between parts of one credential.
SCOPE = 400
#: What a part of each role needs nearby: one of these lists, whole.
NEEDS = {"id": [["secret"]], "secret": [["id"], ["endpoint"]], "endpoint": [["id", "secret"]]}


def _found(text: Column, number: int) -> Column:
    """array<struct<kind, pos, gap, len, ok>> of one kind's leftmost matches: the characters since the one before, and its own."""
    _, _, pattern, group, least, holds = KINDS[number]
    # Zipped, so that text is matched and split once: inside a lambda both would be done anew for each match.
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("g")
    both = F.filter(F.arrays_zip(whole, gaps), lambda z: z["m"].isNotNull())

    def one(z: Column, i: Column) -> Column:
        size = F.length(F.regexp_extract(z["m"], pattern, group)) if group else F.length(z["m"])
        return F.struct(F.lit(number).alias("kind"), i.alias("pos"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("len"), (size >= least).alias("ok"))

    none = F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean>>")
    may = [F.contains(text, F.lit(x)) for x in holds]
    has = reduce(lambda a, b: a | b, may) & text.rlike(pattern) if may else text.rlike(pattern)
    return F.when(has, F.transform(both, one)).otherwise(none)


def find_secrets(docs: DataFrame, scope: int = SCOPE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (row, key, spans), one per row of `docs`; spans is array<struct<start, kind, end, links>> in order,
    in code points, `kind` a number of KINDS, end exclusive; `links` are the starts of the parts that a weak span was reported for,
    the nearest one of each role that counts.

    Each kind's matches are leftmost and do not overlap. Matches become rows; running sums of their
    lengths and of the gaps between them give positions. Linking is an interval join within a
    document, done as two sweeps: ordered by start, the furthest end before a part, and in the other direction the nearest
    start after it, tell for each role which part of it lies within `scope` characters. A weak identifier is reported near
    a secret, a weak secret near an identifier or endpoint, an endpoint near both an identifier and
    a secret; never if it overlaps a match of the first three kinds. No pairs are formed and both sweeps are linear, so a
    document of many parts costs their sort. Rows of one document meet in one task, as its text did.

    A null or empty text has no spans. Texts are scanned whole. Repeated rows are scanned each for itself, an empty
    table gives an empty one, other columns are not read, null keys stay null."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*(_found(body, i) for i in range(len(KINDS))))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), found.alias("found"))
    rows = numbered.select("row", "id", F.explode_outer("found").alias("m")).select("row", "id", "m.*")
    run = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("ok", F.coalesce("ok", F.lit(True))).where(F.col("ok") | (F.col("pos") == 0))
    role = F.element_at(F.array(*(F.lit(r) for _, r, *_ in KINDS)), F.col("kind") + 1)
    rows = rows.withColumn("role", F.when(F.col("ok"), role))
    sweep = Window.partitionBy("row")
    before = sweep.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = sweep.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def near(which: Column, reach: int) -> Column:
        """The start of a part of `which` that begins or ends less than `reach` characters away, the nearer of the two sides; else null."""
        left = F.max(F.when(which, F.struct("end", "start"))).over(before)
        right = F.min(F.when(which, F.struct("start", "end"))).over(after)
        to_left, to_right = F.col("start") - left["end"], right["start"] - F.col("end")
        return F.when((to_left < reach) & (to_right.isNull() | (to_left <= to_right)), left["start"]).when(to_right < reach, right["start"]).when(to_left < reach, left["start"])

    for r in NEEDS:
        rows = rows.withColumn(f"by_{r}", near(F.col("role") == r, scope + 1))
    rows = rows.withColumn("over", near(F.col("ok") & (F.col("kind") < BASE), 0))
    links = F.lit(None).cast("array<int>")
    for r, lists in NEEDS.items():
        parts = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a & b, (F.col(f"by_{x}").isNotNull() for x in whole)), F.col(f"by_{x}")).cast("int") for whole in lists for x in whole)))
        links = F.when(F.col("role") == r, parts).otherwise(links)
    base = F.col("kind") < BASE
    links = F.when(base, F.array().cast("array<int>")).otherwise(links)
    said = F.col("ok") & (base | ((F.size("links") > 0) & F.col("over").isNull()))
    span = F.when(said, F.struct("start", "kind", "end", "links"))
    return rows.withColumn("links", links).groupBy("row").agg(F.first("id").alias(key), F.array_sort(F.collect_list(span)).alias("spans"))


def _said(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, a digest of the first three kinds' spans, all spans as text, and of the weak ones what each is linked to."""
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    weak = F.filter("spans", lambda s: s["kind"] >= BASE)
    linked = F.array_join(F.transform(weak, lambda s: F.concat_ws(">", s["start"].cast("string"), F.array_join(s["links"].cast("array<string>"), "+"))), ",")
    return found.select(key, *(number(i).alias(f"n_{KINDS[i][0]}") for i in range(BASE)), F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"), linked.alias("links"))
