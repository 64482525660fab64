"""Chat formatting from a declarative template, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns look, which roles bear loss, and the machine that accepts orders of roles.

    A turn is `head` + role + `colon` + text + `end`. Inside a role or text every marker that would stand there is broken: its
    first character becomes `mark` and a letter that stands for that character. Before such a letter `mark` itself becomes `mark`
    and a letter, so reading back is exact; everything else stays as it is. Markers must not overlap themselves: then, with
    none inside, the next one is the turn's own."""

    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    mark: str = "\\"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple[str, ...] = ("asked", "answered")

    def __post_init__(self):
        for m in (self.head, self.colon, self.end, *self.broken()):
            if not m or self.mark in m or any(m[:k] == m[-k:] for k in range(1, len(m))):
                raise ValueError(f"a marker must not be empty, hold {self.mark!r} or overlap itself: {m!r}")
        if len(self.mark) != 1 or any(">" in s for s in self.moves):
            raise ValueError("mark is one character; states hold no '>'")

    def broken(self, role: bool = False) -> tuple[str, ...]:
        """The markers that must not stand inside a text or a role, without the white space at an end marker's edge."""
        return (self.head, self.end.strip() or self.end) + ((self.colon,) if role else ())

    def codes(self) -> dict[str, str]:
        """First characters of markers, then the mark, each with a letter that stands in no marker."""
        firsts = dict.fromkeys([m[0] for m in self.broken(role=True)] + [self.mark])
        free = [c for c in "abcdefghijklmnopqrstuvwxyz0123456789" if c not in self.head + self.colon + self.end]
        return dict(zip(firsts, free, strict=False))

    def escape(self, x: Column, role: bool = False) -> Column:
        codes = self.codes()
        x = F.regexp_replace(x, F.lit(f"{quoted(self.mark)}(?=[{''.join(codes.values())}])"), F.lit(_substitute(self.mark + codes[self.mark])))
        for m in self.broken(role):
            x = F.replace(x, F.lit(m), F.lit(self.mark + codes[m[0]] + m[1:]))
        return x

    def unescape(self, x: Column) -> Column:
        """Codes of characters first, that of the mark last: what it gives back is followed by a letter that was there before."""
        for c, letter in self.codes().items():
            x = F.replace(x, F.lit(self.mark + letter), F.lit(c))
        return x

    def state(self, roles: Column) -> Column:
        """The state after all roles; `error` once a role has no move."""
        moves = F.create_map(*(F.lit(x) for s, to in self.moves.items() for r, t in to.items() for x in (f"{s}>{r}", t)))
        return F.aggregate(roles, F.lit(self.start), lambda s, r: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), r)), F.lit("error")))


def quoted(text: str) -> str:
    """A pattern that matches just this text."""
    return "".join(c if c.isalnum() or not c.isascii() or c.isspace() else "\\" + c for c in text)


def _substitute(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def format_chats(turns: DataFrame, template: Template = Template(), key: str = "conv_id") -> DataFrame:
    """Rows (key, valid, state, segments, formatted), one per conversation, turns ordered by `turn`.

    `segments` is array<struct<text, loss>>: head and role, text, end of each turn; loss is true
    for the text alone of roles that bear loss. `formatted` is the segments joined. Turn order
    that the machine rejects is formatted all the same, with `valid` false.

    Null texts and roles count as empty; an empty role bears no loss and has no move. A null turn comes first;
    equal turns go by role, then text, so repeated rows are all kept. A null key is a conversation
    of its own. An empty table gives an empty one; other columns are not read. A conversation is
    one output value, so its texts meet in one row, whatever their length."""
    turn = F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63)).cast("long")).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head, end = F.lit(template.head), F.lit(template.end)

    def marked(t: Column) -> Column:
        parts = [(F.concat(head, template.escape(t["role"], role=True), F.lit(template.colon)), F.lit(False)), (template.escape(t["text"]), t["role"].isin(*template.loss)), (end, F.lit(False))]
        return F.array(*(F.struct(x.alias("text"), loss.alias("loss")) for x, loss in parts))

    chats = chats.withColumn("segments", F.flatten(F.transform("turns", marked)))
    chats = chats.withColumn("state", template.state(F.transform("turns", lambda t: t["role"])))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return chats.select(key, F.col("state").isin(*template.accept).alias("valid"), "state", "segments", text.alias("formatted"))


def read_back(chats: DataFrame, template: Template = Template(), key: str = "conv_id") -> DataFrame:
    """(key, valid, state, turns array<struct<role, text>>, loss_text, formatted): turns parsed from `formatted`,
    and the unescaped text of the segments that bear loss."""
    ends = F.filter(F.split("formatted", quoted(template.end), -1), lambda t: t != "")
    start = len(template.head)

    def turn(t: Column) -> Column:
        role = F.substring_index(F.substr(t, F.lit(start + 1)), template.colon, 1)
        text = F.substr(t, F.length(role) + F.lit(start + len(template.colon) + 1))
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    return chats.select(key, "valid", "state", F.transform(ends, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def digests(chats: DataFrame, template: Template = Template(), key: str = "conv_id") -> DataFrame:
    """What `read_back` gives, as counts and digests, and what the machine says of the order of roles."""
    back = read_back(chats, template, key)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", "state",
    )


#: Breaking a marker or marking a mark makes a text one character longer; the markers of a turn have 14.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '\\[abcd]|### |</turn>|: ')) + length(text) + len(regexp_extract_all(text, '\\[abcd]|### |</turn>')) + 14 AS chars,
         CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END AS r
  FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars,
         string_agg(r, '' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM e GROUP BY conv_id),
m AS (SELECT *, CASE WHEN roles = 's' THEN 'briefed' WHEN regexp_full_match(roles, 's?(ua)+') THEN 'answered' WHEN regexp_full_match(roles, 's?(ua)*u') THEN 'asked' ELSE 'error' END AS state FROM g)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, state IN ('asked', 'answered') AS valid, state FROM m
"""
