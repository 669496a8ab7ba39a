"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over the roles says whether the turns come in a proper order. Each
turn becomes segments (opening mark, text, closing mark), and each segment has a loss flag.
Control strings inside texts and roles are broken up by an escape that can be undone, so a
formatted conversation can be cut at its marks and read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """Marks around a role's text, and whether the text is learned from."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role and the machine over roles.

    Marks are not empty, and none has its first character again. Other roles are written
    between ``role_mark`` and the opening of ``other``.
    """

    start: str = "<s>"
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS]", "[/SYS]"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("[ANS]", "</s>", loss=True),
        }
    )
    role_mark: str = "[ROLE]"
    other: Turn = Turn("[TEXT]", "[/TEXT]")
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)
    escape: str = "\\"

    def marks(self) -> list[str]:
        found = [self.start, self.role_mark, *[m for t in [*self.turns.values(), self.other] for m in (t.opening, t.closing)]]
        for m in found:
            if len(m) < 2 or m[0] in m[1:] or self.escape in m:
                raise ValueError(f"not usable as a mark: {m!r}")
        return list(dict.fromkeys(found))

    def escaped(self, text: Column) -> Column:
        """No mark is left; every escape character is doubled into escape + e."""
        out = F.replace(text, F.lit(self.escape), F.lit(f"{self.escape}e"))
        for m in self.marks():
            out = F.replace(out, F.lit(m), F.lit(f"{m[0]}{self.escape}c{m[1:]}"))
        return out

    def unescaped(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit(f"{self.escape}c"), F.lit("")), F.lit(f"{self.escape}e"), F.lit(self.escape))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns by number, then role and text.
    Null numbers come first; null roles and texts are empty."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    return conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def first_error(turns: Column, template: Template) -> Column:
    """(state, place of the first turn that the machine has no move for, else null)."""
    moves = F.create_map(*[F.lit(x) for state, to in template.moves.items() for role, after in to.items() for x in (f"{state}>{role}", after)])
    nothing = F.lit(None).cast("long")
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("at"), nothing.alias("error"))

    def step(a: Column, t: Column) -> Column:
        after = moves[F.concat(a["state"], F.lit(">"), t["role"])]
        lost = a["error"].isNull() & after.isNull()
        return F.struct(
            F.coalesce(after, F.lit("lost")).alias("state"), (a["at"] + 1).cast("long").alias("at"), F.when(lost, a["at"]).otherwise(a["error"]).alias("error")
        )

    return F.aggregate(turns, begin, step)


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, valid, first_error, segments, formatted): one row per conversation.

    segments is an array of (text, loss); formatted is their texts in a row. Conversations
    whose turns come in no proper order are formatted too, with valid false and the place of
    the first wrong turn. A conversation is one row, so its turns meet in one task; its text
    has to fit in a value of a column, and is written and read back whole up to there. Turns of
    one number come by role, then text; repeated rows are turns one after the other; rows
    without a conv_id are a conversation of their own. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """

    def segment(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def segments(t: Column) -> Column:
        text = template.escaped(t["text"])
        out = F.array(
            segment(F.concat(F.lit(template.role_mark), template.escaped(t["role"]), F.lit(template.other.opening)), False),
            segment(text, template.other.loss),
            segment(F.lit(template.other.closing), False),
        )
        for role, turn in template.turns.items():
            out = F.when(
                t["role"] == role, F.array(segment(F.lit(turn.opening), False), segment(text, turn.loss), segment(F.lit(turn.closing), False))
            ).otherwise(out)
        return out

    walked = ordered_turns(conversations).withColumn("walk", first_error(F.col("turns"), template))
    made = walked.select(
        "conv_id",
        F.col("walk.error").alias("first_error"),
        (F.col("walk.error").isNull() & F.col("walk.state").isin(*template.accepting)).alias("valid"),
        F.concat(F.array(segment(F.lit(template.start), False)), F.flatten(F.transform("turns", segments))).alias("segments"),
    )
    return made.select("conv_id", "valid", "first_error", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) of a formatted conversation."""
    closings = "|".join(re.escape(t.closing) for t in [*template.turns.values(), template.other])
    pieces = F.split(F.substr(formatted, F.lit(len(template.start) + 1)), closings, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing stands after the last closing

    def parse(p: Column) -> Column:
        named = F.split(F.substr(p, F.lit(len(template.role_mark) + 1)), re.escape(template.other.opening), 2)
        out = F.struct(template.unescaped(named[0]).alias("role"), template.unescaped(F.coalesce(F.get(named, F.lit(1)), F.lit(""))).alias("text"))
        for role, turn in template.turns.items():
            mine = F.struct(F.lit(role).alias("role"), template.unescaped(F.substr(p, F.lit(len(turn.opening) + 1))).alias("text"))
            out = F.when(F.startswith(p, F.lit(turn.opening)), mine).otherwise(out)
        return out

    return F.transform(pieces, parse)


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What is read back from formatted conversations: turns from the text, loss from the flags."""
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")
    read = chats.select("conv_id", "valid", "first_error", read_back(F.col("formatted"), template).alias("back"), learned.alias("learned"), F.length("formatted").alias("length"))
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.col("length").cast("long").alias("formatted_chars"),
        "valid",
        "first_error",
    )


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of number -1, whose texts are made of control strings.
    Rows that the table itself has under -1 are turns of the same conversation; of an empty table
    only number -1 comes. Other cases as in ``format_chats``."""
    tricky = spark.sql("SELECT -1L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return digests(format_chats(own.unionByName(tricky)))


def _sql_escape() -> str:
    template, out = Template(), "replace(coalesce({}, ''), '\\', '\\e')"
    for m in template.marks():
        out = f"replace({out}, '{m}', '{m[0]}\\c{m[1:]}')"
    return out


def oracle() -> str:
    t = Template()
    known = " ".join(f"WHEN '{r}' THEN {len(x.opening) + len(x.closing)}" for r, x in t.turns.items())
    escape = _sql_escape()
    other = f"{len(t.role_mark + t.other.opening + t.other.closing)} + length({escape.format('role')})"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
o AS (SELECT *, row_number() OVER w - 1 AS place, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, NOT coalesce(CASE WHEN place = 0 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END, false) AS wrong,
  length({escape.format('text')}) + CASE role {known} ELSE {other} END AS made FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(made) + {len(t.start)})::BIGINT AS formatted_chars,
  bool_and(NOT wrong) AND max_by(role, place) = 'assistant' AS valid,
  min(place) FILTER (wrong)::BIGINT AS first_error
FROM e GROUP BY conv_id
"""
