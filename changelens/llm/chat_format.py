"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything here is DataFrame and SQL functions.

The template names its control strings. A turn is written as
``<|turn|>`` role ``<|text|>`` text ``<|end|>``; inside roles and texts a backslash is
doubled and a control string has a backslash put after its first character, so no control
string can occur inside a text, and `unescape` (drop a backslash, keep what follows it)
gives the text back exactly.

Defined results: a null text or role is empty; turns are ordered by turn (null first), then
role, then text, so ties and repeated rows keep a fixed order; rows of a null conv_id form
one conversation; an empty table gives an empty result; extra columns are ignored. A
conversation of which the machine rejects the order is still formatted: `valid` is false
and `bad_turn` is the position of the first turn that has no transition.
A conversation is one value of the result, so all its turns meet in one row by nature.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import table


@dataclass(frozen=True)
class Template:
    """Control strings, the roles whose texts are learned, and the machine's transitions
    (state, role) -> state. Control strings share their first character, which occurs in
    them nowhere else."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("asked", "answered")
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end)


TEMPLATE = Template()


def _java(text: str) -> str:
    """text as a literal in a Java pattern."""
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escape(col: Column, template: Template = TEMPLATE) -> Column:
    """Doubles backslashes and breaks up control strings."""
    first = template.turn[0]
    rest = "|".join(_java(c[1:]) for c in template.controls)
    doubled = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"{_java(first)}(?={rest})", first.replace("$", r"\$") + r"\\")


def unescape(col: Column) -> Column:
    """The inverse of `escape`."""
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def _machine(turns: Column, template: Template) -> Column:
    """The state after all turns, and the position of the first turn without a transition
    (-1 if none)."""
    steps = F.create_map(
        *[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state} {role}", to)]
    )

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(steps, F.concat_ws(" ", acc["state"], turn["role"]))
        return F.struct(
            F.when(acc["bad"] >= 0, acc["state"]).otherwise(F.coalesce(to, F.lit("stuck"))).alias("state"),
            F.when(acc["bad"] >= 0, acc["bad"]).when(to.isNull(), acc["at"]).otherwise(F.lit(-1)).alias("bad"),
            (acc["at"] + F.lit(1)).alias("at"),
        )

    zero = F.struct(F.lit(template.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("at"))
    return F.aggregate(turns, zero, step)


def format_conversations(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per conversation: conv_id, segments (array of
    text and loss), formatted (the segments' texts in a row), valid, bad_turn, state."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        learned = t["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(F.concat(F.lit(template.turn), escape(t["role"], template), F.lit(template.text)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), learned.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    with_segments = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        _machine(F.col("turns"), template).alias("m"),
    )
    return with_segments.select(
        "conv_id",
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        ((F.col("m.bad") < 0) & F.col("m.state").isin(*template.accepting)).alias("valid"),
        F.col("m.bad").alias("bad_turn"),
        F.col("m.state").alias("state"),
    )


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, _java(template.end))
    whole = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last end marker is empty

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(template.turn) + 1, 2147483647)
        at = F.instr(body, template.text)
        return F.struct(
            unescape(F.substring(body, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(body, at + len(template.text), F.lit(2147483647))).alias("text"),
        )

    return F.transform(whole, turn)


def digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What can be read back from the formatted conversations, as counts and digests."""
    loss = F.filter("segments", lambda s: s["loss"])
    read = formatted.select(
        "conv_id",
        "formatted",
        "valid",
        "bad_turn",
        read_back(F.col("formatted"), template).alias("turns"),
        unescape(F.concat_ws("", F.transform(loss, lambda s: s["text"]))).alias("learned"),
    )
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """rows and conversation -7, both of whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    probe = rows.sparkSession.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("p")
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe.select("p.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every conversation, formatted and read back."""
    return digests(format_conversations(with_probe(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), escaped AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(replace(replace(replace(replace(text, '\', '\\'), '<|turn|>', '<\|turn|>'), '<|text|>', '<\|text|>'), '<|end|>', '<\|end|>'))
    + length(replace(role, '\', '\\')) AS inner_chars
  FROM turns
), judged AS (
  SELECT *, NOT ((before IS NULL AND role IN ('system', 'user')) OR (before = 'system' AND pos = 1 AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user')) AS wrong
  FROM escaped
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(inner_chars + 23)::BIGINT AS formatted_chars,
  NOT bool_or(wrong) AND arg_max(role, pos) IN ('user', 'assistant') AS valid,
  coalesce(min(pos) FILTER (WHERE wrong), -1)::INTEGER AS bad_turn
FROM judged GROUP BY conv_id
"""
