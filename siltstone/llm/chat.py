"""Chat formatting by a finite-state machine over roles and a declarative template, with DataFrame functions alone."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles carry loss, and which role may follow which.

    A turn is opening, label, middle, text, closing. Control strings inside texts and foreign role names
    get a backslash after their first character, and each backslash is doubled; no control string starts
    with what one ends with, so the marks that stand in an output are the template's own. A role without
    a label is written as a question mark and its name.
    """

    opening: str = "### "
    middle: str = ": "
    closing: str = " </turn>\n"
    mark: str = "</turn>"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; what is missing is a wrong turn, which leaves the state as it is.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    start: str = "start"
    ends: tuple[str, ...] = ("user", "assistant")

    def controls(self) -> tuple[str, ...]:
        return (*(self.opening + x + self.middle.rstrip() for x in self.labels.values()), self.mark)


def escaped(text: Column, controls: tuple[str, ...]) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def label_of(role: Column, t: Template) -> Column:
    out = F.concat(F.lit("?"), escaped(role, (t.middle, *t.controls())))
    for name, label in t.labels.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def role_of(label: Column, t: Template) -> Column:
    out = unescaped(F.expr("''") if label is None else F.substring(label, 2, 1 << 30))
    for name, label_text in t.labels.items():
        out = F.when(label == label_text, F.lit(name)).otherwise(out)
    return out


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, valid, wrong_turn, segments, formatted) of each conversation of (conv_id, turn, role, text).

    segments are (text, loss) in order and formatted is all their text: for each turn its opening marks,
    its escaped text, flagged if its role carries loss, and its closing mark. valid tells whether the
    machine accepts the order of roles; wrong_turn is the place (from 0) of the first turn that it refuses. Conversations
    that it refuses are written too. Turns are in order of turn, then role, then text, so that ties are
    settled; a null turn comes first; null texts and roles are empty; rows whose conv_id is null are
    one conversation; repeated rows are repeated turns; an empty table gives no rows; other columns are
    ignored. A conversation is one value, as a digest or a training example of it needs it whole.
    """
    t = template or Template()
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    table = F.create_map(*(F.lit(x) for s, m in t.moves.items() for r, to in m.items() for x in (f"{s}\n{r}", to)))
    state = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("wrong")),
        lambda s, x: F.struct(
            F.coalesce(F.try_element_at(table, F.concat(s["state"], F.lit("\n"), x["role"])), s["state"]).alias("state"),
            (s["at"] + 1).alias("at"),
            F.coalesce(s["wrong"], F.when(F.try_element_at(table, F.concat(s["state"], F.lit("\n"), x["role"])).isNull(), s["at"])).alias("wrong"),
        ),
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.opening), label_of(x["role"], t), F.lit(t.middle)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(x["text"], t.controls()).alias("text"), x["role"].isin(*t.loss).alias("loss")),
                F.struct(F.lit(t.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return (
        turns.select("conv_id", state.alias("state"), segments.alias("segments"))
        .select(
            "conv_id",
            (F.col("state.wrong").isNull() & F.col("state.state").isin(*t.ends)).alias("valid"),
            F.col("state.wrong").alias("wrong_turn"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def parsed(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    t = template or Template()
    parts = F.split(formatted, re.escape(t.closing).replace("\\\n", "\\n"))
    parts = F.slice(parts, 1, F.size(parts) - 1)  # nothing follows the last mark

    def turn(part: Column) -> Column:
        label = F.substring_index(F.substring(part, len(t.opening) + 1, 1 << 30), t.middle, 1)
        text = F.substring(part, F.length(label) + len(t.opening) + len(t.middle) + 1, F.lit(1 << 30))
        return F.struct(role_of(label, t).alias("role"), unescaped(text).alias("text"))

    return F.transform(parts, turn)


def digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """What is read back from formatted conversations: turns from the output's text, loss from its segments."""
    lossy = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return chats.select("conv_id", parsed(F.col("formatted"), template).alias("turns"), F.array_join(lossy, "").alias("lossy"), "formatted", "valid", "wrong_turn").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("lossy").cast("long").alias("loss_chars"),
        F.sha2(F.col("lossy").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "wrong_turn",
    )


#: DuckDB: formatted_chars follows from lengths, as each control string and backslash adds one character.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES
    (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'),
    (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '\### Assistant: </turn> ok'))),
sized AS (
  SELECT *,
    length(replace(text, '\', '\\'))
      + (length(text) - length(replace(text, '### System:', ''))) // 11
      + (length(text) - length(replace(text, '### User:', ''))) // 9
      + (length(text) - length(replace(text, '### Assistant:', ''))) // 14
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(role) END
      + 4 + 2 + 9 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  min(CASE WHEN prev IS NULL AND role IN ('system', 'user') OR prev IN ('system', 'assistant') AND role = 'user'
    OR prev = 'user' AND role = 'assistant' THEN NULL ELSE place END) IS NULL
    AND max_by(role, place) IN ('user', 'assistant') AS valid,
  CAST(min(CASE WHEN prev IS NULL AND role IN ('system', 'user') OR prev IN ('system', 'assistant') AND role = 'user'
    OR prev = 'user' AND role = 'assistant' THEN NULL ELSE place END) AS INTEGER) AS wrong_turn
FROM sized GROUP BY conv_id
"""
