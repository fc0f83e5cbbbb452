"""Chat formatting: a state machine over roles and a declarative template, in built-in functions only.

Conversations are rows (conversation, turn, role, text). Rows of a conversation are ordered by turn,
then role, then text, so ties and repeated rows have one result and every row is kept. Null role or
text counts as empty, a null turn comes first, rows with a null conversation form a conversation of
their own. An empty table gives an empty table. Only the four named columns are read, so further
columns, whatever their names, do not matter.

A formatted conversation is one value, so the turns of one conversation meet in one row; a single
conversation is bounded by what one training example may hold.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "error"


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are marked, which roles are trained on and which role may follow which.

    A control string has two or more characters; the first character of any control string appears in
    none of them beyond its first place. That makes the marks self-delimiting: no mark can start inside
    a text and end in the mark behind it.
    """

    turn_open: str = "<|turn|>"
    text_open: str = "<|says|>"
    turn_close: str = "<|end|>"
    reserved: Sequence[str] = ("<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "\\"
    trained_roles: Sequence[str] = ("assistant",)
    start: str = "start"
    accepting: Sequence[str] = ("assistant",)
    transitions: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    @property
    def controls(self) -> list[str]:
        return list(dict.fromkeys([self.turn_open, self.text_open, self.turn_close, *self.reserved]))

    def __post_init__(self) -> None:
        leads = {c[:1] for c in self.controls}
        if len(self.escape) != 1:
            raise ValueError("the escape is one character")
        for c in self.controls:
            if len(c) < 2 or self.escape in c or any(x in leads for x in c[1:]):
                raise ValueError(f"not a self-delimiting control string: {c!r}")
        if ERROR in self.transitions:
            raise ValueError(f"{ERROR!r} is the state of a conversation with a turn out of order")


def escape_controls(text: Column, template: ChatTemplate) -> Column:
    """Double the escape, then put one behind the first character of every control string."""
    esc = template.escape
    out = F.replace(text, F.lit(esc), F.lit(esc + esc))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + esc + c[1:]))
    return out


def unescape_controls(text: Column, template: ChatTemplate) -> Column:
    """The inverse of ``escape_controls``: an escape gives way to the character behind it."""
    return F.regexp_replace(text, f"(?s){re.escape(template.escape)}(.)", "$1")


def _next_state(template: ChatTemplate, state: Column, role: Column) -> Column:
    by_state = F.lit(ERROR)
    for name, moves in template.transitions.items():
        target = F.lit(ERROR)
        for said, to in moves.items():
            target = F.when(role == F.lit(said), F.lit(to)).otherwise(target)
        by_state = F.when(state == F.lit(name), target).otherwise(by_state)
    return by_state


def format_chats(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss) in order, the ``formatted`` text, ``valid``
    and ``first_bad_turn`` (0-based; the number of turns if only the ending is wrong; else null).

    A turn is three segments: its opening mark with the role, its text, its closing mark; only the text
    of a trained role bears loss. Conversations with turns out of order are formatted too and marked.
    """
    template = template or ChatTemplate()
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def step(acc: Column, t: Column) -> Column:
        moved = _next_state(template, acc["state"], t["role"])
        bad = F.when(acc["bad"].isNull() & (moved == ERROR), acc["at"]).otherwise(acc["bad"])
        return F.struct(moved.alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    walk = F.aggregate(
        "_turns",
        F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        step,
    )

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def marked(t: Column) -> Column:
        trained = t["role"].isin(*template.trained_roles) if template.trained_roles else F.lit(False)
        opening = F.concat(F.lit(template.turn_open), escape_controls(t["role"], template), F.lit(template.text_open))
        return F.array(
            segment(opening, F.lit(False)),
            segment(escape_controls(t["text"], template), trained),
            segment(F.lit(template.turn_close), F.lit(False)),
        )

    ended = F.col("_walk.state").isin(*template.accepting)
    return (
        grouped.select("conv_id", walk.alias("_walk"), F.flatten(F.transform("_turns", marked)).alias("segments"))
        .select(
            "conv_id",
            "segments",
            F.array_join(F.col("segments.text"), "").alias("formatted"),
            ended.alias("valid"),
            F.when(~ended, F.coalesce(F.col("_walk.bad"), F.col("_walk.at"))).alias("first_bad_turn"),
        )
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns, as array of (role, text), read back from a formatted text alone."""
    template = template or ChatTemplate()
    quoted = {k: re.escape(getattr(template, k)) for k in ("turn_open", "text_open")}
    parts = F.split(formatted, quoted["turn_open"], -1)
    closing = len(template.turn_close)

    def parse(halves: Column) -> Column:
        body = F.get(halves, 1)
        return F.struct(
            unescape_controls(F.get(halves, 0), template).alias("role"),
            unescape_controls(F.substring(body, F.lit(1), F.length(body) - closing), template).alias("text"),
        )

    halved = F.transform(parts, lambda p: F.split(p, quoted["text_open"], -1))
    return F.transform(F.filter(halved, lambda h: F.size(h) > 1), parse)


def read_loss(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    template = template or ChatTemplate()
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape_controls(s["text"], template)), "")
