"""Chat formatting: a finite-state machine over roles and text segments with loss flags.

A template is declared, not programmed: the opening of a turn (with the role), its
closing, the roles whose text is learnt, and the transitions of the machine that
accepts a conversation. Texts and roles may hold the control strings themselves;
they are escaped reversibly, so that in the output a control string is always a
control string and splitting at it gives the turns back.

Only DataFrame operations: one shuffle by conversation, then expressions. A
conversation is one training text and therefore one row.

Nulls: a null text or role is the empty string; a null conv_id is a conversation;
a null turn comes first. Turns with equal numbers are ordered by role, then text;
repeated rows stay. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

ESCAPE = "\\"
#: Letters that name what an escape stands for: the escape, the mark, the closing, a colon.
CODES = "bmcd"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the machine: state -> roles it accepts; the role is the next state."""

    mark: str = "###"
    close: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    accepts: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for s in (self.mark, self.close):
            if not s or ESCAPE in s or s in CODES:
                raise ValueError(f"a mark is a text without escapes, and not a code: {s!r}")

    def escapes(self) -> tuple[tuple[str, str], ...]:
        """In order of escaping: the escape itself first. No code holds a control string."""
        return ((ESCAPE, ESCAPE + "b"), (self.mark, ESCAPE + "m"), (self.close, ESCAPE + "c"))


def escaped(text: Column, template: Template, role: bool = False) -> Column:
    """Text without control strings; roles also lose the colon that ends them."""
    for plain, code in template.escapes() + (((":", ESCAPE + "d"),) if role else ()):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, template: Template) -> Column:
    """Undoes ``escaped``: every escape starts a code, so codes are replaced one by one."""
    for plain, code in reversed(template.escapes() + ((":", ESCAPE + "d"),)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _accepted(turns: Column, template: Template) -> Column:
    """Runs the machine over the roles; "!" is the state of failure."""
    def step(state: Column, turn: Column) -> Column:
        nxt = F.when(F.lit(False), F.lit("!"))
        for here, roles in template.accepts.items():
            nxt = nxt.when((state == here) & turn["role"].isin(*roles), turn["role"])
        return nxt.otherwise(F.lit("!"))

    return F.aggregate(turns, F.lit(""), step).isin(*template.final)


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, accepted, segments (text, loss), formatted.

    ``accepted`` says whether the machine accepts the order of roles and ends in
    a final state. Every conversation is formatted; a caller who wants only
    accepted ones filters. Only segments of text, not marks, can carry loss.
    """
    template = template or Template()
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(turn))
    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.mark + " "), escaped(t["role"], template, True), F.lit(": "))
        loss = t["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.close + "\n").alias("text"), F.lit(False).alias("loss")))

    parts = F.flatten(F.transform("turns", segments))
    out = grouped.select(
        "conv_id", _accepted(F.col("turns"), template).alias("accepted"), parts.alias("segments"))
    return out.withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation."""
    template = template or Template()
    pieces = F.split(formatted, re.escape(template.close) + "\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(template.mark) + 2), F.length(piece))
        end = F.instr(body, F.lit(": "))  # roles hold no colon
        role = F.substring(body, F.lit(1), end - 1)
        text = F.substring(body, end + 2, F.length(body))
        return F.struct(unescaped(role, template).alias("role"),
                        unescaped(text, template).alias("text"))

    return F.transform(pieces, turn)
