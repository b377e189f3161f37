r"""Chat formatting from a declarative template, with DataFrame functions only.

A template gives each role its marks and loss flag, and the transitions of a finite-state
machine over roles.  A conversation becomes a list of segments (text, loss); their texts,
one after the other, are the formatted string.

Control strings inside texts are escaped: the escape character is doubled, then put behind the
first character of each control string.  So no control string appears in an escaped text, the
formatted string splits at its marks without doubt, and dropping each escape character but
keeping what follows it gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<text: string, loss: boolean>>"


@dataclass(frozen=True)
class Template:
    """roles: role -> (tag, loss).  A turn is "[TAG] text [/TAG]"; other roles are named inside: "[TURN] role [AS] text [/TURN]".

    follows: which roles may come after a role ("" is the start); ends: roles after which a conversation is complete.
    """

    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {"system": ("SYS", False), "user": ("INST", False), "assistant": ("ANS", True)})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    begin: str = "<s>"
    end: str = "</s>"
    escape: str = "\\"

    def controls(self) -> list[str]:
        tags = [tag for tag, _ in self.roles.values()]
        return [self.begin, self.end, "[TURN]", "[AS]", "[/TURN]", *(f"[{t}]" for t in tags), *(f"[/{t}]" for t in tags)]


def escaped(text: Column, template: Template) -> Column:
    e = template.escape
    out = F.replace(text, F.lit(e), F.lit(e + e))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + e + s[1:])), template.controls(), out)


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(template.escape)}(.)", "$1")


def _segments(role: Column, text: Column, template: Template) -> Column:
    """A turn's three segments."""

    def of(head: Column, tail: str, loss: bool) -> Column:
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(escaped(text, template).alias("text"), F.lit(loss).alias("loss")), F.struct(F.lit(tail).alias("text"), F.lit(False).alias("loss"))).cast(SEGMENTS)

    out = of(F.concat(F.lit("[TURN] "), escaped(role, template), F.lit(" [AS] ")), " [/TURN]", False)
    for name, (tag, loss) in template.roles.items():
        out = F.when(role == name, of(F.lit(f"[{tag}] "), f" [/{tag}]", loss)).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: conv_col, segments, formatted, valid, bad_turn.

    Rows of a conversation are ordered by turn; ties by role and text, so the order of input rows never matters, and
    repeated rows are turns of their own.  valid tells whether the machine accepts the roles and ends in a complete
    state; bad_turn is the number (from 0) of the first turn that it refuses, or null.  Conversations that
    it refuses are formatted all the same, for the caller to filter.

    A null role or text counts as empty; the empty role is none of the template's and carries no loss.  Rows with a null
    conversation id form one conversation.  Further columns are ignored.
    """
    template = template or Template()
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    inner = F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template)))
    mark = lambda s: F.array(F.struct(F.lit(s).alias("text"), F.lit(False).alias("loss"))).cast(SEGMENTS)
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, bs in template.follows.items() for b in bs))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    step = lambda a, t: F.struct(t["role"].alias("state"), (a["n"] + 1).alias("n"), F.coalesce(a["bad"], F.when(~F.array_contains(allowed, F.concat(a["state"], F.lit(">"), t["role"])), a["n"])).alias("bad"))
    out = chats.select("conv", F.concat(mark(template.begin), inner, mark(template.end)).alias("segments"), F.aggregate("turns", start, step).alias("machine"))
    return out.select(
        F.col("conv").alias(conv_col),
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        (F.col("machine.bad").isNull() & F.col("machine.state").isin(*template.ends)).alias("valid"),
        F.col("machine.bad").alias("bad_turn"),
    )


def parsed(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted string, unescaped."""
    template = template or Template()
    tags = ["TURN", *(tag for tag, _ in template.roles.values())]
    turns = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(rf"\[{t}\] .*? \[/{t}\]" for t in map(re.escape, tags))), F.lit(0))

    def turn(s: Column) -> Column:
        body = F.substring(s, F.lit(len("[TURN] ") + 1), F.char_length(s) - len("[TURN]  [/TURN]"))
        cut = F.instr(body, " [AS] ")
        out = F.struct(unescaped(F.substring(body, F.lit(1), cut - 1), template).alias("role"), unescaped(F.substring(body, cut + len(" [AS] "), F.char_length(body)), template).alias("text"))
        for name, (tag, _) in template.roles.items():
            body = F.substring(s, F.lit(len(tag) + 4), F.char_length(s) - 2 * len(tag) - 7)
            out = F.when(s.startswith(f"[{tag}] "), F.struct(F.lit(name).alias("role"), unescaped(body, template).alias("text"))).otherwise(out)
        return out

    return F.transform(turns, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    template = template or Template()
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)))
