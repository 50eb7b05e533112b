"""Chat formatting from a declarative template, in native columns only.

A finite-state machine over roles (its state is the last role) checks the order of turns. Every
turn becomes three segments, opening marker, text and closing marker, each with a flag that says
whether training loses on it. Texts are escaped so that no marker can occur in them or across their
ends: a backslash is doubled, and every character that begins a marker gets a backslash behind it,
which no marker has there. ``read_back`` undoes a formatted conversation from its characters alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers by role, roles under the loss, and the machine: which roles may follow which, and end."""

    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[NAME]", "[/ROLE]")
    loss: tuple[str, ...] = ("assistant",)
    start: tuple[str, ...] = ("system", "user")
    follow: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    end: tuple[str, ...] = ("assistant", "user")

    @property
    def control(self) -> list[str]:
        return [m for pair in self.markers.values() for m in pair] + list(self.other)

    @property
    def heads(self) -> str:
        """The characters that begin markers."""
        return "".join(sorted({m.lstrip()[0] for m in self.control}))

    @property
    def moves(self) -> list[str]:
        """Transitions of the machine, as ``from>to``; it starts from the empty role."""
        return [f">{b}" for b in self.start] + [f"{a}>{b}" for a, to in self.follow.items() for b in to]

    def __post_init__(self) -> None:
        if "\\" in "".join(self.control) or not all(m.strip() for m in self.control):
            raise ValueError("a marker needs a printing character and no backslash")
        if len(set(self.control)) < len(self.control):
            raise ValueError("markers must differ")


def escape(text: Column, template: ChatTemplate) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for head in template.heads:
        out = F.replace(out, F.lit(head), F.lit(head + "\\"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _turn_segments(turn: Column, template: ChatTemplate) -> Column:
    seg = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    text = escape(turn["text"], template)
    opening, middle, closing = (F.lit(m) for m in template.other)
    out = F.array(seg(F.concat(opening, escape(turn["role"], template), middle), False), seg(text, False), seg(closing, False))
    for role, (before, after) in template.markers.items():
        known = F.array(seg(F.lit(before), False), seg(text, role in template.loss), seg(F.lit(after), False))
        out = F.when(turn["role"] == role, known).otherwise(out)
    return out


def format_conversations(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, n_turns, valid, bad_turn, segments, formatted`` for every conversation.

    Turns go by number; turns of one number by role, then text; null numbers come first. A null
    role or text is empty. valid says whether the machine accepts the roles; bad_turn is the
    position (from 0) of the first role that it rejects, n_turns if only the end is wrong, null if
    valid. Rejected conversations are formatted too; unknown roles get the general markers. A null
    id is a conversation of its own. Repeated rows are repeated turns.
    """
    template = template or ChatTemplate()
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.select(F.col(id_col).alias("conv_id"), turn.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    first = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def move(acc: Column, x: Column) -> Column:
        ok = F.concat(acc["state"], F.lit(">"), x["role"]).isin(*template.moves)
        return F.struct(x["role"].alias("state"), (acc["at"] + 1).alias("at"), F.when(acc["bad"].isNull() & ~ok, acc["at"]).otherwise(acc["bad"]).alias("bad"))

    def done(acc: Column) -> Column:
        return F.when(acc["bad"].isNull() & ~acc["state"].isin(*template.end), acc["at"]).otherwise(acc["bad"])

    out = grouped.withColumn("bad_turn", F.aggregate("turns", first, move, done))
    out = out.withColumn("segments", F.flatten(F.transform("turns", lambda t: _turn_segments(t, template))))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("bad_turn").isNull().alias("valid"), "bad_turn", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def learned(segments: Column) -> Column:
    """All text under the loss flags of the segments, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation, unescaped: array<struct<role, text, loss>>."""
    template = template or ChatTemplate()
    shapes = [(role, before, after) for role, (before, after) in template.markers.items()]
    opening, middle, closing = template.other
    pattern = "(?s)" + "|".join(f"{re.escape(b)}.*?{re.escape(a)}" for b, a in [(b, a) for _, b, a in shapes] + [(opening, closing)])

    def one(x: Column) -> Column:
        cut = lambda b, a: F.substr(x, F.lit(len(b) + 1), F.length(x) - len(b) - len(a))
        body = cut(opening, closing)
        turn = lambda role, text, loss: F.struct(role.alias("role"), unescape(text).alias("text"), F.lit(loss).alias("loss"))
        out = turn(unescape(F.substring_index(body, middle, 1)), F.substr(body, F.locate(middle, body) + len(middle)), False)
        for role, before, after in shapes:
            out = F.when(F.startswith(x, F.lit(before)), turn(F.lit(role), cut(before, after), role in template.loss)).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), one)
