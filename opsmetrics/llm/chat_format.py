"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

Everything is declared in a `Template`: the control strings around a turn, which roles carry the
loss, and which role may follow which state. A conversation becomes one row with its segments in
order; the concatenation of their texts is the training text, and the loss mask is the flag of
each segment. Only DataFrame expressions run.

Control strings inside texts are escaped by one backslash after their first character, existing
backslashes there are kept, so `unescape` gives back every text exactly. Roles are URL-encoded.

Defined results: a null text or role counts as empty; turns are ordered by (turn, role, text) with
null turns first, so ties and repeated rows have one order and all are kept; conversations with a
null id are one conversation; an order of roles that the machine does not know is formatted all the
same and flagged. An empty table gives an empty table. Other columns are not looked at. A
conversation is one training text, so it is one row and must fit one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """`open role header_end text close`, once per turn.

    `transitions` are (state, role, next state); the machine begins in "start", must end in one of
    `final`, and any other role in a state is an error.
    """

    open: str = "<|im_start|>"
    header_end: str = "\n"
    close: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: tuple[tuple[str, str, str], ...] = (
        (START, "system", "instructed"), (START, "user", "asked"), ("instructed", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("answered",)
    escape: str = field(default="\\", init=False)

    def __post_init__(self):
        if len({c[0] for c in self.control}) != 1 or min(map(len, self.control)) < 2:
            raise ValueError("control strings need one common first character and a second one")
        if self.open not in self.control or not self.close.startswith(self.control):
            raise ValueError("a turn must begin and end with a control string")


def _pattern(template: Template, escaped: bool) -> str:
    rest = "|".join(re.escape(c[1:]) for c in template.control)
    more = r"\\" if escaped else ""
    return rf"(?<={re.escape(template.control[0][0])})(\\*){more}(?={rest})"


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, _pattern(template, False), r"$1\\")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, _pattern(template, True), "$1")


def _machine(turns: Column, template: Template) -> Column:
    """struct(state, first_error): the state after the last turn, and the position of the first
    turn that the machine rejects (it stays in its state there), or null."""
    steps = F.create_map(*[F.lit(x) for state, role, to in template.transitions for x in (f"{state}>{role}", to)])

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(steps, F.concat(acc["state"], F.lit(">"), turn["role"]))
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"),
            F.when(acc["first_error"].isNull() & to.isNull(), acc["n"]).otherwise(acc["first_error"]).alias("first_error"),
            (acc["n"] + 1).alias("n"))

    begin = F.struct(
        F.lit(START).alias("state"), F.lit(None).cast("int").alias("first_error"), F.lit(0).alias("n"))
    return F.aggregate(turns, begin, step)


def format_conversations(
    turns: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: id, segments (array of text and loss), valid, first_error.

    One shuffle, on the conversation.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.select(F.col(id_col).alias("id"), row.alias("t")).groupBy("id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column | bool) -> Column:
        return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.open), F.url_encode(t["role"]), F.lit(template.header_end))
        return F.array(
            segment(head, False), segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close), False))

    done = grouped.withColumn("machine", _machine(F.col("turns"), template)).withColumn(
        "segments", F.flatten(F.transform("turns", segments)))
    ended = F.col("machine.state").isin(*template.final)
    return done.select(
        "id", "segments", (F.col("machine.first_error").isNull() & ended).alias("valid"),
        F.col("machine.first_error").alias("first_error"))


def join_texts(parts: Column) -> Column:
    return F.array_join(parts, "")


def formatted_text(segments: Column) -> Column:
    """The training text of a conversation."""
    return join_texts(F.transform(segments, lambda s: s["text"]))


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return join_texts(F.transform(kept, lambda s: unescape(s["text"], template)))


def parse_turns(formatted: Column, template: Template = Template()) -> Column:
    """The (role, text) turns of a training text, as they were before formatting."""
    parts = F.split(formatted, re.escape(template.open), -1)
    after_first = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.header_end, 1)
        begin = F.length(role) + len(template.header_end)
        body = F.substring(part, begin + 1, F.length(part) - begin - len(template.close))
        return F.struct(F.url_decode(role).alias("role"), unescape(body, template).alias("text"))

    return F.transform(after_first, turn)


def turns_text(turns: Column, between: Sequence[str] = ("\n", "\n")) -> Column:
    """role, newline, text, newline of each turn."""
    return join_texts(F.transform(
        turns, lambda t: F.concat(t["role"], F.lit(between[0]), t["text"], F.lit(between[1]))))
