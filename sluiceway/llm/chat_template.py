"""Chat formatting with a declarative template and a finite-state machine over roles.

A template names, for each role, the strings around a turn and whether its text is trained on (the loss flag), the string that opens
a conversation, and the allowed steps from role to role. Each turn becomes segments (text, loss); their texts one after
the other are the formatted conversation. Only SQL functions are used.

Escaping: inside texts a backslash is doubled, and a backslash is put after the first character of every control string, so
that no control string of the template is left in a text. ``unescape`` undoes both.

The machine's state is the role of the last turn. A run of turns is a function from the state before it to the state after
it; runs of neighbouring turns are put together first and then joined, so turn order is checked without
ordering a whole conversation in one window. The text of a conversation is one value in the end, and its turns are put
together in runs of ``RUN`` first.

Defined cases: a null text is an empty text and a null role the empty role. Roles the template does not name get the
general marks, with the escaped role between them, and no loss; the machine refuses them. Turns are ordered by turn, ties by role and text; rows
that repeat a turn are turns of their own, a null turn comes first. A null conversation id is a conversation. An empty table gives an empty
result; only the named columns are read, so extra columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import let

RUN = 256  # turn numbers of one run


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool


@dataclass(frozen=True)
class Template:
    start: str
    turns: dict[str, Turn]
    other: tuple[str, str, str]  # before the role, between role and text, after the text
    steps: dict[str, tuple[str, ...]]  # from a role, or "" at the start, to the roles allowed next
    final: tuple[str, ...]  # roles a conversation may end with
    controls: tuple[str, ...] = field(default=())

    def control_strings(self) -> list[str]:
        strings = {self.start, *self.other, *self.controls}
        for turn in self.turns.values():
            strings |= {turn.before, turn.after}
        return sorted({s.strip() for s in strings if s.strip()}, key=lambda s: (-len(s), s))


BRACKETS = Template(
    start="<s>",
    turns={"system": Turn("[SYS] ", " [/SYS]", False), "user": Turn("[INST] ", " [/INST]", False), "assistant": Turn("[OUT] ", "</s>", True)},
    other=("[ROLE] ", " [/ROLE] ", " [/TURN]"),
    steps={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.control_strings())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({heads})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _known(role: Column, template: Template, value) -> Column:
    out = None
    for name, turn in template.turns.items():
        out = (F if out is None else out).when(role == name, F.lit(value(turn)))
    return out


def _machine(template: Template) -> tuple[list[str], dict[tuple[int, str], int]]:
    """States (roles, "" at the start) and steps between them by number."""
    states = ["", *template.turns]
    steps = {(states.index(a), b): states.index(b) for a, to in template.steps.items() for b in to}
    return states, steps


def _run_function(roles: Column, template: Template) -> Column:
    """State after a run of roles, for each state before it. A number from the count of states on is a refusal: what it
    exceeds that count by is the place in the run of the first turn refused."""
    states, steps = _machine(template)
    refused = len(states)
    table = F.create_map(*[F.lit(x) for (a, b), to in steps.items() for x in (f"{a} {b}", to)])
    step = lambda state, turn: F.when(state >= refused, state).otherwise(
        F.coalesce(F.try_element_at(table, F.concat_ws(" ", state.cast("string"), turn.role)), turn.at + refused))
    begin = F.array(*[F.lit(s) for s in range(refused)])
    placed = F.transform(roles, lambda role, i: F.struct(role.alias("role"), i.alias("at")))
    return F.aggregate(placed, begin, lambda at, turn: F.transform(at, lambda s: step(s, turn)))


def _joined_runs(runs: Column, refused: int) -> Column:
    """(state, seen, refused) after runs of (after, turns) one behind the other; refused is the place of the first turn refused."""
    begin = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("refused"))

    def step(acc: Column, run: Column) -> Column:
        after = F.get(run.after, acc.state)
        at = F.when(acc.refused.isNotNull(), acc.refused).when(after >= refused, acc.seen + after - refused)
        return F.struct(F.when(at.isNull(), after).otherwise(acc.state).alias("state"), (acc.seen + run.turns).alias("seen"), at.alias("refused"))

    return F.aggregate(runs, begin, step)


def format_conversations(turns: DataFrame, template: Template = BRACKETS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, segments, valid, first_refused): segments are array<struct<text, loss>>; valid says whether the machine accepts the roles;
    first_refused is the place, from 0, of the first turn it refuses (null: none; the conversation may still end too early)."""
    states, _ = _machine(template)
    name, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    known = name.isin(*template.turns)
    other = [F.lit(s) for s in template.other]
    segments = F.array(
        F.struct(F.when(known, _known(name, template, lambda t: t.before)).otherwise(F.concat(other[0], escape(name, template), other[1])).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(said, template).alias("text"), F.coalesce(_known(name, template, lambda t: t.loss), F.lit(False)).alias("loss")),
        F.struct(F.coalesce(_known(name, template, lambda t: t.after), other[2]).alias("text"), F.lit(False).alias("loss")),
    )
    rows = turns.select(F.col(conv).alias("_conv"), F.floor(F.col(turn) / RUN).alias("_run"), F.struct(
        F.col(turn).alias("turn"), name.alias("role"), said.alias("said"), segments.alias("segments")).alias("_turn"))
    runs = rows.groupBy("_conv", "_run").agg(F.sort_array(F.collect_list("_turn")).alias("_turns")).select(
        "_conv", "_run", F.flatten(F.col("_turns.segments")).alias("segments"), _run_function(F.col("_turns.role"), template).alias("after"),
        F.size("_turns").cast("long").alias("turns"))
    whole = runs.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_run", "segments", "after", "turns"))).alias("_runs"))
    opened = F.concat(F.array(F.struct(F.lit(template.start).alias("text"), F.lit(False).alias("loss"))), F.flatten(F.col("_runs.segments")))
    ends = whole.select("_conv", opened.alias("segments"), _joined_runs(F.col("_runs"), len(states)).alias("_end"))
    valid = F.col("_end.refused").isNull() & F.col("_end.state").isin(*[states.index(r) for r in template.final])
    return ends.select(F.col("_conv").alias(conv), "segments", valid.alias("valid"), F.col("_end.refused").alias("first_refused"))


def rendered(segments: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def loss_spans(segments: Column) -> Column:
    """(start, length) in characters of every segment under the loss mask, in the formatted conversation."""
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda acc, s: F.struct((acc.at + F.length(s.text)).alias("at"), F.when(s.loss, F.concat(acc.spans, F.array(F.struct(acc.at.alias("start"), F.length(s.text).alias("length"))))).otherwise(acc.spans).alias("spans"))
    return F.aggregate(segments, begin, step, lambda acc: acc.spans)


def read_turns(formatted: Column, template: Template = BRACKETS) -> Column:
    """Turns (role, text) read back from a formatted conversation: it is cut at the control strings that open and
    close turns, which no text holds."""
    quoted = lambda s: re.escape(s)
    shapes = [f"{quoted(t.before)}(?:.*?){quoted(t.after)}" for t in template.turns.values()] + ["(?:.*?)".join(map(quoted, template.other))]
    found = F.regexp_extract_all(formatted, F.lit("(?s)(" + "|".join(shapes) + ")"), F.lit(1))

    def read(piece: Column) -> Column:
        role = text = None
        for name, t in template.turns.items():
            fits = F.startswith(piece, F.lit(t.before))
            inner = F.substring(piece, F.lit(len(t.before) + 1), F.length(piece) - (len(t.before) + len(t.after)))
            role, text = ((F if role is None else role).when(fits, F.lit(name))), ((F if text is None else text).when(fits, inner))
        a, b, c = template.other
        shape = f"(?s){quoted(a)}(.*?){quoted(b)}(.*){quoted(c)}"
        role, text = role.otherwise(F.regexp_extract(piece, shape, 1)), text.otherwise(F.regexp_extract(piece, shape, 2))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(found, read)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, one piece after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start, s.length))), "")
