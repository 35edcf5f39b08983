"""Chat formatting with a state machine over roles, in DataFrame functions only.

A declarative template says how a turn of each role begins and ends, which
roles carry loss, and which role may follow which. A conversation becomes an
ordered list of segments (header, content, end of turn), each with a loss
flag; joined they are the formatted text. Control strings within a text are
escaped, so the formatted text can be split into its turns again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """``headers``: what a turn of each role begins with. ``end``: what ends every turn. ``escape``: the
    character put before a control string in a text, and before itself. ``loss``: roles whose content is
    learned. ``moves``: for each state (START or the role of the turn before) the roles that may follow.
    ``finals``: roles that may come last. Headers are all told apart by their first control string."""

    headers: Mapping[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role "
    other_end: str = ": "
    end: str = " </turn>\n"
    escape: str = "\\"
    loss: tuple[str, ...] = ("assistant",)
    moves: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    finals: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        """Strings that mark turns: no text may hold them unescaped."""
        return ("###", "</turn>")


DEFAULT = Template()


def escaped(text: Column, t: Template = DEFAULT, also: tuple[str, ...] = ()) -> Column:
    """The escape character doubled, then one put after the first character of each control string,
    overlapping ones included."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for c in (*t.controls, *also):
        out = F.regexp_replace(out, F.lit(f"{_quoted(c[0])}(?={_quoted(c[1:])})"), F.lit("$0" + _quoted(t.escape)))
    return out


def unescaped(text: Column, t: Template = DEFAULT) -> Column:
    """The inverse of ``escaped``: an escape character goes and the character after it stays."""
    return F.regexp_replace(text, F.lit(_quoted(t.escape) + r"([\s\S])"), F.lit("$1"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in s)


def _header(role: Column, t: Template) -> Column:
    out = F.concat(F.lit(t.other), escaped(role, t, (t.other_end,)), F.lit(t.other_end))
    for name, text in t.headers.items():
        out = F.when(role == name, F.lit(text)).otherwise(out)
    return out


def turn_segments(role: Column, text: Column, t: Template = DEFAULT) -> Column:
    """The three segments of a turn as an array of (text, loss)."""
    def segment(x: Column, loss: Column) -> Column:
        return F.struct(x.alias("text"), loss.alias("loss"))

    return F.array(segment(_header(role, t), F.lit(False)), segment(escaped(text, t), role.isin(*t.loss)), segment(F.lit(t.end), F.lit(False)))


def run_machine(roles: Column, t: Template = DEFAULT) -> Column:
    """Index (from 0) of the first turn that the state machine refuses; the number of turns if the last
    state is not final; null if the conversation is valid."""
    def allowed(state: Column, role: Column) -> Column:
        out = F.lit(False)
        for before, after in t.moves.items():
            out = out | ((state == before) & role.isin(*after))
        return out

    first = F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        bad = F.when(acc["bad"].isNull() & ~allowed(acc["state"], role), acc["at"]).otherwise(acc["bad"])
        return F.struct(role.alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    end = F.aggregate(roles, first, step)
    return F.when(end["bad"].isNotNull(), end["bad"]).when(~end["state"].isin(*t.finals), end["at"])


def format_conversations(turns: DataFrame, t: Template = DEFAULT, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: the id, ``formatted``, ``segments`` (array of text and loss flag,
    in order), ``valid`` and ``bad_turn`` (where the state machine stopped; null if valid).

    Turns are ordered by turn, then role, then text; a null turn comes first. A null text is empty, a
    null role the role ''. Rows that repeat a turn stay, as turns of their own, and usually make the
    conversation invalid; invalid conversations are formatted all the same. Rows with a null id form one
    conversation. An empty table gives no rows; other columns are not read.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    whole = turns.select(F.col(id_col).alias("id"), row.alias("row")).groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda x: turn_segments(x["role"], x["text"], t)))
    bad = run_machine(F.transform("turns", lambda x: x["role"]), t)
    whole = whole.select("id", segments.alias("segments"), bad.alias("bad_turn"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return whole.select(F.col("id").alias(id_col), formatted.alias("formatted"), "segments", F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_back(formatted: Column, t: Template = DEFAULT) -> Column:
    """The turns of a formatted text as an array of (role, text, loss), from the text alone."""
    bodies = F.split(formatted, _quoted(t.end))
    bodies = F.slice(bodies, 1, F.greatest(F.size(bodies) - 1, F.lit(0)))  # nothing follows the last end

    def turn(body: Column) -> Column:
        known = F.lit(None).cast("string")
        start = F.lit(None).cast("int")
        for name, header in t.headers.items():
            is_it = F.startswith(body, F.lit(header))
            known, start = F.when(is_it, F.lit(name)).otherwise(known), F.when(is_it, F.lit(len(header))).otherwise(start)
        # another role: its name is escaped and ends at the first other_end
        rest = F.substr(body, F.lit(len(t.other) + 1))
        name = F.substring_index(rest, t.other_end, 1)
        role = F.coalesce(known, unescaped(name, t))
        start = F.coalesce(start, F.lit(len(t.other) + len(t.other_end)) + F.length(name))
        return F.struct(role.alias("role"), unescaped(F.substr(body, start + 1), t).alias("text"), role.isin(*t.loss).alias("loss"))

    return F.transform(bodies, turn)
