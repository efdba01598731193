"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's rows, ordered by turn (ties by role, then text; null turns
first), are checked by a machine whose state is the last role: ``next`` of the
template lists the roles that may follow each state. Every turn is written as
opening mark, escaped text, closing mark, and the text of a role with ``loss``
carries the loss flag. A conversation that breaks the turn order is formatted
all the same and reported with its first faulty turn.

Control strings inside texts (and inside unknown role names) are broken up by a
backslash after their first character, and backslashes are doubled; reading
back undoes both, so formatting loses nothing.

All of it is column expressions. Per-turn work (escaping and the machine) is done
on rows, with a window that spills; only the finished conversation, which is one
output value by nature, is put together in one row.

Defined results: a null text or role is the empty string; null ``conv_id`` rows
form one conversation; repeated rows are turns of their own; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "<start>"


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role; ``next`` gives the roles that may follow a state. A role
    without marks of its own is named between ``other_open`` and
    ``other_named``. ``control`` are all strings that texts must not show."""

    roles: dict[str, Role]
    next: dict[str, list[str]]
    final: list[str]
    bos: str = "<s>"
    eos: str = "</s>"
    other_open: str = "[ROLE]"
    other_named: str = "[/ROLE]"
    other_close: str = "[/TURN]"
    control: list[str] = field(default_factory=list)

    def strings(self) -> list[str]:
        marks = [m for r in self.roles.values() for m in (r.open.strip(), r.close.strip())]
        own = [*marks, self.bos, self.eos, self.other_open, self.other_named, self.other_close, *self.control]
        return sorted({m for m in own if m})


INSTRUCT = Template(
    roles={"system": Role("[SYS]", "[/SYS]"), "user": Role("[INST]", "[/INST]"),
           "assistant": Role("[OUT]", "[/OUT]", loss=True)},
    next={START: ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    final=["assistant"],
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.strings():
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, values: dict[str, str], other: Column) -> Column:
    out = None
    for name, v in values.items():
        out = F.when(role == name, F.lit(v)) if out is None else out.when(role == name, F.lit(v))
    return other if out is None else out.otherwise(other)


def format_chats(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, n_turns, valid, bad_turn (position of the first faulty turn),
    segments array<struct<text, loss>>: joined, the segments' texts are the
    formatted conversation."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role = F.col("role")
    allowed = F.lit(False)
    for state, after in template.next.items():
        allowed = allowed | ((F.col("state") == state) & role.isin(after))
    named = F.concat(F.lit(template.other_open), escape(role, template), F.lit(template.other_named))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    bos = F.when(F.col("pos") == 0, F.lit(template.bos)).otherwise(F.lit(""))
    head = F.concat(bos, _by_role(role, {k: r.open for k, r in template.roles.items()}, named))
    tail = _by_role(role, {k: r.close for k, r in template.roles.items()}, F.lit(template.other_close))
    loss = role.isin([k for k, r in template.roles.items() if r.loss])
    rows = (rows.withColumn("state", F.coalesce(F.lag("role").over(order), F.lit(START)))
            .withColumn("pos", F.row_number().over(order) - 1).withColumn("ok", allowed)
            .withColumn("s", F.array(seg(head, F.lit(False)), seg(escape(F.col("text"), template), loss),
                                     seg(tail, F.lit(False)))))
    convs = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "s"))).alias("p"),
        F.min(F.when(~F.col("ok"), F.col("pos"))).alias("bad_turn"))
    end = F.element_at("p", -1)["role"].isin(template.final)
    segments = F.concat(F.flatten(F.transform("p", lambda x: x["s"])), F.array(seg(F.lit(template.eos), F.lit(False))))
    return convs.select("conv_id", F.size("p").cast("long").alias("n_turns"),
                        (F.col("bad_turn").isNull() & end).alias("valid"),
                        F.col("bad_turn").cast("long").alias("bad_turn"), segments.alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> parsed from a formatted string alone."""
    closes = [r.close for r in template.roles.values()] + [template.other_close]
    # a closing mark never stands inside an escaped text, so it ends its turn
    cut = "(?<=" + "|".join(re.escape(c) for c in closes) + ")"
    body = F.substring(formatted, F.lit(len(template.bos) + 1),
                       F.length(formatted) - len(template.bos) - len(template.eos))
    pieces = F.filter(F.split(body, cut), lambda x: F.length(x) > 0)

    def turn(x: Column) -> Column:
        out = None
        for name, r in template.roles.items():
            got = F.struct(F.lit(name).alias("role"),
                           unescape(F.substring(x, F.lit(len(r.open) + 1),
                                                F.length(x) - len(r.open) - len(r.close))).alias("text"))
            hit = F.startswith(x, F.lit(r.open))
            out = F.when(hit, got) if out is None else out.when(hit, got)
        rest = F.substring(x, F.lit(len(template.other_open) + 1),
                           F.length(x) - len(template.other_open) - len(template.other_close))
        at = F.instr(rest, template.other_named)
        other = F.struct(unescape(F.substring(rest, F.lit(1), at - 1)).alias("role"),
                         unescape(F.substring(rest, at + len(template.other_named), F.length(rest))).alias("text"))
        return other if out is None else out.otherwise(other)

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digest(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """The registered digest, read back from the formatted conversations."""
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (chats.withColumn("formatted", formatted(F.col("segments")))
            .withColumn("turns", read_back(F.col("formatted"), template))
            .withColumn("under", loss_text(F.col("segments")))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(spoken, "").cast("binary"), 256).alias("turns_sha256"),
                    F.length("under").cast("long").alias("loss_chars"),
                    F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn"))
