"""Chat formatting: a declarative template, a role machine and segments with loss flags.

Everything is DataFrame functions. One row per conversation comes out; its text is one string, so
the turns of a conversation meet in one row by definition and are ordered there.

Defined cases: a null text is empty; a null role is the empty role, which no machine accepts, so
the conversation is marked invalid but still formatted; turns sort by (turn, role, text) with nulls
first, so repeated and tied rows have a fixed order; a null conv_id is a conversation of its own;
an empty table gives no rows; further columns of the input are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How a conversation is written. ``moves`` is the role machine: (state, role) -> state."""
    open: str = "<|turn|>"
    body: str = "<|text|>"
    close: str = "<|end|>\n"
    foreign: tuple[str, ...] = ("</s>", "[INST]", "[/INST]", "<|endoftext|>")   # control strings of other formats
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.body, self.close.rstrip("\n"), *self.foreign)


def escaped(text: Column, t: ChatTemplate) -> Column:
    """Double every backslash, then break each control string after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:])), t.controls, out)


def unescaped(text: Column, t: ChatTemplate) -> Column:
    """The inverse: an odd backslash inside a control string can only come from ``escaped``."""
    out = reduce(lambda c, s: F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s)), t.controls, text)
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_chats(conversations: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, segments (text, loss), formatted, valid, bad_turn (0-based, null if none)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    flow = F.create_map(*[x for (state, role), to in t.moves.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))])
    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def move(acc, x):
        to = flow[F.concat(acc["state"], F.lit("\n"), x["role"])]
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"),
                        F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"))

    def pieces(x):
        head = F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.body))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                       F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))

    ran = chats.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                       F.flatten(F.transform("turns", pieces)).alias("segments"),
                       F.aggregate("turns", begin, move).alias("run"))
    return ran.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                      (F.col("run.bad").isNull() & F.col("run.state").isin(*t.final)).alias("valid"), F.col("run.bad").alias("bad_turn"))


def read_turns(formatted: Column, t: ChatTemplate = ChatTemplate()) -> Column:
    """Array of (role, text), read back from the formatted string alone."""
    parts = F.split(formatted, "\\Q" + t.close + "\\E")           # the last part is what follows the last close: nothing
    cut = len(t.open) + 1

    def turn(p):
        two = F.split(F.substr(p, F.lit(cut)), "\\Q" + t.body + "\\E", 2)
        return F.struct(unescaped(F.get(two, F.lit(0)), t).alias("role"), unescaped(F.get(two, F.lit(1)), t).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(segments: Column, t: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
