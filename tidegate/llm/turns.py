"""Structure repair of conversations: cheapest edits by dynamic programming over a sorted stream.

Rows are dealt by conversation and sorted by turn, the last turn first; mapInPandas carries the state of
the open conversation from one Arrow batch to the next. The state is the cost from here to the end
for each of four places in the pattern (nothing yet, after a system row, after a user row, after
an assistant row). One byte a row, the backpointer, holds the first letter of the best edits from each
place. Costs run from the end to the front, so that among equally cheap edits the walk
that follows takes the least letter at each place, which gives the least string.

Up to ``keep_rows`` rows and ``keep_chars`` characters of a conversation are kept in memory for that
walk. What exceeds it is spilled: its rows and backpointers go out to a table in the shared folder as
they come, and a second sorted stream walks them forwards. A task holds one byte a row at most
then, for the audit string.

Repeats are found before the stream: rows that share conversation, role and text are counted in a
grouped aggregation, and only groups of two or more are joined back, with their first turn.

Defined cases: a null conv_id is a conversation of its own; null roles and texts are one space, as
are null ids and turns in the damage key; rows of equal turn come by role, then text (both by their
bytes); repeated rows are repeats; a conversation without rows after damage has zeros, an empty audit
and the empty string's hash; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegate.llm.chaining import small_enough
from tidegate.session import written

#: The costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "DIKR"
D, I, K, R = range(4)
#: Where a user or assistant row leads, the only role that fits: after a user row an assistant, else a user.
NEXT = (USER, USER, ASSISTANT, USER)
AT_END = (0, 2 * INSERT, INSERT, 0)
SOLID = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
REPEATS = 500_000          # groups of repeats that may be broadcast


@dataclass(frozen=True)
class RepairSpec:
    keep_rows: int = 20_000
    keep_chars: int = 8 << 20


def damaged(said: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of ``said`` after declared damage; a dropped row stays as ``gone``
    without role and text, so that its conversation is not forgotten."""
    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = said.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    there = F.col("kind") != 0
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(there, role).alias("role"), F.when(there, text).alias("text"),
                       (~there).alias("gone"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with blank, again (role and text came at an earlier turn) and open (no end of a sentence)."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    rows = rows.withColumn("_mark", F.md5("text"))
    groups = written(rows.where("NOT gone").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_mark").alias("_text"))
                     .agg(F.min(turn).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeats")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_mark") == F.col("_text"))
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return rows.join(small_enough(groups, REPEATS), same, "left").select(
        "conv_id", "turn", "role", "text", "gone", (~F.col("text").rlike(SOLID)).alias("blank"),
        F.coalesce(turn > F.col("_first"), F.lit(False)).alias("again"), (~last.isin(".", "!", "?")).alias("open"))


@lru_cache(1 << 16)
def step(after: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], int, int]:
    """Costs before a row from the costs after it, less their minimum; that minimum; and the backpointer byte.

    ``fault``: "must go", "open" or "". """
    extra = TRUNCATED if fault == "open" else 0
    best = [[DELETE + after[s], None, None, None] for s in range(4)]
    for s in range(4) if fault != "must go" else ():
        keep = SYSTEM if initial == "s" and s == START else NEXT[s] if initial == ("a" if s == USER else "u") else None
        if keep is not None:
            best[s][K] = extra + after[keep]
        best[s][R] = REROLE + extra + after[NEXT[s]]
    cost = [min(c for c in b if c is not None) for b in best]
    for s in (USER, ASSISTANT, START, SYSTEM):                   # inserting twice comes back to the same place
        best[s][I] = INSERT + min(cost[NEXT[s]], INSERT + cost[NEXT[NEXT[s]]])
    cost = [min(c for c in b if c is not None) for b in best]
    letters = sum(next(x for x in range(4) if best[s][x] == cost[s]) << 2 * s for s in range(4))
    low = min(cost)
    return tuple(c - low for c in cost), low, letters


class Walk:
    """Follows backpointers from the first row on; collects the audit and the hash of what is kept."""

    def __init__(self):
        self.at, self.audit, self.hash, self.any = START, bytearray(), hashlib.sha256(), False

    def _say(self, role: str, text: str):
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _insert(self):
        self.audit += b"I"
        self._say("assistant" if self.at == USER else "user", "")
        self.at = NEXT[self.at]

    def row(self, letters: int, role: str, text: str):
        while (letter := letters >> 2 * self.at & 3) == I:
            self._insert()
        self.audit += LETTERS[letter].encode()
        if letter == D:
            return
        new = SYSTEM if letter == K and role[:1] == "s" else NEXT[self.at]
        self._say(role if letter == K else "assistant" if new == ASSISTANT else "user", text)
        self.at = new

    def end(self) -> tuple[str, str]:
        while self.at in (SYSTEM, USER):
            self._insert()
        return self.audit.decode(), self.hash.hexdigest()


class Conversation:
    """The open conversation of a stream that runs from its last row to its first."""

    def __init__(self, key, spec: RepairSpec):
        self.key, self.spec = key, spec
        self.after, self.cost, self.pos = AT_END, 0, 0
        self.high = self.low = self.role = self.held = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.chars = 0
        self.rows: list[tuple] = []              # pos, role, text, backpointer
        self.spilled = False

    def add(self, turn, role: str, text: str, blank: bool, again: bool, open_end: bool):
        """A row; it is settled when the next one tells whether it repeats a row of the same turn."""
        if self.held and self.held[:3] == (turn, role, text):
            self._settle(True)
        elif self.held:
            self._settle(False)
        self.held = turn, role, text, blank, again, open_end

    def _settle(self, same_turn: bool):
        turn, role, text, blank, again, open_end = self.held
        if turn is not None:
            self.high = turn if self.high is None else self.high
            self.turns += turn != self.low
            self.low = turn
        initial = role[:1]
        if self.role is not None:
            self.illegal += initial + self.role not in ("su", "ua", "au")
        self.role = initial
        again = again or same_turn
        fault = "must go" if blank or again else "open" if open_end else ""
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += fault == "open"
        self.after, low, letters = step(self.after, initial if initial in ("s", "u", "a") else "", fault)
        self.cost += low
        self.rows.append((self.pos, role, text, letters))
        self.pos += 1
        self.chars += len(text) + len(role)
        self.held = None

    def overflow(self) -> list[tuple]:
        """Rows to spill now."""
        if len(self.rows) <= self.spec.keep_rows and self.chars <= self.spec.keep_chars:
            return []
        self.spilled = True
        return self._taken()

    def _taken(self) -> list[tuple]:
        rows, self.rows, self.chars = self.rows, [], 0
        return rows

    def close(self) -> tuple[list[tuple], dict]:
        if self.held:
            self._settle(False)
        done = {"conv_id": self.key, "gaps": 0 if self.high is None else self.high - self.low + 1 - self.turns, "blank": self.blank,
                "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost + self.after[START]}
        if self.spilled:
            return self._taken(), done
        walk = Walk()
        for _, role, text, letters in reversed(self.rows):
            walk.row(letters, role, text)
        done["audit"], done["repaired_sha256"] = walk.end()
        return [], done


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
COLUMNS = ["conv_id", *COUNTS, "audit", "repaired_sha256", "pos", "role", "text", "letters"]
STREAMED = ("conv_id string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string, "
            "pos bigint, role string, text string, letters int")


def _rows(batch: pd.DataFrame):
    """Tuples of a batch, None for what is missing."""
    return batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in COLUMNS})


def _stream(spec: RepairSpec):
    """Sorted rows, last first: one result row a conversation, and the rows of those that are spilled."""
    def run(batches):
        one, begun = None, False
        for b in batches:
            out: list[dict] = []
            for key, turn, role, text, gone, blank, again, open_end in _rows(b):
                if not begun or key != one.key:
                    if begun:
                        out += _closed(one)
                    one, begun = Conversation(key, spec), True
                if not gone:
                    one.add(None if turn is None else int(turn), role, text, bool(blank), bool(again), bool(open_end))
                    out += _spilled(one.key, one.overflow())
            if out:
                yield _frame(out)
        if begun:
            yield _frame(_closed(one))
    return run


def _spilled(key, rows: list[tuple]) -> list[dict]:
    return [{"conv_id": key, "pos": p, "role": r, "text": t, "letters": x} for p, r, t, x in rows]


def _closed(one: Conversation) -> list[dict]:
    rows, done = one.close()
    return [*_spilled(one.key, rows), done]


def _walk(batches):
    """Spilled rows of conversations, first row first: their audit and hash."""
    key, walk = None, None
    for b in batches:
        out = []
        for conv, role, text, letters in _rows(b):
            if walk is None or conv != key:
                if walk is not None:
                    out.append((key, *walk.end()))
                key, walk = conv, Walk()
            walk.row(int(letters), role, text)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "audit", "repaired_sha256"], dtype=object)
    if walk is not None:
        yield pd.DataFrame([(key, *walk.end())], columns=["conv_id", "audit", "repaired_sha256"], dtype=object)


def repair(rows: DataFrame, spec: RepairSpec = RepairSpec()) -> DataFrame:
    """conv_id, the six counts, audit and repaired_sha256 of every conversation of ``rows``
    (conv_id, turn, role, text, gone)."""
    kind = rows.schema["conv_id"].dataType
    order = [F.col("conv_id"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    sent = with_faults(rows).repartition("conv_id").sortWithinPartitions(*order).select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text", "gone", "blank", "again", "open")
    out = written(sent.mapInPandas(_stream(spec), STREAMED), "turns")
    done = out.where("pos IS NULL").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    whole = done.where("audit IS NOT NULL")
    long = (out.where("pos IS NOT NULL").select("conv_id", "pos", "role", "text", "letters").repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("pos").desc()).drop("pos")
            .mapInPandas(_walk, "conv_id string, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "_conv"))
    rest = done.where("audit IS NULL").drop("audit", "repaired_sha256")
    rest = rest.join(long, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return whole.unionByName(rest).withColumn("conv_id", F.col("conv_id").cast(kind))
