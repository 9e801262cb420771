"""Repair of the structure of conversations: the cheapest edits that give turns of the form system, then user and assistant in turn.

Rows are dealt by conversation and sorted by turn, the last first. A task streams them (mapInPandas) and carries a dynamic
programme over Arrow batches: for each state of the form (nothing yet, system, user, assistant), the cost of the cheapest edits
of all later turns, and the order of their audits among the states. A step depends only on the kind of row and on the costs
relative to the least, so steps are few; they are worked out once and numbered, and the number is the row's backpointer. When
the first turn of a conversation has passed, the backpointers are read in reverse, which is the order of the turns.

Backpointers and texts of an open conversation are held in memory up to ``TAPE_BYTES``; beyond that, blocks of them are spilled
to a file of the task attempt, like Spark's own spills: nothing else reads it, it is gone when the conversation ends, and an
attempt that runs again writes its own. So a giant conversation needs a bounded memory, but for its audit of one byte an edit.

Edits: K keep, R rerole to user or assistant, D delete, I insert an empty turn. Blank turns and repeats must be deleted.

Defined cases: null roles and texts are one space; turns go by turn (nulls first), then role and text; rows without conv_id are
a conversation; repeated rows are turns of their own, of which all but the first are duplicates; a role whose first character isn't
s, u or a (an empty role too) can't be kept; a conversation of which no row is left has zeros and the hash of nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inputs import short_batches

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: What an open conversation holds in memory before its blocks are spilled.
TAPE_BYTES = 8 << 20

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with this initial, where the form allows it.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
FINE, MUST_GO, CUT_OFF = range(3)
#: (cost, place of the audit among the states) for each state once all turns have passed: two inserts, one, or none are due.
END = ((0, 0), (2 * INSERT, 2), (INSERT, 1), (0, 0))


def free(state: int) -> int:
    """The state after a turn whose role may be chosen: only one role fits."""
    return ASSISTANT if state == USER else USER


#: Choices of each state (inserts, edit, next state), numbered as this process meets them. Costs relative to the least are few, and so are steps.
STEPS: list[tuple] = []


@lru_cache(maxsize=None)
def step(later: tuple, initial: str, kind: int) -> tuple[tuple, int, int]:
    """One turn of the programme: costs and ranks before it, what was taken off all costs, and the number of each state's choices."""
    found = []
    for state in range(4):
        options, now = [], state
        for inserts in range(3):
            follow = [("D", DELETE, now)]
            if kind != MUST_GO:
                extra = TRUNCATED * (kind == CUT_OFF)
                follow.append(("R", REROLE + extra, free(now)))
                if (now, initial) in AFTER:
                    follow.append(("K", extra, AFTER[now, initial]))
            # no such edits begin others, so they and the rank of what follows order whole audits
            options += [(INSERT * inserts + cost + later[then][0], "I" * inserts + edit, later[then][1], inserts, edit, then) for edit, cost, then in follow]
            now = free(now)
        found.append(min(options))
    order = sorted({(x[1], x[2]) for x in found})
    least = min(x[0] for x in found)
    before = tuple((x[0] - least, order.index((x[1], x[2]))) for x in found)
    STEPS.append(tuple(x[3:] for x in found))
    return before, least, len(STEPS) - 1


class Tape:
    """Blocks of rows, read back last to first; beyond ``limit`` bytes they lie in a file."""

    def __init__(self, limit: int = TAPE_BYTES):
        self.limit, self.held, self.size, self.file, self.places = limit, [], 0, None, []

    def add(self, rows: list[tuple]) -> None:
        self.held.append(rows)
        self.size += sum(48 + len(r[2] or "") for r in rows)
        if self.size > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            for block in self.held:
                self.places.append(self.file.tell())
                pickle.dump(block, self.file, protocol=5)
            self.held, self.size = [], 0

    def reversed_rows(self) -> Iterator[tuple]:
        for block in reversed(self.held):
            yield from reversed(block)
        for place in reversed(self.places):
            self.file.seek(place)
            yield from reversed(pickle.load(self.file))  # noqa: S301  written above by this task

    def close(self) -> None:
        if self.file:
            self.file.close()


class Conversation:
    """One conversation, met from its last turn to its first."""

    def __init__(self, name, limit: int):
        self.name, self.tape = name, Tape(limit)
        self.later, self.cost = END, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.next_initial = None

    def meet(self, rows: Iterator[tuple]) -> None:
        kept = []
        for turn, no_turn, role, text, blank, duplicate, truncated in rows:
            initial = role[0] if role[:1] in ("s", "u", "a") else ""
            if not no_turn:
                self.high = turn if self.high is None else self.high
                self.turns += turn != self.low
                self.low = turn
            self.blank += blank
            self.duplicate += duplicate
            self.truncated += truncated
            if self.next_initial is not None:
                self.illegal += initial + self.next_initial not in ("su", "ua", "au")
            self.next_initial = initial
            kind = MUST_GO if blank or duplicate else CUT_OFF if truncated else FINE
            self.later, least, number = step(self.later, initial, kind)
            self.cost += least
            kept.append((number, role, None if kind == MUST_GO else text))
        self.tape.add(kept)

    def edits(self) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) in order; both null for deleted turns."""
        state = START

        def inserted(n: int):
            nonlocal state
            for _ in range(n):
                state = free(state)
                yield "I", ROLE_OF[state], ""

        for number, role, text in self.tape.reversed_rows():
            inserts, edit, then = STEPS[number][state]
            yield from inserted(inserts)
            state = then
            yield (edit, None, None) if edit == "D" else (edit, role if edit == "K" else ROLE_OF[state], text)
        yield from inserted({SYSTEM: 2, USER: 1}.get(state, 0))

    def report(self) -> tuple:
        audit, digest, first = bytearray(), hashlib.sha256(), True
        for edit, role, text in self.edits():
            audit += edit.encode()
            if edit != "D":
                digest.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                first = False
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + self.later[START][0], audit.decode(), digest.hexdigest()


def fault_columns(rows: DataFrame) -> DataFrame:
    """Adds blank, duplicate and truncated, of which at most one is true. Rows are dealt by conversation here, for good."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    rows = rows.repartition("conv").withColumns({"blank": ~F.col("gone") & (trimmed == ""), "seen": seen})
    duplicate = ~F.col("gone") & ~F.col("blank") & F.col("seen")
    return rows.withColumns({"duplicate": duplicate, "truncated": ~F.col("gone") & ~F.col("blank") & ~duplicate & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")}).drop("seen")


def _streamed(turns: DataFrame, each, schema: str, tape_bytes: int) -> DataFrame:
    """``each(conversation)`` gives the rows of a conversation; turns without ``gone`` are all there."""
    rows = turns.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("gone") if "gone" in turns.columns else F.lit(False).alias("gone"))
    rows = rows.withColumns({c: F.when(~F.col("gone"), F.coalesce(c, F.lit(" "))) for c in ("role", "text")})
    # of equal rows of one turn, those found to be duplicates are the later ones
    ordered = fault_columns(rows).sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("duplicate"))
    columns = ["turn", "no_turn", "role", "text", "blank", "duplicate", "truncated"]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_now: Conversation | None = None
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=names, dtype=object)
            out.clear()
            return made

        def ended():
            for row in each(open_now):
                out.append(row)
                if len(out) >= 2000:
                    yield frame()
            open_now.tape.close()

        for batch in batches:
            own = [batch[c].tolist() for c in columns]
            here, gone = batch["conv"].astype(object).where(batch["conv"].notna(), None).tolist(), batch["gone"].tolist()
            starts = [i for i in range(len(here)) if not i or here[i] != here[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(here)], strict=True):
                if open_now is None or open_now.name != here[a]:
                    if open_now is not None:
                        yield from ended()
                    open_now = Conversation(here[a], tape_bytes)
                left = [i for i in range(a, b) if not gone[i]]
                if left:
                    open_now.meet(zip(*([x[i] for i in left] for x in own), strict=True))
            if out:
                yield frame()
        if open_now is not None:
            yield from ended()
        if out:
            yield frame()

    short_batches(turns.sparkSession)
    sent = ordered.select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", "gone", "blank", "duplicate", "truncated")
    made = sent.mapInPandas(run, schema)
    return made.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def repair_turns(turns: DataFrame, tape_bytes: int = TAPE_BYTES) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: a row for each edit in order; role and text are null where a turn is deleted."""
    return _streamed(turns, lambda c: ((c.name, i, *edit) for i, edit in enumerate(c.edits())), "conv_id string, place long, edit string, role string, text string", tape_bytes)


def repair_report(turns: DataFrame, tape_bytes: int = TAPE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    Rows that ``turns`` marks as ``gone`` (an optional column) only tell that their conversation exists.
    """
    schema = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _streamed(turns, lambda c: [c.report()], schema, tape_bytes)


def damaged(turns: DataFrame, kinds: int = 20) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by the checksum of ``conv_id:turn``; dropped rows stay, without content, as ``gone``."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % kinds).alias("kind"))

    def unless(c: Column) -> Column:
        return F.when(F.col("kind") != 0, c)

    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", unless(role).alias("role"), unless(text).alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("copy")).drop("copy")
