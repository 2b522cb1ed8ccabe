"""Repair of conversation structure: rows stream by conversation and turn, a small DP finds the cheapest edits."""

from __future__ import annotations

import hashlib
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Costs of the edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States of the wanted order of roles, (s?(ua)+)?: nothing yet, after a system, a user, an assistant row.
BEGIN, AFTER_S, AFTER_U, AFTER_A = range(4)
#: What may be inserted or be made of a row in each state (state, role), and what a kept row of a role leads to.
FORCED = ((AFTER_U, "user"), (AFTER_U, "user"), (AFTER_A, "assistant"), (AFTER_U, "user"))
KEEPS = {"s": {BEGIN: AFTER_S}, "u": {BEGIN: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}

#: Edits in the order of their letters, which decides between equally cheap ones; two bits each in a backpointer.
EDITS = "DIKR"

#: Backpointers (a byte a row) of a conversation held in memory; beyond, they go to an unlinked file of the task.
SPOOL_BYTES = 8 << 20

WORDS = r"[^\x20\x09-\x0D]"
ENDS_WELL = r"[.!?][\x20\x09-\x0D]*\z"

REPAIRED = "conv string, turn string, was string, fault string, edit string, role string, text string"


class Plans:
    """Backward DP over the rows of a conversation, last row first.

    The state is the vector of costs to the end, less its smallest. Few such vectors exist, so each (vector, kind of
    row) is worked out once and looked up afterwards.
    """

    def __init__(self, insert: int = INSERT):
        self.insert = insert
        #: Cost of the inserts that end a conversation in each state.
        self.end = (0, 2 * insert, insert, 0)
        self.known: dict[tuple, tuple] = {}

    def step(self, costs: tuple, initial: str, fault: str | None) -> tuple:
        """(new costs, what was taken off them, best edit of each state as four times two bits)."""
        key = costs, initial, fault
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._work_out(*key)
        return found

    def _work_out(self, costs: tuple, initial: str, fault: str | None) -> tuple:
        options = []
        for state in range(4):
            own = {"D": DELETE + costs[state]}
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault == "truncated" else 0
                if state in KEEPS.get(initial, {}):
                    own["K"] = extra + costs[KEEPS[initial][state]]
                own["R"] = extra + REROLE + costs[FORCED[state][0]]
            options.append(own)
        best = [min(own.values()) for own in options]
        for _ in range(2):  # no more than two inserts in a row pay
            best = [min(best[state], self.insert + best[FORCED[state][0]]) for state in range(4)]
        packed = 0
        for state, own in enumerate(options):
            own["I"] = self.insert + best[FORCED[state][0]]
            packed |= EDITS.index(min(e for e in own if own[e] == best[state])) << 2 * state
        low = min(best)
        return tuple(b - low for b in best), low, packed


class Trail:
    """The backpointers of one conversation: written last row first, read first row first; large ones lie in a file."""

    BLOCK = 1 << 16

    def __init__(self, limit: int = SPOOL_BYTES):
        self.file = tempfile.SpooledTemporaryFile(max_size=limit)  # noqa: SIM115  gone when closed or dropped
        self.tail = bytearray()
        self.at = 0
        self.spilled = 0

    def push(self, packed: int) -> None:
        self.tail.append(packed)
        if len(self.tail) == self.BLOCK:
            self.file.write(self.tail)
            self.spilled += len(self.tail)
            self.tail = bytearray()

    def pop(self) -> int:
        if not self.tail:
            self.spilled -= self.BLOCK
            self.file.seek(self.spilled)
            self.tail = bytearray(self.file.read(self.BLOCK))
            self.file.seek(self.spilled)
        return self.tail.pop()

    def close(self) -> None:
        self.file.close()


def _streamed(batches):
    """Repaired rows from a stream that shows each conversation twice: backward without texts, then forward with them.

    State that outlives a batch: the cost vector, the backpointers, and the place in the wanted order.
    """
    plans = Plans()
    costs, trail, state, forward = plans.end, None, BEGIN, True
    conv = None

    def ending(state):
        """The inserts that complete the conversation just read."""
        while state in (AFTER_S, AFTER_U):
            state, role = FORCED[state]
            yield conv, None, None, None, "I", role, ""

    for batch in batches:
        out = []
        columns = (batch[c] for c in ("back", "conv", "turn", "role", "text", "fault"))
        for back, row_conv, turn, role, text, fault in zip(*columns, strict=True):
            fault = fault or None
            if back:
                if forward:  # the conversation before this one has ended
                    if trail is not None:
                        out.extend(ending(state))
                        trail.close()
                    costs, trail, forward = plans.end, Trail(), False
                costs, _, packed = plans.step(costs, role[:1], fault)
                trail.push(packed)
                continue
            if not forward:
                forward, state, conv = True, BEGIN, row_conv
            packed = trail.pop()
            while (edit := EDITS[packed >> 2 * state & 3]) == "I":
                state, made = FORCED[state]
                out.append((conv, None, None, None, "I", made, ""))
            if edit == "D":
                out.append((conv, turn, role, fault, "D", None, None))
            elif edit == "K":
                state = KEEPS[role[:1]][state]
                out.append((conv, turn, role, fault, "K", role, text))
            else:
                state, made = FORCED[state]
                out.append((conv, turn, role, fault, "R", made, text))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRED.split(", ")], dtype=object)
    if trail is not None:
        out = list(ending(state))
        trail.close()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRED.split(", ")], dtype=object)


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``place`` (1, 2, ... in each conversation) and ``fault``; both windows lie on one partitioning by conversation."""
    place = F.row_number().over(W.partitionBy("conv").orderBy(F.col("nth").asc_nulls_first(), "role", "text"))
    text = F.col("text")
    fault = (
        F.when(~text.rlike(WORDS), "blank").when(F.col("seen") > 1, "duplicate").when(~text.rlike(ENDS_WELL), "truncated")
    )
    # Places are dealt first, so that "seen earlier" is by place and equal turns have one order everywhere.
    rows = rows.withColumn("place", place)
    seen = F.row_number().over(W.partitionBy("conv", "role", "text").orderBy("place"))
    return rows.withColumn("seen", seen).withColumn("fault", fault).drop("seen")


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The rows of repaired conversations, with each edit: conv, turn, was (role before), fault, edit, role, text.

    Rows of a conversation are taken by turn (nulls first; equal turns by role, then text). A row is blank, a duplicate
    of an earlier one (role and text), truncated (its last character that is no white space is none of ``.!?``), or has
    no fault. Edits: K(eep) 0, R(erole) to user or assistant 1, D(elete) 2 (the only one for blank and duplicate rows),
    I(nsert) an empty user or assistant row 5; truncated rows that stay add 5. The cheapest edits after which role
    initials read ``(s?(ua)+)?`` are taken, of equally cheap ones the least as text. Deleted rows stay in the result
    with null role and text; inserted ones have a null turn. A role without a character fits nowhere.

    Null roles and texts count as one space, a null conversation is a conversation, repeated rows are duplicates, an
    empty table gives no rows, extra columns are left behind. In each partition a conversation's rows lie together and
    in order. One shuffle, by conversation; a task holds one batch and the backpointers of one conversation (a byte a
    row, in a file beyond 8 MB), so a conversation of any length streams. The file is the task's own: a task that is
    lost runs again.
    """
    space = F.lit(" ")
    nth = F.col(turn_col).cast("long")
    picked = rows.select(
        F.col(conv_col).cast("string").alias("conv"),
        nth.alias("nth"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
    )
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Windows by (conv, ...) are satisfied by this partitioning, so nothing is shuffled again.
    told = _faults(picked.repartition(partitions, "conv"))
    # Each row twice: without its text for the way back, with it for the way forward.
    twice = told.withColumn("back", F.explode(F.array(F.lit(True), F.lit(False))))
    light = F.when(~F.col("back"), F.col("text"))
    order = F.when(F.col("back"), -F.col("place")).otherwise(F.col("place"))
    stream = twice.select("conv", F.col("nth").cast("string").alias("turn"), "role", light.alias("text"), "fault", "back", order.alias("order"))
    stream = stream.sortWithinPartitions("conv", F.col("back").desc(), "order")
    return stream.mapInPandas(_streamed, REPAIRED)


DIGEST = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


class _Digest:
    """Figures of one conversation, gathered row by row."""

    def __init__(self, conv):
        self.conv, self.counts = conv, {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.before = None
        self.turns = self.illegal = self.cost = self.kept = 0
        self.audit: list[str] = []
        self.sha = hashlib.sha256()

    def add(self, turn, was, fault, edit, role, text) -> None:
        self.audit.append(edit)
        self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit]
        if edit != "I":
            if fault:
                self.counts[fault] += 1
                self.cost += TRUNCATED * (fault == "truncated" and edit != "D")
            if self.before is not None and self.before[:1] + was[:1] not in LEGAL:
                self.illegal += 1
            self.before = was
            if turn is not None:
                turn = int(turn)
                self.first = turn if self.first is None else self.first
                self.turns += turn != self.last
                self.last = turn
        if edit != "D":
            self.sha.update((b"\n" if self.kept else b"") + f"{role}:{text}".encode())
            self.kept += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _digested(batches):
    names = [c.split()[0] for c in DIGEST.split(", ")]
    own, begun = None, False
    for batch in batches:
        out = []
        for conv, *rest in zip(*(batch[c.split()[0]] for c in REPAIRED.split(", ")), strict=True):
            if not begun or conv != own.conv:
                if begun:
                    out.append(own.row())
                own, begun = _Digest(conv), True
            own.add(*rest)
        if out:
            yield pd.DataFrame(out, columns=names)
    if begun:
        yield pd.DataFrame([own.row()], columns=names)


def digests(repaired: DataFrame) -> DataFrame:
    """One row of figures for each conversation of ``repair``, by streaming over its rows as they lie."""
    return repaired.mapInPandas(_digested, DIGEST)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, told by crc32 of ``conv_id:turn`` modulo 20 (nulls count as one space).

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user's.
    """

    def or_space(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    rows = rows.filter("kind <> 0").withColumns({"text": text, "role": role})
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).drop("copy", "kind")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table after planted damage: its faults, the cost and the letters of its repair, a digest."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ids = conversations.select("conv_id").distinct()
    found = digests(repair(damaged(conversations)))
    kind = conversations.schema["conv_id"].dataType
    found = found.withColumnRenamed("conv", "found_conv")
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["found_conv"].cast(kind)), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


QUERIES = {"op13_turn_repair": op13_turn_repair}
#: The cheapest edits are a shortest path with ties by text: tested against a brute-force version instead.
SQL: dict[str, str] = {}
