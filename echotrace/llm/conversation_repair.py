"""Conversation structure repair: the cheapest edits that leave turns of the form (system? (user assistant)+)?.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role, text and copy). Each row's first fault counts:
blank (nothing but white space), duplicate (its role and text stood earlier in the conversation), truncated (the last
character that isn't white space is none of . ! ?). A row is kept (0), gets the role user or assistant (3) or is deleted (4;
blank and duplicate rows must be); rows that stay truncated add 3; an empty turn can be put in anywhere (3).

The programme runs over the retained rows. The best way to retain row i in a role is the least, over the role r of the retained
row before it, of what the best rows of role r cost, the deletions since, and the turns that must be put in between r and
the new role. Deletions are prefix sums, so for each r one running minimum serves all later rows: it goes up by 4 with each row
that is passed over. The pair of roles decides how many turns come in between. Audits (one letter for each edit) break ties.
Two audits that cover the same rows are equal only if they end in the same role, and none is the beginning of another,
so the order of two minima is decided by their ranks and not by their letters: a step takes constant time and a
conversation linear time, with four letters and links kept for each row.

A conversation is a stream in its order within one task, as one hash covers its repaired text from first to last: a row's text
is hashed for each role that it may end in and let go. What a task holds is four hashes and 8 bytes for each row of the
conversation it is at. Earlier copies are found by sorting digests, not by remembering them.

Defined results: null conv_ids are one conversation; null roles and texts are one space; a null turn sorts first and doesn't count
for gaps; a role that begins with none of s, u, a can't be kept; repeated rows are duplicates; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: no row retained yet, or the role of the last one.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
#: Turns put in between the role of a retained row (or none) and that of the next one; the last column is for the end.
_BETWEEN = [
    [None, 0, 0, 1, 0],
    [None, None, 0, 1, 2],
    [None, None, 1, 0, 1],
    [None, None, 0, 1, 0],
]
#: White space as the faults understand it.
_SPACE = " \t\n\x0b\x0c\r"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and dropped: the rows after a fixed damage that crc32 of conv_id:turn decides (nulls there: one space).

    Dropped rows stay as rows with dropped set, so that conversations that lose all theirs aren't lost.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        copies.alias("copy"),
        (F.col("_kind") == 0).alias("dropped"),
    )


class Repair:
    """The programme for one conversation, row by row."""

    def __init__(self):
        self.cost = [0, _FAR, _FAR, _FAR]
        self.rank = [0, 1, 2, 3]
        self.hashes = [hashlib.sha256(), None, None, None]
        #: For each row and state, the state before and the edits.
        self.links: list[bytearray] = [bytearray() for _ in range(4)]
        self.edits: list[bytearray] = [bytearray() for _ in range(4)]

    def add(self, initial: str, role: str, text: str, fault: str | None) -> None:
        """One more row."""
        # For each state, the candidates (cost, rank of the state before, edits, state before); edits are compared as text.
        best = [(self.cost[s] + DELETE, self.rank[s], "D", s) if self.cost[s] < _FAR else None for s in range(4)]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault == "truncated" else 0
            for state, letter in ((SYSTEM, "s"), (USER, "u"), (ASSISTANT, "a")):
                ways = [("K", 0)] if initial == letter else []
                ways += [("R", REROLE)] if state != SYSTEM else []
                for before in range(4):
                    between = _BETWEEN[before][state]
                    if between is None or self.cost[before] >= _FAR:
                        continue
                    for edit, price in ways:
                        found = (self.cost[before] + price + extra + INSERT * between, self.rank[before], "I" * between + edit, before)
                        if best[state] is None or found < best[state]:
                            best[state] = found
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        hashes = [None] * 4
        for s, b in enumerate(best):
            self.links[s].append(b[3] if b else 0)
            self.edits[s].append(_EDITS.index(b[2]) if b else 0)
            if b and b[2] == "D":
                hashes[s] = self.hashes[s]
            elif b:
                hashes[s] = _written(self.hashes[b[3]].copy(), b[3], s, b[2], role, text)
        self.hashes, self.cost = hashes, [b[0] if b else _FAR for b in best]
        self.rank = [4] * 4
        for i, (_, _, s) in enumerate(order):
            self.rank[s] = i

    def end(self) -> tuple[int, str, str]:
        """cost, audit and the hash of the repaired text."""
        ways = [(self.cost[s] + INSERT * _BETWEEN[s][4], self.rank[s], s) for s in range(4) if self.cost[s] < _FAR]
        cost, _, state = min(ways)
        between = _BETWEEN[state][4]
        digest = self.hashes[state].copy()
        for role in (["user"] if state == SYSTEM else []) + ["assistant"] * (between > 0):
            digest.update(f"\n{role}:".encode())
        parts = ["I" * between]
        for i in range(len(self.links[0]) - 1, -1, -1):
            parts.append(_EDITS[self.edits[state][i]])
            state = self.links[state][i]
        return cost, "".join(reversed(parts)), digest.hexdigest()


_EDITS = ["D", "K", "R", "IK", "IR"]


def _written(digest, before: int, state: int, edits: str, role: str, text: str):
    """The hash of the text so far with a retained row, and the empty turn in front of it if there is one."""
    if edits[0] == "I":
        # An empty turn has the role that neither neighbour of it has: an assistant's stands between users, else a user's.
        filler = "assistant" if before == USER else "user"
        digest.update(f"{'' if before == NONE else chr(10)}{filler}:\n".encode())
    elif before != NONE:
        digest.update(b"\n")
    role = role if edits[-1] == "K" else ("user" if state == USER else "assistant")
    digest.update(f"{role}:".encode("utf-8", "surrogatepass"))
    digest.update(text.encode("utf-8", "surrogatepass"))
    return digest


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped and fault, each conversation whole in one partition and in order.

    One exchange by conv_id serves the sorts for duplicates (by digest) and for the order.
    """
    text = F.col("text")
    body = F.rtrim(text, F.lit(_SPACE))
    place = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_hash"), F.col("copy")]
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copy",
        "dropped",
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), text), 256).alias("_hash"),
        body.alias("_body"),
    )
    rows = rows.withColumn("_body", F.when(F.col("_body") == "", "blank").when(~F.substring("_body", -1, 1).isin(".", "!", "?"), "truncated"))
    rows = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "_hash").orderBy(*place)) > 1
    fault = F.when(F.col("_body") == "blank", "blank").when(again, "duplicate").otherwise(F.col("_body"))
    rows = rows.withColumn("fault", fault)
    return rows.sortWithinPartitions("conv_id", *place).select("conv_id", "turn", "role", "text", "dropped", "fault")


class _Summary:
    """One conversation's counts and its repair."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.faults, self.illegal = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0}, 0
        self.first = self.last = self.initial = None
        self.turns, self.repair = 0, Repair()

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:  # turns come in order, so a new one differs from the last
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.repair.add(initial, role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, *self.repair.end())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in SUMMARY.split(", "))])
    at, out = None, []

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for conv_id, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is None or at.conv_id != conv_id:
                if at is not None:
                    out.append(at.row())
                at = _Summary(conv_id)
            if not dropped:
                at.add(turn, role, text, fault)
            if len(out) >= 4096:
                yield flushed()
    if at is not None:
        out.append(at.row())
    if out:
        yield flushed()


def undamaged(conversations: DataFrame) -> DataFrame:
    """Any table of conversations in the form that damaged() gives, as it is (null roles and texts: one space)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    ids = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    return conversations.select(*ids, space("role"), space("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def repair_summary(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of role:text, joined by line breaks) of each conversation.

    rows: as damaged() or undamaged() gives them. Conversations with dropped rows only have zeros, an empty audit and the hash of nothing.
    """
    return _ordered(rows).mapInArrow(_summaries, SUMMARY)


def repaired_turns(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of the turns of repaired conversations; deleted ones don't occur.

    The audit's letters are numbered as rows and joined to the conversation's rows by their place; only inserted turns have no row.
    """
    own = _ordered(rows).where(~F.col("dropped")).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_at"))
    own = own.withColumn("_row", F.row_number().over(Window.partitionBy("conv_id").orderBy("_at")))
    letters = summary.select("conv_id", F.posexplode(F.split("audit", "")).alias("_i", "edit")).where("edit <> ''")
    running = Window.partitionBy("conv_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    letters = letters.withColumn("_row", F.when(F.col("edit") != "I", F.sum((F.col("edit") != "I").cast("long")).over(running)))
    letters = letters.withColumn("_place", F.sum((F.col("edit") != "D").cast("long")).over(running) - 1).where("edit <> 'D'")
    total = Window.partitionBy("conv_id")
    # The form of the result decides each role: an odd number of turns begins with a system's.
    letters = letters.withColumn("_even", (F.count("*").over(total) + F.col("_place")) % 2 == 0)
    found = letters.alias("l").join(own.alias("o"), F.col("l.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("l._row") == F.col("o._row")), "left")
    role = F.when(F.col("edit") == "K", F.col("o.role")).when(F.col("_even"), "user").otherwise("assistant")
    return found.select("l.conv_id", F.col("_place").alias("place"), "edit", role.alias("role"), F.coalesce("o.text", F.lit("")).alias("text"))
