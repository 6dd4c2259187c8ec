"""Conversation structure repair as a lightest derivation, solved by Knuth's agenda.

Rows of a conversation, in order of turn, are kept, given another role, deleted, or have turns
inserted between them until their role initials read ``(s?(ua)+)?`` (nothing, or pairs of user and
assistant behind an optional system turn). Items are (rows consumed, state of that pattern);
every edit is a deduction from one item to the next, and a whole stretch of rows is a deduction
from two: prefix and stretch. Values are (cost, audit), audit being the edits' initials. Adding an
edit, or joining two audits, never lowers a value and keeps the order of values of one item (equal
costs consume equally many rows by equally many inserts, so neither audit is the start of the
other). The agenda pops values in order, the first value of an item is final, and the repair is
done when the goal, an accepting item behind the last row, is popped.

* Rows without their texts (role, digest, faults) are range-partitioned by (conversation, turn), so
  one long conversation spreads over tasks. A task solves whole conversations, and stretches of
  at most ``STRETCH`` rows of those that begin or go on elsewhere, from every state they can be
  entered in.
* A row counts as seen earlier through its (conversation, role, digest) and their first turn,
  combined map-side; only those that repeat are joined back.
* Texts are shuffled once, by conversation and in order behind the stretches, which are joined by
  the same agenda; texts then stream through the hash of the repaired conversation, never
  held. That hash runs over a conversation from its start to its end, so one conversation's
  texts pass one task; all else about them is spread.

Defined cases: null fields are one space. Rows of equal turn go by role, then by the md5 of the text;
copies made by the damage follow each other. Null turns come first and do not count in gaps. All
null conv_ids are one conversation, shown as null. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import NULL_ID, cut, prepare, release, shown_id

KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 1), ("D", 2), ("I", 5)
TRUNCATED_COST = 5
STRETCH = 1024
OK, GONE, OPEN = 0, 1, 2                 # faults as the agenda sees them: none, must go, truncated
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
TURN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}           # what a reroled or inserted row is
ROLE = {"u": "user", "a": "assistant"}


def agenda(axioms, deduce, final):
    """Knuth's algorithm: (value, item) popped by value; the first value of an item is its
    lightest. ``deduce(item, value)`` gives what follows from it; stops once ``final(item)`` says
    so. Returns the final values by item, in the order they were found."""
    heap, done = list(axioms), {}
    heapq.heapify(heap)
    while heap:
        value, item = heapq.heappop(heap)
        if item in done:
            continue
        done[item] = value
        if final(item):
            break
        for found in deduce(item, value):
            if found[1] not in done:
                heapq.heappush(heap, found)
    return done


def stretch_spans(rows: tuple[tuple[str, int], ...], entries: tuple[int, ...], closed: bool) -> list:
    """Lightest (entry, exit, cost, audit) of consuming ``rows`` (initial, fault) from each entry
    state; a ``closed`` stretch is a whole conversation, of which only the goal matters."""
    n, out = len(rows), []

    def deduce(item, value):
        (i, state), (cost, audit) = item, value
        turn = TURN[state]
        yield (cost + INSERT[1], audit + INSERT[0]), (i, STEPS[state][turn])
        if i == n:
            return
        initial, fault = rows[i]
        yield (cost + DELETE[1], audit + DELETE[0]), (i + 1, state)
        if fault != GONE:
            cost += TRUNCATED_COST if fault == OPEN else 0
            if initial in STEPS[state]:
                yield (cost + KEEP[1], audit + KEEP[0]), (i + 1, STEPS[state][initial])
            yield (cost + REROLE[1], audit + REROLE[0]), (i + 1, STEPS[state][turn])

    goal = lambda item: closed and item[0] == n and item[1] in ACCEPTING
    for entry in entries:
        done = agenda([((0, ""), (0, entry))], deduce, goal)
        out += [(entry, state, *value) for (i, state), value in done.items() if i == n]
    return out


_short_spans = lru_cache(1 << 14)(stretch_spans)     # short conversations repeat their structure


def joined(stretches: list[list]) -> tuple[int, str]:
    """Lightest (cost, audit) of a conversation from the spans of its stretches."""
    n = len(stretches)
    spans = [{} for _ in stretches]
    for k, own in enumerate(stretches):
        for entry, exit_, cost, audit in own:
            spans[k].setdefault(entry, []).append((exit_, cost, audit))

    def deduce(item, value):
        k, state = item
        if k == n:
            return
        for exit_, cost, audit in spans[k].get(state, ()):
            yield (value[0] + cost, value[1] + audit), (k + 1, exit_)

    goal = lambda item: item[0] == n and item[1] in ACCEPTING
    done = agenda([((0, ""), (0, START))], deduce, goal)
    return next(value for item, value in done.items() if goal(item))


def _filled(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> list:
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return [F.coalesce(F.col(f"`{conv_id}`").cast("long"), F.lit(NULL_ID)).alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
            as_text(role).alias("role"), as_text(text).alias("text"), F.concat(as_text(conv_id), F.lit(":"), as_text(turn)).alias("name")]


def as_given(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they stand, for :func:`repair`: conv_id, turn, role, text, ``copies`` (1)."""
    return conversations.select(*_filled(conversations, conv_id, turn, role, text)).drop("name").withColumn("copies", F.lit(1))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults put in by the CRC-32 of ``conv_id:turn``; ``copies`` is 0 for those dropped."""
    rows = conversations.select(*_filled(conversations, conv_id, turn, role, text))
    hit = F.crc32(F.col("name").cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without texts, with ``fault`` and ``later`` (role and text seen at an earlier turn)."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    narrow = cut(rows.where("copies > 0").select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), "copies",
        F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").alias("fault")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"))
    repeats = cut(narrow.groupBy("conv_id", "role", "digest").agg(F.sum("copies").alias("n"), F.min(at).alias("first"))
                  .where("n > 1").select("conv_id", "role", "digest", "first"), "repeated-turns")
    return (narrow.join(repeats, ["conv_id", "role", "digest"], "left")
            .select("conv_id", "turn", "role", "digest", "copies", "fault", F.coalesce(at > F.col("first"), F.lit(False)).alias("later")))


class _Stretch:
    """Rows of one conversation that follow each other in one task, and what is counted of them."""

    def __init__(self, begins: bool):
        self.rows, self.begins = [], begins
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, role, fault, seen):
        initial = role[:1]
        if self.rows and self.rows[-1][0] + initial not in LEGAL:
            self.illegal += 1
        kind = OK
        if fault == "blank":
            self.blank, kind = self.blank + 1, GONE
        elif seen:
            self.duplicate, kind = self.duplicate + 1, GONE
        elif fault == "truncated":
            self.truncated, kind = self.truncated + 1, OPEN
        self.rows.append((initial, kind))
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn

    def result(self, closed: bool) -> str:
        solve = _short_spans if len(self.rows) <= 16 else stretch_spans
        spans = solve(tuple(self.rows), (START,) if self.begins else tuple(range(4)), closed)
        return json.dumps([self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high,
                           self.rows[0][0], self.rows[-1][0], spans])


def _stretches(batches):
    """mapInArrow over sorted (conv_id, turn, role, digest, copies, fault, later): (conv_id, seq, body)."""
    current, before, own, out, seq = None, None, None, [], 0

    def close(ends):
        nonlocal own
        if own and own.rows:
            out.append((current, seq, own.result(ends and own.begins and not seq)))
        own = None

    first = True
    for batch in batches:
        for conv, turn, role, digest, copies, fault, later in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if conv != current or own is None:
                close(True)
                # what a task sees first may have begun in the one before it
                current, seq, own = conv, 0, _Stretch(not first)
                first = False
            key = (conv, turn, role, digest)
            for _ in range(copies):
                if len(own.rows) == STRETCH:
                    close(False)
                    seq, own = seq + 1, _Stretch(False)
                own.add(turn, role, fault, later or key == before)
                before = key
        if out:
            yield _bodies(out)
            out.clear()
    close(False)
    if out:
        yield _bodies(out)


def _bodies(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))],
                                      names=["conv_id", "seq", "body"])


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """One conversation: its stretches first, then its texts in order."""

    def __init__(self, conv):
        self.conv, self.stretches, self.audit = conv, [], None
        self.hash, self.empty, self.state, self.at, self.cost = hashlib.sha256(), True, START, 0, 0

    def derive(self):
        self.cost, self.audit = joined([s[9] for s in self.stretches]) if self.stretches else (0, "")

    def put(self, symbol, role, text):
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty, self.state = False, STEPS[self.state][symbol]

    def inserts(self):
        while self.audit[self.at:self.at + 1] == INSERT[0]:
            turn = TURN[self.state]
            self.put(turn, ROLE[turn], "")
            self.at += 1

    def row(self, role, text):
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP[0]:
            self.put(role[:1], role, text)
        elif edit == REROLE[0]:
            turn = TURN[self.state]
            self.put(turn, ROLE[turn], text)

    def result(self):
        if self.audit is None:
            self.derive()
        self.inserts()
        counts, low, high, turns = [0, 0, 0, 0], None, None, 0
        for k, s in enumerate(self.stretches):
            counts = [a + b for a, b in zip(counts, s)]
            if k and self.stretches[k - 1][8] + s[7] not in LEGAL:
                counts[3] += 1
            if s[5] is not None:
                turns += s[4] - (high is not None and high == s[5])
                low, high = (s[5] if low is None else low), s[6]
        gaps = 0 if low is None else high - low + 1 - turns
        return (self.conv, gaps, *counts, self.cost, self.audit, self.hash.hexdigest())


def _repairs(batches):
    """mapInArrow over sorted rows (conv_id, kind, role, body, copies): results."""
    own, out = None, []
    for batch in batches:
        for conv, kind, role, body, copies in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if own is None or own.conv != conv:
                if own is not None:
                    out.append(own.result())
                own = _Repair(conv)
            if kind == 0:
                own.stretches.append(json.loads(body))
                continue
            if own.audit is None:
                own.derive()
            for _ in range(copies):
                own.row(role, body)
        if out:
            yield _results(out)
            out.clear()
    if own is not None:
        yield _results([own.result()])


def _results(rows):
    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies): gaps, faults, cost and audit
    of its cheapest repair, and the SHA-256 of the repaired turns."""
    prepare(rows.sparkSession)
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = _faults(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    solved = cut(ordered.mapInArrow(_stretches, "conv_id long, seq int, body string")
                 .withColumn("part", F.spark_partition_id()), "stretches")
    release(rows.sparkSession)
    both = solved.select("conv_id", F.lit(0).alias("kind"), "part", "seq", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.lit("").alias("digest"), "body", F.lit(1).alias("copies")).unionByName(
        rows.select("conv_id", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("seq"), "turn", "role",
                    F.md5("text").alias("digest"), F.col("text").alias("body"), "copies"))
    streamed = both.repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "part", "seq", F.col("turn").asc_nulls_first(), "role", "digest")
    out = streamed.select("conv_id", "kind", "role", "body", "copies").mapInArrow(_repairs, RESULT)
    return out.select(shown_id("conv_id"), *out.columns[1:])
