"""Repair of conversation structure by iterative-deepening A*.

A conversation is read in the order of its turns. The cheapest edits (delete,
insert, keep, change the role) are sought after which the initials of its roles match
``(s?(ua)+)?``. A state of the search is a place between two rows with what the
pattern expects next. Depth first, edits in ASCII order of their initials, under a
bound on the cost that rises to the least estimate that exceeded it; states that failed
with so much left are not entered again with as much or less. The first path that
accepts is the answer: the cheapest, and of those the one whose initials come first.

The estimate never exceeds the cost: rows that must go cost their deletion, truncated
rows 1 each, and of disjoint pairs of neighbours among the other rows that may not
follow each other, each needs one more edit. Long conversations are searched in
stretches of ``STRETCH`` rows from the last one. The ends of a stretch are goals at the cost
that the next stretch has from there. All edits at a place between two stretches
belong to the later one, so a path of a stretch never begins another one, and the first path
in order stays first with what follows it. The work grows with the rows.

Skew: texts are sorted by Spark and flow through tasks row by row, twice: once to find the
edits, once to hash what they give. A task holds of a conversation one code and one
16-byte digest per row, never its texts; what it returns holds one letter per edit.

A null role or text is one space; a null conv_id is a conversation, null turns come first.
Rows with the same turn are taken by role, then text. A role that does not begin
with s, u or a cannot be kept. Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

STRETCH = 64
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a; where each initial leads.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The initial that an inserted or changed row takes in each state.
WANTED = "uuau"
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Codes of rows: the initial in the lowest bits, then whether it must go or is truncated.
INITIALS = "?sua"
MUST_GO, CUT = 4, 8


ROWS_OUT = 2000
PLAN = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "cost bigint, audit string")


def told(column: str) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows as a checksum of their place damages them."""
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    out = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"),
                      kind.alias("kind"))
    out = out.filter("kind <> 0").withColumns({
        "text": F.when(F.col("kind") == 1, "").when(
            F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.withColumn("copy", F.explode(times)).select(
        "conv_id", "turn", "role", "text")


def code_of(role: str, text: str, again: bool) -> tuple[int, str]:
    """Code and first fault of a row; ``again``: its role and text were seen before."""
    code = max(0, INITIALS.find(role[:1] or "?"))
    shown = text.rstrip(SPACES)
    if not shown:
        return code | MUST_GO, "blank"
    if again:
        return code | MUST_GO, "duplicate"
    if shown[-1] not in ".!?":
        return code | CUT, "truncated"
    return code, ""


def estimates(codes: bytes, ends: dict) -> list[int]:
    """Lower bounds of the cost from before each row to the end of the stretch, and beyond."""
    out, sure, pairs, behind = [0] * (len(codes) + 1), 0, 0, None
    least = min(ends.values())
    out[-1] = least
    for i in range(len(codes) - 1, -1, -1):
        if codes[i] & MUST_GO:
            sure += DELETE
        else:
            sure += TRUNCATED if codes[i] & CUT else 0
            initial = INITIALS[codes[i] & 3]
            if behind is not None and initial + behind not in LEGAL:
                pairs, behind = pairs + 1, None  # both rows of the pair are spoken for
            else:
                behind = initial
        out[i] = sure + min(REROLE, INSERT, DELETE - TRUNCATED) * pairs + least
    return out


def search(codes: bytes, state: int, ends: dict, last: bool) -> tuple[int, str, int]:
    """Cost, edits and last state of the first cheapest path from ``state`` over a stretch.

    ``ends`` has the cost beyond the stretch for the states it may end in; only behind
    the last one may rows be inserted at the end.
    """
    guess, n = estimates(codes, ends), len(codes)
    failed: dict[tuple[int, int], tuple[int, float]] = {}

    def moves(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order with the state they lead to and their cost."""
        change = STEP[q, WANTED[q]]
        if i == n:
            if last:
                yield "I", i, change, INSERT
            return
        yield "D", i + 1, q, DELETE
        yield "I", i, change, INSERT
        if not codes[i] & MUST_GO:
            cut = TRUNCATED if codes[i] & CUT else 0
            kept = STEP.get((q, INITIALS[codes[i] & 3]))
            if kept is not None:
                yield "K", i + 1, kept, KEEP + cut
            yield "R", i + 1, change, REROLE + cut

    def descend(i: int, q: int, left: int) -> tuple[str | None, float]:
        """Edits and last state within ``left``, or None and the least that is missing."""
        if guess[i] > left:
            return None, guess[i] - left
        tried, short = failed.get((i, q), (-1, math.inf))
        if tried >= left:
            return None, short + tried - left
        short = math.inf
        if i == n and q in ends:
            if ends[q] <= left:
                return "", q
            short = ends[q] - left
        for letter, at, to, cost in moves(i, q):
            if cost > left:
                short = min(short, cost - left)
                continue
            rest, found = descend(at, to, left - cost)
            if rest is not None:
                return letter + rest, found
            short = min(short, found)
        failed[i, q] = left, short
        return None, short

    bound = guess[0]
    while True:
        path, found = descend(0, state, bound)
        if path is not None:
            return bound, path, int(found)
        bound += int(found)


def repair(codes: bytes) -> tuple[int, str]:
    """Least cost, and the first of the cheapest edits, of the rows of a conversation."""
    starts = list(range(0, len(codes), STRETCH)) or [0]
    ends: dict[int, int] = {0: 0, 3: 0}
    beyond: dict[int, tuple] = {0: (), 3: ()}
    for at in reversed(starts):
        found = {q: search(codes[at:at + STRETCH], q, ends, at == starts[-1])
                 for q in (range(4) if at else (0,))}
        beyond = {q: (path, beyond[to]) for q, (_, path, to) in found.items()}
        ends = {q: cost for q, (cost, _, _) in found.items()}
    edits, rest = [], beyond[0]
    while rest:
        path, rest = rest
        edits.append(path)
    return ends[0], "".join(edits)


class _Conversation:
    """What is counted and remembered of a conversation while its rows pass by."""

    def __init__(self):
        self.codes, self.seen, self.before = bytearray(), set(), None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.turns, self.low, self.high = 0, 0, None, None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:  # turns arrive in order
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        mark = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}")
        code, fault = code_of(role, text, mark in self.seen)
        self.seen.add(mark)
        self.codes.append(code)
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = repair(bytes(self.codes))
        return (min(gaps, 2**63 - 1), self.faults["blank"], self.faults["duplicate"],
                self.faults["truncated"], self.illegal, cost, audit)


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation in one task, one after the other, by turn, role and text."""
    return rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", *first, "turn", "role", "text")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS_OUT or size > 16 << 20:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _streamed(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[tuple]],
              ) -> DataFrame:
    """Rows of each partition through ``work``, in their order."""
    ids = dict(df.dtypes)["conv_id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f"conv_id {ids}", *[x.strip() for x in schema.split(",")]]
    out = pa.schema([(f.split()[0], arrow[f.split()[1]]) for f in fields])

    def run(batches):
        def rows():
            for b in batches:
                yield from b.to_pylist()
        yield from _batches(work(rows()), out)

    return df.mapInArrow(run, ", ".join(fields))


def plan_repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation.

    ``audit`` has the initials of the edits: D, I, K, R. Gaps are turns that are missing between
    the first and the last; illegal counts neighbours whose roles may not follow each other.
    """
    def work(stream):
        now, state = None, None
        for r in stream:
            if state is None or r["conv_id"] != now:
                if state is not None:
                    yield now, *state.result()
                now, state = r["conv_id"], _Conversation()
            state.add(r["turn"], r["role"], r["text"])
        if state is not None:
            yield now, *state.result()

    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                       told("role").alias("role"), told("text").alias("text"))
    return _streamed(_in_order(rows), PLAN, work)


def repaired_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, no, role, text, edit: the conversations as the edits of ``plan`` leave them.

    Rows of a conversation come one after the other, in order, within one partition.
    ``plan`` should be a stored table.
    """
    rows = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"),
                       told("role").alias("role"), told("text").alias("text"))
    edits = plan.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"),
                        F.lit("").alias("role"), F.col("audit").alias("text"))

    def work(stream):
        now, audit, at, no, state = None, "", 0, 0, 0

        def inserted():
            nonlocal at, no, state
            while at < len(audit) and audit[at] == "I":
                role = NAMES[WANTED[state]]
                state = STEP[state, WANTED[state]]
                at, no = at + 1, no + 1
                yield now, no, role, "", "I"

        for r in stream:
            if r["kind"] == 0:
                yield from inserted()
                now, audit, at, no, state = r["conv_id"], r["text"], 0, 0, 0
                continue
            yield from inserted()
            edit, role = audit[at], r["role"]
            at += 1
            if edit == "D":
                continue
            role = NAMES[WANTED[state]] if edit == "R" else role
            state = STEP[state, role[0]]
            no += 1
            yield now, no, role, r["text"], edit
        yield from inserted()

    return _streamed(_in_order(edits.unionByName(rows), "kind"),
                     "no bigint, role string, text string, edit string", work)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` joined by newlines.

    Takes what ``repaired_rows`` returns as it is, and adds to a hash row by row.
    """
    def work(stream):
        now, held = None, None
        for r in stream:
            if r["no"] == 1:
                if held is not None:
                    yield now, held.hexdigest()
                now, held = r["conv_id"], hashlib.sha256()
            else:
                held.update(b"\n")
            held.update(f"{r['role']}:{r['text']}".encode())
        if held is not None:
            yield now, held.hexdigest()

    return _streamed(repaired, "repaired_sha256 string", work)
