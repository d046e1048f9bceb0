"""Conversation structure repair: the cheapest edits that make a conversation's roles legal, by A* on the edit lattice.

A lattice point is (rows taken, state of the roles so far); its edges keep, rerole or delete the next row or insert an empty
turn. The heuristic is a suffix sum: a blank or repeated row must be deleted, a truncated one costs its charge at least. Points
leave the queue by (cost plus heuristic, audit), so that of the cheapest edits the ASCII-least come out.

Rows are dealt by conversation and sorted; a task meets a conversation's light rows (role, faults) first and its texts after, so
that it streams the texts and holds none. The lattice is searched in blocks of BLOCK rows from each state that a block can
begin in; all that passes from block to block is the cost and the order of the least edits into each of four states. Of a
conversation, however long, a task holds its edits, about a byte a row, which its audit holds as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Rows of a block of the lattice.
BLOCK = 256
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. What a kept initial leads to, and what an inserted or new role leads to.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_LAST = (0, 3)
_LEGAL = {"su", "ua", "au"}
_BLANKS = " \t\n\x0b\x0c\r"

_LIGHT, _TEXT, _MARK = 1, 2, 0
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = "conv string, place long, edit string, turn long, role string, text string, counts struct<" + ",".join(f"{c}:long" for c in _COUNTS) + ">"
_ARROW = pa.schema(
    [(c, pa.int64() if c in ("place", "turn") else pa.string()) for c in ("conv", "place", "edit", "turn", "role", "text")]
    + [("counts", pa.struct([(c, pa.int64()) for c in _COUNTS]))]
)


def search(rows: list[tuple[str, int]], start: int, last: bool) -> dict[int, tuple[int, str]]:
    """state: (cost, edits), the cheapest edits of these rows, and of those the ASCII-least, from state start to each state that
    they can end in; with last only to the best legal end, inserts after the last row included.

    rows: (initial of the role, fault): 0 none, 1 must be deleted, 2 truncated.
    """
    n, found = len(rows), {}
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (0, DELETE_COST, min(TRUNCATED_COST, DELETE_COST))[rows[i][1]]
    queue, done = [(least[0], "", 0, start, 0)], set()
    while queue:
        _, audit, i, state, cost = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (not last or state in _LAST):
            found[state] = (cost, audit)
            if last or len(found) == 4:
                break
            continue
        forced = _NEXT[state]
        heappush(queue, (cost + INSERT_COST + least[i], audit + INSERT, i, forced, cost + INSERT_COST))
        if i == n:
            continue
        initial, fault = rows[i]
        heappush(queue, (cost + DELETE_COST + least[i + 1], audit + DELETE, i + 1, state, cost + DELETE_COST))
        if fault != 1:
            spent = cost + TRUNCATED_COST * (fault == 2)
            kept = _KEPT[state].get(initial)
            if kept is not None:
                heappush(queue, (spent + least[i + 1], audit + KEEP, i + 1, kept, spent))
            heappush(queue, (spent + REROLE_COST + least[i + 1], audit + REROLE, i + 1, forced, spent + REROLE_COST))
    return found


class _Conversation:
    """What a task knows of the conversation that it is at."""

    def __init__(self, conv: str | None):
        self.conv, self.counts = conv, dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.turn = self.before = None
        self.distinct, self.initial, self.block = 0, None, []
        # state: (cost, place in the order of edits, (edits before, edits))
        self.ways: dict[int, tuple[int, int, tuple | None]] = {0: (0, 0, None)}
        self.edits: Iterator[str] | None = None
        self.state = self.place = 0

    def add(self, turn: int | None, role: str, same: bytes, blank: bool, truncated: bool, first: bool) -> None:
        """A light row; first: its turn is the first with its role and text."""
        if turn is not None:
            self.low, self.high = (turn if self.low is None else self.low), turn
            self.distinct += self.turn != turn
            self.turn = turn
        key = (turn, role, same)
        repeated = not first or key == self.before
        self.before = key
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        self.block.append((initial, 0 if fault is None else 2 if fault == "truncated" else 1))
        if len(self.block) == BLOCK:
            self._advance(False)

    def _advance(self, last: bool) -> None:
        # edits to one place differ and none begins another, as each ends with the row before the place: their order holds
        # whatever follows
        ways: dict[int, tuple[tuple, tuple]] = {}
        for state, (cost, order, link) in self.ways.items():
            for end, (more, audit) in search(self.block, state, last).items():
                key = (cost + more, order, audit)
                if end not in ways or key < ways[end][0]:
                    ways[end] = (key, (link, audit))
        self.block = []
        ranks = {edits: k for k, edits in enumerate(sorted(key[1:] for key, _ in ways.values()))}
        self.ways = {end: (key[0], ranks[key[1:]], link) for end, (key, link) in ways.items()}

    def finish(self) -> None:
        """All light rows are known: choose the edits."""
        self._advance(True)
        cost, _, link = min(self.ways.values(), key=lambda w: w[:2])
        parts = []
        while link:
            link, part = link
            parts.append(part)
        self.ways, self.edits = {}, iter("".join(reversed(parts)))
        self.counts["cost"] = cost
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.distinct

    def edited(self, row: tuple | None) -> Iterator[tuple]:
        """The plan's rows up to the edit that takes this text row; with None those after the last."""
        for edit in self.edits:
            turn, role, text = (None, None, "") if edit == INSERT else row
            if edit == KEEP:
                self.state = _KEPT[self.state][role[:1]]
            elif edit != DELETE:
                self.state = _NEXT[self.state]
                role = _ROLE[self.state]
            self.place += 1
            yield (self.conv, self.place, edit, turn, role, text, None)
            if edit != INSERT:
                return


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None

    def begun() -> Iterator[tuple]:
        if now.edits is None:
            now.finish()
            yield (now.conv, 0, None, None, None, None, now.counts)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        nonlocal now
        for conv, kind, turn, role, same, text, *flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from begun()
                    yield from now.edited(None)
                now = _Conversation(conv)
            if kind == _LIGHT:
                now.add(turn, role, same, *flags)
            elif kind == _TEXT:
                yield from begun()
                yield from now.edited((turn, role, text))

    def packed(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        made = list(rows(batch))
        if made:
            yield packed(made)
    made = [*begun(), *now.edited(None)] if now is not None else []
    if made:
        yield packed(made)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a conversations table after damage that crc32(conv_id:turn) % 20 deals: 0 drops a row, 1
    empties its text, 2 takes its end marks away, 3 repeats it, 4 sets its role to user. A null counts as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, copies = F.coalesce("text", F.lit(" ")), F.when(F.col("deal") == 0, 0).when(F.col("deal") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("deal", deal)
    return rows.where("deal <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("deal") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The edits of each conversation of rows (conv_id, turn, role, text; more columns are passed over), in order.

    A plan's rows are (conv_id, place, edit, turn, role, text, counts): for each conversation one of place 0 with its counts (gaps,
    blank, duplicate, truncated, illegal, cost), then one for each edit, with the role and text after it (of a deleted row its own).
    A conversation's rows lie in one partition, one after the other. ids: a table of a column conv_id; those without rows get
    a row of place 0.

    Rows stand by turn, nulls first, then by role and MD5 of the text; rows that agree in all are repetitions. Null roles and texts count as
    one space; a role's initial is its first character, and one that is neither s, u nor a, or an empty role, is legal nowhere.
    Null is a conversation of its own.
    """
    spark = rows.sparkSession
    small_batches(spark)
    key = rows.schema["conv_id"].dataType
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    base = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    base = base.withColumn("same", F.unhex(F.md5("text")))
    end = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    light = stored(base.select("conv", "turn", "role", "same", (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("truncated")), "light-turns")
    # only texts that a conversation's role says more than once need their first turn
    again = light.groupBy("conv", "role", "same").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("same").alias("s"), "first")
    met = light["conv"].eqNullSafe(again["c"]) & (light["role"] == again["r"]) & (light["same"] == again["s"])
    light = light.join(again, met, "left").withColumn("is_first", F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn")))

    def shaped(df: DataFrame, kind: int, **own: Column) -> DataFrame:
        none = {"turn": "long", "role": "string", "same": "binary", "text": "string", "blank": "boolean", "truncated": "boolean", "is_first": "boolean"}
        return df.select("conv", F.lit(kind).alias("kind"), *(own.get(c, F.lit(None).cast(t)).alias(c) for c, t in none.items()))

    of = lambda *names: {c: F.col(c) for c in names}
    every = shaped(light, _LIGHT, **of("turn", "role", "same", "blank", "truncated", "is_first"))
    every = every.unionByName(shaped(base, _TEXT, **of("turn", "role", "same", "text")))
    if ids is not None:
        every = every.unionByName(shaped(ids.select(F.col("conv_id").cast("string").alias("conv")), _MARK))
    dealt = every.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "same")
    return dealt.mapInArrow(_plan, _PLAN).withColumn("conv_id", F.col("conv").cast(key)).select("conv_id", "place", "edit", "turn", "role", "text", "counts")


def repaired(plan: DataFrame) -> DataFrame:
    """The turns after repair: (conv_id, place, role, text), places ascending with gaps where rows were deleted."""
    return plan.where("edit <> 'D'").select("conv_id", "place", "role", "text")


def digests(plan: DataFrame) -> DataFrame:
    """A row for each conversation of a plan as repair() returns it: its counts, audit (the edits' initials) and repaired_sha256,
    of role:text of the turns after repair, joined by line feeds. Reads the plan's partitions as they stand: no shuffle."""
    kind = plan.schema["conv_id"].dataType
    rows = plan.select(F.col("conv_id").cast("string").alias("conv"), "place", "edit", "role", "text", *(F.col(f"counts.{c}").alias(c) for c in _COUNTS))
    names = ["conv", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, audit, sha, begun = None, [], None, False
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            conv, place, edit, role, text = columns[:5]
            heads = [k for k, p in enumerate(place) if p == 0]
            done = []
            for a, b in pairwise([0, *heads, len(place)]):
                if a < b and place[a] == 0:
                    if head:
                        done.append((*head, "".join(audit), sha.hexdigest()))
                    head, audit, sha, begun = (conv[a], *(c[a] for c in columns[5:])), [], hashlib.sha256(), False
                    a += 1
                audit.append("".join(edit[a:b]))
                lines = [f"{role[k]}:{text[k]}" for k in range(a, b) if edit[k] != DELETE]
                if lines:
                    sha.update((("\n" if begun else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                    begun = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if 0 < k < 7 else pa.string()) for k, c in enumerate(zip(*done, strict=True))], names=names)
        if head:
            last = (*head, "".join(audit), sha.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if 0 < k < 7 else pa.string()) for k, c in enumerate(last)], names=names)

    found = rows.mapInArrow(run, "conv string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *names[1:])
