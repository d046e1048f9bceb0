"""Packing documents into sequences of a fixed number of tokens, by linear grouping and best fit.

Documents become pieces of a sequence's length at most. How many pieces there are of each length is a table of no more rows than
a sequence has tokens, whatever the corpus; from it alone the driver makes the plan. Pieces over half a sequence open one each,
filled by best fit. Of the rest, large lengths are cut into groups of equal cardinality and rounded up within each; a linear
programme over the patterns of these few sizes, whose columns a knapsack finds, says how many sequences follow each pattern.
Actual pieces then stand in for the rounded ones, and what is left, small pieces mostly, goes to the fullest sequence that holds
it. A plan's slot is a run of pieces of one length and where they lie, so the plan too is bounded by the lengths. Pieces are
numbered within their length by counts per task, and look their place up.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, texts_of
from .tokens import byte_alphabet

CAPACITY, END_ID = 2048, 0
#: Pieces longer than this part of a sequence are large.
LARGE_PART = 8
#: (groups, part): plans that are tried, of which the one with fewest sequences counts, the first of equal ones. Pieces over that
#: part of a sequence, with what best fits beside them, come before the groups. The last is best fit alone.
TRIES = ((64, 2), (64, 3), (0, 1))
#: Rows of (task, length) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: How byte-level vocabularies of this family split a text before merging.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

Slots = np.ndarray
_SLOT = np.dtype([(c, np.int64) for c in ("length", "first", "count", "per_bin", "bin", "offset")])


def patterns(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, how many sequences): whole multiples of the patterns that together hold the demand in the fewest
    sequences by linear programming, rounded down. sizes differ; columns are made by a knapsack as long as one helps."""
    n, width = len(sizes), np.array(sizes)
    columns = np.diag(capacity // width).astype(np.float64)
    need = np.array(demand, dtype=np.float64)
    inverse = np.diag(1.0 / np.diag(columns))
    for step in range(40 * n):
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
        worth = inverse.sum(axis=0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for k in np.argsort(-worth / width):
            if worth[k] > 1e-12:
                # one size more: along each remainder the best is a running maximum once its pieces' worth is taken off
                rows = -(-(capacity + 1) // width[k])
                table = np.full(rows * width[k], -np.inf)
                table[: capacity + 1] = best
                steps = worth[k] * np.arange(rows)[:, None]
                more = (np.maximum.accumulate(table.reshape(rows, -1) - steps, axis=0) + steps).ravel()[: capacity + 1]
                better = more > best + 1e-12
                last[better] = k
                best = np.where(better, more, best)
        best = np.maximum.accumulate(best)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= width[last[c]]
        now, move = inverse @ need, inverse @ column
        ratio = np.where(move > 1e-9, np.maximum(now, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
    times = np.floor(np.linalg.solve(columns, need) + 1e-6).astype(np.int64)
    found, left = [], np.array(demand)
    for k in np.argsort(-times):
        own = columns[:, k].astype(np.int64)
        fits = int(min([times[k], *(left[own > 0] // own[own > 0])]))
        if fits > 0:
            found.append((own, fits))
            left = left - own * fits
    return found


class _Plan:
    """Sequences as runs of equally filled ones, and the slots of pieces in them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.taken = capacity, dict(counts), dict.fromkeys(counts, 0)
        self.bins, self.slots = 0, []
        self.open: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, how many)]
        self.rooms: list[int] = []

    def put(self, length: int, count: int, per_bin: int, first_bin: int, offset: int) -> None:
        self.slots.append((length, self.taken[length], count, per_bin, first_bin, offset))
        self.taken[length] += count
        self.left[length] -= count

    def add(self, room: int, first_bin: int, n: int) -> None:
        if n and room:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first_bin, n))

    def by_patterns(self, groups: int, top: int) -> None:
        """Fill sequences with whole multiples of patterns of the pieces that are large and at most top long."""
        large = [x for x in sorted(self.left, reverse=True) if self.capacity // LARGE_PART < x <= top and self.left[x]]
        total, seen, group_of = sum(self.left[x] for x in large), 0, []
        # a group's pieces as runs (length, count), longest first
        runs: list[list[list[int]]] = []
        for x in large:
            n = self.left[x]
            while n:
                group = seen * groups // total
                if group_of[-1:] != [group]:
                    group_of.append(group)
                    runs.append([])
                part = min(n, -(-(group + 1) * total // groups) - seen)
                runs[-1].append([x, part])
                seen, n = seen + part, n - part
        merged: dict[int, list[list[int]]] = {}
        for own in runs:
            merged.setdefault(own[0][0], []).extend(own)
        sizes = list(merged)
        if not sizes:
            return
        for column, times in patterns(sizes, [sum(n for _, n in merged[s]) for s in sizes], self.capacity):
            # the smallest place of a pattern stays open for what fits it best
            parts = [merged[s] for s, k in zip(sizes, column.tolist(), strict=True) for _ in range(k)]
            parts = parts[:-1] if len(parts) > 1 else parts
            own = []
            for part in parts:
                need, taken = times, []
                while need:
                    x, n = part[0]
                    k = min(n, need)
                    taken.append((x, k))
                    need -= k
                    part[0][1] -= k
                    if not part[0][1]:
                        part.pop(0)
                own.append(taken)
            cuts = sorted({0, *(c for taken in own for c in np.cumsum([k for _, k in taken]).tolist())})
            lengths = [np.repeat([x for x, _ in taken], np.searchsorted(cuts, np.cumsum([k for _, k in taken])) - np.searchsorted(cuts, np.cumsum([k for _, k in taken]) - [k for _, k in taken])) for taken in own]
            for a, b, *row in zip(cuts, cuts[1:], *(x.tolist() for x in lengths), strict=False):
                used = 0
                for x in row:
                    self.put(x, b - a, 1, self.bins, used)
                    used += x
                self.add(self.capacity - used, self.bins, b - a)
                self.bins += b - a

    def best_fit(self, new_above: int = 0) -> None:
        """Put what is left, longest first, where the least room remains, and pieces over new_above into new sequences where none
        has room."""
        for x in sorted(self.left, reverse=True):
            while self.left[x]:
                at = bisect_left(self.rooms, x)
                if at == len(self.rooms):
                    if x <= new_above:
                        break
                    room, first, n = self.capacity, self.bins, -(-self.left[x] // (self.capacity // x))
                    self.bins += n
                else:
                    room = self.rooms[at]
                    first, n = self.open[room].pop()
                    if not self.open[room]:
                        del self.open[room]
                        self.rooms.pop(at)
                offset, each = self.capacity - room, room // x
                full = min(n, self.left[x] // each)
                if full:
                    self.put(x, full * each, each, first, offset)
                    self.add(room - each * x, first, full)
                rest = min(self.left[x], each) if full < n else 0
                if rest:
                    self.put(x, rest, rest, first + full, offset)
                    self.add(room - rest * x, first + full, 1)
                    full += 1
                self.add(room, first + full, n - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Slots, int]:
    """The slots of pieces in sequences, sorted by length and first piece, and the number of sequences, for so many pieces of each
    length. A slot holds count pieces of a length from number first on, per_bin to a sequence, the first at that sequence and offset."""
    best = None
    for groups, part in TRIES:
        made = _Plan({x: n for x, n in counts.items() if n}, capacity)
        if groups:
            made.best_fit(capacity // part)
            made.by_patterns(groups, capacity // part)
        made.best_fit()
        if best is None or made.bins < best.bins:
            best = made
        if best.bins == -(-sum(x * n for x, n in counts.items()) // capacity):
            break
    return np.sort(np.array(best.slots, dtype=_SLOT), order=["length", "first"]), best.bins


def _encoder(path: str):
    """A function from a text to its ids as 32-bit integers, for a byte-level BPE file in which a token's id is its rank; special
    strings inside texts are one id each, as is the tokenizers library's default."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in byte_alphabet().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, t)): k for t, k in spec["model"]["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The stored pieces of every row's ids and END_ID after them: (id, piece, start, length, ids_crc32, task, place), and ids if
    with_ids. A document over capacity is cut into pieces of capacity, of which the first may be shorter; null is an empty text.

    place counts the pieces of the length that the task has made. vocabulary: the path of the file on every machine; by default
    byte_bpe_50k.json of the installed public tokenizers. Repeated rows are documents of their own.
    """
    small_batches(docs.sparkSession, 500)
    kinds = "id long, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids array<int>" * with_ids
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path("byte_bpe_50k.json"))
        encode, task, made = _encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids = np.append(encode(text) if text else np.array([], np.uint32), END_ID).astype("<u4")
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for k, end in enumerate(ends):
                    own, length = ids[start:end], end - start
                    out.append((doc, k, start, length, zlib.crc32(own.tobytes()), task, made[length], *([own.astype(np.int32)] if with_ids else [])))
                    made[length] += 1
                    start = end
            kinds_of = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_of, strict=False)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, kinds), "pieces")


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of pieces() with its sequence_id and its offset there: sequences hold capacity at most, without gaps."""
    spark = cut.sparkSession
    counts = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    slots, _ = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("task", "length", before.alias("base"))
    numbered = cut.join(F.broadcast(base) if counts.count() <= BROADCAST_ROWS else base, ["task", "length"]).withColumn("number", F.col("base") + F.col("place"))
    numbered = numbered.select(*(c for c in cut.columns if c not in ("task", "place")), "number")
    shared, at = spark.sparkContext.broadcast(slots), [numbered.columns.index(c) for c in ("length", "number")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        # one axis for all lengths: a length's pieces lie after those of the shorter ones
        top = np.zeros(capacity + 2, dtype=np.int64)
        np.add.at(top, own["length"] + 1, own["count"])
        top = np.cumsum(top)
        starts = top[own["length"]] + own["first"]
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in at)
            slot = own[np.searchsorted(starts, top[length] + number, side="right") - 1]
            nth = number - slot["first"]
            sequence = slot["bin"] + nth // slot["per_bin"]
            offset = slot["offset"] + nth % slot["per_bin"] * length
            columns = [c for k, c in enumerate(batch.columns) if k != at[1]] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(n for n in batch.schema.names if n != "number"), "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(run, f"{kinds}, sequence_id long, offset long")
