"""SimHash near-duplicates: fingerprints, and the links between those that differ in few bits.

Links are found without comparing all fingerprints. The 64 bits are cut into 32 segments of two, and a fingerprint is
mapped to its 32 segment popcounts. Popcounts of two fingerprints differ, summed over the segments (Manhattan distance),
by at most the number of bits in which the fingerprints differ, so that a Manhattan ball of that radius around each point
holds all its partners. The range join goes over a grid: the 32 coordinates are cut into blocks, of which a distance of d
leaves all but d unchanged; a grid cell is what blocks - d of the blocks hold, and a point is put into the cell of every
such choice. Partners share a cell at least. In a cell, first the Manhattan distance and then the differing bits decide.

A popcount of 0, 1 or 2 is kept in unary (00, 01, 11), so that the Manhattan distance of two points is the number of bits
in which their codes differ, and that a block of coordinates is a mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_mapper, small_batches, stored, texts_of
from .components import connected_components

SEGMENTS = 32
_ODD = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: 0 for a null text or one without words.

    A-Z is lower-cased; words are runs of anything but space and tab to carriage return; shingles of so many words, with
    their repeats, joined by a space (all the words where there are fewer); each one's XXH64 votes on every bit.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, len(words) - shingle + 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp long): each row's fingerprint, its 64 bits as a signed long. No shuffle."""
    small_batches(docs.sparkSession)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch, "text")], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(arrow_mapper(make), "id long, fp long").withColumnRenamed("id", id_col)


def popcount_code(fp: Column) -> Column:
    """The 32 segment popcounts of a fingerprint, two bits each, in unary."""
    high = F.shiftrightunsigned(fp, 1)
    odd = F.lit(_ODD)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def cell_masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance blocks, the mask (a signed long) of the coordinates in them."""
    edges = [round(SEGMENTS * k / blocks) for k in range(blocks + 1)]
    block = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, distance: int) -> int:
    """Into how many blocks to cut: more where there are more points, so that cells stay small. Any choice is exact."""
    return distance + (2 if n < 4_000_000 else 3 if n < 400_000_000 else 4)


def _codes(x: np.ndarray) -> np.ndarray:
    odd, one = np.uint64(_ODD), np.uint64(1)
    high = x >> one
    return ((x | high) & odd) | ((x & high & odd) << one)


def _close(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Where x and y differ in so few bits, after the lower bound has ruled out most."""
    near = np.bitwise_count(_codes(x) ^ _codes(y)) <= distance
    near[near] = np.bitwise_count((x ^ y)[near]) <= distance
    return near


def _walk(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Tree edges (positions) that connect what is linked in one large cell: each point takes its unseen partners."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _close(np.broadcast_to(fps[at], len(left)), fps[left], distance)
            found = left[near]
            if len(found):
                left = left[~near]
                edges += [(at, int(p)) for p in found]
                queue += found.tolist()
    return edges


def _cell_edges(frames: Iterator[pd.DataFrame], distance: int, wide: int = 48) -> Iterator[pd.DataFrame]:
    """Links inside the cells of one partition, whose rows come sorted by cell."""

    def edges(cell: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(axis=1))))
        sizes = np.diff(np.append(starts, len(cell)))
        group = np.repeat(np.arange(len(starts)), sizes)
        out_a, out_b = [], []
        for k in np.flatnonzero(sizes > wide):
            s = slice(starts[k], starts[k] + sizes[k])
            found = np.array(_walk(fp[s], distance), dtype=np.int64).reshape(-1, 2)
            out_a.append(node[s][found[:, 0]])
            out_b.append(node[s][found[:, 1]])
        at = np.flatnonzero((sizes > 1) & (sizes <= wide))
        at = np.flatnonzero(np.isin(group, at)) if len(at) else at
        step = 1
        while len(at):
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            near = at[_close(fp[at], fp[at + step], distance)]
            out_a.append(node[near])
            out_b.append(node[near + step])
            step += 1
        empty = np.array([], dtype=np.int64)
        return pd.DataFrame({"a": np.concatenate([empty, *out_a]), "b": np.concatenate([empty, *out_b])}).drop_duplicates()

    held: list[pd.DataFrame] = []
    rows = 0

    def flush(frame: pd.DataFrame) -> pd.DataFrame:
        cell = frame[["mask", "cell", "i", "j"]].to_numpy(np.int64)
        return edges(cell, frame["fp"].to_numpy(np.int64).view(np.uint64), frame["node"].to_numpy(np.int64))

    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows < 100_000:
            continue
        whole = pd.concat(held, ignore_index=True)
        cell = whole[["mask", "cell", "i", "j"]].to_numpy(np.int64)
        cut = int(np.flatnonzero((cell != cell[-1]).any(axis=1)).max(initial=-1)) + 1
        if cut:
            yield flush(whole.iloc[:cut])
        held, rows = [whole.iloc[cut:]], len(whole) - cut
    if rows:
        yield flush(pd.concat(held, ignore_index=True))


def fingerprint_links(points: DataFrame, distance: int = 4, cell_rows: int = 20_000, blocks: int | None = None) -> DataFrame:
    """(a, b): edges between the nodes of points (node long, fp long, distinct fps) that connect just what links connect.

    In cells of many points the edges are a tree and not all pairs. A cell of more than cell_rows points is cut into parts
    of that size and every two parts meet in a task of their own, so that a task's memory doesn't grow with a cell.
    """
    spark = points.sparkSession
    blocks = blocks or blocks_for(points.count(), distance)
    masks = cell_masks(blocks, distance)
    cells = points.withColumn("code", popcount_code(F.col("fp"))).select(
        "node", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])).alias("c")
    ).select("node", "fp", "c.mask", "c.cell")
    large = (
        cells.groupBy("mask", "cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
        .select("mask", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    )
    dealt = (
        cells.join(large, ["mask", "cell"], "left")
        .withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")))
        .withColumn("with", F.explode(F.expr("if(parts is null, array(0), sequence(0, parts - 1))")))
        .select("mask", "cell", F.coalesce(F.least("part", "with"), F.lit(0)).alias("i"), F.coalesce(F.greatest("part", "with"), F.lit(0)).alias("j"), "fp", "node")
    )
    keys = ["mask", "cell", "i", "j"]
    small_batches(spark, 10_000)
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda frames: _cell_edges(frames, distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, cell_rows: int = 20_000) -> DataFrame:
    """(id_col, fp long, component_id long): one row per document; component_id is the smallest id that links reach.

    Documents link where their fingerprints differ in at most distance bits. Equal fingerprints are one point of the search,
    so that groups of copies, of whatever size, cost no pairs. Null and empty texts have the fingerprint zero and link like
    any other; repeated rows come back as often as they came; rows whose id is null keep a null component.
    """
    each = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    points = stored(each.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("node")), "simhash-points")
    parts = connected_components(fingerprint_links(points, distance, cell_rows))
    of = points.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return each.join(of, "fp", "left").select(
        id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component")).alias("component_id")
    )
