"""Ranked lexical search by TPUT over term-partitioned postings.

The index deals its postings (term, document, contribution) by ranges of (term, contribution descending), so that a frequent
term's list takes many partitions, and keeps each list's head apart. A search has three phases. The heads give partial sums; the
exact scores of the documents with the best ones bound the k-th score from below. A threshold, the same for all lists of an item,
is set so high that a document below it in all of them can't reach that bound, and every list is read down to it; with what was
not seen counted as the threshold, or the list's greatest contribution where that is less, most documents fall behind the
k-th partial sum. Of the others the exact scores are looked up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, texts_of
from .decontam import words

#: Rows of a list's head, at least the k of any search.
HEAD = 200
#: Documents of an item whose exact scores give the first bound, as a multiple of k.
TRIED = 4
#: Terms that are sent to every task as a filter of documents; an index of more terms holds them all.
FILTER_TERMS = 200_000
#: Terms of items that one pass over the postings searches for; documents whose items are broadcast, and keys that are.
PASS_TERMS = 200_000
BROADCAST_ITEMS, BROADCAST_KEYS = 50_000, 1_000_000


@dataclass(frozen=True)
class Index:
    """docs: (key, id, n_terms), a row of the table each. postings: (term, key, c), c over 0; heads: the first of each list, with
    their place."""

    docs: DataFrame
    postings: DataFrame
    heads: DataFrame


def terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term), each once; rows without an id or a text have none. Rows that share an id are one item."""
    low = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.explode(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), found.alias("term")).distinct()


def _count_terms(known: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, names, times = [], [0], [], []
            for text in texts_of(batch):
                own = words(text)
                found = Counter(own if known is None else filter(known.__contains__, own))
                sizes.append(len(own))
                names += found.keys()
                times += found.values()
                ends.append(len(names))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(names, pa.string()), pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n_terms", "terms", "times"])

    return run


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has so many rows at most."""
    return F.broadcast(df) if df.count() <= rows else df


def build(docs: DataFrame, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of docs. only: (term), the terms that searches will ask for, where that is known; others get no postings then.

    All documents count in the statistics, whatever their terms. Each row is a document, repeated ones too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = None
    if only is not None:
        asked = only.select("term").distinct()
        if asked.count() <= FILTER_TERMS:
            known = frozenset(r.term.encode() for r in asked.collect())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count_terms(known), "id long, n_terms long, terms array<string>, times array<long>")
    counted = stored(counted.withColumn("key", F.monotonically_increasing_id()), "terms-of-documents")
    n_docs, length = counted.agg(F.count(F.when(F.col("n_terms") > 0, 1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weights = stored(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")), "weights")
    m = F.expr(f"50 + ((50L * n_terms * {n_docs}L) div {max(length, 1)}L)")
    flat = counted.select("key", m.alias("m"), F.explode(F.arrays_zip("terms", "times")).alias("t")).select("key", "m", F.col("t.terms").alias("term"), F.col("t.times").alias("tf"))
    postings = flat.join(_bounded(weights, FILTER_TERMS), "term").select("term", "key", F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))").alias("c")).where("c > 0")
    postings = postings.repartitionByRange("term", F.desc("c"), "key").sortWithinPartitions("term", F.desc("c"), "key")
    postings = stored(postings, "postings")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("c"), "key"))
    heads = stored(postings.withColumn("place", place).where(F.col("place") <= HEAD), "heads")
    return Index(counted.select("key", "id", "n_terms"), postings, heads)


def _best(rows: DataFrame, score: str, k: int, *ties) -> DataFrame:
    """rows of each item that rank up to k by score."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score), *ties))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _exact(index: Index, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, key, score): pairs (item, key), stored, with their exact scores. asked: (item, term), broadcast."""
    wanted = pairs.groupBy("key").agg(F.collect_set("item").alias("items"))
    met = index.postings.join(_bounded(wanted, BROADCAST_ITEMS), "key").join(asked.select("item", "term"), "term")
    return met.where(F.array_contains("items", F.col("item"))).groupBy("key", "item").agg(F.sum("c").alias("score"))


def _pass(index: Index, asked: DataFrame, k: int) -> DataFrame:
    asked = F.broadcast(asked)
    heads = index.heads.join(asked, "term")
    partial = heads.groupBy("item", "key").agg(F.sum("c").alias("score"))
    tried = stored(_best(partial, "score", TRIED * k, "key").select("item", "key"), "tried")
    bound = _best(_exact(index, asked, tried), "score", k, "key").where(F.col("rank") == k).select("item", F.col("score").alias("bound"))
    tops = heads.where("place = 1").groupBy("item").agg(F.array_sort(F.collect_list("c")).alias("tops"))
    # the greatest x for which min(x, top), summed over the lists, stays below the bound: the least over the numbers j of lists
    # that are below x of what the others have left
    below = "aggregate(tops, struct(0L as j, 0L as before, 0L as x), (s, c) -> struct(s.j + 1 as j, s.before + c as before, greatest(s.x, (bound - 1 - s.before) div (size(tops) - s.j)) as x), s -> s.x)"
    limits = tops.join(bound, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(1))).withColumn("x", F.expr(below))
    limits = limits.withColumn("rest", F.expr("aggregate(tops, 0L, (s, c) -> s + least(c, x))")).select("item", "bound", "x", "rest")
    limits = stored(limits, "thresholds")
    least = limits.agg(F.min("x")).first()[0]
    if least is None:
        return index.docs.select(F.col("key").alias("item"), F.lit(0).alias("rank"), F.col("id"), F.col("key").alias("score")).limit(0)
    asked_from = stored(asked.join(F.broadcast(limits), "item").select("item", "term", "x"), "asked")
    any_item = F.broadcast(asked_from.groupBy("term").agg(F.min("x").alias("least")))
    read = index.postings.where(F.col("c") > least).join(any_item, "term").where("c > least").select("key", "term", "c").repartition("key")
    seen = read.join(F.broadcast(asked_from), "term").where("c > x").groupBy("key", "item").agg(F.sum("c").alias("sum"), F.count("*").alias("n"))
    limits = F.broadcast(limits)
    most = F.col("sum") + F.col("rest") - F.col("n") * F.col("x")
    seen = stored(seen.join(limits, "item").withColumn("most", most).where("most >= bound").select("item", "key", "sum", "most"), "seen")
    better = _best(seen, "sum", k, "key").where(F.col("rank") == k).select("item", F.col("sum").alias("bound"))
    left = seen.join(F.broadcast(better), "item", "left").where("bound is null or most >= bound").select("item", "key")
    scored = _exact(index, asked, stored(left, "candidates"))
    # of the exact scores only those that reach the k-th need their document's id
    scored = stored(scored, "scored")
    last = _best(scored, "score", k, "key").where(F.col("rank") == k).select("item", F.col("score").alias("last"))
    scored = scored.join(F.broadcast(last), "item", "left").where("last is null or score >= last")
    named = index.docs.select("key", "id").join(_bounded(stored(scored.select("item", "key", "score"), "named"), BROADCAST_KEYS), "key")
    return _best(named, "score", k, F.col("id").asc_nulls_last(), "key").select("item", "rank", "id", "score")


def ranked(index: Index, asked: DataFrame, k: int = 50) -> DataFrame:
    """(item, rank, id, score): for each item of asked (item, term), as terms() gives it, the k documents of highest score above 0,
    all if there are fewer; equal scores in order of the id, null ids last.

    Items are searched in passes of about PASS_TERMS terms. k is HEAD at most.
    """
    if not 0 < k <= HEAD:
        raise ValueError(f"k must be from 1 to {HEAD}")
    asked = stored(asked.select("item", "term"), "asked-terms")
    passes = max(1, -(-asked.count() // PASS_TERMS))
    found = None
    for p in range(passes):
        part = _pass(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p) if passes > 1 else asked, k)
        found = part if found is None else found.unionByName(part)
    return found
