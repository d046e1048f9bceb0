"""Benchmark decontamination with a positional inverted index of the training documents, dealt by documents.

Each task indexes the documents it reads in shards of bounded size: for every token of a shard, whatever benchmark comes, the
places where it occurs. A stored row of the index is a shard: its documents, its tokens, and each token's postings. Any number
of benchmarks, and any number of blocks of one, are searched in the same index. Windows of 13 benchmark words lie grouped by the
term that is rarest in all documents, so that a shard meets only those whose rarest term it has; each starts from the list that is
shortest in the shard, and the other terms' lists, shortest first, are intersected at their offsets, so that most windows end
after one list. No row is ever shuffled: the benchmark travels, in blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light_batches, small_batches, stored, texts_of

#: Bytes of words as they are, A-Z as a-z, every other ASCII byte as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Benchmark words that one pass over the documents searches for; about 30 bytes of a task's memory each, besides distinct terms.
BLOCK_WORDS = 2_000_000

#: Words of a shard, of which its last document may hold more; a shard ends with its Arrow batch too. A shard is one row: the
#: Parquet writer looks at its buffers every hundred rows only, so that rows of a few hundred kB bound its memory.
SHARD_WORDS = 100_000

_INDEX = "ids array<long>, same array<long>, n_words array<int>, terms binary, ends binary, places binary"
_FOUND = "id long, same long, n_words long, hits array<struct<start:int,end:int>>, item_ids array<long>, near_ids array<long>"


def words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and anything beyond ASCII, after A-Z is lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The distinct windows of some benchmark items: where each starts in the items' words, put one after the other as term
    numbers, and the items that hold it. About 30 bytes a word, and the distinct terms."""

    def __init__(self, items: list[tuple[int, str]], size: int = 13):
        self.size = size
        number: dict[bytes, int] = defaultdict(count().__next__)
        own = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in (words(t) for _, t in items)]
        self.terms = list(number)
        n_words = np.array([len(x) for x in own], dtype=np.int64)
        n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
        # past the last item there are places enough for any window
        self.stream = np.concatenate([*own, np.full(size, -1, np.int32)])
        start = _ragged(np.cumsum(n_words) - n_words, n)
        length = np.repeat(np.minimum(n_words, size), n).astype(np.int8)
        item = np.repeat(np.array([k for k, _ in items], dtype=np.int64), n)
        # windows of the same words are neighbours by hash; a collision would only leave two of them apart
        mark = length.astype(np.uint64)
        for k in range(size):
            mark = mark * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, self.stream[start + k], -1).astype(np.uint64)
            mark ^= mark >> np.uint64(29)
        order = np.lexsort((item, mark))
        start, length, item = start[order], length[order], item[order]
        new = np.ones(len(start), dtype=bool)
        if len(start):
            new[1:] = length[1:] != length[:-1]
            for k in range(size):
                new[1:] |= (k < length[1:]) & (self.stream[start[1:] + k] != self.stream[start[:-1] + k])
        first = new.copy()
        first[1:] |= item[1:] != item[:-1]
        window = np.cumsum(new) - 1
        self.start, self.length = start[new].astype(np.int32), length[new]
        self.items = item[first]
        self.first_item = np.concatenate(([0], np.cumsum(np.bincount(window[first], minlength=len(self.start))))).astype(np.int32)
        self.by_term(np.zeros(len(self.terms), dtype=np.int64))

    def ids(self, window: np.ndarray) -> np.ndarray:
        """The term numbers of windows, a row each, -1 behind the last."""
        places = np.arange(self.size)
        return np.where(places < self.length[window, None], self.stream[self.start[window, None] + places], -1)

    def by_term(self, often: np.ndarray) -> None:
        """Group the windows by their rarest term; often: how often each term occurs."""
        rarest = np.empty(len(self.start), dtype=np.int32)
        for k in range(0, len(rarest), 100_000):
            ids = self.ids(np.arange(k, min(k + 100_000, len(rarest))))
            counts = np.where(ids >= 0, often[ids], np.iinfo(np.int64).max)
            rarest[k : k + 100_000] = ids[np.arange(len(ids)), counts.argmin(axis=1)]
        self.of_term = np.argsort(rarest, kind="stable").astype(np.int32)
        self.first_of = np.concatenate(([0], np.cumsum(np.bincount(rarest, minlength=len(self.terms))))).astype(np.int32)

    def of(self, terms: np.ndarray) -> np.ndarray:
        """The windows whose rarest term is one of these."""
        first = self.first_of[terms].astype(np.int64)
        return self.of_term[_ragged(first, self.first_of[terms + 1] - first)]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _index_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, same, texts = batch.column(0), batch.column(1), texts_of(batch)
        begin = 0
        while begin < len(texts):
            number: dict[bytes, int] = defaultdict(count().__next__)
            sizes, found, total, end = [], [], 0, begin
            while end < len(texts) and total < SHARD_WORDS:
                w = words(texts[end])
                found.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                sizes.append(len(w))
                total, end = total + len(w), end + 1
            tokens = np.concatenate(found)
            # a token's places in the shard, ascending, token by token
            places = np.argsort(tokens, kind="stable").astype("<i4")
            ends = np.cumsum(np.bincount(tokens, minlength=len(number))).astype("<i4")
            n = end - begin
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in (ids.slice(begin, n), same.slice(begin, n), pa.array(sizes, pa.int32()))]
            packed = [pa.array([x], pa.binary()) for x in (b"\n".join(number), ends.tobytes(), places.tobytes())]
            yield pa.RecordBatch.from_arrays([*lists, *packed], names=["ids", "same", "n_words", "terms", "ends", "places"])
            begin = end


def _matches(key: np.ndarray, span: int, known: np.ndarray, w: Windows, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact): where windows occur. key: term * span + place, sorted, of a shard's postings; known: its terms.

    A start is near if each of the window's words has an occurrence at most slack places from its own, exact if at none.
    """
    # how often the shard has each term; the last place stands for no term
    often = np.zeros(len(w.first_of), dtype=np.int64)
    often[known] = np.diff(np.append(np.searchsorted(key, known * span), len(key)))
    often[-1] = np.iinfo(np.int64).max
    # only windows whose rarest term the shard has, and of them those all of whose terms it has
    live = w.of(known)
    for k in range(w.size):
        live = live[(often[w.stream[w.start[live] + k]] > 0) | (w.length[live] <= k)]
    ids = w.ids(live)
    order = np.argsort(often[ids], axis=1, kind="stable")
    rarest = ids[np.arange(len(live)), order[:, 0]]
    n = often[rarest]
    posting = key[_ragged(np.searchsorted(key, rarest * span), n)] % span
    at_live = np.repeat(np.arange(len(live)), n)
    start = posting - order[at_live, 0]
    shifts = np.arange(-slack, slack + 1)
    at_live, start = np.repeat(at_live, len(shifts)), (start[:, None] + shifts).ravel()
    exact = np.tile(shifts == 0, len(posting))
    for k in range(1, w.size):
        if not len(at_live):
            break
        offset = order[at_live, k]
        term = ids[at_live, offset]
        want = term * span + start + offset
        at = np.minimum(np.searchsorted(key, want - slack), len(key) - 1)
        near = (key[at] >= want - slack) & (key[at] <= want + slack)
        there = near if not slack else key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
        done = term < 0
        exact &= there | done
        keep = near | done
        at_live, start, exact = at_live[keep], start[keep], exact[keep]
    return live[at_live], start, exact


def _search_shard(ids: pa.Array, same: pa.Array, n_words: np.ndarray, own: list[bytes], ends: np.ndarray, places: np.ndarray, number: dict[bytes, int], w: Windows, slack: int) -> pa.RecordBatch:
    rows, pad = len(n_words), w.size + 2 * slack + 1
    base = np.concatenate(([0], np.cumsum(n_words + pad))) + pad
    span = int(base[-1]) + pad
    # the postings of the benchmark's terms, in order of its numbers; documents are moved apart by pad places
    term = np.fromiter((number.get(t, -1) for t in own), np.int64, len(own))
    known = np.flatnonzero(term >= 0)
    known = known[np.argsort(term[known])]
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else np.array([], np.int64)
    sizes = ends[known] - begins[known]
    at = places[_ragged(begins[known], sizes)].astype(np.int64)
    doc = np.searchsorted(np.cumsum(n_words), at, side="right")
    key = np.repeat(term[known], sizes) * span + at + pad * (doc + 1)
    empty = np.array([], dtype=np.int64)
    window, start, exact = _matches(key, span, term[known], w, slack) if len(key) else (empty, empty, empty.astype(bool))
    home = np.searchsorted(base, start + slack, side="right") - 1

    def items(mask: np.ndarray) -> np.ndarray:
        """(row, item) for the windows that the mask picks, each once."""
        n = np.diff(w.first_item)[window[mask]]
        pairs = np.stack([np.repeat(home[mask], n), w.items[_ragged(w.first_item[window[mask]], n)]], axis=1)
        return np.unique(pairs, axis=0)

    sure = items(exact)
    near = items(~exact)
    found = set(map(tuple, sure.tolist()))
    near = np.array([p for p in map(tuple, near.tolist()) if p not in found], dtype=np.int64).reshape(-1, 2)
    cover = np.zeros(span + 1, dtype=np.int32)
    np.add.at(cover, start[exact], 1)
    np.add.at(cover, start[exact] + w.length[window[exact]], -1)
    edge = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8))))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(base, begin, side="right") - 1

    def listed(of: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32()), values)

    spans = pa.StructArray.from_arrays(
        [pa.array((begin - base[row]).astype(np.int32)), pa.array((end - base[row]).astype(np.int32))], names=["start", "end"]
    )
    found = [listed(row, spans), *(listed(x[:, 0], pa.array(x[:, 1], pa.int64())) for x in (sure, near))]
    names = ["id", "same", "n_words", "hits", "item_ids", "near_ids"]
    return pa.RecordBatch.from_arrays([ids, same, pa.array(n_words.astype(np.int64)), *found], names=names)


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, a row for each shard: its documents (ids, same: hashes of their texts, n_words) and its terms, joined by
    line feeds, with the postings of the k-th in places from ends[k - 1] up to ends[k], both 32-bit integers. A place counts
    the shard's words. No shuffle."""
    small_batches(docs.sparkSession)
    light_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_index_shards, _INDEX), "postings")


def _parts(batch: pa.RecordBatch, k: int, *columns: int) -> list[np.ndarray | list[bytes]]:
    """Some of terms, ends and places of the batch's k-th shard."""
    found = (batch.column(c)[k].as_py() for c in columns)
    return [x.split(b"\n") if c == 3 and x else [] if c == 3 else np.frombuffer(x, "<i4") for c, x in zip(columns, found, strict=True)]


def _frequencies(index: DataFrame, windows: Windows) -> np.ndarray:
    """How often each term of the windows occurs in all indexed documents."""
    shared = index.sparkSession.sparkContext.broadcast(b"\n".join(windows.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(shared.value.split(b"\n"))}
        often = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own, ends = (x.as_py() for x in (batch.column(0)[k], batch.column(1)[k]))
                term = np.fromiter((number.get(t, -1) for t in own.split(b"\n")), np.int64) if own else np.array([], np.int64)
                often[term[term >= 0]] += np.diff(np.frombuffer(ends, "<i4"), prepend=0)[term >= 0]
        met = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(often[met])], names=["term", "n"])

    found = np.zeros(len(windows.terms), dtype=np.int64)
    if len(found):
        for r in index.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            found[r.term] = r.n
    return found


def search(index: DataFrame, windows: Windows, slack: int = 1) -> DataFrame:
    """Each indexed document's hits, the items with exact windows and those with near ones only."""
    windows.by_term(_frequencies(index, windows))
    terms, windows.terms = windows.terms, b"\n".join(windows.terms)
    shared = index.sparkSession.sparkContext.broadcast(windows)
    windows.terms = terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        number = {t: k for k, t in enumerate(w.terms.split(b"\n"))}
        for batch in batches:
            for k in range(batch.num_rows):
                ids, same, n_words = (c[k].values for c in batch.columns[:3])
                own, ends, places = _parts(batch, k, 3, 4, 5)
                yield _search_shard(ids, same, n_words.to_numpy().astype(np.int64), own, ends.astype(np.int64), places, number, w, slack)

    return index.mapInArrow(run, _FOUND)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = 13, slack: int = 1, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: id_col, n_words, hits, item_ids, near_ids.

    A window is size consecutive words of an item (an item of fewer words is one window; without words it has none).
    hits: the ranges (start, end exclusive) of the document's words inside exact occurrences, disjoint and in order;
    item_ids: the items with such occurrences, ascending; near_ids: further items of which a window occurs with each word at
    most slack places off. Null and empty texts have no words; items whose id or text is null are passed over; repeated
    documents come back as often as they came, repeated items count once.

    The documents are indexed once. The benchmark is searched in blocks of about block_words words, a pass over the index
    each; several blocks' hits are put together by document and text.
    """
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    items = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0]
    blocks = max(1, -(-(total or 0) // block_words))

    index = positional_index(docs, id_col, text_col)

    def one(k: int) -> DataFrame:
        return search(index, Windows([tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()], size), slack)

    found = one(0)
    if blocks > 1:
        every = found.select("id", "same", "n_words")
        part = found
        for k in range(1, blocks):
            part = part.unionByName(one(k))
        part = part.where("size(item_ids) + size(near_ids) > 0").groupBy("id", "same").agg(
            F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
            F.array_distinct(F.flatten(F.collect_list("near_ids"))).alias("near_ids"),
        )
        joined = F.expr(
            "aggregate(hits, cast(array() as array<struct<start:int,end:int>>), (a, h) -> if(size(a) > 0 and element_at(a, -1).end >= h.start,"
            " concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, h.end) as end))),"
            " concat(a, array(h))))"
        )
        part = part.select(F.col("id").alias("id2"), F.col("same").alias("same2"), joined.alias("hits"), "item_ids", F.array_sort(F.array_except("near_ids", "item_ids")).alias("near_ids"))
        found = every.join(part, F.col("id").eqNullSafe(F.col("id2")) & (F.col("same") == F.col("same2")), "left").select(
            "id", "n_words", *(F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c) for c, kind in (("hits", "array<struct<start:int,end:int>>"), ("item_ids", "array<bigint>"), ("near_ids", "array<bigint>")))
        )
    return found.select(F.col("id").alias(id_col), "n_words", "hits", "item_ids", "near_ids")


def contamination(matches: DataFrame) -> DataFrame:
    """matches with n_hit, the words inside hits, and contaminated: a twentieth of the words at least are hit."""
    return matches.withColumn(
        "n_hit", F.expr("aggregate(hits, 0L, (n, h) -> n + (h.end - h.start))")
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
