"""Toxicity by a classifier chain: a linear model for each category, which also sees the earlier categories' probabilities.

The models learn from a sample of the labelled documents, of bounded size. Features are words and word beginnings, present
or not; those kept are the ones whose frequency differs most between a category's documents and the rest. An earlier
category's probability enters a later model's training as predicted by models that have not seen the row (out of fold), and
its scoring as predicted by the earlier final model. Documents are scored where they are read; nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_mapper, small_batches, stored, texts_of

#: Labelled documents that the models learn from, in expectation.
SAMPLE_ROWS = 12_000
#: Features kept for each category, and the share of the sample in which one may occur: that or twice the category's.
FEATURES = 300
COMMON = 0.1
FOLDS = 5
PREFIXES = (4, 5, 6)

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*|\p{N}+|[^\s\p{L}\p{N}]{2,}")


def _counts(text: str | None) -> Counter[str]:
    """How often each lower-case word, mark in a row and beginning of a longer word ("^abcd") occurs."""
    counts = Counter(_WORD.findall(text.lower())) if text else Counter()
    for w, n in list(counts.items()):
        for k in PREFIXES:
            if len(w) > k:
                counts[f"^{w[:k]}"] += n
    return counts


def features(text: str | None) -> set[str]:
    """What occurs in a text, and, marked with "#2", what occurs more than once."""
    counts = _counts(text)
    return {*counts, *(f"{w}#2" for w, n in counts.items() if n > 1)}


def _known(text: str | None, index: dict[str, int], cache: dict[str, tuple[str, ...]]) -> np.ndarray:
    """The numbers of the text's features that the models know. cache: what of a word they know, kept between texts."""
    if not text:
        return np.array([], dtype=np.int64)
    if len(cache) > 200_000:
        cache.clear()
    counts: Counter[str] = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        own = cache.get(w)
        if own is None:
            own = (w, *(f"^{w[:k]}" for k in PREFIXES if len(w) > k))
            own = cache[w] = tuple(f for f in own if f in index or f"{f}#2" in index)
        for f in own:
            counts[f] += n
    got = [index[f] for f in counts if f in index] + [index[f"{f}#2"] for f, n in counts.items() if n > 1 and f"{f}#2" in index]
    return np.array(sorted(got), dtype=np.int64)


@dataclass(frozen=True)
class Chain:
    """weights: for each category, a weight for each feature, then one for each earlier category's log-odds, then a bias."""

    categories: tuple[str, ...]
    index: dict[str, int]
    weights: tuple[np.ndarray, ...]

    def probabilities(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """An n x categories array; rows and columns say which feature is in which row."""
        odds = np.zeros((n, 0))
        for w in self.weights:
            odds = np.column_stack([odds, _odds(w, rows, columns, odds)])
        return 1 / (1 + np.exp(-odds))


def _odds(w: np.ndarray, rows: np.ndarray, columns: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    m, n = earlier.shape[1], len(earlier)
    of_text = np.bincount(rows, weights=w[columns], minlength=n)[:n]
    return np.clip(of_text + earlier @ w[len(w) - 1 - m : -1] + w[-1], -30, 30)


def _fit(rows: np.ndarray, columns: np.ndarray, n_features: int, earlier: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 150) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps, each coordinate at its own rate."""
    n, m = len(y), earlier.shape[1]
    w = np.zeros(n_features + m + 1)
    if not n or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else 0.0
        return w
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    size = np.bincount(rows, minlength=n)[:n] + np.abs(earlier).sum(axis=1) + 1
    curve = np.concatenate([np.bincount(columns, weights=size[rows], minlength=n_features), np.abs(earlier).T @ size, [size.sum()]]) / 4
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0
    rate, ahead, t = 1 / (curve + penalty + 1e-9), w.copy(), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-_odds(ahead, rows, columns, earlier))) - y
        slope = np.concatenate([np.bincount(columns, weights=error[rows], minlength=n_features), earlier.T @ error, [error.sum()]])
        new = ahead - rate * (slope + penalty * ahead)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return w


def fit_chain(labels: np.ndarray, folds: np.ndarray, rows: np.ndarray, columns: np.ndarray, index: dict[str, int], categories: Sequence[str]) -> tuple[Chain, np.ndarray]:
    """The chain, and its out-of-fold probabilities for the rows that it learned from. labels: rows x categories of 0 and 1."""
    n, weights = len(labels), []
    unseen = np.zeros((n, 0))
    for c in range(len(categories)):
        y, odds = labels[:, c].astype(float), np.zeros(n)
        for k in range(FOLDS):
            own = folds == k
            place = np.cumsum(~own) - 1
            of = ~own[rows]
            w = _fit(place[rows[of]], columns[of], len(index), unseen[~own], y[~own])
            odds[own] = _odds(w, rows, columns, unseen)[own]
        weights.append(_fit(rows, columns, len(index), unseen, y))
        unseen = np.column_stack([unseen, odds])
    return Chain(tuple(categories), index, tuple(weights)), 1 / (1 + np.exp(-unseen))


def _sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str, text_col: str, rows: int) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull())
    for c in categories:
        known = known.where(F.col(c).isin(0, 1))
    known = known.groupBy(F.col(id_col).alias("id")).agg(*[F.max(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories)])
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.join(F.broadcast(known), "id").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int"))


def _counted(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        total: Counter[str] = Counter()
        of = [Counter() for _ in range(n)]
        for text, *ys in frame[["text", *(f"y{k}" for k in range(n))]].itertuples(index=False):
            found = features(text)
            total.update(found)
            for k, y in enumerate(ys):
                if y:
                    of[k].update(found)
        yield pd.DataFrame({"feature": list(total), "n": list(total.values())} | {f"n{k}": [of[k][f] for f in total] for k in range(n)})


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, keep: int = FEATURES, least: int = 4) -> tuple[Chain, pd.DataFrame]:
    """The chain, and for its sample rows the labels and out-of-fold probabilities.

    labels: id_col and a column of 0 and 1 for each category, in the chain's order; rows with other values are passed over,
    of several for one id the largest counts. About sample_rows of the labelled documents, picked by a hash of their id,
    are learned from. Without labels of both kinds a category's probability is its base rate (a half without any label).
    """
    small_batches(docs.sparkSession)
    m = len(categories)
    sample = stored(_sample(docs, labels, categories, id_col, text_col, sample_rows), "toxicity-sample")
    sizes = sample.agg(F.count("*"), *[F.sum(f"y{k}") for k in range(m)]).first()
    counts = sample.mapInPandas(lambda f: _counted(f, m), "feature string, n long, " + ", ".join(f"n{k} long" for k in range(m)))
    counts = stored(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *(f"n{k}" for k in range(m)))]).where(F.col("n") >= least), "toxicity-counts")
    chosen: set[str] = set()
    for k in range(m):
        if 0 < (sizes[k + 1] or 0) < sizes[0]:
            rate = sizes[k + 1] / sizes[0]
            score = (F.col(f"n{k}") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) * (1 - F.col("n") / (sizes[0] + 1)))
            top = counts.withColumn("z", F.abs(score)).where("z >= 4").where(F.col("n") <= max(COMMON, 2 * rate) * sizes[0] + least).orderBy(F.desc("z"), "feature").limit(keep)
            chosen |= {r[0] for r in top.select("feature").collect()}
    index = {f: k for k, f in enumerate(sorted(chosen))}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def known(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[str, ...]] = {}
        for f in frames:
            yield f.assign(columns=[_known(t, shared.value, cache) for t in f["text"]]).drop(columns="text")

    schema = f"id long, {', '.join(f'y{k} int' for k in range(m))}, fold int, columns array<long>"
    typed = sample.select(F.col("id").cast("long").alias("id"), "text", *(f"y{k}" for k in range(m)), "fold")
    got = typed.mapInPandas(known, schema).toPandas().sort_values("id", kind="stable").reset_index(drop=True)
    rows = np.repeat(np.arange(len(got)), got["columns"].map(len).to_numpy(np.int64)) if len(got) else np.array([], np.int64)
    columns = np.concatenate([np.array([], np.int64), *got["columns"]]).astype(np.int64)
    chain, unseen = fit_chain(got[[f"y{k}" for k in range(m)]].to_numpy(), got["fold"].to_numpy(), rows, columns, index, categories)
    return chain, pd.DataFrame({"id": got["id"]} | {c: got[f"y{k}"] for k, c in enumerate(categories)} | {f"p_{c}": unseen[:, k] for k, c in enumerate(categories)})


def best_limit(unseen: pd.DataFrame, category: str) -> float:
    """The probability from which to reject: between 0.1 and 0.9, the middle of those with the best F1 out of fold.

    A half where the sample has not both kinds of label.
    """
    y, p = unseen[category].to_numpy() == 1, unseen[f"p_{category}"].to_numpy()
    if not len(y) or y.all() or not y.any():
        return 0.5
    limits = np.linspace(0.1, 0.9, 81)
    hit, said = ((p >= x) & y for x in limits), (p >= x for x in limits)
    f1 = np.array([2 * h.sum() / (s.sum() + y.sum()) for h, s in zip(hit, said, strict=True)])
    return float(np.median(limits[f1 >= f1.max() - 1e-9]))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_<category> double for each): the chain's probabilities for every row, whole texts.

    A null or empty text has no features, so that its probabilities are what the biases say. Rows come back as often as
    they came.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(chain)))
    names = [f"p_{c}" for c in chain.categories]

    def make():
        own, cache = Chain(**shared.value), {}

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [_known(t, own.index, cache) for t in texts_of(batch)]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            p = own.probabilities(rows, np.concatenate(found), len(found))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in p.T)], names=["id", *names])

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(arrow_mapper(make), f"id long, {', '.join(f'`{c}` double' for c in names)}").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, chain: Chain, category: str, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose probability of the category is under the limit."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(chain)))
    at, which = docs.columns.index(text_col), chain.categories.index(category)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = Chain(**shared.value), {}
        for batch in batches:
            found = [_known(t, own.index, cache) for t in batch.column(at).to_pylist()]
            if found:
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                p = own.probabilities(rows, np.concatenate(found), len(found))
                yield batch.filter(pa.array(p[:, which] < limit))

    return docs.mapInArrow(clean, docs.schema)
