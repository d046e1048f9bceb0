"""Mixing sources to target weights: temperature, then whole passes and a budgeted part of one over permuted blocks.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is found by narrowing a
bracket: each round evaluates the target for a row of exponents in one aggregation over the sources, so that nothing but
those few sums comes to the driver, however many sources there are.

A weight is realised in tokens: the budget times the weight is so many whole passes over the source and a rest. Documents
lie in blocks by a hash; the blocks of a pass are visited in a permutation of its own, and the pass that the budget cuts
short takes whole blocks while they fit and, of the block where it ends, documents while they fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: A table of sources, blocks or documents is broadcast up to so many rows; beyond, a shuffle joins it.
BROADCAST_ROWS = 200_000
MAX_BLOCKS = 65_536
#: Exponents tried in each round, and rounds.
_GRID, _ROUNDS = 33, 7
_SLACK = 1e-9


def word_count(text: Column) -> Column:
    """The number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: the sum of share ** e, the same weighted by log(share), the largest share ** (e - 1)."""
    p = F.col("share")
    cells = [f(e) for e in exponents for f in (lambda e: F.sum(F.pow(p, F.lit(e))), lambda e: F.sum(F.pow(p, F.lit(e)) * F.log(p)), lambda e: F.max(F.pow(p, F.lit(e - 1))))]
    got = shares.agg(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).first()
    return [tuple(got[3 * k : 3 * k + 3]) for k in range(len(exponents))]


def _last(shares: DataFrame, low: float, high: float, holds) -> float:
    """The exponent where holds(exponent, sums), true at low and false beyond some point, ceases to hold; high if never."""
    for _ in range(_ROUNDS):
        grid = [low + (high - low) * k / (_GRID - 1) for k in range(_GRID)]
        good = [holds(e, s) for e, s in zip(grid, _sums(shares, grid), strict=True)]
        k = good.index(False) if False in good else _GRID
        if k == _GRID:
            return high
        if k == 0:
            return low
        low, high = grid[k - 1], grid[k]
    return low


def exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float | None) -> float:
    """The largest exponent up to 1 whose weights have the target entropy (a share of the most possible) at least, made
    larger where a source would else be repeated over max_repeats times. shares: a row (share > 0) per source.

    budget_share: the budget as a multiple of all tokens; None: what makes the least repeated source pass once.
    """
    n = shares.count()
    if n < 2:
        return 1.0

    def entropy(e: float, s: tuple[float, float, float]) -> float:
        return (math.log(s[0]) - e * s[1] / s[0]) / math.log(n)

    found = 1.0
    if target_entropy is not None:
        found = _last(shares, 0.0, 1.0, lambda e, s: entropy(e, s) >= min(target_entropy, 1.0) - 1e-12)
    if max_repeats is not None and found < 1:
        largest = shares.agg(F.max("share")).first()[0]

        def repeats(e: float, s: tuple[float, float, float]) -> float:
            return s[2] / largest ** (e - 1) if budget_share is None else budget_share * s[2] / s[0]

        if repeats(found, _sums(shares, [found])[0]) > max_repeats * (1 + _SLACK):
            # the mirror image: repetition falls as the exponent grows towards 1
            low, high = found, 1.0
            for _ in range(_ROUNDS):
                grid = [low + (high - low) * k / (_GRID - 1) for k in range(_GRID)]
                good = [repeats(e, s) <= max_repeats * (1 + _SLACK) for e, s in zip(grid, _sums(shares, grid), strict=True)]
                k = good.index(True) if True in good else _GRID - 1
                low, high = grid[max(0, k - 1)], grid[k]
            found = high
    return found


@dataclass(frozen=True)
class Mixture:
    """What decides how often a document is drawn. sources: key, weight, passes, blocks; whole: the (key, block) that the
    cut pass takes whole; fits: the (key, id) that it takes of the blocks where it ends."""

    sources: DataFrame
    whole: DataFrame
    fits: DataFrame
    seed: int

    def drawn(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
        """docs with weight and n_copies, in place of columns of that name. The three tables are broadcast while small, so that
        no document is shuffled."""
        key, names = _source_key(source_col), [c for c in docs.columns if c not in ("weight", "n_copies")]
        out = docs.select(*names, key.alias("_key")).join(_checked(self.sources.withColumnRenamed("key", "_key")), "_key")
        out = out.withColumn("_block", F.pmod(F.xxhash64(F.lit(self.seed), F.col(id_col).cast("long")), F.col("_blocks")))
        whole = self.whole.select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.lit(1).alias("_whole"))
        fits = self.fits.select(F.col("key").alias("_key"), F.col("id").alias("_id"), F.lit(1).alias("_fits"))
        out = out.withColumn("_id", F.col(id_col).cast("long")).join(_checked(whole), ["_key", "_block"], "left").join(_checked(fits), ["_key", "_id"], "left")
        copies = (F.col("_passes") + F.coalesce("_whole", "_fits", F.lit(0))).cast("long")
        return out.select(*names, F.col("_weight").alias("weight"), copies.alias("n_copies"))


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))


def _checked(table: DataFrame) -> DataFrame:
    """The stored table, to be broadcast if it has few rows; a shuffle joins it otherwise."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mixture(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, target_entropy: float | None = 0.97,
    max_repeats: float | None = 4.0, budget: float | str = 1.0, block_tokens: int = 1_000_000, seed: int = 7,
) -> Mixture:
    """Weights, and what the budget buys of each source.

    tokens: a document's size, by default the words of its text. budget: tokens to draw as a multiple of all tokens, or
    "cover": the least with which every document is drawn once at least. A source's copies have its weight of the budget in
    tokens, less the document that no longer fits. Null is a source like any other; null and empty texts have no tokens; a
    source without tokens has the weight 0 and is not drawn, unless the budget is "cover". Repeated rows count each; where a
    pass is cut inside a block they go in together, and rows without an id stay out.
    """
    size = word_count(F.col("text")) if tokens is None else tokens
    each = stored(docs.select(F.col(id_col).cast("long").alias("id"), _source_key(source_col).alias("key"), size.alias("n")), "mix-documents")
    sources = stored(each.groupBy("key").agg(F.sum("n").alias("tokens")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(max(total, 1)))
    e = exponent(shares, target_entropy, max_repeats, None if budget == "cover" else float(budget))
    raw = shares.withColumn("raw", F.pow("share", F.lit(e)))
    weights = raw.withColumn("weight", F.col("raw") / F.lit(raw.agg(F.sum("raw")).first()[0] or 1.0)).select("key", "weight")
    of_source = sources.join(weights, "key", "left").na.fill(0.0, ["weight"])
    if budget == "cover":
        bought = of_source.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    else:
        bought = total * float(budget)
    share = F.col("weight") * F.lit(float(bought))
    passes = F.when(F.col("tokens") > 0, F.floor(share / F.col("tokens") + _SLACK)).otherwise(F.lit(int(budget == "cover")))
    rest = F.when(F.col("tokens") > 0, F.greatest(F.lit(0), F.floor(share - F.col("passes") * F.col("tokens") + 1e-6))).otherwise(F.lit(0))
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)))
    of_source = of_source.withColumn("passes", passes.cast("long")).withColumn("rest", rest.cast("long")).withColumn("blocks", blocks.cast("long"))
    of_source = stored(of_source, "mix-weights")
    placed = each.join(_checked(of_source.drop("tokens")), "key").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks")))
    turn = F.xxhash64(F.lit(seed), F.col("key"), F.col("passes"), F.col("block"))
    upto = F.sum("tokens").over(W.partitionBy("key").orderBy(turn, "block"))
    block = placed.groupBy("key", "block", "passes", "rest").agg(F.sum("n").alias("tokens"))
    block = block.withColumn("room", F.col("rest") - upto + F.col("tokens")).where("room > 0 or (room = 0 and tokens = 0)")
    block = stored(block.select("key", "block", "room", F.expr("room >= tokens").alias("whole")), "mix-blocks")
    cut = placed.where("id is not null").join(_checked(block.where("not whole")), ["key", "block"])
    cut = cut.groupBy("key", "id", "room", "passes").agg(F.sum("n").alias("n"))
    within = W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "passes", "id"), "id")
    fits = cut.withColumn("sum", F.sum("n").over(within)).where("sum <= room").select("key", "id")
    of_source = of_source.select("key", *(F.col(c).alias(f"_{c}") for c in ("weight", "passes", "blocks")))
    return Mixture(of_source, block.where("whole").select("key", "block"), stored(fits, "mix-fits"), seed)
