"""The corpus pipeline: five operators in turn over documents.

Toxic documents go; of each group of near-duplicates one stays; documents with benchmark passages go; secrets are masked;
what is left gets the number of copies with which its sources meet their target weights. Decisions are about rows, not ids: rows
without an id or with that of another are judged by their own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.llm import decontam, mixing, secrets, simhash, toxicity
from driftledger.llm.common import read, stored, with_row_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Keys of rows to drop are broadcast up to so many; beyond, a shuffle joins them.
BROADCAST_KEYS = 1_000_000
#: The column that tells rows apart while a stage decides about them; no column of documents may have its name.
KEY = "row_key_of_stage"


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of keyed but those with these keys (stored), without their key."""
    return keyed.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, KEY, "left_anti").drop(KEY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels of these documents, finds toxic go."""
    labels = read(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    chain, unseen = toxicity.train(docs, labels, ("low_quality", "toxic"))
    return toxicity.keep_clean(docs, chain, "toxic", toxicity.best_limit(unseen, "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: that with the smallest id, a null one last; of several with that id, any one."""
    keyed = with_row_key(docs, KEY)
    found = stored(simhash.near_duplicates(keyed.select(KEY, "text"), KEY), "near-duplicates")
    groups = found.groupBy(F.col("component_id").alias("group")).count().where("count > 1").select("group")
    members = found.join(groups, F.col("component_id") == F.col("group"), "left_semi").join(keyed.select(KEY, "doc_id"), KEY)
    first = members.groupBy(F.col("component_id").alias("group")).agg(F.min_by(KEY, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY))).alias("first"))
    dropped = members.join(first, F.col("component_id") == F.col("group")).where(F.col(KEY) != F.col("first")).select(KEY)
    return _without(keyed, stored(dropped, "near-duplicate-rows"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in 13-word windows of the benchmark go."""
    keyed = with_row_key(docs, KEY)
    matches = decontam.benchmark_matches(keyed.select(KEY, "text"), read(spark, sf_dir, "benchmark"), id_col=KEY, slack=0)
    return _without(keyed, stored(decontam.contamination(matches).where("contaminated").select(KEY), "contaminated-rows"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and n_chars counts the new text."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its source's weight and the number of copies that the mixture draws of it, one at least."""
    return mixing.mixture(docs, budget="cover").drawn(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: None: SQL expresses neither the trained chain nor the fingerprints.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read back as the next one's."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
