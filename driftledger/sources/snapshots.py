"""Snapshots, contents, rule files and configuration as inputs of a delta."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.lineage import cut
from ..functions.rules import Rule, parse_rules
from ..operators.trees import ancestors, best_common_ancestors, chains, flatten

SNAPSHOT = "path string, oid string, mode string"
LFS_MAGIC = "version https://git-lfs"


class SourceError(ValueError):
    """An input that can't be used; the message says which and why."""


def blob_oid(content) -> F.Column:
    """The object id of a content: SHA-1 over a header with its length, and the content."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary"), F.lit(b"\x00"), content))


def read_directory(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot, blobs) of the files below a folder of any file system: path relative to it, oid, mode; oid, content.

    The snapshot doesn't hold contents, but computing ids reads them; store it where it is used again.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.expr(f"substring(replace(path, '\\\\', '/'), {len(root) + 2})")
    rows = files.select(relative.alias("path"), blob_oid(F.col("content")).alias("oid"), F.lit("100644").alias("mode"), "content")
    return rows.select("path", "oid", "mode"), rows.select("oid", "content").dropDuplicates(["oid"])


def from_table(rows: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(snapshot, blobs) of a table of files. Separators are made slashes; rows without a path are passed over."""
    bytes_ = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    own = rows.where(F.col(path).isNotNull()).select(F.replace(F.col(path), F.lit("\\"), F.lit("/")).alias("path"), bytes_.alias("content"))
    own = own.select("path", blob_oid(F.col("content")).alias("oid"), F.lit("100644").alias("mode"), "content")
    return own.select("path", "oid", "mode"), own.select("oid", "content").dropDuplicates(["oid"])


def empty_snapshot(spark: SparkSession) -> DataFrame:
    """The snapshot of a revision that isn't known: nothing exists in it."""
    return spark.createDataFrame([], SNAPSHOT)


def scoped(snapshot: DataFrame, scopes: Iterable[str]) -> DataFrame:
    """The part of a snapshot inside the scopes; the filter reaches a stored snapshot's scan."""
    return snapshot.where(P.in_scope(F.col("path"), scopes))


def with_lfs(blobs: DataFrame, objects: DataFrame) -> DataFrame:
    """blobs with each large-file pointer replaced by its object. objects: (sha256, content).

    A pointer without a well-formed id, or to an object that isn't there, stays as it is. Only pointers are shuffled: contents that
    are none stay where they are read, and don't meet in one task for want of an id.
    """
    head = F.substring(F.col("content"), 1, 1024).cast("string")
    pointed = F.when(head.startswith(LFS_MAGIC), F.nullif(F.regexp_extract(head, r"(?m)^oid sha256:([a-f0-9]{64})\s*$", 1), F.lit("")))
    own = objects.select(F.col("sha256").alias("_id"), F.col("content").alias("_object"))
    known = blobs.select("oid", "content", pointed.alias("_id"))
    found = known.where("_id is not null").join(own, "_id", "left").select("oid", F.coalesce("_object", "content").alias("content"))
    return found.unionByName(known.where("_id is null").select("oid", "content"))


def files_with_content(snapshot: DataFrame, blobs: DataFrame, directory: str = ".") -> DataFrame:
    """(path, content) of a snapshot's files below a directory."""
    return snapshot.where(P.in_scope(F.col("path"), [directory])).join(blobs, "oid").select("path", "content")


def read_rules(spark: SparkSession, path: str | None) -> list[Rule]:
    """The rules of a file in gitignore format; none without a path. The file is read on the driver."""
    return [] if path is None else parse_rules("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def api_version(configured: float | None, project_json: str | None, latest: int | None) -> tuple[int, list[str]]:
    """(version, warnings): the configured one, else the project's, else the latest; one above the latest is set to it.

    Without a known latest version a given one is kept, and SourceError says that there is none.
    """
    given = configured
    if given is None and project_json is not None:
        try:
            given = float(json.loads(project_json).get("sourceApiVersion"))
        except (TypeError, ValueError):
            given = None
    if latest is None:
        if given is None:
            raise SourceError("no API version is given and the latest one isn't known")
        return int(given), []
    if given is None:
        return latest, [f"no API version is given, using '{latest}'"]
    if not 0 < given <= latest:
        return latest, [f"API version '{given:g}' is not supported, using '{latest}'"]
    return int(given), []


# --- revisions: commits(id, parents array, tree), refs(name, id), tags(id, target): tag objects, which point at commits or tags


def resolve(refs: DataFrame, commits: DataFrame, name: str, tags: DataFrame | None = None) -> str:
    """The commit that a name or an id stands for; SourceError where there is none. Names that point at names are followed, and
    tag objects peeled to what they point at."""
    hops = refs.select(F.col("name").alias("at"), "id")
    hops = hops if tags is None else hops.unionByName(tags.select(F.col("id").alias("at"), F.col("target").alias("id")))
    asked, seen = name, {name}
    while True:
        got = hops.where(F.col("at") == name).select("id").limit(1).collect()
        if not got:
            break
        name = got[0][0]
        if name in seen:
            raise SourceError(f"{asked!r} points at itself")
        seen.add(name)
    if commits.where(F.col("id") == name).isEmpty():
        raise SourceError(f"{asked!r} is no known revision")
    return name


def root_tree(commits: DataFrame, commit: str) -> str:
    """The id of a commit's tree."""
    return commits.where(F.col("id") == commit).select("tree").first()[0]


def checkout(commits: DataFrame, trees: DataFrame, commit: str) -> DataFrame:
    """The snapshot (path, oid, mode) of a commit. trees: (tree_oid, name, mode, child_oid)."""
    return cut(flatten(trees, root_tree(commits, commit)))


def history(commits: DataFrame, start: str) -> DataFrame:
    """(id, depth): the commits that a commit descends from, itself at depth 0, each at its least depth. A frontier of
    parents is followed a generation at a time, until none is new; each generation is kept in the shared folder."""
    spark = commits.sparkSession
    known = frontier = spark.createDataFrame([(start, 0)], "id string, depth int")
    edges, generations = cut(commits.select("id", F.explode("parents").alias("parent")).distinct()), 0
    while True:
        generations += 1
        parents = edges.join(frontier.select("id"), "id").select(F.col("parent").alias("id")).distinct().join(known, "id", "left_anti")
        frontier = cut(parents.withColumn("depth", F.lit(generations)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
        if generations % 16 == 0:  # a plan of one scan again
            known = cut(known)


def first_commit(commits: DataFrame, start: str) -> str:
    """The commit without parents that start descends from; of several the least by id."""
    from_start = ancestors(chains(commits), commits.sparkSession.createDataFrame([(start,)], "id string"))
    roots = from_start.join(commits.where(F.size(F.coalesce("parents", F.array())) == 0), "id", "left_semi")
    return roots.agg(F.min("id")).first()[0]


def merge_base(commits: DataFrame, one: str, other: str) -> str | None:
    """A best common ancestor of two commits, from which no other common one descends; of several, as criss-cross histories
    have, the least by id, and None where the two have none."""
    return best_common_ancestors(commits, one, other).agg(F.min("id")).first()[0]
