"""Questions of existence and content: semi and anti joins over snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def grep(rows: DataFrame, content: Column, needles: Sequence[str]) -> DataFrame:
    """The rows whose content holds one of the strings."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(content, F.lit(needle))
    return rows.where(found)


def existing_paths(snapshot: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(_path): every path of a snapshot and every directory above one, once; given asked (_path), of these only."""
    every = snapshot.select(F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))).alias("_path"))
    return (every if asked is None else every.join(asked, "_path", "left_semi")).distinct()


def with_existence(rows: DataFrame, snapshot: DataFrame, path: str, name: str = "exists") -> DataFrame:
    """rows with whether the snapshot has the row's path, as a file or as a directory with something in it. The snapshot's
    directories meet the asked paths before they are made distinct; what is found is shuffled to the rows, as its size is only known
    by its compressed files'."""
    asked = rows.select(F.col(path).alias("_path")).where("_path is not null").distinct()
    there = existing_paths(snapshot, asked).withColumn("_there", F.lit(True)).hint("merge")
    return rows.join(there, rows[path] == there["_path"], "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_path", "_there")


def deletion_target(gone: DataFrame, rest: DataFrame, key: Sequence[str]) -> DataFrame:
    """gone with `target`: package where something of the key is left (it is sent again), else destructive."""
    left = rest.select(*key).distinct().withColumn("_left", F.lit(True))
    return gone.join(left, list(key), "left").withColumn("target", F.when(F.col("_left"), "package").otherwise("destructive")).drop("_left")


def files_under(snapshot: DataFrame, directory: str) -> DataFrame:
    """The rows of a snapshot below a directory; all of them for the root."""
    return snapshot.where(P.in_scope(F.col("path"), [directory]) & (F.col("path") != directory))


def component_names(snapshot: DataFrame, suffix_of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, type_dir, name): the components that a snapshot's files `<name>.<suffix>-meta.xml` name in each type directory.

    suffix_of: (directory_name, suffix), small. A file counts for each type directory above it. by: columns that tell
    snapshots apart.
    """
    files = snapshot.where(F.col("path").endswith(P.META_SUFFIX)).select(*by, P.parts(F.col("path")).alias("p"), P.without_meta(P.base_name(F.col("path"))).alias("file"))
    at = files.select(*by, "p", "file", F.posexplode("p").alias("i", "directory_name")).join(F.broadcast(suffix_of), "directory_name")
    at = at.where(F.col("file").endswith(F.concat(F.lit("."), F.col("suffix"))))
    name = F.expr("substring(file, 1, length(file) - length(suffix) - 1)")
    return at.select(*by, F.array_join(F.slice("p", F.lit(1), F.col("i") + 1), "/").alias("type_dir"), name.alias("name")).distinct()


def innermost_component(rows: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows (by, path, type_dir, ...) with `component`: the innermost directory between type_dir and the file that is a name
    there, else the file's name without its extension. names: (by, type_dir, name)."""
    depth = F.size(P.parts(F.col("type_dir")))
    segments = rows.select(*by, "path", "type_dir").distinct().select(*by, "path", "type_dir", F.posexplode(F.slice(P.parts(F.col("path")), F.lit(1), F.size(P.parts(F.col("path"))) - 1)).alias("i", "name")).where(F.col("i") >= depth)
    hits = segments.join(names, [*by, "type_dir", "name"]).groupBy(*by, "path", "type_dir").agg(F.max_by("name", "i").alias("_found"))
    return rows.join(hits, [*by, "path", "type_dir"], "left").withColumn("component", F.coalesce("_found", P.stem(P.base_name(F.col("path"))))).drop("_found")


def referring(rows: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """The rows whose name is among the names."""
    return rows.join(names.select(name).distinct(), name, "left_semi")


def merged(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """existing, then what new has of other keys, with `existing` saying which; existing rows win."""
    more = new.join(existing.select(*key).distinct(), list(key), "left_anti")
    return existing.withColumn("existing", F.lit(True)).unionByName(more.withColumn("existing", F.lit(False)))
