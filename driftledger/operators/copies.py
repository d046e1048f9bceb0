"""Which files a delta copies, each once, and how they are written."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.rules import Rule, ignored

#: The order in which copies to one path win: what was computed before what is read.
KINDS = ("computed", "file", "directory")


def first_copies(copies: DataFrame) -> DataFrame:
    """Of the copies (path, kind, seq, ...) to one path the computed one, else the first by seq."""
    rank = F.when(F.col("kind") == "computed", 0).otherwise(1)
    return copies.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(rank, "seq"))).where("_r = 1").drop("_r")


def expand_directories(copies: DataFrame, snapshot: DataFrame) -> DataFrame:
    """copies with each directory replaced by the files below it: one join on the directories above the snapshot's files."""
    from ..functions.paths import ancestors

    folders = copies.where("kind = 'directory'").select(F.col("path").alias("_dir"), *[c for c in copies.columns if c not in ("path", "kind")])
    below = snapshot.select("path", F.explode(ancestors(F.col("path"))).alias("_dir"))
    files = below.join(folders, "_dir").drop("_dir").withColumn("kind", F.lit("file"))
    return copies.where("kind <> 'directory'").unionByName(files.select(*copies.columns))


def with_content(copies: DataFrame, snapshot: DataFrame, blobs: DataFrame) -> DataFrame:
    """copies with content, joined by object id for files only; a file that the snapshot hasn't is passed over."""
    files = copies.where("kind = 'file'").drop("content").join(snapshot.select("path", "oid"), "path").join(blobs, "oid").drop("oid")
    computed = copies.where("kind = 'computed'")
    return files.select("path", "content").unionByName(computed.select("path", F.col("content").cast("binary").alias("content"))) if "content" in copies.columns else files.select("path", "content")


def kept_copies(copies: DataFrame, rules: list[Rule]) -> DataFrame:
    """copies without those that the rules for additions ignore."""
    return copies.where(~ignored(F.col("path"), rules))


def inside(root: str, path: str) -> str:
    """The place of path below root; ValueError where that isn't strictly below it."""
    place = posixpath.normpath(posixpath.join("/", path))[1:]
    if path.startswith("/") or not place or posixpath.normpath(path).startswith("../") or posixpath.normpath(path) == "..":
        raise ValueError(f"{path!r} leaves the output folder")
    return f"{root.rstrip('/')}/{place}"


def write_files(copies: DataFrame, output: str) -> None:
    """Write each row's content at output/path, from the tasks that hold them; output is a folder of a store that Arrow opens
    (a path or file: URI is a folder that all machines mount).

    A file appears whole: it is written beside its place and moved. Written again after a lost task, it is the same.
    """
    uri = output if "://" in output or output.startswith("file:") else posixpath.abspath(output)

    def write(rows: Iterator[Row]) -> None:
        files, root = FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))
        for row in rows:
            place = inside(root, row["path"])
            files.create_dir(posixpath.dirname(place), recursive=True)
            draft = f"{place}.{uuid.uuid4().hex}.tmp"
            with files.open_output_stream(draft) as f:
                f.write(row["content"] or b"")
            files.move(draft, place)

    copies.select("path", F.col("content").cast("binary").alias("content")).foreachPartition(write)
