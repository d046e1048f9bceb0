"""A folder of files as a Spark data source that plans its own partitions and takes filters on the path.

A bound on the path (as a scope is one) reaches the planner and the tasks, and neither lists a directory outside of it. The planner
lists directories from the top until there are enough to deal; a task walks those that it was dealt and reads their files in
batches of bounded size.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from ..functions.paths import canonical_scopes, in_scope

NAME = "driftledger_files"
#: Directories that the planner looks for before it deals them, and bytes of a batch of files.
LEAST_DIRECTORIES, BATCH_BYTES = 64, 8 << 20
_LAST = "\U0010ffff"


@dataclass
class Bounds:
    """low <= path <= high, by code points."""

    low: str = ""
    high: str = _LAST

    def narrowed(self, low: str = "", high: str = _LAST) -> Bounds:
        return Bounds(max(self.low, low), min(self.high, high))

    def has(self, path: str) -> bool:
        return self.low <= path <= self.high

    def meets(self, directory: str) -> bool:
        """Whether a path below the directory may be within."""
        return not directory or (directory + "/" <= self.high and directory + "/" + _LAST >= self.low)


@dataclass
class Subtree(InputPartition):
    """Directories relative to the root, each with whether what lies below its own files belongs to it."""

    directories: list[tuple[str, bool]]


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.content = options["path"], options.get("content", "true") == "true"
        self.parts, self.bounds = int(options.get("parts", LEAST_DIRECTORIES)), Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take bounds of the path. What bounds don't say in full, such as strict ones, Spark filters again."""
        self.bounds = Bounds()
        for f in filters:
            own = getattr(f, "attribute", None) == ("path",)
            value = getattr(f, "value", None)
            if own and isinstance(f, EqualTo):
                self.bounds = self.bounds.narrowed(value, value)
                continue
            if own and isinstance(f, GreaterThanOrEqual):
                self.bounds = self.bounds.narrowed(low=value)
                continue
            if own and isinstance(f, LessThanOrEqual):
                self.bounds = self.bounds.narrowed(high=value)
                continue
            if own and isinstance(f, StringStartsWith):
                self.bounds = self.bounds.narrowed(value, value + _LAST)
            elif own and isinstance(f, In) and value:
                self.bounds = self.bounds.narrowed(min(value), max(value))
            elif own and isinstance(f, GreaterThan):
                self.bounds = self.bounds.narrowed(low=value)
            elif own and isinstance(f, LessThan):
                self.bounds = self.bounds.narrowed(high=value)
            yield f

    def _store(self) -> tuple[FileSystem, str, bool]:
        store, base = FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else os.path.abspath(self.root))
        return store, base.rstrip("/"), store.type_name == "local"

    def _listed(self, store: FileSystem, base: str, directory: str) -> tuple[list[str], list[str]]:
        """(directories, files) of a directory within the bounds, as paths relative to the root; links are files."""
        folders, files = [], []
        for info in store.get_file_info(FileSelector(f"{base}/{directory}".rstrip("/"))):
            path = f"{directory}/{info.base_name}" if directory else info.base_name
            link = store.type_name == "local" and os.path.islink(info.path)
            if info.type == FileType.Directory and not link:
                folders += [path] * self.bounds.meets(path)
            elif self.bounds.has(path):
                files.append(path)
        return sorted(folders), sorted(files)

    def partitions(self) -> list[InputPartition]:
        store, base, _ = self._store()
        flat, open_ = [], [""]
        while open_ and len(flat) + len(open_) < self.parts:
            deeper = [(d, self._listed(store, base, d)[0]) for d in open_]
            flat += [d for d, _ in deeper]
            open_ = [f for _, folders in deeper for f in folders]
        dealt = [(d, False) for d in flat] + [(d, True) for d in open_]
        n = max(1, min(self.parts, len(dealt)))
        return [Subtree(dealt[k::n]) for k in range(n)]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        store, base, local = self._store()
        rows: list[tuple] = []
        held, stack = 0, list(reversed(partition.directories))
        while stack:
            directory, deep = stack.pop()
            folders, files = self._listed(store, base, directory)
            if deep:
                stack += [(f, True) for f in reversed(folders)]
            for path in files:
                mode, content = "100644", None
                if local:
                    kind = os.lstat(f"{base}/{path}").st_mode
                    mode = "120000" if stat.S_ISLNK(kind) else "100755" if kind & stat.S_IXUSR else mode
                    content = os.readlink(f"{base}/{path}").encode() if stat.S_ISLNK(kind) else None
                if content is None:
                    with store.open_input_stream(f"{base}/{path}") as source:
                        content = source.read()
                oid = hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()
                rows.append((path, oid, mode, content if self.content else None))
                held += len(content) if self.content else 100
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "oid", "mode", "content"])


class FileTree(DataSource):
    """Options: path, the folder, of a store that Arrow opens; content, false for ids alone; parts, how many partitions at most."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, oid string, mode string, content binary"

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(dict(self.options))


def read_tree(spark: SparkSession, folder: str, scopes: Iterable[str] = (), content: bool = True) -> DataFrame:
    """(path, oid, mode, content) of the files below a folder, in the scopes (all without any): a read for each scope, whose bounds
    on the path are pushed into the source. Modes and links are those of a local folder; other stores have plain files.

    Turns spark.sql.python.filterPushdown.enabled on for the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
    load = lambda: spark.read.format(NAME).option("content", str(content).lower()).load(folder)
    wanted = [s for s in canonical_scopes(list(scopes)) if s != "."]
    if not wanted or "." in canonical_scopes(list(scopes)):
        return load()
    # of the paths between a scope and what follows those below it, Spark takes those in the scope
    each = [load().where((F.col("path") >= s) & (F.col("path") < s + "0")).where(in_scope(F.col("path"), [s])) for s in wanted]
    return reduce(DataFrame.unionByName, each)
