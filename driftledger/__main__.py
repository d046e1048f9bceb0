"""The delta between two folders from the command line: `python -m driftledger --from A --to B --registry types.json --output OUT`."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

from .operators.registry import Registry, from_json
from .plans.engine import Options, delta
from .sources.sinks import result_json
from .functions.lineage import cut
from .sources.filetree import read_tree
from .sources.snapshots import read_directory, read_rules


def options_of(argv: Sequence[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="driftledger", description=__doc__)
    p.add_argument("--from", dest="old", required=True, help="folder of the old snapshot")
    p.add_argument("--to", dest="new", required=True, help="folder of the new snapshot")
    p.add_argument("--first", help="folder of the first snapshot, for forced includes")
    p.add_argument("--output", default="./output")
    p.add_argument("--registry", required=True, help="JSON file with a list of types")
    p.add_argument("--source", action="append", default=[], help="a scope; may be given several times")
    for name in ("ignore", "ignore-destructive", "include", "include-destructive"):
        p.add_argument(f"--{name}", help="file of rules")
    p.add_argument("--renames", action="store_true")
    p.add_argument("--ignore-whitespace", action="store_true")
    p.add_argument("--generate-delta", action="store_true", help="copy the changed files too")
    p.add_argument("--changes-manifest", action="store_true", help="write the review file too")
    p.add_argument("--api-version", type=int, default=60)
    return p.parse_args(argv)


def folder_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot, blobs) of a folder: by the data source, with modes, links and empty files, where Arrow opens the store; else
    by Spark's own reader, which passes over empty files."""
    try:
        FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    except (pa.ArrowInvalid, OSError):
        return read_directory(spark, folder)
    rows = cut(read_tree(spark, folder))
    return rows.select("path", "oid", "mode"), rows.select("oid", "content").dropDuplicates(["oid"])


def main(argv: Sequence[str] | None = None) -> int:
    """Write the delta and print where it is; 1, and the error in what is printed, where that fails."""
    args = options_of(argv)
    spark = SparkSession.builder.appName("driftledger").getOrCreate()
    try:
        types = from_json(json.loads("\n".join(r[0] for r in spark.read.text(args.registry, wholetext=True).collect())))
        read = lambda folder: folder_files(spark, folder)
        (old, a), (new, b) = read(args.old), read(args.new)
        blobs, first = a.unionByName(b), None
        if args.first:
            first, more = read(args.first)
            blobs = blobs.unionByName(more)
        rules = lambda path: read_rules(spark, path)
        options = Options(
            scopes=args.source or ["."], ignore=rules(args.ignore), ignore_destructive=rules(args.ignore_destructive) if args.ignore_destructive else None,
            include=rules(args.include), include_destructive=rules(args.include_destructive), renames=args.renames,
            ignore_whitespace=args.ignore_whitespace, generate_delta=args.generate_delta, api_version=args.api_version,
        )
        blobs = blobs.dropDuplicates(["oid"])
        result = delta(old, new, Registry.of(spark, types), options, blobs, first)
        kept = (new, blobs) if args.generate_delta else (None, None)
        print(result_json(args.output, result.write(args.output, args.changes_manifest, *kept)))
        return 0
    except ValueError as e:
        print(result_json(args.output, error=str(e)))
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
