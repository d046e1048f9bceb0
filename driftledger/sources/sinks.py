"""What a delta writes: manifests, the review file, the result."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.xmltree import ENTITIES
from ..operators.changeset import manifest_order

#: Fixed values of the manifest format.
PACKAGE_ROOT = ("Package", {"xmlns": "http://soap.sforce.com/2006/04/metadata"})
PACKAGE_FILE = "package/package.xml"
DESTRUCTIVE_FILE = "destructiveChanges/destructiveChanges.xml"
EMPTY_PACKAGE_FILE = "destructiveChanges/package.xml"
MESSAGES = {
    "malformed_xml": "'{0}' could not be processed, as it isn't well-formed XML in both revisions",
    "flow_deleted": "deleting the flow '{0}' by a destructive manifest may not work",
    "bundle_deletion": "deleting the bundle '{0}' needs its site to be deactivated first",
    "nothing_in_scope": "nothing changed under '{0}'",
    "collector_failed": "not everything could be collected: {0}",
}


def write_sorted(rows: DataFrame, order: list[Column | str], output: str, name: str, head: str, tail: str) -> None:
    """Write output/name below a folder of any file system: head, the column text of all rows in that order, a line each, and
    tail.

    A range sort deals the rows; tasks write their ranges, and the parts are joined by the store where it can (concat), else by
    copying their bytes, so that no row comes to the driver. The file appears whole: it is made beside its place and moved.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda text: jvm.org.apache.hadoop.fs.Path(text)
    place, staged = path(f"{output.rstrip('/')}/{name}"), f"{output.rstrip('/')}/.{uuid.uuid4().hex}"
    rows.orderBy(*order).select("text").write.option("lineSep", "\n").text(f"{staged}/rows")
    fs = place.getFileSystem(conf)
    try:
        listed = sorted((s.getPath().getName() for s in fs.listStatus(path(f"{staged}/rows"))), key=lambda n: (n.split("-")[1].zfill(9), n) if n.startswith("part-") else ("", n))
        parts = [path(f"{staged}/rows/{n}") for n in listed if n.startswith("part-")]
        for text, at in ((head, "head"), (tail, "tail")):
            out = fs.create(path(f"{staged}/{at}"), True)
            out.write(bytearray(text.encode()))
            out.close()
        whole, parts = path(f"{staged}/head"), [*parts, path(f"{staged}/tail")]
        listing = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
        for k, part in enumerate(parts):
            listing[k] = part
        try:
            fs.concat(whole, listing)
        except UnsupportedOperationException:
            whole = path(f"{staged}/whole")
            out = fs.create(whole, True)
            for part in [path(f"{staged}/head"), *parts]:
                source = fs.open(part)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                source.close()
            out.close()
        fs.mkdirs(place.getParent())
        fs.delete(place, False)
        fs.rename(whole, place)
    finally:
        fs.delete(path(staged), True)


def _within(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """rows with first and last: whether no row of equal keys has a lower, or a higher, place. Tasks combine the bounds of their
    rows, and only these are shuffled by key."""
    placed = rows.withColumn("_place", place)
    bounds = placed.groupBy(*keys).agg(F.min("_place").alias("_low"), F.max("_place").alias("_high"))
    return placed.join(bounds, keys).withColumn("first", F.col("_place") == F.col("_low")).withColumn("last", F.col("_place") == F.col("_high")).drop("_place", "_low", "_high")


def _escaped(text: Column) -> Column:
    for char, entity in ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def write_manifest(view: DataFrame | None, api_version: int, output: str, name: str) -> None:
    """Write a view, (type, member), as a manifest, in parallel; None is an empty one."""
    (root, attributes) = PACKAGE_ROOT
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}{"".join(f' {k}="{v}"' for k, v in attributes.items())}>\n'
    tail = f"    <version>{api_version}.0</version>\n</{root}>"
    if view is None:
        return write_text(output, name, head + tail)
    order = manifest_order()
    rows = _within(view.select("type", "member").distinct(), ["type"], F.struct(order[-2].alias("a"), F.col("member").alias("b")))
    lines = F.array(
        F.when(F.col("first"), F.lit("    <types>")),
        F.concat(F.lit("        <members>"), _escaped(F.col("member")), F.lit("</members>")),
        F.when(F.col("last"), F.concat(F.lit("        <name>"), _escaped(F.col("type")), F.lit("</name>"))),
        F.when(F.col("last"), F.lit("    </types>")),
    )
    write_sorted(rows.withColumn("text", F.array_join(lines, "\n")), order, output, name, head, tail)
    return None


def json_string(text: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    named = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    for char, escape in (named | {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in named}).items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), text, F.lit('"'))


def write_review(kinds: DataFrame, output: str, name: str = "changes.json") -> None:
    """Write the view by kind, (kind, type, member, to_member), in parallel as an object of kinds, these of types: types and
    members in order of their UTF-16 code units, renames, objects of from and to, in order of what they lead to."""
    every, units = ("add", "modify", "delete", "rename"), lambda c: F.encode(c, "UTF-16BE")
    renamed = F.col("kind") == "rename"
    own = kinds.select("kind", "type", "member", "to_member").distinct()
    own = own.select("*", units(F.col("type")).alias("t"), F.when(renamed, F.encode("to_member", "UTF-8")).otherwise(units(F.col("member"))).alias("a"), F.when(renamed, F.col("member")).otherwise(F.lit("")).alias("b"))
    of_type = _within(own, ["kind", "type"], F.struct("a", "b")).withColumnsRenamed({"first": "opens_type", "last": "ends_type"})
    rows = _within(of_type, ["kind"], F.struct("t", "a", "b")).withColumnsRenamed({"first": "opens", "last": "ends"})
    entry = F.when(renamed, F.concat(F.lit('      {\n        "from": '), json_string(F.col("member")), F.lit(',\n        "to": '), json_string(F.col("to_member")), F.lit("\n      }"))).otherwise(F.concat(F.lit("      "), json_string(F.col("member"))))
    comma = lambda last: F.when(last, F.lit("")).otherwise(F.lit(","))
    lines = F.array(
        F.when(F.col("opens"), F.concat(F.lit('  "'), F.col("kind"), F.lit('": {'))),
        F.when(F.col("opens_type"), F.concat(F.lit("    "), json_string(F.col("type")), F.lit(": ["))),
        F.concat(entry, comma(F.col("ends_type"))),
        F.when(F.col("ends_type"), F.concat(F.lit("    ]"), comma(F.col("ends")))),
        F.when(F.col("ends"), F.concat(F.lit("  }"), comma(renamed))),
    )
    rank = F.array_position(F.array(*map(F.lit, every)), F.col("kind"))
    rows = rows.select(rank.alias("k"), "t", "a", "b", F.array_join(lines, "\n").alias("text"))
    met = {r.kind for r in own.select("kind").distinct().collect()}
    none = [(every.index(k) + 1, f'  "{k}": {{}}' + ("," if k != every[-1] else "")) for k in every if k not in met]
    if none:
        rows = rows.unionByName(rows.sparkSession.createDataFrame(none, "k int, text string").select(F.col("k").cast("long").alias("k"), "text"), allowMissingColumns=True)
    write_sorted(rows, ["k", "t", "a", "b"], output, name, "{\n", "}")


def sanitised(text: str, most: int = 200) -> str:
    r"""A message's argument: at most so many code points, with backslashes, control and format characters and line
    separators as \u{hex}."""
    odd = lambda c: c == "\\" or unicodedata.category(c) in ("Cc", "Cf") or c in "  "
    return "".join(f"\\u{{{ord(c):x}}}" if odd(c) else c for c in text[:most])


def messages(warnings: DataFrame) -> list[str]:
    """The texts of warnings, (code, subject), in order."""
    return [MESSAGES[code].format(sanitised(subject)) for code, subject in sorted(map(tuple, warnings.select("code", "subject").distinct().collect()))]


def write_text(output: str, name: str, text: str) -> None:
    """Write a small text below an output folder of any file system, from the driver."""
    spark = SparkSession.active()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{output.rstrip('/')}/{name}")
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def result_json(output: str, warnings: Iterable[str] = (), error: str | None = None) -> str:
    """What a command prints: where the output is, and what went wrong."""
    out: dict[str, Any] = {"output-dir": re.sub(r"/+$", "", output)}
    if error is not None:
        out["error"] = error
    if kept := list(warnings):
        out["warnings"] = kept
    return json.dumps(out)
