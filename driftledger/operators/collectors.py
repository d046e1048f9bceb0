"""What is collected beside the changes: forced includes, translations of flows, scopes that matched nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths as P
from ..functions.rules import Rule, ignored, parse_rule
from ..functions.xmltree import children_of, rendered_documents
from .changeset import PACKAGE
from .existence import merged, referring

#: Fixed values of translation files.
FLOW_KEY, TRANSLATION_SUFFIX = "flowDefinitions", ".translation-meta.xml"
NEW_ROOT = {"name": "Translations", "attributes": {"@_xmlns": "http://soap.sforce.com/2006/04/metadata"}}


def included(snapshot: DataFrame, rules: list[Rule], destructive: list[Rule], scopes: list[str] | None = None) -> DataFrame:
    """(status, path): the files that the rules name as additions, and those that the destructive ones name as deletions,
    whether or not they changed. A file may be both."""
    files = snapshot if scopes is None else snapshot.where(P.in_scope(F.col("path"), scopes))
    files = files.select("path").distinct().withColumn("status", F.explode(F.array(F.lit("A"), F.lit("D"))))
    named = F.when(F.col("status") == "D", ignored(F.col("path"), destructive)).otherwise(ignored(F.col("path"), rules))
    return files.where(named).select("status", "path")


def default_destructive(rules: list[Rule]) -> list[Rule]:
    """The rules and the fixed one for deletions."""
    from ..functions.rules import DESTRUCTIVE_RULE

    return [*rules, parse_rule(DESTRUCTIVE_RULE)]


def flow_translations(elements: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, children): a modified Translations element for each translation file that defines a packaged flow, and the
    definitions of packaged flows in it. children: (doc, tag, pos, value) of translation files, doc being the path."""
    flows = elements.where((F.col("target") == PACKAGE) & (F.col("type") == "Flow")).select(F.col("member").alias("name"))
    definitions = children.where(F.col("tag") == FLOW_KEY).withColumn("name", F.get_json_object("value", "$.fullName"))
    own = referring(definitions, flows, "name")
    member = P.stem(P.without_meta(P.base_name(F.col("doc"))))
    more = own.select(F.lit(PACKAGE).alias("target"), F.lit("Translations").alias("type"), member.alias("member"), F.lit("modify").alias("change_kind"), "doc").distinct()
    return more.select("target", "type", "member", "change_kind"), own.select("doc", "tag", "pos", "value", "name")


def translation_candidates(snapshot: DataFrame, blobs: DataFrame, scopes: list[str], rules: list[Rule]) -> DataFrame:
    """(doc, content): the translation files of a snapshot inside the scopes that no rule ignores and that define flows."""
    path = F.col("path")
    files = snapshot.where(path.endswith(TRANSLATION_SUFFIX) & P.in_scope(path, scopes) & ~ignored(path, rules)).join(blobs, "oid")
    return files.select(path.alias("doc"), F.col("content").cast("string").alias("content")).where(F.contains("content", F.lit(FLOW_KEY)))


def merged_definitions(existing: DataFrame, own: DataFrame) -> DataFrame:
    """The definitions of an output file, and after them those of own whose names it hasn't. Rows (doc, tag, pos, value, name)."""
    return merged(existing, own, ["doc", "name"])


def merged_translations(own: DataFrame, written: DataFrame | None) -> DataFrame:
    """(doc, content): each document of own, (doc, tag, pos, value, name) as flow_translations gives them, after what the
    output already has of it. written: (doc, content); malformed or absent, the document has a new root and own alone.

    Children stay with those of their tag, tags in order of their first child; of definitions with one name the first counts.
    """
    own = own.withColumn("_r", F.row_number().over(W.partitionBy("doc", "name").orderBy("pos"))).where("_r = 1").drop("_r")
    docs = own.select("doc").distinct()
    found = children_of((own.select("doc", F.lit("").alias("content")) if written is None else written).join(docs, "doc", "left_semi")).where("error is null")
    named = F.when(F.col("tag") == FLOW_KEY, F.get_json_object("value", "$.fullName"))
    known = found.where("pos > 0").select("doc", "tag", "pos", "value", named.alias("name"))
    # an unnamed child has no equal in own
    rows = merged_definitions(known, own).withColumn("_first", F.min(F.when(F.col("existing"), F.col("pos"))).over(W.partitionBy("doc", "tag")))
    place = F.struct(F.coalesce("_first", F.lit((1 << 62))).alias("first"), (~F.col("existing")).alias("new"), "pos", "tag", "value")
    children = rows.groupBy("doc").agg(F.array_sort(F.collect_list(place)).alias("all"))
    children = children.select("doc", F.transform("all", lambda s: F.struct(s["tag"].alias("tag"), s["value"].alias("value"))).alias("children"))
    roots = docs.join(found.where("pos = 0").select("doc", "value"), "doc", "left").select("doc", F.coalesce("value", F.lit(json.dumps(NEW_ROOT))).alias("value"))
    return rendered_documents(children, roots)


def unmatched_scopes(changes: DataFrame, scopes: list[str], nothing_left: bool) -> list[str]:
    """The scopes to warn of: all, where something changed, none of it in them, no scope is the root and nothing is left."""
    if not nothing_left or any(s in P.ROOT_MARKERS for s in scopes):
        return []
    seen, within = changes.agg(F.count("*"), F.count_if(P.in_scope(F.col("path"), scopes))).first()
    return list(scopes) if seen and not within else []
