"""Diffs of keyed nested documents: what was added, modified or deleted inside a document, and what of it is left to send.

A document is rows (doc, tag, pos, value): its root's children in order, each a JSON text. tag_rules (tag, key, xml_name,
excluded) say how a tag's children are told apart: by a field, as a whole list (<array>), by their text (<object>), or not at
all (a null key, or no rule).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import cut

ARRAY_KEY, OBJECT_KEY = "<array>", "<object>"


def canonical(value: Column) -> Column:
    """A JSON text in one form for all orders of object keys; any other text, one with a repeated key too, as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


@dataclass(frozen=True)
class DocumentDiff:
    """changes: doc, kind (add, modify, delete), type, member; documents: doc, has_package_content; retained: doc, tag, pos,
    value, tag_order: the children that are left, of documents with package content."""

    changes: DataFrame
    documents: DataFrame
    retained: DataFrame


_LISTS = ("array", "keyless", "unknown")


def _bucketed(children: DataFrame, tag_rules: DataFrame, side: int) -> DataFrame:
    rules = F.broadcast(tag_rules.select("tag", "key", "xml_name", F.coalesce("excluded", F.lit(False)).alias("excluded"), F.lit(True).alias("_ruled")))
    bucket = F.when(F.col("_ruled").isNull(), "unknown").when(F.col("key").isNull(), "keyless").when(F.col("key") == ARRAY_KEY, "array").when(F.col("key") == OBJECT_KEY, "object").otherwise("keyed")
    out = children.select("doc", "tag", "pos", "value").join(rules, "tag", "left").withColumn("bucket", bucket).withColumn("side", F.lit(side))
    return out.withColumn("member", F.when(F.col("bucket") == "keyed", F.from_json("value", "map<string,string>")[F.col("key")])).drop("_ruled", "key")


def paired_children(old: DataFrame, new: DataFrame, tag_rules: DataFrame) -> DataFrame:
    """All children of both revisions (side 0 and 1), with `kind`: what became of the child, null for nothing. `own_kind` is
    the same but null in lists, and known after the first window; `list_side` is the side, null where there is no list.

    Children meet by their key, an object's by its text, in one window, which numbers the lists of each side too. Those of lists
    then meet by their place in a second one, to which the others bring no text that isn't asked for. There is no join.
    """
    both = _bucketed(old, tag_rules, 0).unionByName(_bucketed(new, tag_rules, 1))
    listed, is_new = F.col("bucket").isin(*_LISTS), F.col("side") == 1
    # equal texts are equal documents; only others are brought into one form
    differ = lambda a, b: ~(a.eqNullSafe(b) | canonical(a).eqNullSafe(canonical(b)))
    # windows read plain columns: an expression over them would be shuffled beside them. The key stands for the member, too
    key = F.when(F.col("bucket") == "object", F.col("value")).otherwise(F.coalesce("member", F.lit("")))
    both = both.withColumns({"_key": key, "_named": F.col("member").isNotNull(), "list_side": F.when(listed, F.col("side"))}).drop("member")
    pair = W.partitionBy("doc", "tag", "_key", "list_side").orderBy("side", "pos", "value")
    first = F.first("side").over(pair.rowsBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumns({"_first": first, "_previous": F.lag("side").over(pair), "_next": F.lead("side").over(pair), "_before": F.lag("value").over(pair), "_n": F.row_number().over(pair)})
    modified = F.when(differ(F.col("value"), F.col("_before")), "modify")
    keyed = F.when(~is_new, F.when(F.col("_next").isNull(), "delete")).when(F.col("_previous") == 0, modified).otherwise("add")
    own_kind = F.when((F.col("bucket") == "keyed") & F.col("_named"), keyed).when((F.col("bucket") == "object") & (F.col("_first") == 1), "object")
    # places count from 1; what is in no list passes through, a document's children spread over numbers below 0
    slot = F.when(listed, F.col("_n")).otherwise(-1 - F.pmod(F.hash("_key", "pos"), F.lit(1 << 16)))
    both = both.withColumns({"member": F.when(F.col("_named"), F.col("_key")), "own_kind": own_kind, "_slot": slot, "_item": F.when(listed, F.col("value")), "_own": F.when(~listed, F.col("value"))})
    place, in_list = W.partitionBy("doc", "tag", "_slot").orderBy("side"), F.col("_slot") > 0
    both = both.drop("value", "_before", "_previous", "_next").withColumns({"_before": F.lag("_item").over(place), "_previous": F.lag("side").over(place), "_next": F.lead("side").over(place)})
    alone = F.when(is_new, F.col("_previous").isNull()).otherwise(F.col("_next").isNull())
    kind = F.when(~in_list, F.col("own_kind")).when(alone | (is_new & differ(F.col("_item"), F.col("_before"))), "list")
    both = both.withColumns({"value": F.when(in_list, F.col("_item")).otherwise(F.col("_own")), "kind": kind})
    return both.select("doc", "tag", "pos", "value", "side", "bucket", "member", "xml_name", "excluded", "kind", "own_kind", "list_side")


def document_diff(old: DataFrame, new: DataFrame, tag_rules: DataFrame, keep: bool = False) -> DocumentDiff:
    """The diff of each document between two revisions; old and new are rows (doc, tag, pos, value). keep: compare once and keep
    the result in the shared folder, for uses of more than one table of the diff.

    Of children of the old revision with one key the last counts; of the new one the first is compared and later ones are
    additions. Children without their key field are passed over. Lists and unknown tags are compared in order and as a
    whole, objects by their exact text; these give no members. Excluded tags give none either, but keep the document.
    Values that aren't JSON are compared as texts.
    """
    rows = paired_children(old, new, tag_rules)
    if keep:
        rows = cut(rows)
    # lists are left out before the window, which list_side parts
    changes = rows.where("list_side is null and bucket = 'keyed' and own_kind is not null and not excluded")
    changes = changes.select("doc", F.col("own_kind").alias("kind"), F.col("xml_name").alias("type"), "member")
    listed, sent = F.col("bucket").isin(*_LISTS), F.col("own_kind").isin("add", "modify", "object")
    # what became of each tag and document: aggregations that tasks combine before the shuffle, and joins that bring them back to
    # the children, which adaptive execution splits; no document's children are one window. A list that is gone sends nothing
    differs = F.coalesce(F.col("kind") == "list", F.lit(False))
    first = F.min(F.when(F.col("side") == 1, F.col("pos")))
    by_tag = rows.groupBy("doc", "tag").agg(F.max(F.coalesce(sent, F.lit(False))).alias("_sent"), (F.max(differs) & (F.max("side") == 1)).alias("_changed"), first.alias("tag_order"))
    documents = by_tag.groupBy("doc").agg(F.max(F.col("_sent") | F.col("_changed")).alias("has_package_content"))
    # a document has few tags
    tags = by_tag.withColumn("_alive", F.max(F.col("_sent") | F.col("_changed")).over(W.partitionBy("doc"))).where("_alive").select("doc", "tag", "_changed", "tag_order")
    own = rows.where((F.col("side") == 1) & (listed | F.coalesce(sent, F.lit(False)))).select("doc", "tag", "pos", "value", listed.alias("_listed"), (F.col("bucket") == "array").alias("_array"))
    left = own.join(tags, ["doc", "tag"]).where(~F.col("_listed") | F.col("_changed") | ~F.col("_array"))
    return DocumentDiff(changes, documents, left.select("doc", "tag", "pos", "value", "tag_order"))


def retained_json(diff: DocumentDiff) -> DataFrame:
    """(doc, children): the children left of each document with package content, in order, as (tag, value)."""
    item = F.struct("tag_order", "pos", "tag", "value")
    return diff.retained.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["tag"].alias("tag"), s["value"].alias("value"))).alias("children"))


def require_bounded(children: DataFrame, most: int = 100_000) -> DataFrame:
    """children; the query that reads them fails where a document has more children of one tag than that."""
    n = F.count("*").over(W.partitionBy("doc", "tag"))
    return children.withColumn("_n", n).where(F.assert_true(F.col("_n") <= most, F.lit("too many children of one tag")).isNull()).drop("_n")
