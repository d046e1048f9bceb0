"""Views of a set of changed elements, (target, type, member, change_kind), and of renames, (type, from_member, to_member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PACKAGE, DESTRUCTIVE = "package", "destructive"
ELEMENT = ["target", "type", "member", "change_kind"]
_KEY = ["type", "member"]
#: applied, removed: targets; add, modify, delete: kinds; source, led_to: sides of renames.
_FLAGS = ("applied", "removed", "add", "modify", "delete", "source", "led_to")


def union(*parts: DataFrame) -> DataFrame:
    """The distinct (type, member) of all parts."""
    out = parts[0].select(*_KEY)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_KEY))
    return out.distinct()


def subtract(base: DataFrame, minus: DataFrame) -> DataFrame:
    """The distinct (type, member) of base that minus hasn't; types that lose all members go."""
    return base.select(*_KEY).distinct().join(minus.select(*_KEY).distinct(), _KEY, "left_anti")


def distinct_renames(renames: DataFrame) -> DataFrame:
    """Each (type, from_member, to_member) once, without those that rename nothing."""
    return renames.where("from_member <> to_member").select("type", "from_member", "to_member").distinct()


def rename_targets(renames: DataFrame) -> DataFrame:
    return distinct_renames(renames).select("type", F.col("to_member").alias("member")).distinct()


def rename_sources(renames: DataFrame) -> DataFrame:
    return distinct_renames(renames).select("type", F.col("from_member").alias("member")).distinct()


def _flagged(elements: DataFrame, renames: DataFrame) -> DataFrame:
    """(type, member, and a flag for each of _FLAGS) of all members that elements or renames name: one aggregation."""
    moved = renames.where("from_member <> to_member")
    none = {name: F.lit(False) for name in _FLAGS}
    row = lambda df, member, **flags: df.select("type", F.col(member).alias("member"), *[(none | flags)[n].alias(n) for n in _FLAGS])
    kinds = {n: F.col("change_kind") == n for n in ("add", "modify", "delete")}
    rows = row(elements, "member", applied=F.col("target") == PACKAGE, removed=F.col("target") == DESTRUCTIVE, **kinds)
    sides = moved.select("type", F.explode(F.array(F.struct(F.col("from_member").alias("m"), F.lit(True).alias("source")), F.struct(F.col("to_member").alias("m"), F.lit(False).alias("source")))).alias("s")).select("type", "s.m", "s.source")
    rows = rows.unionByName(row(sides, "m", source=F.col("source"), led_to=~F.col("source")))
    return rows.groupBy(*_KEY).agg(*[F.coalesce(F.max(n), F.lit(False)).alias(n) for n in _FLAGS])


def package_view(elements: DataFrame, renames: DataFrame) -> DataFrame:
    """(type, member) to apply: what targets the package, and what something was renamed to."""
    return _flagged(elements, renames).where("applied or led_to").select(*_KEY)


def destructive_view(elements: DataFrame, renames: DataFrame) -> DataFrame:
    """(type, member) to remove: what targets removal, and what was renamed, without what is to be applied."""
    return _flagged(elements, renames).where("(removed or source) and not (applied or led_to)").select(*_KEY)


def kind_view(elements: DataFrame, renames: DataFrame) -> DataFrame:
    """(kind, type, member, to_member): add without rename targets, modify, delete without what was added, modified or
    renamed, and rename with its two members. A member may be added and modified at once."""
    gone = F.col("delete") & ~(F.col("add") | F.col("modify") | F.col("source"))
    own = F.array(F.when(F.col("add") & ~F.col("led_to"), "add"), F.when(F.col("modify"), "modify"), F.when(gone, "delete"))
    each = _flagged(elements, renames).select(F.explode(F.filter(own, lambda k: k.isNotNull())).alias("kind"), *_KEY, F.lit(None).cast("string").alias("to_member"))
    return each.unionByName(distinct_renames(renames).select(F.lit("rename").alias("kind"), "type", F.col("from_member").alias("member"), "to_member"))


def is_empty(elements: DataFrame, renames: DataFrame) -> bool:
    """Whether there is nothing to apply and nothing to remove."""
    return package_view(elements, renames).isEmpty() and destructive_view(elements, renames).isEmpty()


def by_target(elements: DataFrame) -> DataFrame:
    """(target, type, members): the members as a sorted set."""
    return elements.groupBy("target", "type").agg(F.array_sort(F.collect_set("member")).alias("members"))


def by_kind(elements: DataFrame) -> DataFrame:
    """(change_kind, type, members): the members as a sorted set."""
    return elements.groupBy("change_kind", "type").agg(F.array_sort(F.collect_set("member")).alias("members"))


def reconstructed(elements: DataFrame) -> DataFrame:
    """Each (target, type, member) once, with the first of add, modify and delete that the member has under any target."""
    rank = F.when(F.col("change_kind") == "add", 1).when(F.col("change_kind") == "modify", 2).otherwise(3)
    kinds = elements.groupBy(*_KEY).agg(F.min_by("change_kind", rank).alias("change_kind"))
    return elements.select("target", *_KEY).distinct().join(kinds, _KEY).select(*ELEMENT)


def roll_up(elements: DataFrame, parent: str = "DigitalExperienceBundle", child: str = "DigitalExperience") -> DataFrame:
    """elements without the children whose parent, their member's part before the first dot, is there under the same target.
    A child without a dot stays."""
    parents = elements.where(F.col("type") == parent).select("target", F.col("member").alias("_parent")).distinct()
    dotted = (F.col("type") == child) & F.contains("member", F.lit("."))
    covered = elements.where(dotted).withColumn("_parent", F.substring_index("member", ".", 1)).join(parents, ["target", "_parent"], "left_anti")
    return elements.where(~dotted).unionByName(covered.select(*elements.columns))


def bundle_warnings(elements: DataFrame, parent: str = "DigitalExperienceBundle") -> DataFrame:
    """(code, subject): one for each parent to be removed."""
    gone = elements.where((F.col("type") == parent) & (F.col("target") == DESTRUCTIVE))
    return gone.select(F.lit("bundle_deletion").alias("code"), F.col("member").alias("subject")).distinct()


def resolve_renames(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """(type, from_member, to_member) of path pairs (from_path, to_path) whose two sides have one type and two members.

    described: side ("from" or "to"), path, type, member. Paths that aren't described are passed over.
    """
    side = lambda s, p, m: described.where(F.col("side") == s).select(F.col("path").alias(p), F.col("type").alias(f"{s}_type"), F.col("member").alias(m)).distinct()
    both = pairs.join(side("from", "from_path", "from_member"), "from_path").join(side("to", "to_path", "to_member"), "to_path")
    return both.where("from_type = to_type and from_member <> to_member").select(F.col("from_type").alias("type"), "from_member", "to_member").distinct()


def manifest_order(first: str = "CustomObject", collation: str = "fr") -> list[Column]:
    """What the rows (type, member) of a manifest stand in order of: `first` before the other types, these and the members in
    the order of that locale, and by code points where it holds two equal."""
    by = lambda c: [F.expr(f"{c} collate {collation}"), F.col(c)]
    return [F.when(F.col("type") == first, 0).otherwise(1), *by("type"), *by("member")]


def manifest_rows(view: DataFrame, first: str = "CustomObject", collation: str = "fr") -> DataFrame:
    """(type, member) of a view, once each, in a manifest's order. A range sort; no type is ever one value."""
    return view.select(*_KEY).distinct().orderBy(*manifest_order(first, collation))


def manifest(view: DataFrame, first: str = "CustomObject", collation: str = "fr") -> DataFrame:
    """(place, type, members): a view as manifest blocks; `first` before the other types, these and the members in the order
    of that locale. One row a type, so that place is a number over few rows."""
    grouped = view.select(*_KEY).distinct().groupBy("type").agg(F.array_sort(F.collect_list(F.struct(F.expr(f"member collate {collation}").alias("k"), "member"))).alias("m"))
    order = W.orderBy(F.when(F.col("type") == first, 0).otherwise(1), F.expr(f"type collate {collation}"), "type")
    return grouped.select(F.row_number().over(order).alias("place"), "type", F.transform("m", lambda s: s["member"]).alias("members"))
