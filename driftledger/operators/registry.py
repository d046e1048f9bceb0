"""The registry of types: how it is built, which type a path has, and which rule handles a type."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

# Names that the rules below depend on.
UNSAFE_SUFFIXES = ("app", "xml", "md")
CONTAINER_ADAPTERS = ("bundle", "digitalExperience", "mixedContent")
META_FILE_ADAPTERS = ("matchingContentFile", "mixedContent", "bundle", "decomposed", "digitalExperience")
SHARED_FOLDER_TYPES = ("dashboard", "report", "emailtemplate")
EXCLUDED_PARENTS = ("Translations", "CustomObjectTranslation")
TRANSLATION_PARENTS = ("CustomObjectTranslation", "Translations", "StandardValueSetTranslation")
COMPOSED_TYPES = (
    "CustomObject", "CustomObjectTranslation", "PermissionSet", "Workflow", "SharingRules", "BusinessProcess", "CompactLayout",
    "CustomField", "FieldSet", "Index", "ListView", "RecordType", "SharingCriteriaRule", "SharingGuestRule", "SharingOwnerRule",
    "SharingReason", "Territory2", "Territory2Rule", "ValidationRule", "WebLink", "WorkflowAlert", "WorkflowFieldUpdate",
    "WorkflowFlowAction", "WorkflowKnowledgePublish", "WorkflowOutboundMessage", "WorkflowRule", "WorkflowSend", "WorkflowTask",
)
HANDLER_OF_TYPE = {
    "AuraDefinitionBundle": "lwc", "CustomField": "custom_field", "CustomFieldTranslation": "object_translation",
    "CustomLabel": "custom_label", "CustomObject": "custom_object", "CustomObjectTranslation": "object_translation",
    "Dashboard": "reporting_folder", "Flow": "flow", "GenAiFunction": "lwc", "GlobalValueSetTranslation": "in_file",
    "LightningComponentBundle": "lwc", "PermissionSet": "contained_decomposed", "Report": "reporting_folder",
    "StandardValueSetTranslation": "in_file", "Territory2": "decomposed", "Territory2Model": "custom_object",
    "Territory2Rule": "decomposed", "VirtualBot": "bot", "VirtualDiscovery": "shared_folder",
    "VirtualModeration": "shared_folder", "VirtualWave": "shared_folder",
}
HANDLER_OF_ADAPTER = {"bundle": "in_resource", "digitalExperience": "in_bundle", "mixedContent": "in_resource"}


class RegistryError(ValueError):
    """A registry entry that can't be used; the message says which and why."""


@dataclass(frozen=True)
class TypeDef:
    """One type. content: (suffix, xml_name) of types that share its directory; key may be <array> or <object>."""

    xml_name: str
    directory_name: str | None = None
    suffix: str | None = None
    in_folder: bool = False
    meta_file: bool = False
    parent_xml_name: str | None = None
    xml_tag: str | None = None
    key: str | None = None
    excluded: bool = False
    prune_only: bool = False
    adapter: str | None = None
    decomposition: str | None = None
    content: tuple[tuple[str, str], ...] = ()
    child_xml_names: tuple[str, ...] = field(default=())
    #: The properties that an entry stated, among them those with a default's value.
    stated: frozenset[str] = field(default=frozenset(), compare=False)


_JSON_NAMES = {
    "xmlName": "xml_name", "directoryName": "directory_name", "suffix": "suffix", "inFolder": "in_folder", "metaFile": "meta_file",
    "parentXmlName": "parent_xml_name", "xmlTag": "xml_tag", "key": "key", "excluded": "excluded", "pruneOnly": "prune_only",
    "adapter": "adapter", "decomposition": "decomposition", "content": "content", "childXmlNames": "child_xml_names",
}


def from_json(entries: Iterable[Mapping[str, Any]]) -> list[TypeDef]:
    """Types from a user's JSON entries; RegistryError for unknown fields or an empty xmlName."""
    out = []
    for k, entry in enumerate(entries):
        unknown = sorted(set(entry) - set(_JSON_NAMES))
        if unknown or not entry.get("xmlName"):
            raise RegistryError(f"entry {k}: " + (f"unknown fields {unknown}" if unknown else "xmlName is missing or empty"))
        values = {_JSON_NAMES[n]: v for n, v in entry.items() if v is not None}
        values["content"] = tuple((c["suffix"], c["xmlName"]) for c in values.get("content", ()))
        values["child_xml_names"] = tuple(values.get("child_xml_names", ()))
        out.append(TypeDef(**values, stated=frozenset(_JSON_NAMES[n] for n in entry)))
    return out


def from_standard(types: Mapping[str, Mapping[str, Any]]) -> list[TypeDef]:
    """Types from a standard registry's `types` object, by the conversion rules of that registry.

    Types of folders, and their aliases, are no types of their own; a companion file exists for some adapters; dashboards,
    reports and mail templates share their directory with the type of their folders; a child's directory is its element's
    name where its parent lists that, else its own; a child's suffix or directory that its parent has is dropped; children of
    translations are excluded.
    """
    folders = {t["folderType"] for t in types.values() if t.get("inFolder") and t.get("folderType")}
    folders |= {k for k, t in types.items() if t.get("aliasFor") in folders}
    out: list[TypeDef] = []
    for type_id, t in types.items():
        if type_id in folders:
            continue
        suffix, strategies, children = t.get("suffix"), t.get("strategies", {}), t.get("children", {})
        folder = types.get(t.get("folderType", "")) if type_id in SHARED_FOLDER_TYPES else None
        out.append(TypeDef(
            xml_name=t["name"], directory_name=t.get("directoryName"), suffix=suffix, in_folder=bool(t.get("inFolder")),
            meta_file=strategies.get("adapter") in META_FILE_ADAPTERS, adapter=strategies.get("adapter"), decomposition=strategies.get("decomposition"),
            content=((suffix, t["name"]), (folder["suffix"], folder["name"])) if folder else (), child_xml_names=tuple(c["name"] for c in children.get("types", {}).values()),
        ))
        for c in children.get("types", {}).values():
            tag = c.get("xmlElementName")
            directory = tag if tag and tag in children.get("directories", {}) else c.get("directoryName")
            own = directory if directory and directory != t.get("directoryName") else None
            out.append(TypeDef(
                xml_name=c["name"], directory_name=own, suffix=c.get("suffix") if own or c.get("suffix") != suffix else None,
                parent_xml_name=t["name"], xml_tag=tag, key=c.get("uniqueIdElement"), excluded=t["name"] in EXCLUDED_PARENTS,
            ))
    return out


def overlay(base: Iterable[TypeDef], over: Iterable[TypeDef]) -> list[TypeDef]:
    """Both registries by name: of a type in both, what over states replaces what base has, false and empty values too. A
    TypeDef that wasn't read from JSON states what isn't its default."""
    blank = {f.name: f.default for f in fields(TypeDef) if f.name not in ("xml_name", "stated")}
    out = {t.xml_name: t for t in base}
    for t in over:
        known = out.get(t.xml_name)
        out[t.xml_name] = t if known is None else replace(known, **{n: getattr(t, n) for n, d in blank.items() if n in t.stated or getattr(t, n) != d})
    return list(out.values())


def handlers(types: Iterable[TypeDef]) -> dict[str, str]:
    """The handler of each type by name: by type, folder, adapter, parent, children in files, else the standard one."""
    types = list(types)
    by_name = {t.xml_name: t for t in types}
    plain = lambda name: name is not None and name in by_name and not by_name[name].adapter
    with_children = {t.parent_xml_name for t in types if t.xml_tag and t.key and plain(t.parent_xml_name)}

    def of(t: TypeDef) -> str:
        parent = by_name.get(t.parent_xml_name) if t.parent_xml_name else None
        if t.xml_name in HANDLER_OF_TYPE:
            return HANDLER_OF_TYPE[t.xml_name]
        if t.in_folder:
            return "in_folder"
        if t.adapter in HANDLER_OF_ADAPTER:
            return HANDLER_OF_ADAPTER[t.adapter]
        if t.parent_xml_name and t.xml_tag and t.key and not (parent and parent.adapter):
            return "decomposed"
        if parent and not t.xml_tag and parent.decomposition == "folderPerType":
            return "custom_object_child"
        return "in_file" if t.xml_name in with_children else "standard"

    return {t.xml_name: of(t) for t in types}


def tag_rules(spark: SparkSession, types: Iterable[TypeDef]) -> DataFrame:
    """(tag, key, xml_name, excluded): how children are told apart inside documents. Of several types with a tag the last
    counts; those of translations are excluded."""
    out = {}
    for t in types:
        if t.xml_tag:
            out[t.xml_tag] = (t.xml_tag, t.key, t.xml_name, t.excluded or t.parent_xml_name in TRANSLATION_PARENTS or t.xml_name in TRANSLATION_PARENTS)
    return spark.createDataFrame(list(out.values()), "tag string, key string, xml_name string, excluded boolean")


def shared_folder_types(types: Iterable[TypeDef]) -> dict[str, str]:
    """The type of each suffix that shares a directory."""
    return {s: name for t in types for s, name in t.content}


_COLUMNS = (
    "type string, directory_name string, suffix string, in_folder boolean, meta_file boolean, parent_type string, prune_only boolean,"
    " adapter string, handler string, owns boolean, composed boolean, parent_suffix string"
)


@dataclass(frozen=True)
class Registry:
    """A registry as tables that are broadcast: a few hundred rows each.

    types: a row per type; by_suffix, by_directory, by_name: (key, type), one row per key. A suffix that two entries have is
    unsafe and not in by_suffix.
    """

    defs: tuple[TypeDef, ...]
    types: DataFrame
    by_suffix: DataFrame
    by_directory: DataFrame
    by_name: DataFrame

    @staticmethod
    def of(spark: SparkSession, types: Iterable[TypeDef]) -> Registry:
        types = tuple(types)
        handler, by_name = handlers(types), {t.xml_name: t for t in types}
        suffixes: dict[str, str] = {}
        unsafe = set(UNSAFE_SUFFIXES)
        for t in types:
            for s in [t.suffix] * bool(t.suffix) + [s for s, _ in t.content]:
                if s in suffixes:
                    unsafe.add(s)
                else:
                    suffixes[s] = t.xml_name
        owns = lambda t: bool(t.in_folder or t.adapter in CONTAINER_ADAPTERS or t.content)
        parent = lambda t: by_name.get(t.parent_xml_name or "")
        rows = [
            (t.xml_name, t.directory_name, t.suffix, t.in_folder, t.meta_file, t.parent_xml_name, t.prune_only, t.adapter, handler[t.xml_name], owns(t), t.xml_name in COMPOSED_TYPES, p.suffix if (p := parent(t)) else None)
            for t in by_name.values()
        ]
        pairs = lambda d: spark.createDataFrame(list(d.items()), "key string, type string")
        return Registry(
            types,
            spark.createDataFrame(rows, _COLUMNS),
            pairs({s: n for s, n in suffixes.items() if s not in unsafe}),
            pairs({t.directory_name: t.xml_name for t in types if t.directory_name}),
            pairs({n: n for n in by_name}),
        )


def unsafe_suffixes(definitions: DataFrame) -> DataFrame:
    """(suffix): those of more than one row of (suffix, type), and the fixed ones."""
    fixed = definitions.sparkSession.createDataFrame([(s,) for s in UNSAFE_SUFFIXES], "suffix string")
    often = definitions.where("suffix is not null").groupBy("suffix").count().where("count > 1").select("suffix")
    return often.unionByName(fixed).distinct()


def lookup(changes: DataFrame, registry: Registry, path: str = "path") -> DataFrame:
    """changes with `type`: by the safe suffix of the file name, else by directory, else by a name that is the whole path;
    null where none has it.

    By directory the last segment with a type decides, but none below the first that owns what is in it. Directories are
    looked up once each: one aggregation by directory, all other joins are broadcast.
    """
    name = P.without_meta(P.base_name(F.col(path)))
    suffix = F.when(name.rlike(r".\.[^.]*$"), F.substring_index(name, ".", -1))
    out = changes.withColumn("_suffix", suffix).withColumn("_path", F.col(path))
    by_suffix = F.broadcast(registry.by_suffix.select(F.col("key").alias("_suffix"), F.col("type").alias("_t1")))
    owners = registry.by_directory.join(registry.types.select("type", "owns"), "type").select(F.col("key").alias("segment"), F.col("type").alias("_t"), "owns")
    split = changes.select(F.col(path).alias("_path")).where("_path is not null").distinct().select("_path", F.posexplode(P.parts(F.col("_path"))).alias("pos", "segment"))
    hits = split.join(F.broadcast(owners), "segment").groupBy("_path").agg(F.min(F.when(F.col("owns"), F.col("pos"))).alias("stop"), F.collect_list(F.struct("pos", "_t")).alias("found"))
    inside = F.filter("found", lambda f: F.col("stop").isNull() | (f["pos"] <= F.col("stop")))
    by_directory = hits.select("_path", F.array_max(inside)["_t"].alias("_t2"))
    by_name = F.broadcast(registry.by_name.select(F.col("key").alias("_path"), F.col("type").alias("_t3")))
    out = out.join(by_suffix, "_suffix", "left").join(by_directory, "_path", "left").join(by_name, "_path", "left")
    return out.withColumn("type", F.coalesce("_t1", "_t2", "_t3")).select(*changes.columns, "type")


def comparison_name(path: Column, composed: Column, first_directory: Column) -> Column:
    """The lower-case name by which a deletion meets an addition: the file's, or, for composed types, the segments from the
    first type directory on without their slashes. first_directory: its place in the path, from 1; null for none."""
    p = P.parts(path)
    whole = F.array_join(F.slice(p, F.coalesce(first_directory, F.lit(1)), F.size(p)), "")
    return F.lower(F.when(F.coalesce(composed, F.lit(False)), whole).otherwise(P.base_name(path)))


def with_comparison_name(typed: DataFrame, registry: Registry) -> DataFrame:
    """typed (path, type) with comparison_name."""
    directories = F.array(*[F.lit(d) for d in sorted({t.directory_name for t in registry.defs if t.directory_name})] or [F.lit("")])
    places = F.transform(P.parts(F.col("path")), lambda s, i: F.when(F.array_contains(directories, s), i + 1))
    composed = F.col("type").isin(*COMPOSED_TYPES)
    first = F.when(composed, F.array_min(places))
    return typed.withColumn("comparison_name", comparison_name(F.col("path"), composed, first))
