"""From typed changes to elements, copies and warnings: what each kind of type makes of a changed file.

A change's handler is a column of the registry, so that one pass of column expressions serves all of them; only questions
about other files of the new snapshot are joins. What a handler can't do for a row never fails the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.lineage import cut
from ..functions.xmltree import children_of, rendered_documents
from . import documents as X
from . import existence as E
from .diff import change_kind
from .registry import Registry, lookup, shared_folder_types, tag_rules

MASTER_DETAIL = "<type>MasterDetail</type>"
_BUNDLES = ("in_resource", "in_bundle", "lwc", "object_translation")
_CHILDREN = ("decomposed", "custom_field", "custom_object_child")


@dataclass(frozen=True)
class Outcome:
    """elements: target, type, member, change_kind; copies: path, kind, seq, content; warnings: code, subject."""

    elements: DataFrame
    copies: DataFrame
    warnings: DataFrame


def _met(rows: DataFrame) -> DataFrame:
    """rows that are joined by a shuffle. Spark would guess by the size of their compressed files that they can be sent to all tasks,
    but a file's row becomes one for each directory above it: the driver would have to hold them."""
    return rows.hint("merge")


def _first(text: Column, old: Column, new: str = "") -> Column:
    """text with the first occurrence of old replaced."""
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def _scan_anchor(p: Column, name: Column) -> Column:
    """The last segment that is the name, else that begins with it and a dot, else the last one; from 1."""
    begins = F.array_max(F.transform(p, lambda s, i: F.when(s.startswith(F.concat(name, F.lit("."))), i + 1)))
    exact = P.last_index(p, name)
    return F.when(exact > 0, exact).otherwise(F.coalesce(begins, F.size(p)))


def _siblings(snapshots: DataFrame) -> DataFrame:
    """(gone, dir, sibling): the names right below each directory."""
    p = P.parts(F.col("path"))
    at = snapshots.select("gone", p.alias("p"), F.explode(F.sequence(F.lit(1), F.size(p))).alias("i")).where("i > 1")
    return at.select("gone", F.array_join(F.slice("p", F.lit(1), F.col("i") - 1), "/").alias("dir"), F.get("p", F.col("i") - 1).alias("sibling"))


def _walked_up(rows: DataFrame, snapshots: DataFrame, registry: Registry) -> DataFrame:
    """(gone, path, walked): for paths outside their type's directory, the name that a sibling of the nearest directory above
    has in common with the path."""
    above = rows.select("gone", "path", F.explode(P.ancestors(F.col("path"))).alias("dir")).distinct()
    near = _met(cut(_siblings(snapshots).join(above.select("gone", "dir").distinct(), ["gone", "dir"], "left_semi").distinct()))
    named = lookup(near.select(F.col("sibling").alias("path")).distinct(), registry).join(F.broadcast(registry.types.select("type", "suffix")), "type")
    named = named.where(F.col("suffix").isNotNull() & F.contains("path", F.concat(F.lit("."), F.col("suffix"))))
    named = named.select(F.col("path").alias("sibling"), _first(_first(F.col("path"), F.lit(P.META_SUFFIX)), F.concat(F.lit("."), F.col("suffix"))).alias("name"))
    found = above.join(near.join(named, "sibling"), ["gone", "dir"])
    found = found.where(F.exists(P.parts(F.col("path")), lambda s: (s == F.col("name")) | s.startswith(F.concat(F.col("name"), F.lit(".")))))
    return found.groupBy("gone", "path").agg(F.min_by("name", F.struct(-F.length("dir"), F.col("sibling"))).alias("walked"))


def describe(changes: DataFrame, registry: Registry, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """changes (status, path, type) with what the handlers need to know of each path: its parts, its place below the type's
    directory, its component, and the element that it stands for (element_type, member).

    old and new are the snapshots (path); None for either stands for one that can't be read, where nothing exists.
    """
    df = cut(changes).join(F.broadcast(registry.types), "type")
    p, n = P.parts(F.col("path")), F.size("p")
    meta = F.col("path").endswith(P.META_SUFFIX)
    df = df.withColumn("p", p).withColumn("base_path", F.when(meta & F.col("meta_file"), P.without_meta(F.col("path"))).otherwise(F.col("path")))
    df = df.withColumn("base", P.base_name(F.col("base_path"))).withColumn("ext", P.extension(F.col("base_path"))).withColumn("dir", P.dir_name(F.col("base_path")))
    df = df.withColumn("parent_folder", P.base_name(F.col("dir"))).withColumn("dir_index", P.last_index(F.col("p"), F.col("directory_name")))
    df = df.withColumn("component_name", P.stem(P.without_meta(F.element_at("p", -1)))).withColumn("file_stem", P.stem(F.element_at("p", -1)))
    depth = n - F.col("dir_index")
    df = df.withColumn("_deep", (F.col("dir_index") > 0) & (depth > 2) & F.col("suffix").isNotNull()).withColumn("_outside", F.col("dir_index") == 0)
    df = df.withColumn("type_dir", F.when(F.col("dir_index") > 0, P.joined(F.col("p"), 1, F.col("dir_index"))))
    df = df.withColumn("gone", F.col("status") == "D")
    suffixes = registry.types.where("directory_name is not null and suffix is not null").select("directory_name", "suffix")
    # deletions ask the old snapshot, all else the new one
    sides = [s.select("path", F.lit(gone).alias("gone")) for s, gone in ((old, True), (new, False)) if s is not None]
    none = F.lit(None).cast("string")
    if sides:
        # the snapshots are asked for some paths only, often for none: then neither they nor the changes are shuffled
        snapshots, asked = _met(reduce(DataFrame.unionByName, sides)), df.agg(F.max("_deep").alias("deep"), F.max("_outside").alias("outside")).first()
        deep = _met(df).where("_deep").select("gone", "path", "type_dir").distinct()
        known = E.innermost_component(deep, E.component_names(snapshots, suffixes, ["gone"]), ["gone"]) if asked.deep else None
        walked = _walked_up(df.where("_outside"), snapshots, registry) if asked.outside else None
        df = df.withColumn("component", none) if known is None else df.join(known.drop("type_dir"), ["gone", "path"], "left")
        df = df.withColumn("walked", none) if walked is None else df.join(walked, ["gone", "path"], "left")
    else:
        df = df.withColumn("component", F.col("file_stem")).withColumn("walked", none)
    by_path = F.when(F.col("dir_index") < n - 1, F.col("dir_index") + 1).otherwise(F.col("dir_index"))
    dotted = F.concat(F.lit("."), F.col("suffix"))
    # what is used several times is a column: as an expression it would be computed for each use, in lambdas for each part
    df = df.withColumn("_file", F.element_at("p", -1)).withColumn("_bare", _first(F.col("_file"), F.lit(P.META_SUFFIX))).withColumn("_named", _first(F.col("_bare"), dotted))
    named = F.col("_named")
    anchor = (
        F.when(F.col("_outside"), _scan_anchor(F.col("p"), F.coalesce("walked", "file_stem")))
        .when((depth <= 1) | F.col("suffix").isNull(), by_path)
        .when((depth == 2) & F.contains("_file", dotted) & (named != F.element_at("p", -2)), _scan_anchor(F.col("p"), named))
        .when(depth == 2, by_path)
        .otherwise(_scan_anchor(F.col("p"), F.coalesce("component", "file_stem")))
    )
    df = df.withColumn("anchor", anchor).drop("_file", "_bare", "_named")
    df = df.withColumn("after", F.when(F.col("dir_index") > 0, F.slice("p", F.col("dir_index") + 1, F.greatest(n - F.col("dir_index"), F.lit(0)))).otherwise(F.slice("p", F.col("anchor"), n)))
    df = df.withColumn("type_dir", F.coalesce("type_dir", P.joined(F.col("p"), 1, F.col("anchor") - 1)))
    parent = F.when(F.col("dir_index") >= 2, F.get("p", F.col("dir_index") - 2)).when(F.col("anchor") >= 3, F.get("p", F.col("anchor") - 3)).otherwise(F.lit(""))
    df = df.withColumn("parent_name", parent)
    whole = F.when(F.size("after") > 1, P.joined(F.col("p"), 1, F.col("anchor"))).otherwise(F.concat_ws("/", "type_dir", "component_name"))
    page = (F.col("handler") == "in_bundle") & (F.size("after") > 4)
    df = df.withColumn("is_page", page).withColumn("component_path", F.when(page, F.concat_ws("/", "type_dir", P.joined(F.col("after"), 1, F.lit(4)))).otherwise(whole))
    split = ~F.contains("base", F.coalesce(dotted, F.lit("\x00"))) | (P.base_name(F.col("dir")) == P.stem(F.col("base")))
    df = df.withColumn("split", split)
    back = F.when(F.col("component_name") == F.col("parent_folder"), 2).otherwise(3)
    plain = _first(_first(F.col("base_path"), F.lit(P.META_SUFFIX)), F.coalesce(dotted, F.lit("\x00")))
    df = df.withColumn("holder", F.when(F.col("split"), P.joined(F.col("p"), 1, n - back + 1)).otherwise(plain))
    return cut(_with_element(df.drop("gone", "_deep", "_outside", "walked", "anchor", "file_stem"), registry))


def _with_element(df: DataFrame, registry: Registry) -> DataFrame:
    h, shared = F.col("handler"), shared_folder_types(registry.defs)
    resolved = F.create_map(*[F.lit(x) for pair in shared.items() for x in pair])[F.col("ext")] if shared else F.lit(None).cast("string")
    df = df.withColumn("resolved", resolved)
    folder = F.regexp_replace(F.regexp_replace(P.without_meta(F.array_join("after", "/")), "Folder$", ""), r"\.[^/.]+$", "")
    bundle = F.regexp_replace(P.without_meta(P.joined(F.col("after"), 1, F.lit(2))), F.concat(F.lit(r"\."), F.coalesce("suffix", F.lit("\x00")), F.lit("$")), "")
    page = F.concat(P.joined(F.col("after"), 1, F.lit(2)), F.lit("."), P.joined(F.col("after"), 3, F.lit(2)))
    file = P.stem(F.col("base"))
    member = (
        F.when(h.isin("in_folder", "reporting_folder"), folder)
        .when(h == "bot", F.when(F.col("parent_folder") == file, file).otherwise(F.concat_ws(".", "parent_folder", file)))
        .when(F.col("is_page"), page)
        .when(h == "in_bundle", bundle)
        .when(h == "object_translation", F.get("after", F.lit(0)))
        .when(h.isin("in_resource", "lwc"), F.when(F.size("after") > 1, F.get("after", F.lit(0))).otherwise(F.col("component_name")))
        .when(h.isin(*_CHILDREN), F.concat_ws(".", "parent_name", "component_name"))
        .when(h == "contained_decomposed", P.base_name(F.col("holder")))
        .otherwise(F.col("component_name"))
    )
    of_shared = h.isin("reporting_folder", "shared_folder", "bot")
    kind = F.when(of_shared, F.col("resolved")).when(F.col("is_page"), "DigitalExperience").otherwise(F.col("type"))
    own = F.coalesce(F.col("suffix") == F.col("ext"), F.lit(False))
    elsewhere = ~F.coalesce(F.col("parent_folder") == F.col("directory_name"), F.lit(False))
    ready = (
        F.when(h.isin("in_folder", "reporting_folder"), own | elsewhere | F.col("ext").endswith("Folder"))
        .when(h.isin("shared_folder", "bot"), own | F.col("resolved").isNotNull())
        .when(h.isin("in_resource", "in_bundle", "object_translation", "contained_decomposed", "custom_label"), F.lit(True))
        .when(h == "lwc", elsewhere)
        .otherwise(own)
    )
    return df.withColumn("element_type", kind).withColumn("member", member).withColumn("processable", ready)


def _diffed() -> Column:
    """Whether a change is to be looked for inside its document."""
    h = F.col("handler")
    return ((h == "in_file") & ~((F.col("status") == "D") & F.col("prune_only"))) | ((h == "custom_label") & (F.col("ext") != "label"))


def _contents(paths: DataFrame, snapshot: DataFrame | None, blobs: DataFrame) -> DataFrame:
    """(doc, content): the contents of these paths in a snapshot."""
    if snapshot is None:
        return blobs.select(F.lit("").alias("doc"), F.col("content").cast("string").alias("content")).where("false")
    return snapshot.join(paths.select("path").distinct(), "path").join(blobs, "oid").select(F.col("path").alias("doc"), F.col("content").cast("string").alias("content"))


def collect(changes: DataFrame, registry: Registry, old: DataFrame | None, new: DataFrame | None, blobs: DataFrame | None = None, copies: bool = True) -> Outcome:
    """The outcome of typed changes (status A, M or D, path, type).

    old, new: the snapshots (path, oid), None for one that can't be read; blobs: (oid, content), needed for changes inside
    documents and for questions about contents; copies: whether to list the files to copy.
    """
    old, new, blobs = (None if rows is None else _met(rows) for rows in (old, new, blobs))
    df = describe(changes, registry, old, new).where("processable and element_type is not null").withColumn("seq", F.xxhash64("path"))
    inner, plain = df.where(_diffed()), df.where(~_diffed())
    # what still exists of a deleted component is sent again
    h = F.col("handler")
    asked = F.when(h.isin(*_BUNDLES), F.col("component_path")).when((h == "contained_decomposed") & F.col("split"), F.col("holder"))
    plain = plain.withColumn("_asked", F.when(F.col("status") == "D", asked))
    if new is not None:
        # only these are shuffled to what exists; all others have no path to ask for, and would meet in one task
        asking = E.with_existence(plain.where("_asked is not null"), new, "_asked", "left")
        plain = asking.unionByName(plain.where("_asked is null").withColumn("left", F.lit(False)))
    else:
        plain = plain.withColumn("left", F.lit(False))
    plain = cut(plain.withColumn("target", F.when((F.col("status") == "D") & ~F.col("left"), "destructive").otherwise("package")))
    kind = change_kind(F.col("status")).alias("change_kind")
    elements = plain.select("target", F.col("element_type").alias("type"), "member", kind)
    bots = plain.where("handler = 'bot' and target = 'package'")
    elements = elements.unionByName(bots.select("target", F.lit("Bot").alias("type"), F.col("parent_folder").alias("member"), kind))
    warnings = plain.where("handler = 'flow' and status = 'D'").select(F.lit("flow_deleted").alias("code"), F.col("member").alias("subject"))
    computed = None
    if blobs is not None:
        # the parents of object translations are sent as what changed in them, whole where that is nothing
        parents = plain.where("handler = 'object_translation' and target = 'package'").select(_translation_parent().alias("doc")).where("doc is not null").distinct()
        paths = inner.select(F.col("base_path").alias("path"))
        paths = paths.unionByName(parents.select(F.col("doc").alias("path"))) if copies else paths
        before, after = _contents(paths, old, blobs), _contents(paths, new, blobs)
        parsed_old, parsed_new = children_of(before, lenient=True), cut(children_of(after))
        broken = parsed_new.where("error is not null").select("doc")
        rules = tag_rules(changes.sparkSession, registry.defs)
        rows = lambda x: x.where("pos > 0").join(broken, "doc", "left_anti").select("doc", "tag", "pos", "value")
        diff = X.document_diff(rows(parsed_old), rows(parsed_new), rules, keep=True)
        of_doc = inner.select(F.col("base_path").alias("doc"), "handler", "status", F.col("type").alias("container"), F.col("component_name").alias("container_member")).distinct()
        prefix = F.when(F.col("handler") == "custom_label", F.lit("")).otherwise(F.concat(F.substring_index(P.base_name(F.col("doc")), ".", 1), F.lit(".")))
        inside = diff.changes.join(of_doc, "doc").select(
            F.when(F.col("kind") == "delete", "destructive").otherwise("package").alias("target"), "type", F.concat(prefix, F.col("member")).alias("member"), F.col("kind").alias("change_kind")
        )
        holding = diff.documents.where("has_package_content").join(of_doc, "doc").where("handler <> 'custom_label'")
        elements = elements.unionByName(inside).unionByName(holding.select(F.lit("package").alias("target"), F.col("container").alias("type"), F.col("container_member").alias("member"), change_kind(F.col("status")).alias("change_kind")))
        warnings = warnings.unionByName(broken.join(of_doc, "doc", "left_semi").select(F.lit("malformed_xml").alias("code"), F.col("doc").alias("subject")))
        if copies:
            roots = parsed_new.where("pos = 0 and error is null").select("doc", "value")
            computed = rendered_documents(X.retained_json(diff), roots)
    files = _copies(plain.where("target = 'package'"), new, blobs) if copies else None
    if files is None:
        files = changes.select(F.lit("").alias("path"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("content")).where("false")
    elif computed is not None:
        files = files.unionByName(computed.select(F.col("doc").alias("path"), F.lit("computed").alias("kind"), F.xxhash64("doc").alias("seq"), F.col("content").cast("binary").alias("content")))
    return Outcome(elements.distinct(), files, warnings.distinct())


def _translation_parent() -> Column:
    """The file of the object translation that a change belongs to; null for other handlers. A copy of the whole file is listed
    too, which counts where it can't be pruned."""
    own = F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.concat(F.element_at("p", -2), F.lit(".objectTranslation-meta.xml")))
    return F.when((F.col("handler") == "object_translation") & (F.size("p") > 1), own)


def _before_dots(node: Column) -> Column:
    """A path cut before each dot of its last segment."""
    p = F.split(P.base_name(node), r"\.")
    above = F.when(F.contains(node, F.lit("/")), F.concat(P.dir_name(node), F.lit("/"))).otherwise(F.lit(""))
    cut_at = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.concat(above, F.array_join(F.slice(p, F.lit(1), i), ".")))
    return F.when(F.size(p) > 1, cut_at).otherwise(F.array().cast("array<string>"))


def _copies(sent: DataFrame, new: DataFrame | None, blobs: DataFrame | None) -> DataFrame:
    """(path, kind, seq, content) of what is sent: each file, its companion, and what its type needs beside it."""
    h, meta = F.col("handler"), F.lit(P.META_SUFFIX)

    def companion(path: Column) -> Column:
        beside = F.concat_ws("/", F.when(P.dir_name(path) != "", P.dir_name(path)), F.concat(P.stem(P.base_name(path)), F.lit("."), F.col("suffix"), meta))
        own = F.when(h.isin("shared_folder", "bot"), F.concat(path, meta)).otherwise(beside)
        return F.when(F.col("meta_file") & ~path.endswith(P.META_SUFFIX) & ~h.isin(*_BUNDLES), own)

    def firsts(asking: DataFrame) -> DataFrame:
        """asking with equal rows as one, by the first seq: of copies to one path the first wins, so that a bundle's files are listed
        once and not for each of its changes."""
        return asking.groupBy(*[c for c in asking.columns if c != "seq"]).agg(F.min("seq").alias("seq"))

    def both(path: Column) -> list[Column]:
        return [path, companion(path)]

    base = F.when(~((h == "object_translation") & F.col("path").endswith("objectTranslation-meta.xml")), F.col("base_path"))
    of_bundle = F.when(h.isin("in_resource", "lwc", "in_bundle") & ~F.col("is_page") & F.col("suffix").isNotNull(), F.concat(F.col("component_path"), F.lit("."), F.col("suffix"), meta))
    folder = F.get("after", F.lit(0))
    folder_file = F.when(h == "reporting_folder", F.concat(folder, meta)).when(folder.endswith("Folder"), F.concat(folder, meta)).otherwise(F.concat(folder, F.lit("."), F.lower("suffix"), meta))
    of_folder = F.when(h.isin("in_folder", "reporting_folder"), F.concat_ws("/", "type_dir", folder_file))
    above = P.dir_name(F.col("type_dir"))
    parent_file = F.concat_ws("/", F.when(above != "", above), F.concat(F.col("parent_name"), F.lit("."), F.col("parent_suffix"), meta))
    of_parent = F.when((h == "decomposed") & F.col("parent_suffix").isNotNull(), parent_file)
    bot = F.when(h == "bot", F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.concat(F.col("parent_folder"), F.lit(".bot"))))
    listed = F.array(*both(base), of_bundle, of_folder, of_parent, *both(bot), _translation_parent())
    out = sent.select(F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("path"), F.lit("file").alias("kind"), "seq")
    out = out.unionByName(sent.where("handler = 'contained_decomposed' and split").select(F.col("holder").alias("path"), F.lit("directory").alias("kind"), "seq"))
    if new is not None:
        under = new.select(F.col("path").alias("file"), F.explode(P.ancestors(F.col("path"))).alias("_dir"))
        # files of a bundle: below its folder, or beside it with its name and a dot
        whole = firsts(sent.where(h.isin("in_resource", "lwc", "in_bundle")).select("seq", F.col("component_path").alias("_dir")))
        node = F.explode(F.concat(P.ancestors(F.col("path")), F.array("path")))
        beside = new.select(F.col("path").alias("file"), node.alias("node")).select("file", F.explode(_before_dots(F.col("node"))).alias("_dir"))
        own = _met(under.unionByName(beside)).join(whole, "_dir").select(F.col("file").alias("path"), F.lit("file").alias("kind"), "seq")
        out = out.unionByName(own)
        # files below the folder of one in a folder that have its name in their path: of each file the parts that are as long
        # as one of the folder's names, so that no folder's files meet all its names
        near = firsts(sent.where(h.isin("in_folder", "reporting_folder")).select("seq", F.col("dir").alias("_dir"), P.stem(F.col("base")).alias("_name")))
        lengths = near.groupBy("_dir").agg(F.collect_set(F.length("_name")).alias("_lengths"))
        parts = under.join(lengths, "_dir").select("file", "_dir", F.explode("_lengths").alias("n"))
        places = F.transform(F.sequence(F.lit(1), F.greatest(F.length("file") - F.col("n") + 1, F.lit(1))), lambda k: F.substring("file", k, F.col("n")))
        parts = parts.select("file", "_dir", F.explode(F.array_distinct(places)).alias("_name"))
        out = out.unionByName(parts.join(_met(near), ["_dir", "_name"]).select(F.col("file").alias("path"), F.lit("file").alias("kind"), "seq"))
        if blobs is not None:
            detail = lambda rows: rows.join(blobs, "oid").where(F.contains(F.col("content").cast("string"), F.lit(MASTER_DETAIL)))
            fields = sent.where("handler = 'custom_field' and parent_suffix is not null").select("seq", F.col("base_path").alias("path"), parent_file.alias("parent"))
            out = out.unionByName(detail(fields.join(new.select("path", "oid"), "path")).select(F.col("parent").alias("path"), F.lit("file").alias("kind"), "seq"))
            objects = firsts(sent.where("handler = 'custom_object' and type = 'CustomObject'").select("seq", F.concat_ws("/", "dir", F.lit("fields")).alias("_dir")))
            files = under.join(objects, "_dir").join(new.select(F.col("path").alias("file"), "oid"), "file")
            out = out.unionByName(detail(files).select(F.col("file").alias("path"), F.lit("file").alias("kind"), "seq"))
    return out.distinct().withColumn("content", F.lit(None).cast("binary"))
