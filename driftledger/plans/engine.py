"""A whole delta between two snapshots, from changes to manifests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.paths import canonical_scopes, in_scope
from ..functions.rules import Rule, kept
from ..functions.xmltree import children_of
from ..operators import changeset as C
from ..operators import collectors, copies, diff, handlers
from ..operators.registry import Registry, lookup, with_comparison_name
from ..operators.trees import tree_diff
from ..sources import sinks
from ..sources.snapshots import SourceError, checkout, first_commit, merge_base, resolve, root_tree, with_lfs


@dataclass(frozen=True)
class Options:
    """scopes: where to look; ignore, ignore_destructive, include, include_destructive: rules; renames: whether moved files are
    told from deleted and added ones, those of which similarity per cent of the lines stayed too; ignore_whitespace: whether changes of white space count; generate_delta: whether
    files are listed for copying; tree_reads: whether handlers may ask what exists in the snapshots."""

    scopes: Sequence[str] = (".",)
    ignore: list[Rule] = field(default_factory=list)
    ignore_destructive: list[Rule] | None = None
    include: list[Rule] = field(default_factory=list)
    include_destructive: list[Rule] = field(default_factory=list)
    renames: bool = False
    similarity: int = 50
    ignore_whitespace: bool = False
    generate_delta: bool = True
    tree_reads: bool = True
    api_version: int = 60


@dataclass(frozen=True)
class Result:
    """Tables: changes (status, path, type), elements, renames, copies, warnings (code, subject); and the views."""

    changes: DataFrame
    elements: DataFrame
    renames: DataFrame
    copies: DataFrame
    warnings: DataFrame
    options: Options

    @property
    def package(self) -> DataFrame:
        return C.package_view(self.elements, self.renames)

    @property
    def destructive(self) -> DataFrame:
        return C.destructive_view(self.elements, self.renames)

    @property
    def kinds(self) -> DataFrame:
        return C.kind_view(self.elements, self.renames)

    def write(self, output: str, review: bool = False, snapshot: DataFrame | None = None, blobs: DataFrame | None = None) -> list[str]:
        """Write the manifests, the review file on demand and, given the new snapshot and contents, the copies; the warnings'
        texts come back."""
        for view, name in ((self.package, sinks.PACKAGE_FILE), (self.destructive, sinks.DESTRUCTIVE_FILE), (None, sinks.EMPTY_PACKAGE_FILE)):
            sinks.write_manifest(view, self.options.api_version, output, name)
        if review:
            sinks.write_review(self.kinds, output)
        if snapshot is not None and blobs is not None:
            wanted = copies.kept_copies(copies.expand_directories(self.copies, snapshot), self.options.ignore)
            copies.write_files(copies.with_content(copies.first_copies(wanted), snapshot, blobs), output)
        return sinks.messages(self.warnings)


def typed_changes(old: DataFrame, new: DataFrame, registry: Registry, options: Options, blobs: DataFrame | None = None, raw: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((status, path, type), rename pairs): changes in scope, of known types, that the rules keep, without cancelled deletions.
    raw: the differing files, where they are known already; otherwise the snapshots are compared."""
    scopes = canonical_scopes(options.scopes)
    inside = lambda s: diff.blobs_only(s).where(in_scope(F.col("path"), scopes))
    content = lambda s: s.join(blobs, "oid").select("path", F.col("content").cast("string").alias("content"))
    raw = diff.snapshot_diff(inside(old), inside(new)) if raw is None else raw.where(in_scope(F.col("path"), scopes))
    if options.ignore_whitespace and blobs is not None:
        raw = diff.drop_whitespace_changes(raw, content(old), content(new))
    raw = cut(raw)
    pairs = diff.exact_renames(raw if options.renames else raw.where("false"))
    if options.renames and blobs is not None:
        pairs = cut(pairs)
        moved = pairs.select(F.col("from_path").alias("path")).unionByName(pairs.select(F.col("to_path").alias("path")))
        pairs = pairs.unionByName(diff.similar_renames(raw.join(moved, "path", "left_anti"), content(old), content(new), options.similarity))
    known = lookup(raw.select("status", "path"), registry).where("type is not null")
    left = known.where(kept(F.col("status"), F.col("path"), options.ignore, options.ignore_destructive))
    return cut(diff.cancel_deletions(with_comparison_name(left, registry)).select("status", "path", "type")), pairs


def _collected(outcomes: list[handlers.Outcome]) -> handlers.Outcome:
    """The outcomes as one; elements, which the views and other collectors read, and warnings are computed now."""
    union = lambda name: reduce(DataFrame.unionByName, [getattr(o, name) for o in outcomes])
    return handlers.Outcome(cut(union("elements").distinct()), union("copies"), cut(union("warnings").distinct()))


def _forced(old: DataFrame | None, new: DataFrame, first: DataFrame | None, registry: Registry, options: Options, blobs: DataFrame | None) -> handlers.Outcome:
    """What the include rules bring back: additions as changes from the first commit, deletions as changes back to it."""
    named = cut(lookup(collectors.included(new, options.include, options.include_destructive, canonical_scopes(options.scopes)), registry).where("type is not null"))
    return _collected([handlers.collect(named.where(F.col("status") == s), registry, a, b, blobs, options.generate_delta) for s, a, b in (("A", first, new), ("D", new, first))])


def _translations(elements: DataFrame, new: DataFrame, options: Options, blobs: DataFrame, written: DataFrame | None) -> handlers.Outcome:
    """The translation files of packaged flows, and their flows merged into what the output has of them."""
    files = collectors.translation_candidates(new, blobs, canonical_scopes(options.scopes), options.ignore)
    flows, own = collectors.flow_translations(elements, children_of(files, lenient=True))
    copies = collectors.merged_translations(own, written) if options.generate_delta else files.where("false")
    copies = copies.select(F.col("doc").alias("path"), F.lit("computed").alias("kind"), F.xxhash64("doc").alias("seq"), F.col("content").cast("binary").alias("content"))
    return _collected([handlers.Outcome(flows, copies, flows.select(F.lit("").alias("code"), F.lit("").alias("subject")).where("false"))])


def delta(
    old: DataFrame, new: DataFrame, registry: Registry, options: Options | None = None, blobs: DataFrame | None = None,
    first: DataFrame | None = None, objects: DataFrame | None = None, written: DataFrame | None = None, raw: DataFrame | None = None,
) -> Result:
    """The delta from one snapshot (path, oid, mode) to another. blobs: (oid, content), for questions about contents; objects:
    (sha256, content), which large-file pointers among them stand for; first: the snapshot of the first commit, against
    which forced includes are seen (without it nothing existed then); written: (doc, content), what the output folder
    already has; raw: the files in scope that differ (path, status, old_oid, new_oid), where they are known already.

    It runs in stages, each one's rows kept in the shared folder; the views are computed when they are used. A collector
    that fails gives a warning and nothing else.
    """
    options = options or Options()
    if blobs is not None and objects is not None:
        blobs = with_lfs(blobs, objects)
    changes, pairs = typed_changes(old, new, registry, options, blobs, raw)
    trees = (old, new) if options.tree_reads else (None, None)
    parts = [_collected([handlers.collect(changes, registry, *trees, blobs, options.generate_delta)])]
    asked = {}
    if options.tree_reads and (options.include or options.include_destructive):
        asked["forced includes"] = lambda: _forced(old, new, first, registry, options, blobs)
    if options.tree_reads and blobs is not None and not parts[0].elements.where("type = 'Flow' and target = 'package'").isEmpty():
        asked["flow translations"] = lambda: _translations(parts[0].elements, new, options, blobs, written)
    failed = []
    for name, collector in asked.items():
        try:
            part = collector()
            # what would fail when the copies are read fails here
            parts.append(handlers.Outcome(part.elements, cut(part.copies), part.warnings))
        except Exception as e:  # whatever fails, the other parts count
            failed.append(("collector_failed", f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}"))
    elements = C.roll_up(reduce(DataFrame.unionByName, [p.elements for p in parts]).distinct()) if len(parts) > 1 else C.roll_up(parts[0].elements)
    files = reduce(DataFrame.unionByName, [p.copies for p in parts])
    warnings = reduce(DataFrame.unionByName, [p.warnings for p in parts]).unionByName(C.bundle_warnings(reduce(DataFrame.unionByName, [p.elements for p in parts])))
    spark = old.sparkSession
    renames = spark.createDataFrame([], "type string, from_member string, to_member string")
    if options.renames:
        described = lambda side, column, status, snapshot: handlers.describe(lookup(pairs.select(F.lit(status).alias("status"), F.col(column).alias("path")), registry).where("type is not null"), registry, *snapshot).select(F.lit(side).alias("side"), "path", F.col("element_type").alias("type"), "member")
        sides = described("from", "from_path", "D", (trees[0], None)).unionByName(described("to", "to_path", "A", (None, trees[1])))
        renames = cut(C.resolve_renames(pairs, sides))
    scopes = canonical_scopes(options.scopes)
    if "." not in scopes and C.is_empty(elements, renames):
        every = diff.snapshot_diff(diff.blobs_only(old), diff.blobs_only(new))
        failed += [("nothing_in_scope", scope) for scope in collectors.unmatched_scopes(every, scopes, True)]
    if failed:
        warnings = warnings.unionByName(spark.createDataFrame(failed, "code string, subject string"))
    return Result(changes, elements, renames, files, warnings.distinct(), options)


def delta_of_revisions(
    refs: DataFrame, commits: DataFrame, trees: DataFrame, start: str, end: str, registry: Registry, options: Options | None = None,
    blobs: DataFrame | None = None, tags: DataFrame | None = None, from_merge_base: bool = False, **more: DataFrame,
) -> Result:
    """The delta from one revision to another, each a name, a tag or a commit's id: refs (name, id), tags (id, target), commits
    (id, parents, tree), trees (tree_oid, name, mode, child_oid). from_merge_base: start where the two histories last met.

    The changes come from a descent of both trees; flat snapshots are made for the questions about what exists. SourceError
    where a revision isn't known or the two have nothing in common.
    """
    options = options or Options()
    one, other = resolve(refs, commits, start, tags), resolve(refs, commits, end, tags)
    if from_merge_base:
        base = merge_base(commits, one, other)
        if base is None:
            raise SourceError(f"{start!r} and {end!r} have no common ancestor")
        one = base
    raw = tree_diff(trees, root_tree(commits, one), root_tree(commits, other), list(canonical_scopes(options.scopes))).changes
    old, new = checkout(commits, trees, one), checkout(commits, trees, other)
    if (options.include or options.include_destructive) and "first" not in more:
        more["first"] = checkout(commits, trees, first_commit(commits, other))
    return delta(old, new, registry, options, blobs, raw=cut(raw), **more)
