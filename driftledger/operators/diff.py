"""What changed between two snapshots: the diff itself, renames, cancelled deletions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import cut

BLOB_MODES = ("100644", "100755", "120000")
KINDS = {"A": "add", "M": "modify", "D": "delete"}


def change_kind(status: Column) -> Column:
    """add, modify or delete for A, M and D; null else."""
    return F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[status]


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str] = ("path",), version: str = "oid") -> DataFrame:
    """(key, status, old_<version>, new_<version>): A, D and M rows of two snapshots, compared null-safely by version.

    Keys are unique and not null in each snapshot. One full outer join; the filter on the key is to be applied to both
    snapshots before. Content is no part of it: join it afterwards, for the rows that need it.
    """
    o = old.select(*key, F.col(version).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(*key, F.col(version).alias("_new"), F.lit(True).alias("_in_new"))
    both = o.join(n, list(key), "full_outer")
    status = F.when(F.col("_in_old").isNull(), "A").when(F.col("_in_new").isNull(), "D").when(~F.col("_old").eqNullSafe(F.col("_new")), "M")
    return both.withColumn("status", status).where("status is not null").select(*key, "status", F.col("_old").alias(f"old_{version}"), F.col("_new").alias(f"new_{version}"))


def counted(changes: DataFrame, seen: Observation) -> DataFrame:
    """changes, with the number of rows that pass observed as `rows`; no extra job."""
    return changes.observe(seen, F.count(F.lit(1)).alias("rows"))


def blobs_only(snapshot: DataFrame) -> DataFrame:
    """The regular files and links of a snapshot: submodules and directories go."""
    return snapshot.where(F.col("mode").isin(*BLOB_MODES))


def squeezed(content: Column) -> Column:
    """Text without white space in its lines and without blank lines. Line breaks between other lines stay."""
    lines = F.regexp_replace(F.regexp_replace(content, r"[ \t\r\f\x0B]+", ""), r"\n+", "\n")
    return F.trim(lines, F.lit("\n"))


def drop_whitespace_changes(changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """changes without the modifications of which only white space inside lines or blank lines differ. old, new: path, content.

    Content is joined for modified paths alone, once a side; a path without content on a side keeps its row.
    """
    side = lambda of, name: of.select("path", F.lit("M").alias("status"), F.struct("content").alias(name))
    both = changes.join(side(old, "_a"), ["path", "status"], "left").join(side(new, "_b"), ["path", "status"], "left")
    same = squeezed(F.col("_a")["content"]) == squeezed(F.col("_b")["content"])
    return both.where(~F.coalesce(same, F.lit(False))).select(*changes.columns)


def numbered(rows: DataFrame, keys: list[str], order: list[str], parts: int = 64, name: str = "n") -> DataFrame:
    """rows with their number, from 1, in order among those of equal keys (not null).

    Rows are range-partitioned by keys and order, numbered within (part, keys), and what earlier parts hold of the keys is added: a
    key of whatever size is dealt to many tasks.
    """
    placed = cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    own = placed.withColumn("_own", F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order)))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_rows")).withColumn("_before", before)
    return own.join(bases, [*keys, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).select(*rows.columns, name)


def exact_renames(changes: DataFrame) -> DataFrame:
    """(from_path, to_path, similarity): deletions and additions with one content, paired in order of their paths.

    Contents with one deletion or one addition are paired by an aggregation that tasks combine before the shuffle. Those with
    several of both are numbered over ranges of paths, so that no content, such as that of all empty files, is one task's.
    """
    gone, come = (F.col("status") == "D") & F.col("old_oid").isNotNull(), (F.col("status") == "A") & F.col("new_oid").isNotNull()
    sides = changes.where(gone | come).select(F.when(gone, F.col("old_oid")).otherwise(F.col("new_oid")).alias("oid"), F.when(gone, F.col("path")).alias("from_path"), F.when(come, F.col("path")).alias("to_path"))
    of = sides.groupBy("oid").agg(F.count("from_path").alias("gone"), F.count("to_path").alias("come"), F.min("from_path").alias("from_path"), F.min("to_path").alias("to_path"))
    of = cut(of.where("gone > 0 and come > 0"))
    one = of.where("gone = 1 or come = 1").select("from_path", "to_path", F.lit(100).alias("similarity"))
    many = of.where("gone > 1 and come > 1").select("oid")
    if many.isEmpty():
        return one
    rows = sides.join(many, "oid", "left_semi")
    side = lambda c: numbered(rows.where(F.col(c).isNotNull()).select("oid", c), ["oid"], [c])
    return one.unionByName(side("from_path").join(side("to_path"), ["oid", "n"]).select("from_path", "to_path", F.lit(100).alias("similarity")))


def similar_renames(changes: DataFrame, old: DataFrame, new: DataFrame, least: int = 50, rounds: list[int] | None = None) -> DataFrame:
    """(from_path, to_path, similarity): further pairs whose lines agree to `least` percent or more, each path in one pair.

    old, new: path, content. Paths with the same lines are one group. Candidates are all that can be similar enough: of the m lines
    that a group has in common with any of the other side, t must agree, so that two similar ones meet among the m - t + 1 of these that
    the fewest pairs have. Similarity is then computed from the lines, counted once each. Pairs of groups are taken from the most similar down, equal ones in an order drawn by hash, in which rounds
    of what is the best of both its groups are few (about the logarithm of the pairs; appended to rounds); a pair of groups takes
    as many pairs of paths as the smaller one has, in order of the paths. Exact renames are to be taken out before.
    """

    def sketched(status: str, content: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        paths = changes.where(F.col("status") == status).select("path").join(content.select("path", "content"), "path")
        lines = F.array_distinct(F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != ""))
        hashed = paths.select("path", F.sort_array(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines")).where(F.size("lines") > 0)
        hashed = cut(hashed.withColumn("group", F.md5(F.array_join(F.col("lines").cast("array<string>"), ","))))
        groups = hashed.groupBy("group").agg(F.first("lines").alias("lines"), F.count("*").alias("n"))
        return hashed.select("path", "group"), cut(groups.select(F.col("group").alias(side), "lines", "n"))

    (from_paths, gone), (to_paths, come) = sketched("D", old, "f"), sketched("A", new, "t")
    lines_of = lambda df, side: df.select(side, F.explode("lines").alias("line"))
    held = lambda df, side: lines_of(df, side).groupBy("line").agg(F.count("*").alias(f"{side}_n"))
    common = cut(held(gone, "f").join(held(come, "t"), "line").select("line", (F.col("f_n") * F.col("t_n")).alias("w")))

    def rarest(groups: DataFrame, side: str) -> DataFrame:
        """(side, line): the lines that a group meets similar ones by."""
        shared = lines_of(groups, side).join(common.hint("merge"), "line").groupBy(side).agg(F.sort_array(F.collect_list(F.struct("w", "line"))).alias("met"))
        agree = F.greatest(F.ceil(F.size("lines") * least / 100), F.lit(1)).cast("int")
        sure = shared.join(groups.select(side, agree.alias("agree")), side).withColumn("asked", F.size("met") - F.col("agree") + 1).where("asked > 0")
        return sure.select(side, F.explode(F.slice("met", F.lit(1), F.col("asked"))["line"]).alias("line"))

    pairs = rarest(gone, "f").join(rarest(come, "t"), "line").select("f", "t").distinct()
    pairs = pairs.join(gone.select("f", F.col("lines").alias("_a")), "f").join(come.select("t", F.col("lines").alias("_b")), "t")
    score = F.floor(100 * F.size(F.array_intersect("_a", "_b")) / F.greatest(F.size("_a"), F.size("_b"))).cast("int")
    left = cut(pairs.select("f", "t", score.alias("similarity")).where(F.col("similarity") >= least).withColumn("draw", F.md5(F.concat("f", "t"))))
    # how many of each group's paths are taken
    taken = [groups.select(side, "n", F.lit(0).cast("long").alias(f"{side}_taken")) for groups, side in ((gone, "f"), (come, "t"))]
    found: list[DataFrame] = []
    while not left.isEmpty():
        best = lambda side: left.groupBy(side).agg(F.max_by(F.struct("f", "t", "similarity"), F.struct("similarity", "draw")).alias("b")).select("b.*")
        both = best("f").join(best("t"), ["f", "t", "similarity"])
        for side, have in zip("ft", taken, strict=True):
            both = both.join(have.withColumnRenamed("n", f"{side}_n"), side)
        both = cut(both.withColumn("k", F.least(F.col("f_n") - F.col("f_taken"), F.col("t_n") - F.col("t_taken"))))
        found.append(both.select("f", "t", "similarity", "f_taken", "t_taken", "k"))
        for at, side in enumerate("ft"):
            more = both.select(side, F.col("k").alias("_k"))
            taken[at] = cut(taken[at].join(more, side, "left").select(side, "n", (F.col(f"{side}_taken") + F.coalesce("_k", F.lit(0))).alias(f"{side}_taken")))
            left = left.join(taken[at].where(F.col("n") > F.col(f"{side}_taken")).select(side), side, "left_semi")
        left = cut(left.select("f", "t", "similarity", "draw"))
    if rounds is not None:
        rounds.append(len(found))
    if not found:
        return changes.select(F.col("path").alias("from_path"), F.col("path").alias("to_path"), F.lit(0).alias("similarity")).where("false")
    matched = cut(reduce(DataFrame.unionByName, found))
    single = matched.where("k = 1").select("f", "t", "similarity", (F.col("f_taken") + 1).alias("nf"), (F.col("t_taken") + 1).alias("nt"))
    several = matched.where("k > 1").select("f", "t", "similarity", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j"), "f_taken", "t_taken")
    each = single.unionByName(several.select("f", "t", "similarity", (F.col("f_taken") + F.col("j")).alias("nf"), (F.col("t_taken") + F.col("j")).alias("nt")))

    def placed(paths: DataFrame, groups: DataFrame, side: str) -> DataFrame:
        """(side, n<side>, path): the paths of the groups by their number; groups of one path need no numbering."""
        alone = paths.join(groups.where("n = 1").select(F.col(side).alias("group")), "group", "left_semi").withColumn("n", F.lit(1).cast("long"))
        many = groups.where("n > 1").select(F.col(side).alias("group"))
        if not many.isEmpty():
            rest = numbered(paths.join(many, "group", "left_semi"), ["group"], ["path"])
            alone = alone.unionByName(rest.withColumn("n", F.col("n").cast("long")).select(*alone.columns))
        return alone.select(F.col("group").alias(side), F.col("n").alias(f"n{side}"), F.col("path").alias("from_path" if side == "f" else "to_path"))

    named = each.join(placed(from_paths, gone, "f"), ["f", "nf"]).join(placed(to_paths, come, "t"), ["t", "nt"])
    return named.select("from_path", "to_path", "similarity")


def expand_renames(changes: DataFrame) -> DataFrame:
    """(status, path): each R row (path, old_path) as a deletion of the old and an addition of the new path."""
    plain = changes.where("status <> 'R' or old_path is null").select("status", "path")
    renamed = changes.where("status = 'R' and old_path is not null")
    return plain.unionByName(renamed.select(F.lit("D").alias("status"), F.col("old_path").alias("path"))).unionByName(renamed.select(F.lit("A").alias("status"), "path"))


def cancel_deletions(changes: DataFrame, name: Column | str = "comparison_name") -> DataFrame:
    """changes without the deletions whose comparison name an addition has. Modifications neither cancel nor are cancelled.

    One left anti join; only names of additions travel.
    """
    named = changes.withColumn("_name", F.col(name) if isinstance(name, str) else name)
    added = named.where("status = 'A'").select("_name").distinct()
    stays = named.where("status <> 'D'").unionByName(named.where("status = 'D'").join(added, "_name", "left_anti").select(*named.columns))
    return stays.drop("_name")
