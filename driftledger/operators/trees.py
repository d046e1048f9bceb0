"""Revisions as hash trees: what two of them differ in, their flat snapshots, and where histories meet.

A tree is rows (tree_oid, name, mode, child_oid), an entry each; equal ids stand for equal contents. A commit is (id, tree,
parents). Trees may be stored in shards by the first digits of their ids, so that a descent reads the shards of the trees that it
asks for and no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import cut
from ..functions.paths import base_name, dir_name
from .diff import BLOB_MODES

TREE_MODE = "040000"
_SHARD = "tree_shard"


def store_trees(trees: DataFrame, folder: str, digits: int = 2) -> DataFrame:
    """trees, written to folder in shards by the first digits of their ids, and read back. Each shard is dealt to a task."""
    shard = F.substring("tree_oid", 1, digits)
    trees.select("tree_oid", "name", "mode", "child_oid", shard.alias(_SHARD)).distinct().repartition(_SHARD).write.partitionBy(_SHARD).parquet(folder)
    return trees.sparkSession.read.schema(f"tree_oid string, name string, mode string, child_oid string, {_SHARD} string").parquet(folder)


def trees_of(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trees, roots) of a snapshot (path, oid, mode) with more columns that tell snapshots apart: the entries of all directories,
    each once, and each snapshot's root (those columns, tree).

    An id is made of sums of hashes of a directory's entries, which tasks combine before the shuffle, so that no directory is
    one task's list. Directories are made from the deepest up; each level's entries are kept in the shared folder.
    """
    own = [c for c in snapshot.columns if c not in ("path", "oid", "mode")]
    depth = F.size(F.split("path", "/"))
    level = cut(snapshot.select(*own, "path", "oid", "mode", depth.alias("depth")))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    entries = lambda df: df.select(*own, dir_name(F.col("path")).alias("path"), base_name(F.col("path")).alias("name"), "mode", F.col("oid").alias("child_oid"))
    found, above = [], None
    for d in range(deepest, 0, -1):
        rows = entries(level.where(F.col("depth") == d))
        rows = rows if above is None else rows.unionByName(entries(above))
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "name", "mode", "child_oid").cast("decimal(20,0)")).cast("string")
        ids = rows.groupBy(*own, "path").agg(F.md5(F.concat_ws(",", F.count("*").cast("string"), total(1), total(2))).alias("tree_oid"))
        rows = cut(rows.join(ids, [*own, "path"]))
        found.append(rows.select("tree_oid", "name", "mode", "child_oid").distinct())
        above = rows.select(*own, "path", F.col("tree_oid").alias("oid"), F.lit(TREE_MODE).alias("mode")).distinct()
    if above is None:
        none = snapshot.select(F.lit("").alias("tree_oid"), F.lit("").alias("name"), "mode", F.lit("").alias("child_oid")).where("false")
        return none, snapshot.select(*own, F.lit("").alias("tree")).where("false")
    return cut(reduce(DataFrame.unionByName, found).distinct()), above.select(*own, F.col("oid").alias("tree"))


def _asked(trees: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries of the trees in wanted (oid); of stored shards only those that these lie in are read."""
    if _SHARD in trees.columns:
        digits = F.length(F.lit(trees.select(_SHARD).limit(1).collect()[0][0])) if not trees.isEmpty() else F.lit(2)
        shards = [r[0] for r in wanted.select(F.substring("oid", F.lit(1), digits)).distinct().collect()]  # 16 ** digits at most
        trees = trees.where(F.col(_SHARD).isin(shards))
    return trees.select("tree_oid", "name", "mode", "child_oid")


def _meets(path: Column, scopes: list[str]) -> Column:
    """Whether a directory lies in one of the scopes or one of them in it."""
    if not scopes or "." in scopes:
        return F.lit(True)
    each = [(path == s) | path.startswith(s + "/") | F.lit(s).startswith(F.concat(path, F.lit("/"))) for s in scopes]
    return reduce(lambda a, b: a | b, each)


@dataclass
class TreeDiff:
    """changes: (path, status, old_oid, new_oid); levels: (pairs of trees, entries read) of each level of the descent."""

    changes: DataFrame
    levels: list[tuple[int, int]] = field(default_factory=list)


def tree_diff(trees: DataFrame, old_root: str | None, new_root: str | None, scopes: list[str] | None = None) -> TreeDiff:
    """What differs between two trees (None: nothing there), as a diff of their flat snapshots has it: files and links added,
    deleted, or of another object id.

    A frontier of pairs of trees descends only where ids differ: a level is one join of the pairs with the entries of their trees,
    and its rows are kept in the shared folder. scopes: directories and files to look at, no others are descended to.
    """
    spark, scopes = trees.sparkSession, [s.rstrip("/") for s in scopes or []]
    frontier = spark.createDataFrame([("", old_root, new_root)] if old_root != new_root else [], "path string, old string, new string")
    out, levels = [], []
    while True:
        n = frontier.count()
        if not n:
            break
        wanted = frontier.select(F.col("old").alias("oid")).unionByName(frontier.select(F.col("new").alias("oid"))).where("oid is not null").distinct()
        entries = _asked(trees, wanted)
        # each entry under each path that its tree stands at, its side marked; entries of both sides meet by path and name
        sides = frontier.select("path", F.explode(F.array(F.struct(F.lit("o").alias("side"), F.col("old").alias("oid")), F.struct(F.lit("n").alias("side"), F.col("new").alias("oid")))).alias("s"))
        sides = sides.select("path", "s.side", F.col("s.oid").alias("tree_oid")).where("tree_oid is not null").join(entries, "tree_oid")
        full = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
        of = lambda side: F.max(F.when(F.col("side") == side, F.struct("mode", "child_oid")))
        met = sides.groupBy(full.alias("path")).agg(of("o").alias("o"), of("n").alias("n"))
        met = cut(met.where("not (o.child_oid <=> n.child_oid and (o.mode = '040000') <=> (n.mode = '040000'))"))
        levels.append((n, entries.count()))
        part = lambda side, kinds: F.when(F.col(f"{side}.mode").isin(*kinds), F.col(f"{side}.child_oid"))
        blobs = met.select("path", part("o", BLOB_MODES).alias("old_oid"), part("n", BLOB_MODES).alias("new_oid"))
        out.append(blobs.where("(old_oid is not null or new_oid is not null) and not old_oid <=> new_oid"))
        below = met.select("path", part("o", (TREE_MODE,)).alias("old"), part("n", (TREE_MODE,)).alias("new"))
        frontier = below.where("not old <=> new").where(_meets(F.col("path"), scopes))
    status = F.when(F.col("old_oid").isNull(), "A").when(F.col("new_oid").isNull(), "D").otherwise("M")
    none = spark.createDataFrame([], "path string, old_oid string, new_oid string")
    changes = reduce(DataFrame.unionByName, out, none)
    inside = F.lit(True) if not scopes or "." in scopes else reduce(lambda a, b: a | b, [(F.col("path") == s) | F.col("path").startswith(s + "/") for s in scopes])
    return TreeDiff(changes.where(inside).select("path", status.alias("status"), "old_oid", "new_oid"), levels)


def flatten(trees: DataFrame, root: str | None) -> DataFrame:
    """The snapshot (path, oid, mode) of a tree: files, links and submodules, a level of directories at a time."""
    spark = trees.sparkSession
    frontier = spark.createDataFrame([("", root)] if root is not None else [], "path string, oid string")
    out = [spark.createDataFrame([], "path string, oid string, mode string")]
    while not frontier.isEmpty():
        full = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
        rows = frontier.withColumnRenamed("oid", "tree_oid").join(_asked(trees, frontier), "tree_oid")
        rows = cut(rows.select(full.alias("path"), F.col("child_oid").alias("oid"), "mode"))
        out.append(rows.where(F.col("mode") != TREE_MODE))
        frontier = rows.where(F.col("mode") == TREE_MODE).select("path", "oid")
    return reduce(DataFrame.unionByName, out)


# --- histories: commits(id, parents array)


@dataclass
class Chains:
    """A history cut into chains of first parents. nodes: (id, chain, place), place 0 at the end that is nearest to a root; edges:
    (chain, place, to_chain, to_place, road, mile), from a commit to those parents that don't follow it in its chain. Edges stand in
    line on roads: what is before an edge on its road, of lower miles, can be taken once the edge was."""

    nodes: DataFrame
    edges: DataFrame
    rounds: int


def _lined(links: DataFrame) -> tuple[DataFrame, int]:
    """((id, end, place), rounds) of links (id, next), in which no two ids have the same next: where each id's line ends and how many
    steps away, by pointer doubling. A line of n takes about log2(n) rounds, each of as many rows as there are ids."""
    now = cut(links.select("id", F.coalesce("next", "id").alias("end"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("place")))
    rounds = 0
    while True:
        rounds += 1
        far = now.select(F.col("id").alias("end"), F.col("end").alias("further"), F.col("place").alias("more"))
        after = cut(now.join(far, "end").select("id", F.col("further").alias("end"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")))
        if not after.agg(F.max("moved")).first()[0]:
            return now, rounds
        now = after.drop("moved")


def _heirs(wanted: DataFrame) -> DataFrame:
    """(id, next) of wanted (id, next): of the ids that have one next only the least keeps it."""
    return wanted.groupBy("next").agg(F.min("id").alias("id"))


def _roads(edges: DataFrame, parts: int = 64) -> DataFrame:
    """(edge, road, mile) of edges (edge, chain, place, to_chain, to_place): from where an edge leads, one goes on by the nearest edge
    that leaves the chain there or below.

    That edge is sought over ranges of chains and places, and what earlier ranges hold of the chain is added, so that a chain with
    many merges is dealt to many tasks.
    """
    leave = edges.groupBy("chain", "place").agg(F.min("edge").alias("leaves")).select("chain", "place", F.lit(0).alias("kind"), "leaves", F.lit(None).cast("long").alias("edge"))
    come = edges.select(F.col("to_chain").alias("chain"), F.col("to_place").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("leaves"), "edge")
    placed = cut(leave.unionByName(come).repartitionByRange(parts, "chain", "place", "kind").withColumn("_part", F.spark_partition_id()))
    own = placed.withColumn("_own", F.last("leaves", True).over(W.partitionBy("_part", "chain").orderBy("place", "kind").rowsBetween(W.unboundedPreceding, 0)))
    before = F.last("_last", True).over(W.partitionBy("chain").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    ends = placed.groupBy("chain", "_part").agg(F.max_by("leaves", F.when(F.col("leaves").isNotNull(), F.col("place"))).alias("_last")).withColumn("_before", before)
    nearest = own.where("kind = 1").join(ends.select("chain", "_part", "_before"), ["chain", "_part"]).select(F.col("edge").alias("id"), F.coalesce("_own", "_before").alias("next"))
    links = edges.select(F.col("edge").alias("id")).join(_heirs(nearest.where("next is not null")), "id", "left")
    return _lined(links)[0].select(F.col("id").alias("edge"), F.col("end").alias("road"), F.col("place").alias("mile"))


def chains(commits: DataFrame) -> Chains:
    """The chains of a history and the roads of the edges between them. Parents that aren't commits are passed over."""
    known = commits.select("id", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    edges = known.select("id", F.posexplode("parents").alias("nth", "parent")).join(known.select(F.col("id").alias("parent")), "parent", "left_semi")
    edges = cut(edges.groupBy("id", "parent").agg(F.min("nth").alias("nth")))
    first = edges.groupBy("id").agg(F.min_by("parent", "nth").alias("next"))
    # of the commits with one first parent, one continues its chain
    now, rounds = _lined(known.select("id").join(_heirs(first), "id", "left"))
    nodes = now.select("id", F.col("end").alias("chain"), "place")
    to = nodes.select(F.col("id").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    across = edges.join(nodes, "id").join(to, "parent").where("chain <> to_chain or place <> to_place + 1")
    across = cut(across.select("chain", "place", "to_chain", "to_place", F.monotonically_increasing_id().alias("edge")))
    return Chains(nodes, cut(across.join(_roads(across), "edge").drop("edge")), rounds)


def ancestors(of: Chains, starts: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(start, id): the commits that each of the starts (id) descends from, itself included.

    What is reached of a chain is all below a place, and of a road all before a mile, so that a round carries a row for each start and
    chain: its highest place. The rounds are as many as one must turn between chains and roads on the way, not as there are
    generations or chains; their number is appended to rounds.
    """
    reached = frontier = cut(starts.select(F.col("id").alias("start")).distinct().join(of.nodes, F.col("start") == F.col("id")).select("start", "chain", "place"))
    taken = 0
    while not frontier.isEmpty():
        taken += 1
        over = frontier.select("start", "chain", F.col("place").alias("top")).join(of.edges, "chain").where("place <= top")
        roads = over.groupBy("start", "road").agg(F.max("mile").alias("most"))
        further = roads.join(of.edges, "road").where("mile <= most").groupBy("start", F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("place"))
        before = reached.withColumnRenamed("place", "known")
        frontier = cut(further.join(before, ["start", "chain"], "left").where("known is null or place > known").select("start", "chain", "place"))
        reached = cut(reached.unionByName(frontier).groupBy("start", "chain").agg(F.max("place").alias("place")))
    if rounds is not None:
        rounds.append(taken)
    top = reached.withColumnRenamed("place", "top")
    return of.nodes.join(top, "chain").where("place <= top").select("start", "id")


def best_common_ancestors(commits: DataFrame, one: str, other: str, of: Chains | None = None, rounds: list[int] | None = None) -> DataFrame:
    """(id): the common commits of two that no other common commit descends from; several in criss-cross histories, none where
    the two have nothing in common. rounds: as of ancestors."""
    spark = commits.sparkSession
    found = ancestors(of or chains(commits), spark.createDataFrame([(one,), (other,)], "id string"), rounds)
    common = cut(found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == (1 if one == other else 2)).select("id"))
    # the way from a common commit to one before it is all common: it begins with a parent
    parents = commits.join(common, "id", "left_semi").select(F.explode("parents").alias("id"))
    return common.join(parents, "id", "left_anti")
