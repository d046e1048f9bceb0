"""Hash trees and histories against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from driftledger.operators import diff as D
from driftledger.operators import trees as T

SNAPSHOT = "revision string, path string, oid string, mode string"


def files(rnd, n):
    return {"/".join(rnd.choice("abcd") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 4))) + f"{k}.x": (str(rnd.randint(0, 9)), rnd.choice(["100644", "100755", "120000", "160000"])) for k in range(n)}


@pytest.fixture(scope="module")
def revisions(spark):
    rnd = random.Random(2)
    old = files(rnd, 120)
    new = {p: (str(rnd.randint(10, 19)), m) if rnd.random() < 0.1 else (o, m) for p, (o, m) in old.items() if rnd.random() > 0.1} | files(rnd, 8)
    # a file becomes a directory and the reverse; a mode changes alone
    old |= {"z/turn": ("1", "100644"), "z/back/in": ("2", "100644"), "m": ("3", "100644")}
    new |= {"z/turn/in": ("4", "100644"), "z/back": ("5", "100644"), "m": ("3", "100755")}
    rows = [(r, p, *v) for r, side in (("old", old), ("new", new)) for p, v in side.items()]
    trees, roots = T.trees_of(spark.createDataFrame(rows, SNAPSHOT))
    return old, new, trees, {r.revision: r.tree for r in roots.collect()}


def test_trees_flatten_to_what_they_are_made_of(revisions):
    old, new, trees, roots = revisions
    for side, name in ((old, "old"), (new, "new")):
        assert {r.path: (r.oid, r.mode) for r in T.flatten(trees, roots[name]).collect()} == side
    assert T.flatten(trees, None).isEmpty()


def test_descent_finds_what_flat_snapshots_differ_in(spark, revisions, tmp_path):
    old, new, trees, roots = revisions
    flat = lambda side: spark.createDataFrame([(p, o, m) for p, (o, m) in side.items()], "path string, oid string, mode string")
    want = sorted(tuple(r) for r in D.snapshot_diff(D.blobs_only(flat(old)), D.blobs_only(flat(new))).select("path", "status").collect())
    for table in (trees, T.store_trees(trees, str(tmp_path / "trees"))):
        got = T.tree_diff(table, roots["old"], roots["new"])
        assert sorted(tuple(r) for r in got.changes.select("path", "status").collect()) == want and ("m", "M") not in want
    assert T.tree_diff(trees, roots["old"], roots["old"]).levels == []
    added = T.tree_diff(trees, None, roots["new"]).changes.select("path", "status").collect()
    assert sorted(map(tuple, added)) == sorted((p, "A") for p, (_, m) in new.items() if m in D.BLOB_MODES)
    scoped = T.tree_diff(trees, roots["old"], roots["new"], ["z", "a/b"])
    assert sorted(tuple(r) for r in scoped.changes.select("path", "status").collect()) == [x for x in want if x[0].startswith(("z/", "a/b/"))]


def test_rows_read_grow_with_changed_directories(spark, tmp_path):
    """One changed file among 4,000 directories of five files: the descent reads its directories' shards only."""
    names = spark.range(20_000).select(F.concat_ws("/", (F.col("id") % 20).cast("string"), (F.col("id") % 4000).cast("string"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").alias("oid"))
    old = names.withColumn("revision", F.lit("old")).withColumn("mode", F.lit("100644"))
    new = old.withColumn("revision", F.lit("new")).withColumn("oid", F.when(F.col("path") == "7/3007/3007", "other").otherwise(F.col("oid")))
    trees, roots = T.trees_of(old.unionByName(new))
    by = {r.revision: r.tree for r in roots.collect()}
    stored = T.store_trees(trees, str(tmp_path / "trees"))
    got = T.tree_diff(stored, by["old"], by["new"])
    assert [tuple(r)[:2] for r in got.changes.collect()] == [("7/3007/3007", "M")]
    assert [n for n, _ in got.levels] == [1, 1, 1] and sum(n for _, n in got.levels) < 0.15 * stored.count()


def reach(parents, start):
    seen, todo = set(), [start]
    while todo:
        c = todo.pop()
        if c in parents and c not in seen:
            seen.add(c)
            todo += parents[c]
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_and_bases_against_a_walk(spark, seed):
    rnd = random.Random(seed)
    parents = {}
    for k in range(150):
        pool = [f"c{j}" for j in range(max(0, k - 12), k)]
        parents[f"c{k}"] = [] if not pool or rnd.random() < 0.03 else list(dict.fromkeys(rnd.choice(pool) for _ in range(rnd.choice([1, 1, 1, 2, 2, 3])))) + (["unknown"] if rnd.random() < 0.05 else [])
    commits = spark.createDataFrame([(k, v) for k, v in parents.items()], "id string, parents array<string>")
    of = T.chains(commits)
    starts = ["c149", "c140", "c3"]
    got = {(r.start, r.id) for r in T.ancestors(of, spark.createDataFrame([(s,) for s in starts], "id string")).collect()}
    assert got == {(s, a) for s in starts for a in reach(parents, s)}
    for one, other in (("c149", "c148"), ("c140", "c149"), ("c3", "c3")):
        common = reach(parents, one) & reach(parents, other)
        best = {c for c in common if not any(c in reach(parents, d) for d in common - {c})}
        assert {r.id for r in T.best_common_ancestors(commits, one, other, of).collect()} == best


def test_criss_cross_histories_have_two_bases(spark):
    rows = [("r", []), ("a", ["r"]), ("b", ["r"]), ("x", ["a", "b"]), ("y", ["b", "a"]), ("lone", None)]
    commits = spark.createDataFrame(rows, "id string, parents array<string>")
    assert {r.id for r in T.best_common_ancestors(commits, "x", "y").collect()} == {"a", "b"}
    assert T.best_common_ancestors(commits, "x", "lone").isEmpty()


def test_long_chains_take_few_rounds(spark):
    n = 100_000
    commits = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("parents"))
    of = T.chains(commits)
    assert of.rounds <= 20 and of.edges.isEmpty()
    assert T.ancestors(of, spark.createDataFrame([(str(n - 1),)], "id string")).count() == n


def test_exact_renames_of_many_equal_files(spark):
    rows = [("D", f"a{k:04}", "e", None) for k in range(900)] + [("A", f"b{k:04}", None, "e") for k in range(700)] + [("D", "x", "1", None), ("A", "y", None, "1"), ("D", "w", "2", None), ("A", "v2", None, "2"), ("A", "v1", None, "2"), ("A", "n", None, None), ("D", "n2", None, None)]
    changes = spark.createDataFrame(rows, "status string, path string, old_oid string, new_oid string")
    got = sorted(tuple(r)[:2] for r in D.exact_renames(changes).collect())
    assert got == sorted([(f"a{k:04}", f"b{k:04}") for k in range(700)] + [("x", "y"), ("w", "v1")])


def test_equal_scores_are_matched_in_few_rounds(spark):
    """A hundred by a hundred pairs of one score, and 5,000 paths of the same lines on either side: no path twice, none left."""
    shared = "\n".join(f"line {k}" for k in range(10))
    old = [(f"d/{k}", f"{shared}\nown d{k}") for k in range(100)] + [(f"same/{k:05}", "p\nq\nr\ns") for k in range(5000)]
    new = [(f"a/{k}", f"{shared}\nown a{k}") for k in range(100)] + [(f"equal/{k:05}", "p\nq\nr\nt") for k in range(4000)]
    sides = [spark.createDataFrame(rows, "path string, content string") for rows in (old, new)]
    changes = sides[0].selectExpr("path", "'D' as status").unionByName(sides[1].selectExpr("path", "'A' as status"))
    rounds = []
    got = [tuple(r) for r in D.similar_renames(changes, *sides, rounds=rounds).collect()]
    assert rounds[0] <= 20
    assert len(got) == 4100 == len({f for f, _, _ in got}) == len({t for _, t, _ in got})
    assert sorted((f, t) for f, t, _ in got if f.startswith("same")) == [(f"same/{k:05}", f"equal/{k:05}") for k in range(4000)]
    assert {s for f, _, s in got if f.startswith("d/")} == {90} and {s for f, _, s in got if f.startswith("same")} == {75}
    assert D.similar_renames(changes.where("false"), *sides).isEmpty()
