"""What may not grow faster than the input: rows between steps, and what the driver is asked to hold."""

from pyspark.sql import functions as F

from driftledger.operators import diff as D
from driftledger.operators import handlers
from driftledger.operators import registry as R
from driftledger.operators import trees as T
from driftledger.plans import catalogue  # noqa: F401  its end loads the others
from driftledger.plans import tree_catalogue as Q
from driftledger.sources import snapshots as S

SNAPSHOT = "path string, oid string, mode string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def objects(spark, n):
    rows = [(f"src/objects/O{k}/{place}", f"{k}{place[:1]}", "100644") for k in range(n) for place in (f"O{k}.object-meta.xml", "fields/X.field-meta.xml")]
    return spark.createDataFrame(rows, SNAPSHOT)


def test_copies_broadcast_no_snapshot(spark, tmp_path):
    """Small files on disk, of which each row becomes one for each directory above it."""
    objects(spark, 20).write.parquet(str(tmp_path / "new"))
    new = spark.read.parquet(str(tmp_path / "new"))
    blobs = new.select("oid", F.lit("<CustomField><type>MasterDetail</type></CustomField>").cast("binary").alias("content"))
    copies = Q.collected(spark, new.where("false"), new, blobs).copies.where("kind = 'file'")
    assert "BroadcastExchange" not in plan_of(copies)
    assert {r.path for r in copies.select("path").collect()} == {r.path for r in new.collect()}


def test_files_of_a_bundle_are_listed_once_for_all_its_changes(spark):
    """Fifty changed files of one bundle beside fifty others: not fifty rows for each of the hundred, and the first copy as before."""
    rows = [(f"src/lwc/b/f{k}.js", str(k), "100644") for k in range(100)]
    new = spark.createDataFrame(rows, SNAPSHOT)
    copies = Q.collected(spark, new.where("cast(oid as int) >= 50"), new).copies.cache()
    assert copies.count() <= 200 and copies.select("path").distinct().count() == 100
    first = copies.groupBy("path").agg(F.min("seq").alias("seq"))
    least = min(r[0] for r in new.where("cast(oid as int) < 50").select(F.xxhash64("path")).collect())
    assert {r.seq for r in first.collect()} == {least}


def described(spark, monkeypatch, rows):
    """(what the handlers know of changes, the plans that were cut, the last one last)."""
    plans, cut = [], handlers.cut
    monkeypatch.setattr(handlers, "cut", lambda df: (plans.append(plan_text(df)), cut(df))[1])
    changes = spark.createDataFrame(rows, "status string, path string, type string")
    snapshot = spark.createDataFrame([(r[1], "1") for r in rows] + [("src/reports/a/b.report-meta.xml", "1"), ("other/O2.object-meta.xml", "1")], "path string, oid string")
    return handlers.describe(changes, R.Registry.of(spark, Q.TYPES), snapshot, snapshot), plans


def plan_text(df):
    spark = df.sparkSession
    most = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", most)


PLAIN = [
    ("A", "src/objectTranslations/T/F.fieldTranslation-meta.xml", "CustomObjectTranslation"), ("D", "src/objectTranslations/T/T.objectTranslation-meta.xml", "CustomObjectTranslation"),
    ("M", "src/objects/O/O.object-meta.xml", "CustomObject"), ("M", "src/objects/O/O.object-meta.xml", "CustomObject"), ("A", "src/objects/objects/P.v2.object-meta.xml", "CustomObject"),
]


def test_changes_that_ask_no_snapshot_are_not_joined_with_it(spark, monkeypatch):
    """Their place is told by their path, in expressions that are computed once and not for each use and part."""
    got, plans = described(spark, monkeypatch, PLAIN)
    assert "LeftOuter" not in plans[-1] and plans[-1].count("element_at(") < 10
    assert sorted((r.path[4:], r.component_path[4:], "/".join(r.after), r.member) for r in got.collect()) == [
        ("objectTranslations/T/F.fieldTranslation-meta.xml", "objectTranslations/T", "T/F.fieldTranslation-meta.xml", "T"),
        ("objectTranslations/T/T.objectTranslation-meta.xml", "objectTranslations/T", "T/T.objectTranslation-meta.xml", "T"),
        ("objects/O/O.object-meta.xml", "objects/O", "O/O.object-meta.xml", "O"), ("objects/O/O.object-meta.xml", "objects/O", "O/O.object-meta.xml", "O"),
        ("objects/objects/P.v2.object-meta.xml", "objects/objects/P.v2", "P.v2.object-meta.xml", "P.v2"),
    ]


def test_changes_that_ask_a_snapshot_are_told_by_it(spark, monkeypatch):
    """One below a component, one outside of its type's directory, one at the root, beside one that asks nothing; and none at all."""
    rows = [("M", "src/reports/a/b/c/r.report-meta.xml", "Report"), ("A", "other/O2/O2.object-meta.xml", "CustomObject"), ("M", "O3.object", "CustomObject"), PLAIN[0]]
    got, plans = described(spark, monkeypatch, rows)
    assert plans[-1].count("LeftOuter") >= 2
    assert {r.path: (r.component_path, r.member) for r in got.collect()} == {
        "src/reports/a/b/c/r.report-meta.xml": ("src/reports/a/b", "a/b/c/r"), "other/O2/O2.object-meta.xml": ("other/O2", "O2"),
        "O3.object": ("/O3", "O3"), PLAIN[0][1]: ("src/objectTranslations/T", "T"),
    }
    assert described(spark, monkeypatch, [])[0].count() == 0


def test_only_deletions_that_ask_are_shuffled_to_what_exists(spark, monkeypatch):
    """Not the others, which have no path to ask for: null would be one task's."""
    plans, cut = [], handlers.cut
    monkeypatch.setattr(handlers, "cut", lambda df: (plans.append(plan_text(df)), cut(df))[1])
    changes = spark.createDataFrame(PLAIN, "status string, path string, type string")
    snapshot = spark.createDataFrame([(r[1], "1") for r in PLAIN if r[0] != "D"], "path string, oid string")
    found = handlers.collect(changes, R.Registry.of(spark, Q.TYPES), snapshot, snapshot)
    asked = [x for x in plans if "_there" in x]
    assert len(asked) == 1 and "Union" in asked[0] and asked[0].count("LeftOuter") == 1
    assert {tuple(r) for r in found.elements.where("member = 'T'").collect()} == {("package", "CustomObjectTranslation", "T", k) for k in ("add", "delete")}


def test_merges_far_back_take_few_rounds(spark):
    """Sixty histories of 400 commits, of which some merge the one before: not a round for each."""
    n = 24_000
    k = F.col("id")
    parents = F.when(k % 400 == 1, F.array().cast("array<long>")).when(k % 100 == 7, F.array(k - 1, k - 390)).otherwise(F.array(k - 1))
    commits = spark.range(n).select(k.cast("string").alias("id"), parents.cast("array<string>").alias("parents"))
    rounds = []
    got = T.ancestors(T.chains(commits), spark.createDataFrame([(str(n - 1),)], "id string"), rounds)
    seen, todo = set(), [n - 1]
    while todo:
        c = todo.pop()
        if 0 <= c < n and c not in seen:
            seen.add(c)
            todo += [] if c % 400 == 1 else [c - 1, c - 390] if c % 100 == 7 else [c - 1]
    assert sorted(int(r.id) for r in got.collect()) == sorted(seen)
    assert rounds[0] <= 4


def test_common_ancestors_of_merges_far_back_take_few_rounds(spark):
    """The same histories: what the last commit and one of the history before have in common at best."""
    n, k = 8_000, F.col("id")
    parents = lambda c: [] if c % 400 == 1 else [c - 1, c - 390] if c % 100 == 7 else [c - 1]
    commits = spark.createDataFrame([(str(c), [str(p) for p in parents(c)]) for c in range(n)], "id string, parents array<string>")

    def reach(todo):
        seen = set()
        while todo:
            c = todo.pop()
            if 0 <= c < n and c not in seen:
                seen.add(c)
                todo += parents(c)
        return seen

    both, rounds = reach([n - 1]) & reach([n - 401]), []
    got = T.best_common_ancestors(commits, str(n - 1), str(n - 401), rounds=rounds)
    assert {int(r.id) for r in got.collect()} == both - {p for c in both for p in parents(c)}
    assert rounds[0] <= 4


def test_every_similar_rename_is_found(spark):
    """Pairs that agree in just half of their lines, 4,000 of them: bands of hashes miss some."""
    of = lambda side, edited: spark.range(4000).select(F.concat(F.lit(side), F.col("id").cast("string")).alias("path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.col("id").cast("string"), F.lit(" line "), i.cast("string"), F.when(i <= 6, edited).otherwise(""))), "\n").alias("content"))
    old, new = of("d/", ""), of("a/", " edited")
    changes = old.selectExpr("path", "'D' as status").unionByName(new.selectExpr("path", "'A' as status"))
    got = D.similar_renames(changes, old, new)
    assert {tuple(r) for r in got.collect()} == {(f"d/{k}", f"a/{k}", 50) for k in range(4000)}


def test_contents_that_are_no_pointers_are_not_shuffled(spark):
    """Contents without an id, which all had the same key of the join."""
    sha = "a" * 64
    rows = [(str(k), bytearray(b"text")) for k in range(8)] + [("p", bytearray(f"version https://git-lfs.github.com/spec/v1\noid sha256:{sha}\nsize 1\n".encode()))]
    got = S.with_lfs(spark.createDataFrame(rows, "oid string, content binary").repartition(4), spark.createDataFrame([(sha, bytearray(b"object"))], "sha256 string, content binary").hint("merge"))
    assert {r.oid: bytes(r.content) for r in got.collect()} == {str(k): b"text" for k in range(8)} | {"p": b"object"}
    assert sum(r[0] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect() if r[0] < 8) == 9
