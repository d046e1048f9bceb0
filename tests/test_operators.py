"""Single operators on small inputs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from driftledger.functions import paths as P
from driftledger.functions import xmltree
from driftledger.functions.rules import ignored, kept, parse_rules
from driftledger.operators import changeset as C
from driftledger.operators import collectors, copies
from driftledger.operators import diff as D
from driftledger.operators import documents as X
from driftledger.operators import registry as R
from driftledger.sources import sinks, snapshots


def column(spark, values, expression):
    """The value of an expression over `path` for each of the values."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, path string")
    return [r[0] for r in df.select("k", expression.alias("v")).orderBy("k").select("v").collect()]


def test_scopes(spark):
    path = F.col("path")
    values = ["src", "src/a", "src-legacy/a", "x/src/a", None]
    assert column(spark, values, P.in_scope(path, ["src"])) == [True, True, False, False, None]
    assert column(spark, values, P.in_scope(path, [])) == [False] * 5
    assert column(spark, values, P.in_scope(path, ["./"])) == [True] * 5
    assert P.canonical_scopes(["a/b/", "./a/b", "", "."][:2] + ["."]) == ["a/b", "."]
    with pytest.raises(P.ScopeError, match=r"':x'.*'\.\./a'.*'/abs'"):
        P.canonical_scopes([":x", "../a", "/abs", "fine"])


def test_pathspecs(spark):
    values = ["a/b/c.cls", "a/d.cls", "a/bb/c.txt", "ab/c.cls"]
    assert column(spark, values, P.matches_pathspec(F.col("path"), ["./a/*.cls"])) == [True, True, False, False]
    assert column(spark, values, P.matches_pathspec(F.col("path"), ["a/?.cls", "ab"])) == [False, True, False, True]
    assert column(spark, values, P.matches_pathspec(F.col("path"), ["[a]*"])) == [False] * 4


def test_path_parts(spark):
    values = ["a/b.x/c.cls-meta.xml", "c", ".hidden", "a/.b"]
    assert column(spark, values, P.extension(F.col("path"))) == ["cls", "c", "hidden", "b"]
    assert column(spark, values, P.stem(P.without_meta(P.base_name(F.col("path"))))) == ["c", "c", ".hidden", ".b"]
    assert column(spark, values, P.dir_name(F.col("path"))) == ["a/b.x", "", "", "a"]
    assert column(spark, values[:2], P.ancestors(F.col("path"))) == [["a", "a/b.x"], []]


@pytest.mark.parametrize(
    ("rules", "paths"),
    [
        ("*.log\n!keep.log", {"a.log": True, "d/a.LOG": True, "keep.log": False, "a.txt": False}),
        ("build/\n!build/keep", {"build": False, "build/keep": True, "x/build/y": True}),
        ("/top\nmid/dle", {"top": True, "a/top": False, "mid/dle": True, "a/mid/dle": False, "top/x": True}),
        ("a/**/z\n**/q\nr/**", {"a/z": True, "a/b/c/z": True, "x/y/q": True, "r/s": True, "r": False}),
        ("# note\n\n\\#x\nf[0-9]?.md\n", {"#x": True, "f1a.md": True, "fa1.md": False, "# note": False}),
        ("", {"x": False}),
    ],
)
def test_ignore_rules(spark, rules, paths):
    assert column(spark, list(paths), ignored(F.col("path"), parse_rules(rules))) == list(paths.values())


def test_deletions_have_rules_of_their_own(spark):
    df = spark.createDataFrame([("D", "a/x"), ("A", "a/x"), ("M", "b"), ("D", "o/recordTypes/r"), ("R", "a/x")], "status string, path string")
    own = lambda *of: [tuple(r) for r in df.where(kept(F.col("status"), F.col("path"), *of)).collect()]
    assert own(parse_rules("a/"), None) == [("M", "b"), ("R", "a/x")]
    assert own(parse_rules("a/"), []) == [("D", "a/x"), ("M", "b"), ("R", "a/x")]


def test_diff_is_null_safe_and_symmetric(spark):
    schema = "path string, oid string"
    a = spark.createDataFrame([("same", None), ("null", None), ("gone", "1"), ("mod", "1")], schema)
    b = spark.createDataFrame([("same", None), ("null", "1"), ("come", "1"), ("mod", "2")], schema)
    rows = lambda x, y: {(r.path, r.status) for r in D.snapshot_diff(x, y).collect()}
    assert rows(a, b) == {("null", "M"), ("gone", "D"), ("come", "A"), ("mod", "M")}
    assert rows(b, a) == {("null", "M"), ("gone", "A"), ("come", "D"), ("mod", "M")}
    assert rows(a, a) == set() and rows(a.limit(0), a.limit(0)) == set()


def test_cancelled_deletions(spark):
    df = spark.createDataFrame([("D", "x"), ("D", "y"), ("A", "x"), ("M", "y")], "status string, comparison_name string")
    assert {tuple(r) for r in D.cancel_deletions(df).collect()} == {("D", "y"), ("A", "x"), ("M", "y")}


def test_similar_renames(spark):
    lines = [f"line {k}" for k in range(40)]
    files = lambda d: spark.createDataFrame([(p, "\n".join(x)) for p, x in d.items()], "path string, content string")
    old = files({"old/a": lines, "old/b": ["other"] * 3, "keep": ["k"]})
    new = files({"new/a": [*lines[:34], "changed"], "new/c": ["nothing", "alike"], "keep": ["k"]})
    changes = spark.createDataFrame([("D", "old/a"), ("D", "old/b"), ("A", "new/a"), ("A", "new/c")], "status string, path string")
    assert [tuple(r) for r in D.similar_renames(changes, old, new).collect()] == [("old/a", "new/a", 85)]


def test_similar_renames_pair_what_the_best_leave(spark):
    files = lambda d: spark.createDataFrame([(p, "\n".join(x)) for p, x in d.items()], "path string, content string")
    lines = [f"line {k}" for k in range(40)]
    old, new = {"a": lines, "b": lines[:36]}, {"x": [*lines[:39], "y"], "z": [*lines[:30], *"pqrstu"], "w": ["none"]}
    changes = spark.createDataFrame([("D", p) for p in old] + [("A", p) for p in new], "status string, path string")
    assert {tuple(r) for r in D.similar_renames(changes, files(old), files(new)).collect()} == {("a", "x", 97), ("b", "z", 83)}
    assert D.similar_renames(changes.limit(0), files(old), files(new)).count() == 0


def test_registry_conversion_and_overlay():
    standard = {
        "apexclass": {"name": "ApexClass", "suffix": "cls", "directoryName": "classes", "strategies": {"adapter": "matchingContentFile"}},
        "report": {"name": "Report", "suffix": "report", "directoryName": "reports", "inFolder": True, "folderType": "reportfolder"},
        "dashboard": {"name": "Dashboard", "suffix": "dashboard", "directoryName": "dashboards", "inFolder": True, "folderType": "nowhere"},
        "document": {"name": "Document", "suffix": "document", "directoryName": "documents", "inFolder": True, "folderType": "documentfolder"},
        "documentfolder": {"name": "DocumentFolder", "suffix": "documentFolder", "directoryName": "documents"},
        "folderalias": {"name": "OldReportFolder", "suffix": "oldFolder", "aliasFor": "reportfolder"},
        "plain": {"name": "Plain", "suffix": "plain", "directoryName": "plains", "folderType": "other"},
        "reportfolder": {"name": "ReportFolder", "suffix": "reportFolder", "directoryName": "reports"},
        "customobject": {
            "name": "CustomObject", "suffix": "object", "directoryName": "objects", "strategies": {"adapter": "decomposed", "decomposition": "folderPerType"},
            "children": {"directories": {"fields": "customfield"}, "types": {
                "customfield": {"name": "CustomField", "suffix": "field", "directoryName": "fields", "xmlElementName": "fields", "uniqueIdElement": "fullName"},
                "odd": {"name": "Odd", "suffix": "object", "directoryName": "objects"},
                "own": {"name": "Own", "suffix": "own", "directoryName": "owns", "xmlElementName": "notListed"}}},
        },
    }
    types = {t.xml_name: t for t in R.from_standard(standard)}
    assert set(types) == {"ApexClass", "Report", "Dashboard", "Document", "Plain", "CustomObject", "CustomField", "Odd", "Own"}
    assert types["ApexClass"].meta_file and types["Report"].content == (("report", "Report"), ("reportFolder", "ReportFolder"))
    assert types["Report"].in_folder and types["Document"].in_folder and not types["Plain"].in_folder
    assert types["Dashboard"].content == types["Document"].content == () and types["Own"].directory_name == "owns" and types["Own"].suffix == "own"
    assert types["CustomField"].directory_name == "fields" and types["CustomField"].key == "fullName"
    assert types["Odd"].suffix is None and types["Odd"].directory_name is None
    merged = R.overlay(types.values(), [R.TypeDef("ApexClass", suffix="apex"), R.TypeDef("New")])
    assert {t.xml_name: t.suffix for t in merged}["ApexClass"] == "apex" and merged[-1].xml_name == "New"
    stated = R.overlay([R.TypeDef("A", suffix="a", meta_file=True, in_folder=True)], R.from_json([{"xmlName": "A", "metaFile": False}]))
    assert (stated[0].suffix, stated[0].meta_file, stated[0].in_folder) == ("a", False, True)
    with pytest.raises(R.RegistryError, match="unknown fields"):
        R.from_json([{"xmlName": "X", "nonsense": 1}])
    with pytest.raises(R.RegistryError, match="xmlName"):
        R.from_json([{"suffix": "x"}])


def test_type_lookup_order(spark):
    from tests.trees import registry

    paths = {
        "a/classes/X.cls": "ApexClass", "a/classes/X.cls-meta.xml": "ApexClass", "a/reports/F/flows/R.report": "Report", "a/flows/objects/x": "CustomObject",
        "a/lwc/c/classes/x.js": "LightningComponentBundle", "x.unknown": None, "CustomLabels": "CustomLabels", "cls": None, "a/reports/F.reportFolder-meta.xml": "Report",
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.type for r in R.lookup(df, registry(spark)).collect()} == paths


def _rules(spark):
    rows = [("keyed", "name", "Keyed", False), ("hidden", "name", "Hidden", True), ("list", X.ARRAY_KEY, "List", False), ("obj", X.OBJECT_KEY, "Obj", True), ("less", None, "Less", True)]
    return spark.createDataFrame(rows, "tag string, key string, xml_name string, excluded boolean")


def _diff(spark, old, new):
    schema = "doc string, tag string, pos long, value string"
    rows = lambda items: spark.createDataFrame([("d", t, k, json.dumps(v)) for k, (t, v) in enumerate(items)], schema)
    d = X.document_diff(rows(old), rows(new), _rules(spark))
    changes = sorted((r.kind, r.type, r.member) for r in d.changes.collect())
    flag = {r.doc: r.has_package_content for r in d.documents.collect()}.get("d")
    left = [(r.tag, json.loads(r.value)) for r in d.retained.orderBy("tag_order", "pos").collect()]
    return changes, flag, left


def k(name, v="1", **more):
    return ("keyed", {"name": name, "v": v, **more})


@pytest.mark.parametrize(
    ("old", "new", "changes", "flag", "left"),
    [
        ([k("a"), k("b"), k("c")], [k("a"), k("b", "2"), k("n")], [("add", "Keyed", "n"), ("delete", "Keyed", "c"), ("modify", "Keyed", "b")], True, [k("b", "2"), k("n")]),
        ([("keyed", {"v": "1", "name": "a"})], [k("a")], [], False, []),  # the order of fields doesn't matter
        ([k("a", "1"), k("a", "2")], [k("a", "2"), k("a", "2")], [("add", "Keyed", "a")], True, [k("a", "2")]),  # last old, first new
        ([("keyed", {"v": "1"})], [("keyed", {"v": "2"})], [], False, []),  # without the key
        ([k("a")], [], [("delete", "Keyed", "a")], False, []),
        ([("hidden", {"name": "x", "v": "1"})], [("hidden", {"name": "x", "v": "2"})], [], True, [("hidden", {"name": "x", "v": "2"})]),
        ([("list", {"v": 1}), ("list", {"v": 2})], [("list", {"v": 2}), ("list", {"v": 1})], [], True, [("list", {"v": 2}), ("list", {"v": 1})]),
        ([("list", {"v": 1})], [("list", {"v": 1})], [], False, []),
        ([("list", {"v": 1})], [], [], False, []),  # a list that is gone goes unseen
        ([("obj", {"a": 1, "b": 2})], [("obj", {"b": 2, "a": 1}), ("obj", {"a": 1, "b": 2})], [], True, [("obj", {"b": 2, "a": 1})]),
        ([("less", "x"), k("a")], [("less", "x"), k("a", "2")], [("modify", "Keyed", "a")], True, [("less", "x"), k("a", "2")]),
        ([("other", "x")], [("other", "y")], [], True, [("other", "y")]),
        ([], [], [], None, []),
    ],
)
def test_document_diff(spark, old, new, changes, flag, left):
    assert _diff(spark, old, new) == (changes, flag, left)


def test_xml_round_trip():
    text = '<?xml version="1.0" encoding="UTF-8"?>\n<Root xmlns="u">\n    <!-- c -->\n    <a x="1">\n        <b>t &amp; u</b>\n        <b></b>\n    </a>\n    <leaf>v</leaf>\n</Root>\n'
    *children, (_, root) = xmltree.root_children(text)
    assert children == [("#comment", " c "), ("a", {"@_x": "1", "b": ["t &amp; u", {}]}), ("leaf", "v")]
    assert xmltree.render(root["name"], root["attributes"], children) == text
    assert xmltree.render("P", {}, [("m", "a<&>")], escape=True, trailing_newline=False).endswith("<m>a&lt;&amp;&gt;</m>\n</P>")


@pytest.mark.parametrize("text", ["<a><b></a>", "<a>", "", "plain", "<a/><b/>", "<a></a>x", "<a><b x=1></b></a>"])
def test_malformed_documents(text):
    with pytest.raises(xmltree.MalformedDocument):
        list(xmltree.root_children(text))


def test_lenient_reading_keeps_what_came_before_an_error(spark):
    docs = spark.createDataFrame([(1, "<r><a>1</a><b></r>"), (2, None), (3, " "), (4, "<r><a>1</a></r>")], "doc int, content string")
    rows = lambda lenient: {(r.doc, r.tag, r.pos, r.value) for r in xmltree.children_of(docs, lenient).collect() if r.tag}
    assert rows(True) == {(1, "a", 1, '"1"'), (4, "a", 1, '"1"')}
    assert rows(False) == {(4, "a", 1, '"1"')}
    assert [r.doc for r in xmltree.children_of(docs).where("error is not null").collect()] == [1]


def test_views(spark):
    e = spark.createDataFrame([("package", "T", "a", "add"), ("destructive", "T", "b", "delete"), ("destructive", "T", "a", "delete"), ("package", "T", "c", "delete"), ("destructive", "U", "b", "delete")], "target string, type string, member string, change_kind string")
    r = spark.createDataFrame([("T", "old", "new"), ("T", "old", "new"), ("T", "x", "x"), ("U", "o", "b")], "type string, from_member string, to_member string")
    rows = lambda df: {tuple(x) for x in df.collect()}
    assert rows(C.package_view(e, r)) == {("T", "a"), ("T", "c"), ("T", "new"), ("U", "b")}
    assert rows(C.destructive_view(e, r)) == {("T", "b"), ("T", "old"), ("U", "o")}
    assert rows(C.kind_view(e, r)) == {("add", "T", "a", None), ("delete", "T", "b", None), ("delete", "T", "c", None), ("delete", "U", "b", None), ("rename", "T", "old", "new"), ("rename", "U", "o", "b")}
    assert not C.is_empty(e, r) and C.is_empty(e.limit(0), r.limit(0))
    assert [(x.place, x.type, x.members) for x in C.manifest(C.package_view(e, r), first="U").orderBy("place").collect()] == [(1, "U", ["b"]), (2, "T", ["a", "c", "new"])]


def test_locale_order(spark):
    view = spark.createDataFrame([("b", "é"), ("b", "f"), ("b", "E"), ("A", "x"), ("CustomObject", "y")], "type string, member string")
    assert [(x.type, x.members) for x in C.manifest(view).orderBy("place").collect()] == [("CustomObject", ["y"]), ("A", ["x"]), ("b", ["E", "é", "f"])]


def test_roll_up(spark):
    B, P_ = "DigitalExperienceBundle", "DigitalExperience"
    e = spark.createDataFrame([("package", B, "s/a"), ("package", P_, "s/a.v/h"), ("destructive", P_, "s/a.v/i"), ("package", P_, "nodot"), ("destructive", B, "s/z")], "target string, type string, member string")
    assert {tuple(r) for r in C.roll_up(e).collect()} == {("package", B, "s/a"), ("destructive", P_, "s/a.v/i"), ("package", P_, "nodot"), ("destructive", B, "s/z")}
    assert [tuple(r) for r in C.bundle_warnings(e).collect()] == [("bundle_deletion", "s/z")]


def test_flow_translations_and_merge(spark):
    e = spark.createDataFrame([("package", "Flow", "F1", "add"), ("destructive", "Flow", "F2", "delete")], "target string, type string, member string, change_kind string")
    rows = [("t/fr.translation-meta.xml", "flowDefinitions", 1, '{"fullName":"F1"}'), ("t/fr.translation-meta.xml", "flowDefinitions", 2, '{"fullName":"F2"}'), ("t/de.translation-meta.xml", "bots", 1, '{"fullName":"F1"}')]
    more, own = collectors.flow_translations(e, spark.createDataFrame(rows, "doc string, tag string, pos int, value string"))
    assert [tuple(r) for r in more.collect()] == [("package", "Translations", "fr", "modify")]
    assert [r.name for r in own.collect()] == ["F1"]
    there = own.withColumn("value", F.lit("old"))
    assert [r.value for r in collectors.merged_definitions(there, own).collect()] == ["old"]


def test_unmatched_scopes(spark):
    df = spark.createDataFrame([("a/x",)], "path string")
    assert collectors.unmatched_scopes(df, ["b"], True) == ["b"]
    assert collectors.unmatched_scopes(df, ["a"], True) == [] == collectors.unmatched_scopes(df, ["."], True) == collectors.unmatched_scopes(df.limit(0), ["b"], True)


def test_copies(spark, tmp_path):
    rows = [("p", "file", 1, None), ("p", "computed", 2, b"c"), ("d", "directory", 3, None), ("q", "file", 9, None), ("q", "file", 4, None)]
    asked = spark.createDataFrame(rows, "path string, kind string, seq long, content binary")
    snapshot = spark.createDataFrame([("p", "1"), ("d/e/f", "2"), ("dd/x", "3"), ("q", "4")], "path string, oid string")
    blobs = spark.createDataFrame([("1", b"1"), ("2", b"2"), ("3", b"3"), ("4", b"4")], "oid string, content binary")
    files = copies.first_copies(copies.expand_directories(asked, snapshot))
    assert {(r.path, r.kind, r.seq) for r in files.collect()} == {("p", "computed", 2), ("d/e/f", "file", 3), ("q", "file", 4)}
    copies.write_files(copies.with_content(files, snapshot, blobs), str(tmp_path))
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {"p": b"c", "d/e/f": b"2", "q": b"4"}
    for bad in ("../x", "/abs", "a/../..", "."):
        with pytest.raises(ValueError, match="leaves"):
            copies.inside("/out", bad)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.txt").write_bytes(b"hello\n")
    snapshot, blobs = snapshots.read_directory(spark, str(tmp_path))
    assert [(r.path, r.oid) for r in snapshot.collect()] == [("a/f.txt", "ce013625030ba8dba906f756967f9e9ca394464a")]
    assert snapshots.files_with_content(snapshot, blobs, "a").count() == 1 and snapshots.scoped(snapshot, ["b"]).isEmpty()
    pointer = b"version https://git-lfs.github.com/spec/v1\noid sha256:" + b"a" * 64 + b"\nsize 3\n"
    held = spark.createDataFrame([("1", pointer), ("2", b"plain"), ("3", pointer.replace(b"a" * 64, b"../x"))], "oid string, content binary")
    objects = spark.createDataFrame([("a" * 64, b"big")], "sha256 string, content binary")
    got = {r.oid: bytes(r.content) for r in snapshots.with_lfs(held, objects).collect()}
    assert got["1"] == b"big" and got["2"] == b"plain" and got["3"].startswith(b"version")


def test_revisions(spark):
    commits = spark.createDataFrame([("r", []), ("a", ["r"]), ("b", ["a"]), ("c", ["a"]), ("m", ["b", "c"]), ("lone", [])], "id string, parents array<string>")
    refs = spark.createDataFrame([("main", "m"), ("tag", "main")], "name string, id string")
    assert snapshots.resolve(refs, commits, "tag") == "m" and snapshots.first_commit(commits, "m") == "r"
    assert snapshots.merge_base(commits, "b", "c") == "a" and snapshots.merge_base(commits, "b", "lone") is None
    with pytest.raises(snapshots.SourceError):
        snapshots.resolve(refs, commits, "nothing")


def test_api_version():
    assert snapshots.api_version(58, None, 60) == (58, []) and snapshots.api_version(None, '{"sourceApiVersion": "59.0"}', 60) == (59, [])
    assert snapshots.api_version(99, None, 60)[0] == 60 == snapshots.api_version(None, "not json", 60)[0]
    with pytest.raises(snapshots.SourceError):
        snapshots.api_version(None, None, None)


def test_messages():
    assert sinks.sanitised("a\nb\\c" + "x" * 300) == "a\\u{a}b\\u{5c}c" + "x" * 195
    assert json.loads(sinks.result_json("out/", ["w"], "bad")) == {"output-dir": "out", "error": "bad", "warnings": ["w"]}


def test_whitespace_query_takes_all_documents(spark, tmp_path):
    from driftledger.plans import catalogue

    rows = [(0, "a b"), (1, "a"), (2, "a  b"), (3, "a"), (4, ""), (5, None), (8, None), (12, "c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for side in catalogue.spaced_documents(spark, str(tmp_path)):
        assert sorted(r.path for r in side.collect()) == [k for k, _ in rows]
    got = catalogue.QUERIES["whitespace_only_changes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, "M"), (12, "M")]


def test_lists_are_compared_place_by_place(spark):
    from driftledger.operators import documents as X

    rows = lambda lists: spark.createDataFrame([(d, "t", k, v) for d, l in lists.items() for k, v in enumerate(l)], "doc long, tag string, pos long, value string")  # noqa: E731, E741
    rules = spark.createDataFrame([("t", X.ARRAY_KEY, "T", False)], "tag string, key string, xml_name string, excluded boolean")
    a, b = '{"x": 1, "y": 2}', '{"x": 3}'
    old = rows({1: [a, b], 2: [a, b], 3: [a, b], 4: [a], 5: [a, a], 7: [a], 8: ["no json"]})
    new = rows({1: ['{"y": 2, "x": 1}', b], 2: [b, a], 3: [a], 4: [a, a], 5: [a, a], 6: [a], 8: ["no json"]})
    got = X.document_diff(old, new, rules).documents
    assert {r.doc: r.has_package_content for r in got.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False, 8: False}
    assert "collect_list" not in got._jdf.queryExecution().toString()


def shuffled(df):
    """The columns of each shuffle of the plan, the last one first."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [{c.split("#")[0] for c in found.split(", ")} for found in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)]


def children(spark, rows):
    return spark.createDataFrame(rows, "doc long, tag string, pos long, value string")


def test_texts_of_keyed_children_are_shuffled_once(spark):
    """For what is left of a document: all texts by key, those of lists by place, and no member beside its key."""
    rows = children(spark, [(1, "keyed", 0, '{"name": "a"}')])
    carried = shuffled(X.document_diff(rows, rows, _rules(spark)).documents)
    assert sum("value" in columns for columns in carried) == 1 and sum("pos" in columns for columns in carried) == 1
    assert not any(columns & {"member", "xml_name", "excluded"} for columns in carried)


def test_changes_of_keyed_children_are_one_shuffle(spark):
    """And lists are left out before it: their rules aren't met."""
    rows = children(spark, [(1, "keyed", 0, '{"name": "a"}'), (1, "list", 1, "x")])
    changes = X.document_diff(rows, rows, _rules(spark)).changes
    assert len(shuffled(changes)) == 1
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and plan.count("Join Inner") == 2 and "Join LeftOuter" not in plan


def test_odd_children_meet_as_before(spark):
    """Without a document, a tag, a text or a key; an empty key meets what has none; repeated keys, texts, places and rows."""
    a, b, none, empty = '{"name":"a","v":1}', '{"v":2,"name":"a"}', '{"v":1}', '{"name":"","v":1}'
    old = [(1, "keyed", 0, none), (1, "keyed", 1, a), (1, "keyed", 1, a), (2, "keyed", 0, empty), (3, "keyed", 0, none), (None, "keyed", 0, a), (4, "keyed", 0, None), (5, "keyed", 0, a), (5, "keyed", 1, empty)]
    new = [(1, "keyed", 0, a), (1, "keyed", 1, b), (1, "keyed", 2, b), (2, "keyed", 0, none), (3, "keyed", 0, empty), (None, "keyed", 0, b), (4, "keyed", 0, None)]
    old += [(1, "obj", 0, a), (1, "obj", 0, a), (2, "obj", 0, None), (6, "list", 0, a), (6, "list", 0, b), (7, "list", 0, None), (8, "list", 0, "x"), (8, "list", 1, "x"), (6, None, 0, "x"), (9, "hidden", 0, a)]
    new += [(1, "obj", 1, b), (1, "obj", 1, b), (1, "obj", 2, a), (2, "obj", 0, None), (6, "list", 0, b), (6, "list", 0, a), (7, "list", 0, None), (8, "list", 0, "x"), (6, None, 0, "y"), (6, None, 0, "y"), (9, "hidden", 0, b)]
    rows = X.paired_children(children(spark, old), children(spark, new), _rules(spark)).where("kind is not null").collect()
    got = sorted((r.doc or 0, r.tag or "", r.side, r.pos, r.value or "", r.member, r.kind) for r in rows)
    assert got == [
        (0, "keyed", 1, 0, b, "a", "modify"), (1, "keyed", 1, 1, b, "a", "add"), (1, "keyed", 1, 2, b, "a", "add"), (1, "obj", 1, 1, b, None, "object"), (1, "obj", 1, 1, b, None, "object"),
        (3, "keyed", 1, 0, empty, "", "modify"), (5, "keyed", 0, 0, a, "a", "delete"), (5, "keyed", 0, 1, empty, "", "delete"), (6, "", 1, 0, "y", None, "list"), (6, "", 1, 0, "y", None, "list"),
        (8, "list", 0, 1, "x", None, "list"), (9, "hidden", 1, 0, b, "a", "modify"),
    ]
    found = X.document_diff(children(spark, old), children(spark, new), _rules(spark))
    assert {r.doc: r.has_package_content for r in found.documents.collect()} == {None: True, 1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: True, 9: True}
    assert sorted((r.doc or 0, r.kind, r.type, r.member) for r in found.changes.collect()) == [(0, "modify", "Keyed", "a"), (1, "add", "Keyed", "a"), (1, "add", "Keyed", "a"), (3, "modify", "Keyed", ""), (5, "delete", "Keyed", ""), (5, "delete", "Keyed", "a")]
    assert sorted((r.doc or 0, r.tag or "", r.pos, r.value or "", r.tag_order) for r in found.retained.collect()) == [(1, "keyed", 1, b, 0), (1, "keyed", 2, b, 0), (1, "obj", 1, b, 1), (1, "obj", 1, b, 1), (3, "keyed", 0, empty, 0), (8, "list", 0, "x", 0), (9, "hidden", 0, b, 0)]


def test_articles_of_whole_pages(spark, tmp_path):
    from driftledger.plans import catalogue

    pages = ["<html><article>x<h1>One</h1><p>a</p></article> <article id='2'><p>b</p><p>c</p></article></html>", "<p>none</p>", None, "<article><h1>Cut</h1><b></article>"]
    spark.createDataFrame([(k, f"u{k}", h) for k, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.article, r.tag, r.pos, r.value) for r in catalogue.QUERIES["html_root_children"](spark, str(tmp_path)).collect() if r.pos]
    assert sorted(got) == [(0, 0, "h1", 1, '"One"'), (0, 0, "p", 2, '"a"'), (0, 1, "p", 1, '"b"'), (0, 1, "p", 2, '"c"'), (3, 0, "h1", 1, '"Cut"')]


def test_white_space_counts_by_line(spark):
    pairs = [("a\nb", "ab"), ("a\nb", "a\n\n b "), ("a b", "ab"), ("a", "a\n"), ("", "\n \n"), ("a\r\nb", "a\nb"), ("a b\nc", "a\nb c")]
    old, new = (spark.createDataFrame([(str(k), p[s]) for k, p in enumerate(pairs)], "path string, content string") for s in (0, 1))
    changes = old.selectExpr("path", "'M' as status")
    assert sorted(r.path for r in D.drop_whitespace_changes(changes, old, new).collect()) == ["0", "6"]


@pytest.mark.parametrize("head", ["<!DOCTYPE a>", '<!DOCTYPE a SYSTEM "x>y">', "<!DOCTYPE a [<!ENTITY b \"c>]\"> <!-- ]> it's --> <?p ]> ?> <!ELEMENT a (#PCDATA)>]>", "<!DOCTYPE a [\n<!ATTLIST a b CDATA 'd]>'>\n] >"])
def test_declarations_are_passed_over(head):
    from driftledger.functions.xmltree import MalformedDocument, root_children

    assert [t for t, _ in root_children(f"<?xml version='1.0'?>{head}<a><b>1</b><!--x--><c/></a>")] == ["b", "#comment", "c", ""]
    with pytest.raises(MalformedDocument):
        list(root_children("<!DOCTYPE a [<!ENTITY " + "b" * 20_000 + "<a><b/></a>"))


def test_a_star_is_no_empty_name(spark):
    rules = parse_rules("a/*\n!a/keep\nb/**\n")
    paths = spark.createDataFrame([("a/keep",), ("a/x",), ("a/keep/y",), ("a",), ("b/c/d",), ("b",), ("aa/x",)], "path string")
    assert {r.path for r in paths.where(ignored(F.col("path"), rules)).collect()} == {"a/x", "b/c/d"}


def test_whole_documents(spark):
    from driftledger.functions.xmltree import whole_document, whole_documents

    assert whole_document("<a x='1'><b>1</b><b>2</b><c><d/></c></a>") == {"a": {"@_x": "1", "b": ["1", "2"], "c": {"d": {}}}}
    assert whole_document("<a/>") == {"a": {}}
    for broken in (None, "", " ", "text", "<a>", "<a></b>", "<a/><b/>", "<a><b></a></b>", "<a>" + "<b/>" * 3):
        assert whole_document(broken) == {}
    docs = spark.createDataFrame([(1, "<a><b>é</b></a>"), (2, "<a"), (3, None)], "doc long, content string")
    assert sorted(map(tuple, whole_documents(docs).collect())) == [(1, '{"a": {"b": "é"}}'), (2, "{}"), (3, "{}")]
