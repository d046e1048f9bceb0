"""Whole deltas over a small tree."""

import json
import os

import pytest

from pyspark.sql import functions as F

from driftledger.functions.rules import parse_rules
from driftledger.plans.engine import Options, delta
from tests.trees import registry, snapshots

WORKFLOW = '<?xml version="1.0"?>\n<Workflow xmlns="w">\n{}</Workflow>\n'
ALERT = "    <alerts>\n        <fullName>{}</fullName>\n        <text>{}</text>\n    </alerts>\n"

TRANSLATED = "<CustomObjectTranslation><fields><name>F</name></fields>{}</CustomObjectTranslation>"

OLD = {
    "a/classes/Same.cls": "x", "a/classes/Changed.cls": "x", "a/classes/Gone.cls": "x", "a/classes/Gone.cls-meta.xml": "x",
    "a/flows/Old.flow-meta.xml": "f",
    "a/lwc/part/part.js": "1", "a/lwc/part/part.html": "1", "a/lwc/left/left.js": "1",
    "a/permissionsets/Ps/fieldPermissions/F.fieldPermission-meta.xml": "1", "a/permissionsets/Ps/Ps.permissionset-meta.xml": "1",
    "a/workflows/W.workflow-meta.xml": WORKFLOW.format(ALERT.format("Kept", 1) + ALERT.format("Moved", 1) + ALERT.format("Dropped", 1)),
    "a/workflows/D.workflow-meta.xml": WORKFLOW.format(ALERT.format("One", 1)),
    "a/profiles/Admin.profile-meta.xml": "<Profile><tabVisibilities><tab>A</tab><v>1</v></tabVisibilities></Profile>",
    "a/digitalExperiences/site/shop/sfdc_cms__view/home/content.json": "1",
    "a/objectTranslations/Acc__c-fr/Acc__c-fr.objectTranslation-meta.xml": TRANSLATED.format("<label>Old</label>"),
    "notes.txt": "n",
}
NEW = {
    "a/classes/Same.cls": "x", "a/classes/Changed.cls": "y", "a/classes/Changed.cls-meta.xml": "m", "a/classes/New.cls": "n",
    "a/objects/Acc__c/Acc__c.object-meta.xml": "o", "a/objects/Acc__c/fields/Md__c.field-meta.xml": "<type>MasterDetail</type>",
    "a/objects/Acc__c/recordTypes/Rt.recordType-meta.xml": "r", "a/objects/Acc__c/indexes/I.index-meta.xml": "i",
    "a/lwc/part/part.js": "1",
    "a/staticresources/img.resource-meta.xml": "s", "a/staticresources/img/icons/a.png": "p",
    "a/reports/F/R.report-meta.xml": "r", "a/reports/F.reportFolder-meta.xml": "r", "a/documents/D/logo.document": "d", "a/documents/D/logo.document-meta.xml": "d",
    "a/permissionsets/Ps/Ps.permissionset-meta.xml": "1",
    "a/workflows/W.workflow-meta.xml": WORKFLOW.format(ALERT.format("Added", 1) + ALERT.format("Kept", 1) + ALERT.format("Moved", 2)),
    "a/workflows/Broken.workflow-meta.xml": "<Workflow><alerts></Workflow>",
    "a/profiles/Admin.profile-meta.xml": "<Profile><tabVisibilities><tab>A</tab><v>2</v></tabVisibilities></Profile>",
    "a/bots/Bt/v1.botVersion-meta.xml": "b",
    "a/labels/L.labels-meta.xml": "<CustomLabels><labels><fullName>Hi</fullName></labels></CustomLabels>",
    "a/digitalExperiences/site/shop/sfdc_cms__view/about/content.json": "2", "notes.txt": "m",
    "a/objectTranslations/Acc__c-fr/Acc__c-fr.objectTranslation-meta.xml": TRANSLATED.format("<label>Old</label>"),
    "a/objectTranslations/Acc__c-fr/F__c.fieldTranslation-meta.xml": "<CustomFieldTranslation/>",
    "a/documents/D/logo.png": "d", "a/lwc/part.js-meta.xml": "1", "a/lwc/partial/x.js": "1",
}


@pytest.fixture(scope="module")
def result(spark):
    old, new, blobs = (df.cache() for df in snapshots(spark, OLD, NEW))
    return delta(old, new, registry(spark), Options(), blobs), new, blobs


def test_elements(result):
    got = {tuple(r) for r in result[0].elements.select("target", "type", "member", "change_kind").collect()}
    want = {
        ("package", "ApexClass", "Changed", "modify"), ("package", "ApexClass", "Changed", "add"), ("package", "ApexClass", "New", "add"),
        ("destructive", "ApexClass", "Gone", "delete"), ("destructive", "Flow", "Old", "delete"),
        ("package", "CustomObject", "Acc__c", "add"), ("package", "CustomField", "Acc__c.Md__c", "add"), ("package", "RecordType", "Acc__c.Rt", "add"),
        ("package", "Index", "Acc__c.I", "add"),
        ("package", "LightningComponentBundle", "part", "delete"), ("destructive", "LightningComponentBundle", "left", "delete"),
        ("package", "StaticResource", "img", "add"), ("package", "Report", "F/R", "add"), ("package", "ReportFolder", "F", "add"), ("package", "Document", "D/logo", "add"),
        ("package", "PermissionSet", "Ps", "delete"),
        ("package", "WorkflowAlert", "W.Added", "add"), ("package", "WorkflowAlert", "W.Moved", "modify"), ("destructive", "WorkflowAlert", "W.Dropped", "delete"),
        ("package", "Workflow", "W", "modify"), ("destructive", "WorkflowAlert", "D.One", "delete"),
        ("package", "CustomObjectTranslation", "Acc__c-fr", "add"), ("package", "Document", "D/logo", "add"), ("package", "LightningComponentBundle", "partial", "add"),
        ("package", "Profile", "Admin", "modify"), ("package", "BotVersion", "Bt.v1", "add"), ("package", "Bot", "Bt", "add"), ("package", "CustomLabel", "Hi", "add"),
        ("package", "DigitalExperience", "site/shop.sfdc_cms__view/about", "add"),
    }
    assert got == want


def test_a_deleted_page_of_which_an_addition_has_the_file_name_is_cancelled(result):
    assert result[0].elements.where("member like '%home%'").count() == 0


def test_warnings(result):
    got = {tuple(r) for r in result[0].warnings.select("code", "subject").collect()}
    assert got == {("flow_deleted", "Old"), ("malformed_xml", "a/workflows/Broken.workflow-meta.xml")}


def test_copies(result):
    got = {(r.path, r.kind) for r in result[0].copies.collect()}
    for path in (
        "a/classes/Changed.cls", "a/classes/Changed.cls-meta.xml", "a/objects/Acc__c/Acc__c.object-meta.xml", "a/lwc/part/part.js",
        "a/objects/Acc__c/fields/Md__c.field-meta.xml", "a/staticresources/img/icons/a.png", "a/staticresources/img.resource-meta.xml", "a/reports/F-meta.xml", "a/documents/D.document-meta.xml",
    ):
        assert (path, "file") in got, path
    for path in ("a/documents/D/logo.png", "a/documents/D/logo.document", "a/lwc/part.js-meta.xml"):
        assert (path, "file") in got, path
    assert ("a/permissionsets/Ps", "directory") in got
    parent = "a/objectTranslations/Acc__c-fr/Acc__c-fr.objectTranslation-meta.xml"
    assert (parent, "file") in got and (parent, "computed") not in got
    assert ("a/workflows/W.workflow-meta.xml", "computed") in got
    assert not any("Same" in p or "Gone" in p for p, _ in got)


def test_written_output(result, tmp_path):
    r, new, blobs = result
    notes = r.write(str(tmp_path), review=True, snapshot=new, blobs=blobs)
    assert len(notes) == 2
    package = (tmp_path / "package/package.xml").read_text()
    assert package.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<Package xmlns=') and package.endswith("<version>60.0</version>\n</Package>")
    assert package.index("<name>CustomObject</name>") < package.index("<name>ApexClass</name>") < package.index("<name>Workflow</name>")
    assert "<members>Old</members>" in (tmp_path / "destructiveChanges/destructiveChanges.xml").read_text()
    assert "<types>" not in (tmp_path / "destructiveChanges/package.xml").read_text()
    review = json.loads((tmp_path / "changes.json").read_text())
    assert review["delete"]["WorkflowAlert"] == ["D.One", "W.Dropped"] and review["add"]["WorkflowAlert"] == ["W.Added"]
    pruned = (tmp_path / "a/workflows/W.workflow-meta.xml").read_text()
    assert pruned == '<?xml version="1.0" encoding="UTF-8"?>\n<Workflow xmlns="w">\n' + ALERT.format("Added", 1) + ALERT.format("Moved", 2) + "</Workflow>\n"
    assert (tmp_path / "a/classes/Changed.cls").read_text() == "y"
    translated = (tmp_path / "a/objectTranslations/Acc__c-fr/Acc__c-fr.objectTranslation-meta.xml").read_text()
    assert translated == NEW["a/objectTranslations/Acc__c-fr/Acc__c-fr.objectTranslation-meta.xml"]  # unchanged, so sent whole
    assert os.path.exists(tmp_path / "a/permissionsets/Ps/Ps.permissionset-meta.xml")


def test_a_snapshot_against_itself_is_empty(spark):
    _, new, blobs = snapshots(spark, OLD, NEW)
    r = delta(new, new, registry(spark), Options(), blobs)
    assert r.elements.isEmpty() and r.warnings.isEmpty() and r.copies.isEmpty()


def test_ignored_and_included(spark):
    old, new, blobs = snapshots(spark, OLD, NEW)
    r = delta(old, new, registry(spark), Options(ignore=parse_rules("*\n"), include=parse_rules("a/classes/Same*"), generate_delta=False), blobs)
    assert {tuple(x) for x in r.elements.select("target", "type", "member").collect()} == {("package", "ApexClass", "Same")}


def test_without_tree_reads_nothing_exists(spark):
    old, new, blobs = snapshots(spark, OLD, NEW)
    r = delta(old, new, registry(spark), Options(scopes=["a/lwc"], tree_reads=False, generate_delta=False))
    assert {tuple(x) for x in r.elements.select("target", "member").collect()} == {("destructive", "part"), ("destructive", "left"), ("package", "partial")}


def test_renames_are_told_apart(spark):
    old, new, blobs = snapshots(spark, {"a/classes/One.cls": "same text", "a/classes/Other.cls": "1"}, {"a/classes/Two.cls": "same text", "a/classes/Other.cls": "1"})
    r = delta(old, new, registry(spark), Options(renames=True), blobs)
    assert [tuple(x) for x in r.renames.collect()] == [("ApexClass", "One", "Two")]
    assert {tuple(x) for x in r.kinds.collect()} == {("rename", "ApexClass", "One", "Two")}
    assert {tuple(x) for x in r.package.collect()} == {("ApexClass", "Two")} and {tuple(x) for x in r.destructive.collect()} == {("ApexClass", "One")}


def flows_translated(*names):
    return "<Translations>" + "".join(f"<flowDefinitions><fullName>{n}</fullName></flowDefinitions>" for n in names) + "<label>x</label></Translations>"


def test_forced_includes_are_seen_against_the_first_commit(spark):
    alerts = lambda *names: WORKFLOW.format("".join(ALERT.format(n, 1) for n in names))
    now = {"a/workflows/W.workflow-meta.xml": alerts("Kept", "Later")}
    old, new, blobs = snapshots(spark, now, now)
    first, _, more = snapshots(spark, {"a/workflows/W.workflow-meta.xml": alerts("Kept")}, {})
    rules = parse_rules("a/workflows/*")
    r = delta(old, new, registry(spark), Options(include_destructive=rules, generate_delta=False), blobs.unionByName(more).dropDuplicates(["oid"]), first)
    assert {tuple(x) for x in r.elements.collect()} == {("destructive", "WorkflowAlert", "W.Later", "delete")}
    r = delta(old, new, registry(spark), Options(include=rules, generate_delta=False), blobs.unionByName(more).dropDuplicates(["oid"]), first)
    assert {tuple(x) for x in r.elements.collect()} == {("package", "WorkflowAlert", "W.Later", "add"), ("package", "Workflow", "W", "add")}


def test_flow_translations_are_merged_and_scoped(spark, tmp_path):
    files = {f"{d}/translations/fr.translation-meta.xml": flows_translated("One", "Two", "Other") for d in ("a", "b", "a/no")}
    old, new, blobs = snapshots(spark, files, files | {"a/flows/One.flow-meta.xml": "f", "a/flows/Two.flow-meta.xml": "f"})
    known = "<Translations v='1'><labels><a>1</a></labels><flowDefinitions><fullName>Two</fullName><mine>1</mine></flowDefinitions></Translations>"
    written = spark.createDataFrame([("a/translations/fr.translation-meta.xml", known)], "doc string, content string")
    r = delta(old, new, registry(spark), Options(scopes=["a"], ignore=parse_rules("a/no/")), blobs, written=written)
    assert {tuple(x) for x in r.elements.select("type", "member").collect()} == {("Flow", "One"), ("Flow", "Two"), ("Translations", "fr")}
    copies = {x.path: x.content.decode() for x in r.copies.where("kind = 'computed'").collect()}
    assert set(copies) == {"a/translations/fr.translation-meta.xml"}
    text = "".join(line.strip() for line in copies["a/translations/fr.translation-meta.xml"].split("\n")[1:])
    assert text == '<Translations v="1"><labels><a>1</a></labels><flowDefinitions><fullName>Two</fullName><mine>1</mine></flowDefinitions><flowDefinitions><fullName>One</fullName></flowDefinitions></Translations>'


def test_scopes_that_match_nothing_are_named(spark):
    old, new, _ = snapshots(spark, {"a/classes/One.cls": "1"}, {"a/classes/One.cls": "2"})
    of = lambda *scopes: {tuple(x) for x in delta(old, new, registry(spark), Options(scopes=scopes, generate_delta=False)).warnings.collect()}
    assert of("b", "c") == {("nothing_in_scope", "b"), ("nothing_in_scope", "c")} and of("b", "a") == of(".") == set()


def test_pointers_stand_for_their_objects_and_moved_files_for_their_lines(spark):
    lines = [f"line {k}" for k in range(20)]
    pointer = "version https://git-lfs.github.com/spec/v1\noid sha256:{}\nsize 1\n"
    old, new, blobs = snapshots(spark, {"a/classes/One.cls": pointer.format("0" * 64)}, {"a/classes/Two.cls": pointer.format("1" * 64)})
    objects = spark.createDataFrame([("0" * 64, bytearray("\n".join(lines).encode())), ("1" * 64, bytearray("\n".join([*lines[:18], "x"]).encode()))], "sha256 string, content binary")
    r = delta(old, new, registry(spark), Options(renames=True, generate_delta=False), blobs, objects=objects)
    assert [tuple(x) for x in r.renames.collect()] == [("ApexClass", "One", "Two")]


def test_a_collector_that_fails_is_a_warning(spark, monkeypatch):
    from pyspark.errors import AnalysisException

    from driftledger.plans import engine

    def fails(*_):
        raise AnalysisException("no such thing", errorClass=None, messageParameters=None)

    monkeypatch.setattr(engine, "_forced", fails)
    old, new, _ = snapshots(spark, {}, {"a/classes/One.cls": "2"})
    r = delta(old, new, registry(spark), Options(include=parse_rules("*"), generate_delta=False))
    assert r.elements.count() == 1 and [x.code for x in r.warnings.collect()] == ["collector_failed"]


def test_the_command_writes_a_delta(spark, tmp_path, capsys):
    from driftledger.__main__ import main

    for side, files in (("old", {"a/classes/One.cls": "1"}), ("new", {"a/classes/One.cls": "2", "a/classes/Two.cls": "2"})):
        for path, text in files.items():
            (tmp_path / side / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / side / path).write_text(text)
    (tmp_path / "types.json").write_text(json.dumps([{"xmlName": "ApexClass", "directoryName": "classes", "suffix": "cls", "metaFile": True}]))
    where = [f"--{n}={tmp_path}/{v}" for n, v in (("from", "old"), ("to", "new"), ("registry", "types.json"), ("output", "out"))]
    assert main([*where, "--generate-delta", "--source=a"]) == 0
    assert json.loads(capsys.readouterr().out) == {"output-dir": f"{tmp_path}/out"}
    assert "<members>Two</members>" in (tmp_path / "out/package/package.xml").read_text() and (tmp_path / "out/a/classes/Two.cls").read_text() == "2"
    assert main([*where, "--source=../b"]) == 1 and "error" in json.loads(capsys.readouterr().out)


def test_a_collector_that_fails_is_a_warning(spark, monkeypatch):
    """Whatever is raised, when the collector runs or when its copies are computed, the other parts count."""
    from driftledger.operators import handlers
    from driftledger.plans import engine

    old, new, blobs = snapshots(spark, OLD, NEW)

    def raises(*_):
        raise ValueError("no such thing")

    def late(*_):
        none = spark.createDataFrame([], "target string, type string, member string, change_kind string")
        copies = spark.range(1).selectExpr("'a' as path", "'computed' as kind", "id as seq", "cast(raise_error('poison') as binary) as content")
        return handlers.Outcome(none, copies, spark.createDataFrame([], "code string, subject string"))

    for broken, said in ((raises, "no such thing"), (late, "poison")):
        monkeypatch.setattr(engine, "_forced", broken)
        r = engine.delta(old, new, registry(spark), Options(include=parse_rules("a/classes/Same*"), generate_delta=False), blobs)
        assert [w.subject for w in r.warnings.collect() if w.code == "collector_failed" and said in w.subject]
        assert ("package", "ApexClass", "Changed") in {tuple(x) for x in r.elements.select("target", "type", "member").collect()}


def test_two_commits_are_the_input_of_a_delta(spark):
    """A tag of a tag, a branch and a merge base, against the delta of the flat snapshots."""
    from driftledger.operators.trees import trees_of
    from driftledger.plans.engine import delta_of_revisions
    from driftledger.sources.snapshots import SourceError

    old, new, blobs = snapshots(spark, OLD, NEW)
    trees, roots = trees_of(old.withColumn("revision", F.lit("old")).unionByName(new.withColumn("revision", F.lit("new"))))
    root = {r.revision: r.tree for r in roots.collect()}
    rows = [("c0", [], root["old"]), ("c1", ["c0"], root["old"]), ("s1", ["c1"], root["new"]), ("c2", ["c1"], root["new"]), ("lone", [], root["new"])]
    commits = spark.createDataFrame(rows, "id string, parents array<string>, tree string")
    refs = spark.createDataFrame([("main", "c2"), ("HEAD", "main"), ("v1", "t2"), ("side", "s1")], "name string, id string")
    tags = spark.createDataFrame([("t2", "t1"), ("t1", "c0"), ("loop", "loop")], "id string, target string")
    want = delta(old, new, registry(spark), Options(), blobs)
    plain = lambda df: sorted(map(tuple, df.collect()))
    for start, based in (("v1", False), ("side", True)):
        got = delta_of_revisions(refs, commits, trees, start, "HEAD", registry(spark), Options(), blobs, tags, based)
        assert plain(got.package) == plain(want.package) and plain(got.destructive) == plain(want.destructive) and plain(got.kinds) == plain(want.kinds)
    scoped = delta_of_revisions(refs, commits, trees, "v1", "HEAD", registry(spark), Options(scopes=["a/lwc"], generate_delta=False), blobs, tags)
    assert plain(scoped.package) == plain(delta(old, new, registry(spark), Options(scopes=["a/lwc"], generate_delta=False), blobs).package)
    for start, end in (("lone", "HEAD"), ("nothing", "HEAD"), ("loop", "HEAD")):
        with pytest.raises(SourceError):
            delta_of_revisions(refs, commits, trees, start, end, registry(spark), Options(), blobs, tags, True)
