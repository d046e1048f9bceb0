"""The data source of a folder of files: what it gives, and which directories it doesn't list."""

import os

import pytest
from pyspark.sql import functions as F

from driftledger.sources import filetree, snapshots
from driftledger.sources.filetree import Bounds, FileTreeReader, read_tree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for k in range(60):
        place = root / f"d{k % 6}" / f"e{k % 4}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"f{k}.txt").write_bytes(b"x" * k)
    (root / "d1-more").mkdir()
    (root / "d1-more" / "g").write_text("beside")
    (root / "top é.txt").write_text("t")
    os.chmod(root / "d0" / "e0" / "f0.txt", 0o755)
    os.symlink("f0.txt", root / "d0" / "e0" / "link")
    (root / "empty").mkdir()
    return root


def found(df):
    return sorted(tuple(r) for r in df.select("path", "oid", "mode").collect())


def test_all_files(spark, folder):
    got = found(read_tree(spark, str(folder)))
    plain, _ = snapshots.read_directory(spark, str(folder))
    want = {r.path: r.oid for r in plain.collect()}
    assert {p: o for p, o, m in got if m != "120000"} == {p: o for p, o in want.items() if not p.endswith("link")} | {"d0/e0/f0.txt": "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"}  # Spark's own reader passes over empty files
    assert {(p, m) for p, _, m in got if m != "100644"} == {("d0/e0/f0.txt", "100755"), ("d0/e0/link", "120000")}
    assert read_tree(spark, str(folder), content=False).where("content is not null").isEmpty()
    assert {len(r.content) for r in read_tree(spark, str(folder)).where("path like 'd3/%'").collect()} == {k for k in range(60) if k % 6 == 3}


def test_scopes_are_pushed(spark, folder):
    every = found(read_tree(spark, str(folder)))
    for scopes in (["d1"], ["d1/e1", "d4"], ["top é.txt"], ["nothing"], ["."], []):
        inside = lambda p: not scopes or "." in scopes or any(p == s or p.startswith(s + "/") for s in scopes)
        assert found(read_tree(spark, str(folder), scopes)) == [x for x in every if inside(x[0])]
    plan = read_tree(spark, str(folder), ["d1"])._jdf.queryExecution().executedPlan().toString()
    assert "path#" in plan and "Filter" in plan and ">= d1" not in plan  # taken by the source
    assert read_tree(spark, str(folder)).where(F.col("path") == "d2/e2/f2.txt").count() == 1


def test_directories_outside_are_not_listed(folder, monkeypatch):
    reader = FileTreeReader({"path": str(folder), "parts": "4"})
    reader.bounds = Bounds("d2", "d20")
    listed, own = [], FileTreeReader._listed
    monkeypatch.setattr(FileTreeReader, "_listed", lambda self, store, base, d: (listed.append(d), own(self, store, base, d))[1])
    rows = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column(0).to_pylist()]
    assert sorted(rows) == sorted(f"d2/e{k % 4}/f{k}.txt" for k in range(60) if k % 6 == 2)
    assert {d.split("/")[0] for d in listed} == {"", "d2"}


def test_batches_are_bounded(folder, monkeypatch):
    monkeypatch.setattr(filetree, "BATCH_BYTES", 100)
    reader = FileTreeReader({"path": str(folder), "parts": "1"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) > 10 and sum(b.num_rows for b in batches) == 63
