"""Archives: what the reader gives back, and what it refuses."""

import glob
import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from driftledger.llm import warc


def pages_of(spark):
    body = "<p>é" + "x" * 1200
    rows = [(1, "http://a/1", body), (2, None, body), (3, "http://a/3 x\n", body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 200_000), (9, "u", "z" * 1000), (10, "u", "z" * 1000), (10, "u", "z" * 1000), (None, "u", "z" * 1000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit("clash"), "payload": F.lit(0)})


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, tmp_path, zip64):
    rows, pages = pages_of(spark)
    path = str(tmp_path / "out")
    warc.write_archives(pages.repartition(3), path, zip64=zip64, member_bytes=2000)
    got = warc.read_archives(spark, f"file://{path}", with_payload=True, segment_bytes=500).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    refers = {1: 3, 2: 3, 9: 10, None: 10}
    for page, _, html in rows:
        raw = (html or "").encode()
        for r in by[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", refers[page]) if page in refers else ("response", None))
            assert r.payload is None if page in refers else bytes(r.payload) == raw
    assert by[3][0].url == "http://a/3%20x%0A" and by[2][0].url is None
    for name in glob.glob(f"{path}/part-*"):
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None and len({m.compress_type for m in z.infolist()}) == 1
            for m in z.namelist():
                if m.startswith("archive/"):
                    assert gzip.decompress(z.read(m)).startswith(b"WARC/1.1\r\n")


def test_empty_tables(spark, tmp_path):
    _, pages = pages_of(spark)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def archive(zip64=False, comment=b"\n"):
    rows = warc.ZipRows(zip64)
    return b"".join(r + b"\n" for r in (rows.member("a", b"1"), rows.member("b/ü", b"22"), rows.end()))


@pytest.mark.parametrize("zip64", [False, True])
def test_directories(zip64):
    data = archive(zip64)
    found = warc.central_directory(*warc.in_memory(data))
    assert {n: data[at : at + size] for n, (at, size, _) in found.items()} == {"a": b"1", "b/ü": b"22"}


def test_directories_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"x" * 10)
    assert warc.central_directory(*warc.in_memory(out.getvalue()))["big"][1] == 10
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 100)
    with pytest.raises(ValueError, match="compressed"):
        warc.central_directory(*warc.in_memory(packed.getvalue()))


@pytest.mark.parametrize("cut", [1, 10, 60])
def test_damaged_archives(cut):
    data = archive()
    with pytest.raises(ValueError):
        warc.central_directory(*warc.in_memory(data[:-cut]))
    with pytest.raises(ValueError):
        warc.central_directory(*warc.in_memory(data[cut:] if cut > 1 else b""))
