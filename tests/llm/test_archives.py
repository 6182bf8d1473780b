import io
import zipfile

import pytest

from tarnwork.llm import archives


@pytest.mark.parametrize("zip64", [True, False])
def test_reader_and_writer_agree_with_the_standard_library(zip64):
    members = [("a", b"x" * 1000), ("dir/é", b""), (archives.INDEX, b"y")]
    raw = archives.write_zip(members, zip64)
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    p = archives.Package(io.BytesIO(raw), len(raw))
    assert {n: p.read(*p.locate(n)) for n in p.members} == dict(members)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n, d in members:
            z.writestr(n, d)
        z.comment = b"PK\5\6 a comment"
    p = archives.Package(out, len(out.getvalue()))
    assert {n: p.read(*p.locate(n)) for n in p.members} == dict(members)
    with pytest.raises(ValueError):
        archives.Package(io.BytesIO(raw[:-5]), len(raw) - 5)


def test_deflated_members_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    p = archives.Package(out, len(out.getvalue()))
    with pytest.raises(ValueError):
        p.locate("a")


def test_round_trip(spark):
    rows = [(3, "http://a b/\n", "<p>é</p>", 1), (1, None, "<p>é</p>", 1), (2, "u", None, 1), (5, "u", "", 1), (9, "u", "x" * 100_000, 1), (9, "u", "x" * 100_000, 1), (None, "u", "<p>é</p>", 1), (None, "v", "alone", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to int")
    got = archives.round_trip(df).collect()
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        revisit = first is not None and page != first
        want.append((page, "revisit" if revisit else "response", archives.digest32(raw), first if revisit else None, len(raw)))
    assert sorted(((r["page_id"], r["record_type"], r["payload_digest"], r["refers_to"], r["payload_bytes"]) for r in got), key=str) == sorted(want, key=str)
    folder = archives.archive_folder(spark)
    back = archives.read(archives.write(archives.with_revisits(df), folder, archive_bytes=100), folder).collect()
    assert {r["payload"].decode() for r in back if r["record_type"] == "response"} == {h or "" for _, _, h, _ in rows}
    assert archives.round_trip(df.limit(0)).collect() == []


def test_hot_payload_and_clashing_names(spark):
    rows = [(i if i % 5 else None, "u", "same page" if i % 3 == 0 else f"page {i}", "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, _sha string, _first int")
    got = archives.round_trip(df).collect()
    same = [r for r in got if r["payload_bytes"] == len("same page")]
    assert len(got) == 300 and sorted({str(r["refers_to"]) for r in same}) == ["3", "None"] and sum(r["record_type"] == "response" for r in same) == 1
