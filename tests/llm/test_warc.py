"""Archives: round trip, salvage of damaged files, revisits."""

import hashlib
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.llm import warc as W


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def records(data):
    salvage = W.Salvage()
    found = [(at, r.headers["warc-record-id"].strip("<>"), r.payload) for at, r in W.ArchiveReader(File(data), salvage)]
    return found, salvage.gaps


def archive(n=6, gz=True, size=2000):
    parts = [W.record_bytes("response", f"urn:page:{i}", "http://a/", (b"WARC/1.1\r\nbody %d " % i) * (size // 16)) for i in range(n)]
    return [W.gzip_member(p) if gz else p for p in parts]


@pytest.mark.parametrize("gz", [True, False])
def test_round_trip(gz):
    found, gaps = records(b"".join(archive(gz=gz)))
    assert [f[1] for f in found] == [f"urn:page:{i}" for i in range(6)] and not gaps


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut_middle", "junk_between", "cut_end", "zero_head"])
def test_salvage(gz, damage):
    parts = archive(gz=gz)
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    if damage == "flip":
        at = len(parts[2]) - 30 if gz else len(parts[2]) // 2
        parts[2] = parts[2][:at] + bytes([parts[2][at] ^ 255]) + parts[2][at + 1 :]
    elif damage == "cut_middle":
        parts[2] = parts[2][: len(parts[2]) // 2]
    elif damage == "junk_between":
        parts[2] = parts[2] + b"\x1f\x8b\x08 junk WARC/1.1 \r\n"
    elif damage == "cut_end":
        parts[5] = parts[5][:-7]
    else:
        parts[2] = b"\0" * 20 + parts[2][20:]
    found, gaps = records(b"".join(parts))
    lost = {"junk_between": set(), "cut_end": {5}}.get(damage, {2})
    assert [f[1] for f in found if not f[1] == ""] == [f"urn:page:{i}" for i in range(6) if i not in lost]
    assert len(gaps) == 1
    if damage in ("flip", "zero_head"):
        assert (gaps[0].start, gaps[0].end) == (starts[2], starts[3])
    assert gaps[0].reason


@pytest.mark.parametrize("size", [200, 200_000])
def test_several_records_in_a_member(size):
    parts = archive(5, gz=False, size=size)
    member = W.gzip_member(b"".join(parts))
    found, gaps = records(member + archive(1)[0])
    assert [f[1] for f in found] == [*(f"urn:page:{i}" for i in range(5)), "urn:page:0"] and not gaps
    parts[1] = parts[1].replace(b"body 1", b"BODY 1", 1)
    parts[3] = parts[3].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    member = W.gzip_member(b"".join(parts))
    found, gaps = records(member + archive(1)[0])
    assert [f[1] for f in found if f[2]] == [f"urn:page:{i}" for i in (0, 2, 4, 0)]
    assert [(g.start, g.end) for g in gaps] == [(0, len(member))] and "within" in gaps[0].reason


def test_records_before_the_damage_of_a_member_are_read():
    parts = [W.record_bytes("response", f"urn:page:{i}", "http://a/", random.Random(i).randbytes(90_000)) for i in range(5)]
    member = W.gzip_member(b"".join(parts))
    found, gaps = records(member[:-2000] + archive(1)[0])
    assert [f[1] for f in found][:3] == ["urn:page:0", "urn:page:1", "urn:page:2"] and found[-1][1] == "urn:page:0" and len(gaps) == 1


def test_long_payload(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 9_000_000), (2, "u", "x" * 9_000_000)], "page_id long, url string, html string")
    got = sorted(map(tuple, W.archive_pages(pages).select("page_id", "payload_bytes", "refers_to").collect()))
    assert got == [(1, 9_000_000, None), (2, 9_000_000, 1)]


def test_damage_between_writing_and_reading_is_an_error(spark, monkeypatch):
    whole = W.write_archives

    def damaged(planned, folder, **options):
        manifest = whole(planned, folder, **options)
        path = manifest.first()["path"].removeprefix("file://")
        with open(path, "r+b") as file:
            file.seek(40)
            file.write(b"\0\0\0\0")
        return manifest

    monkeypatch.setattr(W, "write_archives", damaged)
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(10)], "page_id long, url string, html string")
    with pytest.raises(Exception, match="damaged archive"):
        W.archive_pages(pages).collect()


def test_small_payloads_do_not_meet_on_one_key(spark):
    pages = spark.createDataFrame([(i, "u", "") for i in range(4000)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = W.plan_revisits(pages).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r["count"] for r in sizes) < 4000


def test_wrong_length_and_digest_are_gaps():
    parts = archive(gz=False)
    parts[1] = parts[1].replace(b"Content-Length: 2", b"Content-Length: 9", 1)
    parts[3] = parts[3].replace(b"body 3", b"BODY 3", 1)
    found, gaps = records(b"".join(parts))
    assert [f[1][-1] for f in found] == ["0", "2", "4", "5"] and len(gaps) == 2


@given(st.binary(max_size=300), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_junk_never_raises_and_is_accounted_for(junk, where):
    parts = archive(4, size=64)
    parts.insert(where % 5, junk)
    data = b"".join(parts)
    found, gaps = records(data)
    assert [f[1] for f in found] == [f"urn:page:{i}" for i in range(4)]
    assert sum(g.end - g.start for g in gaps) == len(junk)


def test_archive_pages(spark):
    big, other = "é" * 60, "x" * 100
    rows = [(5, "http://b/ü", big), (3, None, big), (9, "u", big), (9, "u", big), (4, "v", other), (None, "w", other), (7, "x", "short"), (8, "y", "short"), (10, "z", None), (11, "z", ""), (3, "again", big), (-2, "n", "n" * 200)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, digest string, salt int")
    got = sorted(map(tuple, W.archive_pages(pages, file_bytes=300).collect()), key=str)
    least = {big: 3, other: 4}
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = least.get(html)
        own = first is None or page == first
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if own else "revisit", None if own else first))
    assert got == sorted(expected, key=str)
    assert W.archive_pages(pages.limit(0)).count() == 0


def test_gap_rows(spark, tmp_path):
    parts = archive()
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"junk" + parts[1])
    rows = W.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")).collect()
    assert [r["record_id"] for r in rows if r["record_type"]] == ["urn:page:0", "urn:page:1"]
    gap = next(r for r in rows if r["gap_reason"])
    assert (gap["gap_start"], gap["gap_end"]) == (len(parts[0]), len(parts[0]) + 4)
