from __future__ import annotations

import hashlib
import io
import zipfile

import pytest

from fieldloom.llm import queries, warczip
from fieldloom.llm.ziparchive import ZipError, ZipReader, ZipWriter


def reader(data):
    return ZipReader(lambda at, n: data[at : at + n], len(data))


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_agree_with_the_standard_library(zip64):
    out = io.BytesIO()
    w = ZipWriter(out.write, zip64)
    members = {"a/one.txt": b"1" * 1000, "empty": b"", "ü.bin": bytes(range(256)) * 9}
    for k, v in members.items():
        w.add(k, v)
    w.close()
    z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == members
    r = reader(out.getvalue())
    assert {n: r.whole(n) for n in r.members} == members and r.range("ü.bin", 300, 5) == members["ü.bin"][300:305]


def test_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"stored")
        z.writestr("y", b"packed" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside"
    r = reader(out.getvalue())
    assert r.whole("x") == b"stored"
    with pytest.raises(ZipError, match="packed"):
        r.whole("y")
    with pytest.raises(ZipError, match="beyond"):
        r.range("x", 3, 10)
    with pytest.raises(ZipError, match="no end"):
        reader(b"nothing")


def test_damage_is_noticed():
    out = io.BytesIO()
    w = ZipWriter(out.write)
    w.add("m", b"abcdef")
    w.close()
    bad = bytearray(out.getvalue())
    bad[bad.index(b"abcdef")] ^= 1
    with pytest.raises(ZipError, match="checksum"):
        reader(bytes(bad)).whole("m")


def test_against_sql(same_rows):
    same_rows(queries.op10_warc_archives, queries.OP10_SQL)


def test_odd_pages(spark):
    big, other = "é" * 600, "b" * 1000
    pages = [(1, "u", big, 0), (2, None, big, 0), (3, "u\r\nx", big, 0), (3, "again", big, 0), (4, "u", None, 0), (5, "u", "", 0), (6, "u", "small", 0), (7, "u", "small", 0), (None, "u", big, 0), (8, "u", other, 0), (9, "u", "x\r\n\r\ny" * 300_000, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, n long")
    archives = warczip.write_archives(df)
    found = warczip.read_archives(archives)
    got = sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect())
    want = []
    for i, _, html, _ in pages:
        raw = (html or "").encode()
        revisit = html == big and i in (1, 2)
        want.append((repr(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want)
    texts = {r["page_id"]: r["payload"] for r in found.filter("record_type = 'response'").collect()}
    assert bytes(texts[9]).decode() == pages[-1][2] and bytes(texts[5]) == b""
    assert archives.agg({"n_records": "sum"}).first()[0] == len(pages)
    with zipfile.ZipFile(archives.first()["path"].removeprefix("file://").removeprefix("file:")) as z:
        assert z.testzip() is None and "indexes/index.cdxj" in z.namelist()


def test_small_archives_and_empty_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warczip, "MEMBER_BYTES", 2_000)
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert warczip.read_archives(warczip.write_archives(df)).count() == df.count()
    assert warczip.read_archives(warczip.write_archives(df.limit(0))).count() == 0
