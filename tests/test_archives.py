"""ZIP directories against a library's own archives, and broken ones."""

from __future__ import annotations

import io
import random
import zipfile

from pyspark.sql import functions as F

from glasspane.operators import archives, inspect
from tests.test_files import frame
from tests.test_no_false_clean import png


def zipped(entries, comment=b"", before=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
        z.comment = comment
    return before + out.getvalue()


PLAIN = [("a.txt", b"hello"), ("folder/", b""), ("folder/ü.txt", b"x" * 300), ("empty", b"")]
FILES = {
    "plain": zipped(PLAIN), "packed": zipped(PLAIN, method=zipfile.ZIP_DEFLATED), "comment": zipped(PLAIN, b"a note with PK\5\6 in it " + bytes(30)), "prefix": zipped(PLAIN, before=b"#!/bin/sh\n"),
    "tail": zipped(PLAIN) + b"more", "none": zipped([]), "many": zipped([(f"f{i}", b"") for i in range(3000)]),
}
BROKEN = {"empty": b"", "text": b"PK\3\4 hello", "cut": zipped(PLAIN)[:-30], "half": zipped(PLAIN)[60:], "no directory": zipped(PLAIN).replace(b"PK\1\2", b"PK\1\3"), "count": zipped(PLAIN)[:-12] + b"\7\0" + zipped(PLAIN)[-10:]}


def test_entries_equal_a_librarys(spark):
    got = {r.name: r.d for r in frame(spark, {**FILES, **BROKEN}).select("name", archives.zip_directory(F.col("content")).alias("d")).collect()}
    for name, data in FILES.items():
        with zipfile.ZipFile(io.BytesIO(FILES["plain"] if name == "comment" else data)) as z:  # that comment holds the mark itself
            want = [(i.filename, i.is_dir(), i.compress_type, i.compress_size, i.file_size, i.header_offset) for i in z.infolist()]
        assert got[name].error is None and [tuple(e) for e in got[name].entries] == want, name
    assert got["tail"].tail == 4 and got["comment"].comment == len(FILES["comment"]) - len(FILES["plain"])
    assert all(got[k].error and not got[k].entries for k in BROKEN)


def test_kinds_members_and_findings(spark):
    files = {
        "odt": zipped([("mimetype", b"application/vnd.oasis.opendocument.text"), ("content.xml", b"<x/>")]), "epub": zipped([("mimetype", b"application/epub+zip")]),
        "docx": zipped([("[Content_Types].xml", b"<x/>"), ("word/document.xml", b"<x/>")]), "jar": zipped([("META-INF/MANIFEST.MF", b"")]),
        "nested": zipped([("in.zip", FILES["plain"]), ("Users/me/pic.png", png((b"tEXt", b"a\0b")))]), "broken": BROKEN["cut"],
    }
    f = frame(spark, files)
    got = {r.name: r for r in f.select("name", archives.zip_kind(F.col("content")).alias("kind"), archives.zip_findings(F.col("content")).alias("f")).collect()}
    assert {k: r.kind for k, r in got.items()} == {"odt": "ODF text", "epub": "EPUB", "docx": "Word", "jar": "JAR", "nested": "archive", "broken": None}
    assert [(x.kind, x.location) for x in got["nested"].f] == [("comment", "ZIP:entry names"), ("unknown extension", "ZIP:in.zip"), ("author", "ZIP:Users/me/pic.png")]
    assert got["broken"].f is None and [x.kind for x in got["jar"].f] == ["unknown extension", "comment"]
    inner = archives.members(f.where("name = 'nested'").withColumnRenamed("name", "file"), "file")
    assert {r.name: (r.format, r.verdict) for r in inspect.inspected(inner).collect()} == {"in.zip": ("ZIP", "no statement"), "Users/me/pic.png": ("PNG", "warning")}
    assert [(r.name, r.error) for r in archives.entries(f.where("name = 'broken'").withColumnRenamed("name", "file"), "file").collect()] == [(None, "no end record")]


def test_damaged_archives_are_rows(spark):
    rnd, files = random.Random(6), {}
    for i in range(150):
        b = bytearray(FILES[("plain", "comment", "prefix")[i % 3]])
        for _ in range(rnd.randint(1, 4)):
            b[rnd.randrange(len(b))] = rnd.randrange(256)
        files[f"f{i}"] = bytes(b[: rnd.randint(0, len(b))] if i % 5 == 0 else b)
    assert len(frame(spark, files).select("name", archives.zip_findings(F.col("content"))).collect()) == 150
