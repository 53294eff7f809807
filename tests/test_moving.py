"""GIF and AVI files, headers, outside views and refusals on single cases."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from glasspane.functions import envelopes, paths
from glasspane.operators import headers, inspect
from tests.test_files import frame, riff

HEAD, PICTURE = b"GIF89a\1\0\1\0\0\0\0", b"\x2c" + bytes(4) + b"\1\0\1\0\0" + b"\2\2\x4c\1\0"
LOOP = b"\x21\xff\x0bNETSCAPE2.0\3\1\0\0\0"
LIST = lambda kind, *parts: (b"LIST", kind + b"".join(t + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for t, d in parts))
FILES = {
    "gif": (HEAD + LOOP + PICTURE + b";", []),
    "gif comment": (HEAD + b"\x21\xfe\5hello\6 world\0" + PICTURE + b";", ["comment"]),
    "gif text": (HEAD + b"\x21\1\x0c" + bytes(12) + b"\2hi\0" + PICTURE + b";", ["comment"]),
    "gif xmp": (HEAD + b"\x21\xff\x0bXMP DataXMP\2ab\0" + PICTURE + b";", ["author"]),
    "gif foreign": (HEAD + b"\x21\xff\x0bABCDEFGHIJK\2ab\0" + PICTURE + b";", ["unknown extension"]),
    "gif strange": (HEAD + b"\x21\x77\2ab\0" + PICTURE + b";", ["unknown extension"]),
    "gif tail": (HEAD + PICTURE + b";me", ["unknown extension"]),
    "gif open": (HEAD + PICTURE, []),
    "avi": (riff(b"AVI ", LIST(b"hdrl", (b"avih", bytes(8))), LIST(b"movi", (b"00dc", b"xyz"))), []),
    "avi name": (riff(b"AVI ", LIST(b"hdrl", (b"strn", b"me\0"))), ["comment"]),
    "avi info": (riff(b"AVI ", LIST(b"INFO", (b"IART", b"me\0"), (b"ISFT", b"it\0"))), ["author", "software"]),
    "avi date": (riff(b"AVI ", LIST(b"hdrl", (b"IDIT", b"2024\0"))), ["timestamp"]),
    "avi strange": (riff(b"AVI ", LIST(b"hdrl", (b"NAME", b"me"))), ["unknown extension"]),
}
BROKEN = {"gif cut": HEAD + PICTURE[:-2], "gif head": HEAD[:8], "gif unknown": HEAD + b"\x99", "gif comment cut": HEAD + b"\x21\xfe\5he", "avi cut": FILES["avi"][0][:-1]}


def test_verdicts(spark):
    got = {r.name: r for r in inspect.inspected(frame(spark, {**{k: v for k, (v, _) in FILES.items()}, **BROKEN})).collect()}
    assert {k: [f.kind for f in got[k].findings] for k in FILES} == {k: kinds for k, (_, kinds) in FILES.items()}
    assert got["gif comment"].findings[0].value == "hello world"
    assert {k for k, r in got.items() if r.verdict == "confirmed"} == {k for k, (_, kinds) in FILES.items() if not kinds}
    assert all(got[k].error for k in BROKEN)


def test_cleaning_leaves_nothing(spark):
    got = {r.name: r for r in inspect.cleaned(frame(spark, {k: v for k, (v, _) in FILES.items()})).collect()}
    assert {k for k, r in got.items() if r.outcome == "partial"} == {"avi strange"}
    clean = {k: bytes(r.cleaned) for k, r in got.items() if r.outcome == "complete"}
    assert all(v == HEAD + PICTURE + b";" for k, v in clean.items() if k.startswith("gif ")) and clean["gif"] == FILES["gif"][0]
    assert all(len(v) == len(FILES[k][0]) for k, v in clean.items() if k.startswith("avi"))
    assert not [r.name for r in inspect.inspected(frame(spark, clean)).collect() if r.findings or r.error]


def test_headers(spark):
    field = lambda tag, data: bytes([tag]) + struct.pack(">H", len(data)) + data
    base = {1: b"\0", 2: bytes(7) + b"\5", 3: bytes(8), 4: b"\0"}
    record = lambda fields: b"".join(field(k, v) for k, v in fields.items())
    cases = {
        record(base): None, record({**base, 4: b"\1", 5: bytes(32)}): None, record({**base, 5: bytes(32)}): "signed flag and key disagree",
        record({**base, 4: b"\2"}): "signed is not 0 or 1", record({**base, 2: b"\5"}): "wrong length of 02", record({**base, 6: b"\xff"}): "name is no UTF-8",
        record({**base, 6: b"x" * 256}): "name too long", record({**base, 8: b""}): "unknown type", b"": "signed missing", record(base)[:-1]: "truncated chunk",
        record({2: bytes(8), **{k: v for k, v in base.items() if k != 2}}): "tags out of order", record({4: b"\0"}): "content type missing",
    }
    rows = spark.createDataFrame([(bytearray(k),) for k in cases], "d binary").select("d", headers.header_fields(F.col("d")).alias("h")).collect()
    assert {bytes(r.d): r.h.error for r in rows} == cases
    assert [(r.h.content_type, int(r.h.plaintext_size)) for r in rows if bytes(r.d) == record(base)] == [("text", 5)]


def test_outside_views(spark):
    cases = {b"  eyJh": (1, None), b"E2\0\1\7x": (2, None), b"": (None, "bad magic"), b"E": (None, "bad magic"), b"E2\0": (None, "truncated"), b"E2\0\1": (None, "truncated"), b"E2\0\3\1": (None, "unsupported suite")}
    rows = spark.createDataFrame([(bytearray(k),) for k in cases], "d binary").select("d", envelopes.outside_view(F.col("d"), b"E2").alias("v")).collect()
    assert {bytes(r.d): (r.v.version, r.v.error) for r in rows} == cases


def test_refusals(spark):
    cases = {"/var": "system directory", "/var/folders/x": None, "/private/var/db": "system directory", "/varx": None, "C:\\WINDOWS\\": "system directory", "D:\\": "drive root", "/home/me/": "home directory", "/home/me/x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    got = rows.select("p", paths.refusal(F.col("p"), paths.last_name(F.col("p")), F.lit("/home/me"), F.lit(True), F.lit(False), F.lit(False)).alias("r")).collect()
    assert {r.p: r.r for r in got} == cases
