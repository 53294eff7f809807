"""Cleaning of whole files: idempotent, honest about what is not understood, never failing on broken bytes."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from glasspane.operators import chunks, images, inspect

JPEG = b"\xff\xd8" + b"\xff\xe0\x00\x07JFIF\x00" + b"\xff\xe1\x00\x12Exif\x00\x00MM\x00*\x88\x25\xff\xd8\x00\x00" + b"\xff\xfe\x00\x06note" + b"\xff\xdb\x00\x04\x00\x01" + b"\xff\xda\x00\x04\x01\x02" + b"\xa1\xff\x00\xff\xd9"
CLEAN_JPEG = b"\xff\xd8" + b"\xff\xdb\x00\x04\x00\x01" + b"\xff\xda\x00\x04\x01\x02" + b"\xa1\xff\x00\xff\xd9"


def riff(kind, *parts):
    body = kind + b"".join(t + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for t, d in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


WEBP = riff(b"WEBP", (b"VP8X", b"\x3c" + bytes(9)), (b"ICCP", b"abc"), (b"VP8 ", b"xy"), (b"XMP ", b"<x/>"))
BMP = b"BM" + struct.pack("<IIIIiiHHII", 58 + 5, 0, 54, 40, 1, 1, 1, 24, 0, 4) + bytes(16) + b"\1\2\3\0" + b"extra"
WAV = riff(b"WAVE", (b"fmt ", bytes(16)), (b"bext", b"someone"), (b"LIST", b"INFO" + b"IART\x03\0\0\0me\0\0"), (b"data", b"\0\0"))
FILES = {"jpeg": JPEG, "webp": WEBP, "bmp": BMP, "wav": WAV, "ogg": b"OggS rest", "text": b"hello", "empty": b"", "zip": b"PK\x03\x04 rest"}


def frame(spark, files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, content binary")


def test_whole_files(spark):
    got = {r.name: r for r in inspect.cleaned(frame(spark, FILES)).collect()}
    assert {k: (r.outcome, r.verdict) for k, r in got.items()} == {
        "jpeg": ("complete", "confirmed"), "webp": ("complete", "confirmed"), "bmp": ("complete", "confirmed"), "wav": ("complete", "confirmed"),
        "ogg": ("unknown", "no statement"), "text": ("unknown", "no statement"), "empty": ("unknown", "no statement"), "zip": ("unknown", "no statement"),
    }
    assert all((r.findings is None) == (not r.understood) for r in got.values())
    assert [(f.kind, f.severity) for f in got["jpeg"].findings] == [("unknown extension", 0), ("device", 1), ("gps", 2), ("embedded preview", 2), ("comment", 1)]
    assert [f.kind for f in got["webp"].findings] == ["color profile", "author"] and [f.value for f in got["bmp"].findings] == ["5 bytes"]
    assert bytes(got["jpeg"].cleaned) == CLEAN_JPEG and bytes(got["bmp"].cleaned) == BMP[:-5] and len(got["wav"].cleaned) == len(WAV)
    assert bytes(got["webp"].cleaned) == riff(b"WEBP", (b"VP8X", b"\x10" + bytes(9)), (b"VP8 ", b"xy"))
    again = {r.name: r for r in inspect.cleaned(frame(spark, {k: bytes(r.cleaned) for k, r in got.items()})).collect()}
    assert all(again[k].cleaned == got[k].cleaned for k in got)


def test_broken_files_are_rows(spark):
    rnd, broken = random.Random(2), {}
    for name in ("jpeg", "webp", "bmp", "wav"):
        data = FILES[name]
        for n in range(0, len(data), 9):
            broken[f"{name} cut at {n}"] = data[:n]
        for k in range(8):
            b = bytearray(data)
            b[rnd.randrange(len(b))] ^= 1 << rnd.randrange(8)
            broken[f"{name} flip {k}"] = bytes(b)
    df = frame(spark, broken).select("name", images.jpeg_findings(F.col("content")), images.jpeg_cleaned(F.col("content")), images.webp_cleaned(F.col("content")), images.bmp_findings(F.col("content")), chunks.riff_cleaned(F.col("content")))
    assert df.count() == len(broken) == len(df.collect())


def test_strict_records(spark):
    field = lambda tag, data: bytes([tag]) + struct.pack(">H", len(data)) + data
    files = {"good": field(1, b"a") + field(2, b"") + field(9, b"xyz"), "order": field(2, b"a") + field(1, b"b"), "twice": field(1, b"a") * 2, "short": field(1, b"abc")[:-1]}
    got = {r.name: r.t for r in frame(spark, files).select("name", chunks.tlv_fields(F.col("content")).alias("t")).collect()}
    assert [(f.tag, f.size) for f in got["good"].fields] == [("01", 1), ("02", 0), ("09", 3)] and got["good"].error is None
    assert all(got[k].error for k in ("order", "twice", "short"))
