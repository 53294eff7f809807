"""Nested boxes: tags, keys by position, times, and broken nesting."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from glasspane.operators import boxes
from tests.test_files import frame


def box(tag, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I", 1) + tag + struct.pack(">Q", 16 + len(body)) + body if wide else struct.pack(">I", 8 + len(body)) + tag + body


def value(text):
    return box(b"data", struct.pack(">II", 1, 0), text)


FTYP = box(b"ftyp", b"isom\0\0\2\0isom")
MDAT = box(b"mdat", b"\1\2\3")
TIME = lambda at, v=0: struct.pack(">B3x", v) + (struct.pack(">QQ", at, at) if v else struct.pack(">II", at, at)) + bytes(20)
NAMES = (b"com.apple.quicktime.location.ISO6709", b"com.apple.quicktime.make", b"com.apple.quicktime.content.identifier", b"x.custom")
KEYS = box(b"keys", bytes(4), struct.pack(">I", len(NAMES)), *(struct.pack(">I", 8 + len(n)) + b"mdta" + n for n in NAMES))
number = lambda i, text: box(struct.pack(">I", i), value(text))
FILES = {
    "plain": (FTYP + box(b"moov", box(b"mvhd", TIME(0)), box(b"trak", box(b"tkhd", TIME(0, 1)))) + MDAT, []),
    "times": (FTYP + box(b"moov", box(b"mvhd", TIME(5)), box(b"trak", box(b"tkhd", TIME(7, 1)))), [("timestamp", "Video:mvhd", None), ("timestamp", "Video:tkhd", None)]),
    "place": (FTYP + box(b"moov", box(b"udta", box(b"\xa9xyz", b"\0\x12\x15\xc7+47.1+008.5/"))), [("gps", "Video:udta/©xyz", "+47.1+008.5/")]),
    "tags": (FTYP + box(b"moov", box(b"udta", box(b"meta", bytes(4), box(b"hdlr", bytes(24), b"\0"), box(b"ilst", box(b"\xa9ART", value(b"me")), box(b"\xa9too", value(b"Tool 1")))))), [("author", "Video:ilst/©ART", "me"), ("software", "Video:ilst/©too", "Tool 1")]),
    "keys": (FTYP + box(b"moov", box(b"meta", bytes(4), KEYS, box(b"ilst", number(3, b"abc"), number(1, b"+1+2/"), number(9, b"none"), number(4, b"c")))), [("device", "Video:com.apple.quicktime.content.identifier", "abc"), ("gps", "Video:com.apple.quicktime.location.ISO6709", "+1+2/"), ("comment", "Video:x.custom", "c")]),
    "users": (FTYP + box(b"moov", box(b"udta", box(b"XYZ1", b"secret")), wide=True), [("unknown extension", "Video:udta", "22 bytes")]),
    "handler": (FTYP + box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", bytes(24), b"Camera One\0"), box(b"minf", box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), struct.pack(">I", 30), b"avc1", bytes(12), b"FFMP", bytes(6))))))), [("software", "Video:hdlr", "Camera One"), ("software", "Video:stsd", "FFMP")]),
    "open end": (FTYP + box(b"moov", box(b"mvhd", TIME(0))) + b"\0\0\0\0mdat1234567", []),
}
BROKEN = {
    "past": (FTYP + box(b"moov", b"\0\0\0\x20free"), "box past its range"), "small": (FTYP + b"\0\0\0\4free", "box smaller than its head"), "cut": (FTYP + MDAT[:-1], "box past its range"), "empty": (b"", "no boxes"),
    "wide": (FTYP + b"\0\0\0\1free\xff\xff\xff\xff\xff\xff\xff\xff", "size not readable"),
}


def test_findings_and_faults(spark):
    files = {**{k: v for k, (v, _) in FILES.items()}, **{k: v for k, (v, _) in BROKEN.items()}}
    deep = b""
    for _ in range(30):
        deep = box(b"udta", deep)
    files["deep"] = FTYP + deep
    got = {r.name: r.r for r in frame(spark, files).select("name", boxes.video_report(F.col("content")).alias("r"), boxes.boxes(F.col("content")).alias("b")).collect()}
    assert {k: got[k].error for k in files if k != "deep"} == {**{k: None for k in FILES}, **{k: e for k, (_, e) in BROKEN.items()}}
    assert {k: [(f.kind, f.location, f.value) for f in got[k].findings] for k in FILES} == {k: want for k, (_, want) in FILES.items()}
    assert got["deep"].error is None  # only so many levels are entered


def test_damaged_files_are_rows(spark):
    rnd, files = random.Random(4), {}
    for i in range(120):
        b = bytearray(FILES[("tags", "keys", "handler")[i % 3]][0])
        for _ in range(rnd.randint(1, 3)):
            b[rnd.randrange(len(b))] = rnd.randrange(256)
        files[f"f{i}"] = bytes(b)
    assert len(frame(spark, files).select(boxes.video_report(F.col("content"))).collect()) == 120
