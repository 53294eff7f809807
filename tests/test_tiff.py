"""TIFF directories, Exif blocks and raw photos, in both byte orders."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from glasspane.operators import inspect, tiff
from tests.test_files import frame


def directory(order, at, entries, after=0):
    """A directory at ``at`` with its outside values behind it: entries are (tag, type, count, value bytes or number)."""
    size, head, values = 2 + 12 * len(entries) + 4, struct.pack(order + "H", len(entries)), b""
    for tag, kind, count, value in entries:
        if value is None or isinstance(value, int):
            field = struct.pack(order + ("HH" if kind == 3 else "I"), *([value or 0, 0] if kind == 3 else [value or 0]))
        elif len(value) <= 4:
            field = value.ljust(4, b"\0")
        else:
            field, values = struct.pack(order + "I", at + size + len(values)), values + value
        head += struct.pack(order + "HHI", tag, kind, count) + field
    return head + struct.pack(order + "I", after) + values


def tiff_of(order, entries, *more, pictures=b""):
    """Directories one behind another, then picture bytes; a tag of None stands for offsets of the pictures."""
    at, parts = 8, []
    sizes = [len(directory(order, 0, e)) for e in (entries, *more)]
    ends = [8 + sum(sizes[: i + 1]) for i in range(len(sizes))]
    for i, e in enumerate((entries, *more)):
        e = [(t, k, n, ends[-1] if v is None else v) for t, k, n, v in e]
        parts.append(directory(order, at, e, ends[i] if i + 1 < len(sizes) else 0))
        at = ends[i]
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + b"".join(parts) + pictures


def text(tag, value):
    return (tag, 2, len(value) + 1, value.encode() + b"\0")


PICTURE = [(0x0111, 4, 1, None), (0x0117, 4, 1, 4)]
FILES = {}
for o, name in (("<", "small"), (">", "big")):
    FILES |= {
        f"{name} clean": (tiff_of(o, PICTURE, pictures=b"\1\2\3\4"), []),
        f"{name} tags": (tiff_of(o, [text(0x010F, "Acme"), text(0x013B, "me & you"), *PICTURE], pictures=b"\1\2\3\4"), [("device", "TIFF:Make", "Acme"), ("author", "TIFF:Artist", "me & you")]),
        f"{name} pages": (tiff_of(o, PICTURE, [text(0x0131, "a tool"), (0x00FE, 4, 1, 1)], pictures=b"\1\2\3\4"), [("software", "TIFF:IFD1/Software", "a tool"), ("embedded preview", "TIFF:IFD1/directory", None)]),
        f"{name} tail": (tiff_of(o, PICTURE, pictures=b"\1\2\3\4me"), [("unknown extension", "TIFF:tail", "2 bytes")]),
        f"{name} gps": (tiff_of(o, [(0x8825, 4, 1, 8 + 18 + 24), *PICTURE])[: 8 + 18 + 24] + struct.pack(o + "H", 0) + bytes(4) + b"", None),
        f"{name} raw": (tiff_of(o, [(0x0106, 3, 1, 32803), *PICTURE], pictures=b"\1\2\3\4"), [("unknown extension", "TIFF:raw photo", "sensor data")]),
        f"{name} dng": (tiff_of(o, [(0xC612, 1, 4, b"\1\4\0\0"), *PICTURE], pictures=b"\1\2\3\4"), [("unknown extension", "TIFF:raw photo", "sensor data")]),
    }
GAP = tiff_of("<", [(0x0111, 4, 1, 8 + 2 + 36 + 4 + 2), (0x0117, 4, 1, 4), (0x0100, 4, 1, 1)], pictures=b"me\1\2\3\4")
CIRCLE = b"II" + struct.pack("<HI", 42, 8) + directory("<", 8, PICTURE[1:], 8)
LONG = b"II" + struct.pack("<HI", 42, 8) + directory("<", 8, [(0x010F, 2, 50, 4000)])
BROKEN = {
    "circle": (CIRCLE, "directories in a circle"), "value": (LONG, "value past the end"), "cut": (CIRCLE[:20], "directory past the end"), "big": (b"II\x2b\0" + bytes(20), "BigTIFF is not read"),
    "picture": (tiff_of("<", PICTURE, pictures=b"\1\2\3"), "picture data past the end"), "head": (b"MM\0\x2a\0\0", "truncated head"), "none": (b"MM\0\x2a" + bytes(8), "no directory"),
    "pairs": (tiff_of("<", [(0x0111, 4, 2, struct.pack("<II", 8, 8)), (0x0117, 4, 1, 4)]), "picture data past the end"),
    "many": (b"II" + struct.pack("<HI", 42, 8) + b"".join(struct.pack("<HI", 0, 14 + 6 * i) for i in range(80)), "too many directories"),
}


def test_findings_and_faults(spark):
    files = {**{k: v for k, (v, _) in FILES.items()}, **{k: v for k, (v, _) in BROKEN.items()}, "gap": GAP}
    got = {r.name: r for r in inspect.inspected(frame(spark, files)).collect()}
    assert {k: got[k].error for k in BROKEN} == {k: why for k, (_, why) in BROKEN.items()}
    told = lambda k: [(f.kind, f.location, f.value) for f in got[k].findings]
    for k, (_, want) in FILES.items():
        if want is not None:
            assert (told(k), got[k].verdict) == (want, "warning" if want else "confirmed"), k
    assert told("gap") == [("unknown extension", "TIFF:gap", "2 bytes")]


def test_sub_directories_are_walked_once(spark):
    sub = struct.pack("<H", 1) + struct.pack("<HHI4s", 0x0106, 3, 1, struct.pack("<HH", 34892, 0)) + bytes(4)
    at = 8 + 2 + 24 + 4
    data = b"II" + struct.pack("<HI", 42, 8) + directory("<", 8, [(0x014A, 4, 1, at), (0x8769, 4, 1, at)]) + sub
    row = frame(spark, {"x": data}).select(tiff.directories(F.col("content")).alias("t"), tiff.camera_raw(F.col("content")).alias("raw")).first()
    assert row.t.error is None and [(d.main, d.at) for d in row.t.dirs] == [(True, 8), (False, at)] and row.raw == "sensor data"


def exif(data):
    body = b"Exif\0\0" + data
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\4\1\2\xa1\xff\xd9"


def test_exif_of_photos(spark):
    gps_at = 8 + 2 + 36 + 4 + 5
    tags = tiff_of(">", [text(0x0110, "Cam1"), text(0x010F, "M"), (0x8825, 4, 1, gps_at)]) + bytes(6)
    files = {"tags": exif(tags), "no tag but bytes": exif(tiff_of(">", [text(0x0131, "x\x25\u0088z")])), "unreadable": exif(b"MM\0\x2a\x88\x25")}
    got = {r.name: [(f.kind, f.location, f.value) for f in r.findings] for r in inspect.inspected(frame(spark, files)).collect()}
    assert got["tags"] == [("device", "APP1:Exif/Model", "Cam1"), ("device", "APP1:Exif/Make", "M"), ("gps", "APP1:Exif/GPS-IFD", "4 bytes")]
    assert [k for k, *_ in got["no tag but bytes"]] == ["software"]
    assert [k for k, *_ in got["unreadable"]] == ["device", "gps"]


def test_flipped_bytes_are_rows(spark):
    rnd, files = random.Random(8), {}
    data = FILES["big pages"][0]
    for i in range(200):
        b = bytearray(data[: rnd.randint(8, len(data))] if i % 2 else data)
        b[rnd.randrange(len(b))] ^= 1 << rnd.randrange(8)
        files[f"f{i}"] = bytes(b)
    got = inspect.inspected(frame(spark, files)).collect()
    assert len(got) == 200 and all(r.error or r.findings is not None for r in got if r.format == "TIFF")
