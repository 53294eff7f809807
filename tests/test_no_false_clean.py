"""A file with anything beside what its format needs never gets the clean verdict."""

from __future__ import annotations

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from glasspane.operators import inspect, moving
from glasspane.plans import tables
from tests.test_files import BMP, frame, riff


def flac(*blocks, before=b""):
    out = before + b"fLaC"
    for k, (kind, data) in enumerate(blocks):
        out += bytes([kind | (128 if k == len(blocks) - 1 else 0)]) + struct.pack(">I", len(data))[1:] + data
    return out + b"\xff\xf8sound"


def comments(vendor, *entries, count=None):
    out = struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(entries) if count is None else count)
    return out + b"".join(struct.pack("<I", len(e)) + e for e in entries)


STREAM = (0, bytes(34))
ID3 = b"ID3\x04\0\0\0\0\0\x05hello"
BEXT = b"a concert".ljust(256, b"\0") + b"someone".ljust(32, b"\0") + bytes(32) + b"2024-01-0208:00:00" + bytes(264)
PDF = b"%PDF-1.4\n1 0 obj << /Producer () >> endobj\ntrailer\n%%EOF\n"

CLEAN = {"flac": flac(STREAM, (1, bytes(9)), (3, bytes(18))), "wav": riff(b"WAVE", (b"fmt ", bytes(16)), (b"data", b"\0\0")), "pdf": PDF, "webp": riff(b"WEBP", (b"VP8 ", b"xy")), "bmp": BMP[:2] + struct.pack("<I", 58) + BMP[6:-5]}
TELLING = {
    "flac vendor": (flac(STREAM, (4, comments(b"tool"))), ["software"]),
    "flac picture": (flac(STREAM, (6, b"image")), ["embedded preview"]),
    "flac application": (flac(STREAM, (2, b"riffdata")), ["unknown extension"]),
    "flac cue sheet": (flac(STREAM, (5, b"cues"), (4, comments(b"", b"ARTIST=me"))), ["comment", "author"]),
    "flac unknown block": (flac(STREAM, (77, b"?")), ["unknown extension"]),
    "flac behind id3": (flac(STREAM, before=ID3), ["unknown extension"]),
    "flac many comments": (flac(STREAM, (4, comments(b"", *[b"k=v"] * 5000))), ["comment"] * 5000),
    "flac cut comments": (flac(STREAM, (4, comments(b"", b"k=v", count=9))), ["unknown extension", "comment"]),
    "wav bext": (riff(b"WAVE", (b"fmt ", bytes(16)), (b"bext", BEXT)), ["comment", "author", "timestamp", "timestamp"]),
    "wav ixml": (riff(b"WAVE", (b"fmt ", bytes(16)), (b"iXML", b"<a><b>me</b></a>")), ["comment"]),
    "wav id3": (riff(b"WAVE", (b"id3 ", ID3)), ["unknown extension"]),
    "wav labels": (riff(b"WAVE", (b"LIST", b"adtlnote")), ["unknown extension"]),
    "wav strange field": (riff(b"WAVE", (b"LIST", b"INFOXABC\x02\0\0\0me")), ["comment"]),
    "pdf xmp": (PDF.replace(b"endobj", b"<x:xmpmeta>me</x:xmpmeta> endobj"), ["author"]),
    "pdf hex": (PDF.replace(b"/Producer ()", b"/Author <FEFF006D0065>"), ["author"]),
    "pdf escaped": (PDF.replace(b"/Producer ()", rb"/Author (\(me\) and you)"), ["author"]),
    "pdf elsewhere": (PDF.replace(b"/Producer ()", b"/Author 5 0 R"), ["author"]),
    "webp strange": (riff(b"WEBP", (b"VP8 ", b"xy"), (b"NAME", b"me")), ["unknown extension"]),
}
def png(*more, end=b""):
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"") + end


def jpeg(scan=b"\xa1\xff\x00\xff\xd3\xb2", end=b""):
    return b"\xff\xd8\xff\xdb\0\4\0\1\xff\xda\0\4\1\2" + scan + b"\xff\xd9" + end


def bmp(pixels=bytes(4), gap=b"", size=4, tail=b"", reserved=bytes(4), bits=24):
    head = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, bits, 0, size, 0, 0, 0, 0)
    return b"BM" + struct.pack("<I", 54 + len(gap) + len(pixels + tail)) + reserved + struct.pack("<I", 54 + len(gap)) + head + gap + pixels + tail


SOUND = [(b"fmt ", bytes(16)), (b"data", b"\0\0")]
LIST = lambda kind, *parts: (b"LIST", kind + b"".join(t + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for t, d in parts))
CLEAN |= {
    "png": png(), "jpeg": jpeg(), "jpeg scans": jpeg(b"\xa1\xff\xc4\0\4\xff\xd9\xff\xda\0\4\1\2\xb3"), "bmp plain": bmp(), "bmp empty gap": bmp(gap=bytes(10)), "bmp no length": bmp(size=0),
    "wav filler": riff(b"WAVE", *SOUND, (b"JUNK", bytes(20))), "avi filler": riff(b"AVI ", LIST(b"hdrl", (b"JUNK", bytes(8))), LIST(b"movi", (b"00dc", b"xyz"), LIST(b"rec ", (b"01wb", b"ab")))),
}
TELLING |= {
    "jpeg tail": (jpeg(end=b"me"), ["unknown extension"]),
    "jpeg comment between scans": (jpeg(b"\xa1\xff\xfe\0\4me\xff\xda\0\4\1\2\xb3"), ["unknown extension"]),
    "bmp tail": (bmp(tail=b"me"), ["unknown extension"]), "bmp gap": (bmp(gap=b"me"), ["unknown extension"]), "bmp reserved": (bmp(reserved=b"me\0\0"), ["unknown extension"]),
    "bmp tail without length": (bmp(size=0, tail=b"me"), ["unknown extension"]), "bmp long picture": (bmp(size=6, pixels=b"\1\2\3\0me"), ["unknown extension"]),
    "wav junk": (riff(b"WAVE", *SOUND, (b"JUNK", b"me")), ["unknown extension"]), "wav pad": (riff(b"WAVE", *SOUND, (b"PAD ", b"me")), ["unknown extension"]),
    "avi junk": (riff(b"AVI ", LIST(b"hdrl", (b"JUNK", b"me"))), ["unknown extension"]),
    "avi info in movi": (riff(b"AVI ", LIST(b"movi", (b"00dc", b"xyz"), LIST(b"INFO", (b"IART", b"me\0")))), ["author"]),
    "flac padding": (flac(STREAM, (1, b"\0\0me")), ["unknown extension"]),
    "flac id3v1": (flac(STREAM) + b"TAG" + b"me".ljust(125, b"\0"), ["unknown extension"]),
    "flac ape": (flac(STREAM) + b"APETAGEX" + struct.pack("<IIII", 2000, 32 + 2, 0, 0x80000000) + bytes(8) + b"me" + b"APETAGEX" + struct.pack("<IIII", 2000, 32 + 2, 0, 0x80000000) + bytes(8), ["unknown extension"]),
    "pdf tail": (PDF + b"me", ["unknown extension"]), "pdf comment": (PDF.replace(b"trailer", b"% me\ntrailer"), ["comment"]),
    "pdf company": (PDF.replace(b"1 0 obj << /Producer ()", b"1 0 obj << /Company (me)").replace(b"trailer", b"trailer << /Info 1 0 R >>"), ["comment"]),
    "pdf annotation": (PDF.replace(b"endobj", b"/Annots [ << /T (me) >> ] endobj"), ["comment"]),
    "png long end": (png((b"gAMA", b"12345")), ["unknown extension"]),
}
BROKEN = {"png tail": png(end=b"SECRET author John"), "png cut": png()[:-1], "jpeg cut": jpeg()[:6], "webp cut": CLEAN["webp"][:-2], "bmp short": bmp()[:2] + bytes(4) + bmp()[6:-1], "avi cut": CLEAN["avi filler"][:-1], "pdf head": b"%PDF-", "flac without last": b"fLaC\0\0\0\x22" + bytes(34), "flac cut": flac(STREAM)[:20], "bmp cut": BMP[:2] + bytes(4) + BMP[6:56], "wav cut": CLEAN["wav"][:-1]}
HIDDEN = {"pdf packed": PDF.replace(b"/Producer ()", b"/Type /ObjStm"), "pdf locked": PDF.replace(b"/Producer ()", b"/Encrypt 3 0 R"), "pdf name": PDF.replace(b"/Producer", b"/Auth#6Fr")}


def test_verdicts(spark):
    files = {**CLEAN, **{k: v for k, (v, _) in TELLING.items()}, **BROKEN, **HIDDEN}
    got = {r.name: r for r in inspect.inspected(frame(spark, files)).collect()}
    assert {k for k, r in got.items() if r.verdict == "confirmed"} == set(CLEAN)
    assert {k: [f.kind for f in got[k].findings] for k in TELLING} == {k: kinds for k, (_, kinds) in TELLING.items()}
    assert all(got[k].error and got[k].findings is None for k in BROKEN)
    assert all(got[k].verdict == "no statement" and not got[k].understood for k in HIDDEN)
    assert [f.value for k in ("pdf hex", "pdf escaped", "pdf elsewhere") for f in got[k].findings] == ["me", r"\(me\) and you", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_block_outside_the_keep_list_is_a_finding(spark, seed):
    rnd, files = random.Random(seed), {}
    name = lambda: bytes(rnd.choice(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_") for _ in range(4))
    for i in range(60):
        extra = bytes(rnd.randrange(1, 128) for _ in range(rnd.randint(1, 40)))
        blocks = [STREAM, (rnd.choice([2, 6, *range(7, 127)]), extra)]
        files[f"flac {i}"] = flac(*blocks, (1, bytes(3))) if rnd.random() < 0.5 else flac(*blocks)
        parts = [(b"fmt ", bytes(16)), (name(), extra), (b"data", b"\0\0")]
        files[f"wav {i}"] = riff(b"WAVE", *parts)
        files[f"webp {i}"] = riff(b"WEBP", (b"VP8 ", b"xy"), (name(), extra))
    got = inspect.inspected(frame(spark, files)).collect()
    assert len(got) == len(files) and not [r.name for r in got if r.verdict == "confirmed"]


def test_a_file_that_is_an_expression_is_worked_out_once(spark):
    """Made, cleaned and read in one projection over a table: equal to the steps apart."""
    rows = spark.range(150).select("id", F.concat(F.lit("note "), F.col("id")).alias("note"), F.pmod("id", F.lit(3)).cast("int").alias("kind"))
    made = rows.withColumn("gif", tables.gif_of(F.col("note"), F.col("kind"))).withColumn("clean", moving.gif_cleaned(F.col("gif")))
    got = made.select("kind", F.size(moving.gif_findings(F.col("gif"))).alias("found"), F.size(moving.gif_findings(F.col("clean"))).alias("left"), (moving.gif_cleaned(F.col("clean")) == F.col("clean")).alias("stable"))
    assert {(r.kind, r.found, r.left, r.stable) for r in got.collect()} == {(0, 1, 0, True), (1, 2, 0, True), (2, 2, 0, True)}


def test_cleaning_leaves_nothing(spark):
    files = {k: v for k, (v, _) in TELLING.items()}
    got = {r.name: r for r in inspect.cleaned(frame(spark, files)).collect()}
    whole = {k: bytes(r.cleaned) for k, r in got.items() if r.outcome == "complete"}
    assert set(got) - set(whole) == {"flac cue sheet", "flac unknown block", "wav labels", "webp strange", "jpeg comment between scans", "png long end", *(k for k in TELLING if k.startswith("pdf"))}
    again = {r.name: r for r in inspect.cleaned(frame(spark, whole)).collect()}
    assert all(not r.findings and bytes(r.cleaned) == whole[k] for k, r in again.items())
    assert whole["jpeg tail"] == jpeg() and whole["bmp tail"][54:] == bmp()[54:] and whole["flac ape"] == whole["flac id3v1"] == flac(STREAM)
    assert bytes(got["flac behind id3"].cleaned) == flac(STREAM) and len(whole["flac picture"]) == len(files["flac picture"])
