"""Golden values, boundaries and properties of functions and operators."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from glasspane.functions import keys, lengths, magic, text, verdicts
from glasspane.operators import chunks, findings, rollups, sessions, trust
from glasspane.sources import artifacts
from glasspane.streaming import sessions as streams


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("n", "padded"), [(0, 256), (100, 256), (256, 256), (257, 272), (1000, 1024), (1025, 1088), (65537, 67584), (1 << 40, 1 << 40), ((1 << 40) + 1, (1 << 40) + (1 << 34))])
def test_size_class(spark, n, padded):
    e = max(n, 257).bit_length() - 1
    step = 1 << (e - e.bit_length())
    assert padded == (256 if n <= 256 else -(-n // step) * step)
    assert one(spark, lengths.size_class(F.lit(n).cast("long")))[0] == padded


def test_chunks_and_stanzas(spark):
    got = [one(spark, lengths.chunk_count(F.lit(n).cast("long")))[0] for n in (0, 1, 65536, 65537)]
    assert got == [1, 1, 1, 2]
    assert [one(spark, lengths.padded_stanzas(F.lit(n)))[0] for n in (1, 2, 3, 5, 9, 15, 16, 17)] == [2, 2, 4, 8, 16, 16, 16, 17]


@pytest.mark.parametrize("data", [b"", b"\x00", b"hello", bytes(range(32)), os.urandom(1216)])
def test_base32(spark, data):
    bits = "".join(f"{b:08b}" for b in data)
    want = "".join(text.ALPHABET[int(bits[i : i + 5].ljust(5, "0"), 2)] for i in range(0, len(bits), 5))
    row = one(spark, text.base32(F.lit(bytearray(data))).alias("e"), text.base32_bytes(text.grouped(F.lower(text.base32(F.lit(bytearray(data)))))).alias("d"))
    assert row.e == want and bytes(row.d) == data


def test_base32_refuses_what_is_not_canonical(spark):
    assert [one(spark, text.base32_bytes(F.lit(s)))[0] for s in ("01", "U0", "0", "é0")] == [None] * 4
    assert bytes(one(spark, text.base32_bytes(F.lit("oI-l0")))[0]) == one(spark, text.base32_bytes(F.lit("0110")))[0]


def test_missing_key_differs_from_zero_key(spark):
    z = F.unhex(F.lit("00" * 32))
    none = F.lit(None).cast("binary")
    row = one(spark, keys.fingerprint(z, none, none).alias("a"), keys.fingerprint(z, z, none).alias("b"), keys.fingerprint(z, F.unhex(F.lit("00")), none).alias("c"))
    assert row.a != row.b and row.c is None
    assert bytes(row.a) == hashlib.sha256(b"fp-v2" + bytes(32) + bytes(33) + bytes(1217)).digest()


def test_safety_number_is_hkdf_and_symmetric(spark):
    a, b = F.unhex(F.lit("11" * 32)), F.unhex(F.lit("22" * 32))
    got = spark.range(1).select(keys.safety_number(a, b).alias("x"), keys.safety_number(b, a).alias("y")).first()
    prk = hmac.digest(bytes(32), hashlib.sha256(b"sn-v2" + b"\x11" * 32 + b"\x22" * 32).digest(), "sha256")
    out, block = b"", b""
    for i in (1, 2, 3):
        block = hmac.digest(prk, block + b"sn-digits" + bytes([i]), "sha256")
        out += block
    assert got.x == got.y == " ".join(f"{int.from_bytes(out[i : i + 8], 'big') % 100000:05d}" for i in range(0, 96, 8))


def test_payload_statuses(spark):
    enc = F.unhex(F.lit("ab" * 32))
    none = F.lit(None).cast("binary")
    p = keys.payload(enc, none, none)
    row = one(spark, *[keys.read_payload(x)["status"] for x in (p, F.regexp_replace(p, ".$", "!"), F.lit("hello"), F.lit(""), none.cast("string"))])
    assert list(row) == ["read", "damaged", "foreign", "foreign", "foreign"]


def test_armor(spark):
    data = os.urandom(300)
    row = one(spark, text.armored(F.lit(bytearray(data)), "HEAD", "FOOT").alias("a"))
    assert row.a.split("\n")[1:-1] == [base64.b64encode(data).decode()[i : i + 64] for i in range(0, 400, 64)]
    back = one(spark, text.armored_bytes(F.lit("x " + row.a.replace("\n", "\r\n> ") + " y"), "HEAD", "FOOT"), text.armored_bytes(F.lit("HEAD !! FOOT"), "HEAD", "FOOT"), text.armored_bytes(F.lit("HEAD"), "HEAD", "FOOT"))
    assert bytes(back[0]) == data and back[1] is None and back[2] is None


FORMATS = [
    (bytes.fromhex("89504E470D0A1A0A"), "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"RIFF\0\0\0\0WEBP", "WebP"), (b"RIFF\0\0\0\0WAVE", "WAV"), (b"RIFF\0\0\0\0AVI ", "AVI"),
    (b"GIF89a", "GIF"), (b"BM" + bytes(12) + b"\x28\0\0\0" + bytes(40), "BMP"), (b"BMW is a car, not a bitmap", None), (b"II*\0", "TIFF"), (b"MM\0+", "TIFF"),
    (b"\0\0\0\x18ftypmp42\0\0\0\0isomheic", "video"), (b"\0\0\0\x18ftypheic\0\0\0\0mif1heic", "HEIC/AVIF"), (b"\0\0\0\x14ftyp3gp4\0\0\0\0", "video"),
    (bytes.fromhex("1A45DFA3"), "Matroska"), (b"fLaC", "FLAC"), (b"ID3\x04\0\0\0\0\0\x02xxfLaC", "FLAC"), (b"ID3\x04\0\0\0\0\0\x02xx", "MP3"), (b"\xff\xfb\x90\0", "MP3"),
    (b"OggS", "Ogg"), (b"  <?xml version='1.0'?><svg/>", "SVG"), (b"<?xml version='1.0'?><html/>", None), (b"junk\n%PDF-1.7", "PDF"), (b"PK\x03\x04", "ZIP"),
    (b"", None), (b"\x1f\x8b", None), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", None), (b"plain text", None),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(FORMATS)], "i int, d binary")
    got = {r.i: r.f for r in df.select("i", magic.detect(F.col("d")).alias("f")).collect()}
    assert [got[i] for i in range(len(FORMATS))] == [f for _, f in FORMATS]


def test_unknown_is_never_confirmed(spark):
    df = spark.createDataFrame([(bytearray(d),) for d, f in FORMATS if f is None], "d binary")
    understood = magic.detect(F.col("d")).isNotNull()
    assert {r.v for r in df.select(verdicts.received(understood, F.lit(0), F.lit(True)).alias("v")).collect()} == {"no statement"}
    assert one(spark, verdicts.cleaning(F.lit(None).cast("string")), verdicts.cleaning(F.lit("unknown")))[0:2] == ("no statement", "no statement")


def chunk(tag, data):
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


PNG = bytes.fromhex("89504E470D0A1A0A")
CLEAN = PNG + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
DIRTY = PNG + chunk(b"IHDR", bytes(13)) + chunk(b"tEXt", b"Author\0me") + chunk(b"eXIf", b"12345") + chunk(b"tIME", bytes(7)) + chunk(b"prVt", b"??") + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def test_png(spark):
    df = spark.createDataFrame([(bytearray(DIRTY),), (bytearray(CLEAN),)], "d binary")
    got = df.select(chunks.png_findings(F.col("d")).alias("f"), chunks.png_cleaned(F.col("d")).alias("c")).collect()
    assert [(f.ord, f.kind, f.location, f.value, f.severity) for f in got[0].f] == [
        (0, "comment", "PNG:tEXt", "Author", 1), (1, "gps", "PNG:eXIf", "5 bytes", 2), (2, "timestamp", "PNG:tIME", None, 1), (3, "unknown extension", "PNG:prVt", "2 bytes", 0),
    ]
    assert bytes(got[0].c) == bytes(got[1].c) == CLEAN and got[1].f == []


def test_broken_files_give_rows(spark):
    import random

    rnd = random.Random(1)
    broken = [DIRTY[:n] for n in range(0, len(DIRTY), 7)]
    for _ in range(40):
        b = bytearray(DIRTY)
        b[rnd.randrange(8, len(b))] ^= 1 << rnd.randrange(8)
        broken.append(bytes(b))
    df = spark.createDataFrame([(bytearray(b),) for b in broken], "d binary")
    rows = df.select(chunks.png_findings(F.col("d")), chunks.png_chunks(F.col("d"))["error"].alias("e"), chunks.png_cleaned(F.col("d")).alias("c"), chunks.riff_info(F.col("d")), chunks.flac_blocks(F.col("d")), chunks.pdf_findings(F.col("d")), chunks.vorbis_comments(F.col("d"))).collect()
    assert len(rows) == len(broken) and all(r.c is None for r in rows if r.e) and any(r.e for r in rows)


def test_resolve_precedence(spark):
    prev = "array<struct<fingerprint:binary,sig_pub:binary,was_verified:boolean>>"
    k = lambda s: bytearray(s.encode())
    contacts = spark.createDataFrame(
        [(1, k("a"), "seen", [(k("f1"), k("b"), True)]), (2, k("b"), "verified", []), (3, None, "seen", []), (4, None, "seen", []), (5, k("c"), "changed", [(k("f2"), k("d"), False), (k("f3"), k("e"), True)]), (6, k("c"), "revoked", [])],
        f"ord long, sig_pub binary, state string, previous_keys {prev}",
    )
    messages = spark.createDataFrame([(0, None), (1, k("a")), (2, k("b")), (3, k("c")), (4, k("d")), (5, k("z"))], "message_id long, signer binary")
    got = {r.message_id: (r.case, r.contact_ord, bytes(r.previous_fingerprint or b""), r.previous_verified) for r in trust.resolve_signers(messages, contacts).collect()}
    assert got == {0: ("unsigned", None, b"", None), 1: ("seen", 1, b"", None), 2: ("verified", 2, b"", None), 3: ("changed", 5, b"f3", True), 4: ("changed", 5, b"f2", False), 5: ("unknown", None, b"", None)}


def test_trust_fold_is_final_after_revoke_and_full_at_64(spark):
    events = [("a", i, i, x) for i, x in enumerate(["verify", "replace", "revoke", "verify", "revoke"])] + [("b", i, i, "replace") for i in range(66)]
    got = {r.contact_id: r for r in trust.fold_trust(spark.createDataFrame(events, "contact_id string, seq long, at long, action string")).collect()}
    assert (got["a"].state, got["a"].refused, got["a"].last_verified, got["a"].revoked_at) == ("revoked", 1, True, 4)
    assert (got["b"].state, got["b"].previous, got["b"].refused) == ("changed", 64, 2)


def test_session_boundary_and_stream(spark, tmp_path):
    rows = [("u", 0), ("u", 900_000_000), ("u", 1_799_999_999), ("u", 2_700_000_000), ("v", 5)]
    df = spark.createDataFrame(rows, "k string, us long").select("k", F.timestamp_micros("us").alias("ts"))
    got = sorted((r.k, r.session, r.n) for r in sessions.idle_sessions(df, "k", "ts").collect())
    assert got == [("u", 1, 1), ("u", 2, 2), ("u", 3, 1), ("v", 1, 1)]
    df.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = streams.session_starts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts")
    q = stream.writeStream.format("memory").queryName("starts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.session) for r in spark.table("starts").collect()) == [("u", 1), ("u", 2), ("u", 3), ("v", 1)]


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(DIRTY)
    (tmp_path / "b.txt").write_bytes(b"x" * 5000)
    inside, outside = artifacts.artifacts(spark, str(tmp_path), most=1000)
    assert [r.format for r in artifacts.detected(inside).collect()] == ["PNG"] and outside.count() == 1
    artifacts.write_report(inside.select("length"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_report(inside.select("length"), str(tmp_path / "out"))


def test_only_in_older_keeps_repeats(spark):
    assert one(spark, findings.only_in_older(F.lit("a\n x \nx\n\nb"), F.lit("b\nc")))[0] == ["a", "x", "x"]


def test_longest_mount_has_no_path_boundary(spark):
    mounts = spark.createDataFrame([("/", "ext4"), ("/home", "btrfs")], "mount string, fstype string")
    got = {r.path: r.fstype for r in rollups.longest_mount(spark.createDataFrame([("/homework",), ("/x",), ("y",)], "path string"), mounts).collect()}
    assert got == {"/homework": "btrfs", "/x": "ext4", "y": None}
