"""The given tables, and artifacts, keys and messages that Spark derives from them.

The tables hold no files, keys or signed messages; where an operator needs some,
every row of a table is given that role by a fixed rule, so the work grows with
the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.functions.values import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly over all cores, for dear work by row: one task reads a whole row group, which may be the whole table."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def key_of(*parts: Column | str) -> Column:
    """A 32-byte key named by text parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _b(text: str) -> Column:
    return F.lit(text).cast("binary")


def _hex(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _be(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def _le(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substr(h, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)]))


def png_chunk(tag: str, data: Column) -> Column:
    return F.concat(_be(F.octet_length(data)), _b(tag), data, F.unhex(F.lpad(F.hex(F.crc32(F.concat(_b(tag), data))), 8, "0")))


def png_of(keyword: Column, text: Column, stamped: Column) -> Column:
    """An image file with a text chunk and, where ``stamped``, a time chunk."""
    head = png_chunk("IHDR", _hex("00000001000000010802000000"))
    note = png_chunk("tEXt", F.concat(keyword.cast("binary"), _hex("00"), text.cast("binary")))
    time = F.when(stamped, png_chunk("tIME", _hex("07E8010101010101"))).otherwise(_hex(""))
    return F.concat(_hex("89504E470D0A1A0A"), head, note, time, png_chunk("IDAT", _hex("789C6360000000040001")), png_chunk("IEND", _hex("")))


def riff_chunk(tag: str, data: Column) -> Column:
    pad = F.when(F.pmod(F.octet_length(data), F.lit(2)) == 1, _hex("00")).otherwise(_hex(""))
    return F.concat(_b(tag), _le(F.octet_length(data)), data, pad)


def wav_of(artist: Column, comment: Column) -> Column:
    """A sound file with an INFO list before its samples."""
    info = F.concat(_b("INFO"), riff_chunk("IART", F.concat(artist.cast("binary"), _hex("00"))), riff_chunk("ICMT", F.concat(comment.cast("binary"), _hex("00"))))
    rest = F.concat(_b("WAVE"), riff_chunk("fmt ", _hex("01000100401F0000803E000002001000")), riff_chunk("LIST", info), riff_chunk("data", _hex("00000000")))
    return F.concat(_b("RIFF"), _le(F.octet_length(rest)), rest)


def flac_of(entries: list[Column]) -> Column:
    """A sound file with a stream block, a comment block and one audio byte pair."""
    texts = [F.concat(_le(F.octet_length(e)), e.cast("binary")) for e in entries]
    block = F.concat(_le(F.lit(4)), _b("tool"), _le(F.lit(len(texts))), *texts)
    size = lambda n: F.substr(_be(n), F.lit(2), F.lit(3))
    return F.concat(_b("fLaC"), _hex("00000022"), _hex("00" * 34), _hex("84"), size(F.octet_length(block)), block, _hex("FFF8"))


def pdf_of(author: Column, revisions: Column) -> Column:
    """A document with an author field and so many revision ends."""
    head = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Author ("), author, F.lit(") /Producer (tool) >> endobj\n"))
    return F.concat(head, F.repeat(F.lit("trailer\n%%EOF\n"), revisions)).cast("binary")


def contacts_of(customers: DataFrame) -> DataFrame:
    """Every customer as a contact; one in five has no signing key, states go round, changed ones have an old key."""
    n = F.col("c_custkey")
    state = F.get(F.lit(["seen", "verified", "changed", "revoked"]), F.pmod(n, F.lit(4)).cast("int"))
    old = F.struct(key_of("fp", n).alias("fingerprint"), key_of("old", n).alias("sig_pub"), (F.pmod(n, F.lit(8)) == 2).alias("was_verified"))
    none = F.array().cast("array<struct<fingerprint:binary,sig_pub:binary,was_verified:boolean>>")
    return customers.select(
        n.alias("ord"),
        F.col("c_name").alias("name"),
        F.when(F.pmod(n, F.lit(5)) != 0, key_of("sig", n)).alias("sig_pub"),
        state.alias("state"),
        F.when(state == "changed", F.array(old)).otherwise(none).alias("previous_keys"),
    )


def messages_of(events: DataFrame) -> DataFrame:
    """Every event as a message: signed with a current, an old or an unknown key, or not at all."""
    turn = F.pmod("event_id", F.lit(4))
    signer = F.when(turn == 0, key_of("sig", F.col("user_id"))).when(turn == 1, key_of("old", F.col("user_id"))).when(turn == 2, key_of("other", F.col("user_id")))
    return events.select(F.col("event_id").alias("message_id"), signer.alias("signer"))


def jpeg_of(comment: Column, located: Column) -> Column:
    """A photo with a comment and, where ``located``, an Exif block with a location tag."""
    segment = lambda marker, data: F.concat(_hex("FF" + marker), F.substr(_be(F.octet_length(data) + 2), F.lit(3), F.lit(2)), data)
    exif = segment("E1", F.concat(_b("Exif"), _hex("00004D4D002A8825")))
    parts = [segment("E0", _hex("4A46494600")), F.when(located, exif).otherwise(_hex("")), segment("FE", comment.cast("binary")), segment("DB", _hex("0001")), segment("DA", _hex("0102")), _hex("A1B2C3FFD9")]
    return F.concat(_hex("FFD8"), *parts)


def webp_of(note: Column) -> Column:
    """A picture with Exif and XMP blocks, announced in its feature byte."""
    rest = F.concat(_b("WEBP"), riff_chunk("VP8X", _hex("1C000000000000000000")), riff_chunk("VP8 ", _hex("0102")), riff_chunk("EXIF", note.cast("binary")), riff_chunk("XMP ", note.cast("binary")))
    return F.concat(_b("RIFF"), _le(F.octet_length(rest)), rest)


def bmp_of(tail: Column) -> Column:
    """A picture of four bytes with something behind it."""
    head = F.concat(_b("BM"), _le(F.lit(58) + F.octet_length(tail)), _hex("00000000"), _le(F.lit(54)))
    info = F.concat(_le(F.lit(40)), _hex("0100000001000000010018000000000004000000"), _hex("00" * 16))
    return F.concat(head, info, _hex("01020300"), tail.cast("binary"))


def stanzas_of(suppliers: Column) -> Column:
    """A stanza (type, length, body) for each supplier; every fifth is a dummy."""
    def stanza(k: Column) -> Column:
        kind = F.when(F.pmod(k, F.lit(5)) == 0, _hex("FF")).otherwise(_hex("01"))
        return F.concat(kind, F.substr(_be(F.octet_length(k.cast("string"))), F.lit(3), F.lit(2)), k.cast("string").cast("binary"))

    return F.aggregate(F.transform(suppliers, stanza), _hex(""), lambda a, x: F.concat(a, x))


def gif_of(comment: Column, kind: Column) -> Column:
    """A picture with a comment of at most 255 bytes and an application block: a loop (0), a text of its maker (1) or another one (2)."""
    head = F.concat(_b("GIF89a"), F.when(F.pmod(kind, F.lit(2)) == 0, _hex("01000100000000")).otherwise(_hex("01000100800000AABBCCDDEEFF")))
    block = F.when(kind == 0, _hex("21FF0B4E45545343415045322E300301000000")).when(kind == 1, _hex("21FF0B584D502044617461584D5002616200")).otherwise(_hex("21FF0B494343524742473130313201AA00"))
    note = F.concat(_hex("21FE"), F.substr(_be(F.octet_length(comment)), F.lit(4), F.lit(1)), comment.cast("binary"), _hex("00"))
    return F.concat(head, _hex("21F9040000000000"), note, block, _hex("2C000000000100010000"), _hex("02024C0100"), _hex("3B"))


def avi_of(track: Column, tool: Column) -> Column:
    """A film with a track name and the name of a tool."""
    text = lambda c: F.concat(c.cast("binary"), _hex("00"))
    track_list = riff_chunk("LIST", F.concat(_b("strl"), riff_chunk("strh", _hex("00000000")), riff_chunk("strn", text(track))))
    head = riff_chunk("LIST", F.concat(_b("hdrl"), riff_chunk("avih", _hex("00000000")), track_list))
    info = riff_chunk("LIST", F.concat(_b("INFO"), riff_chunk("ISFT", text(tool))))
    rest = F.concat(_b("AVI "), head, info, riff_chunk("LIST", F.concat(_b("movi"), riff_chunk("00dc", _hex("0102")))), riff_chunk("idx1", _hex("00000000")))
    return F.concat(_b("RIFF"), _le(F.octet_length(rest)), rest)


def header_field(tag: str, data: Column) -> Column:
    return F.concat(_hex(tag), F.substr(_be(F.octet_length(data)), F.lit(3), F.lit(2)), data)


def header_of(size: Column, name: Column, variant: Column) -> Column:
    """A message header; variants above 1 break one rule each."""
    only = lambda k, c, other="": F.when(variant == k, c).otherwise(_hex(other))
    eight = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
    return F.concat(
        header_field("00", F.when(variant == 7, _hex("0001")).otherwise(_hex("0000"))),
        header_field("01", F.when(variant == 4, _hex("02")).otherwise(_hex("01"))),
        F.when(variant == 6, _hex("")).otherwise(header_field("02", eight(size))),
        header_field("03", eight(F.lit(16))),
        header_field("04", F.when(variant.isin(1, 2), _hex("01")).otherwise(_hex("00"))),
        only(1, header_field("05", key_of("sig", size))),
        header_field("06", F.when(variant == 5, F.concat(F.lit("a/"), name)).otherwise(name).cast("binary")),
        only(3, header_field("09", _hex("00"))),
    )


def tiff_of(maker: Column, artist: Column, variant: Column, small: bool) -> Column:
    """A picture of four bytes with its maker and artist (5 bytes or more each): plain (0), with two bytes behind it (1), with a directory that points to itself (2), with a place (3)."""
    n32 = _le if small else _be
    n16 = lambda n: F.substr(_le(n), F.lit(1), F.lit(2)) if small else F.substr(_be(n), F.lit(3), F.lit(2))
    entry = lambda tag, kind, count, value: F.concat(n16(F.lit(tag)), n16(F.lit(kind)), n32(count), n32(value))
    a, b = F.octet_length(maker) + 1, F.octet_length(artist) + 1
    picture = F.lit(74) + a + b
    last = F.when(variant == 3, entry(0x8825, 4, F.lit(1), picture + 4)).otherwise(entry(0x9999, 4, F.lit(1), F.lit(0)))
    entries = F.concat(entry(0x010F, 2, a, F.lit(74)), entry(0x0111, 4, F.lit(1), picture), entry(0x0117, 4, F.lit(1), F.lit(4)), entry(0x013B, 2, b, F.lit(74) + a), last)
    after = n32(F.when(variant == 2, 8).otherwise(0))
    head = F.concat(_b("II" if small else "MM"), n16(F.lit(42)), n32(F.lit(8)), n16(F.lit(5)), entries, after)
    behind = F.when(variant == 1, _b("me")).when(variant == 3, _hex("000000000000")).otherwise(_hex(""))
    return F.concat(head, maker.cast("binary"), _hex("00"), artist.cast("binary"), _hex("00"), _hex("01020304"), behind)


def exif_of(tiff: Column) -> Column:
    """A photo with an Exif block."""
    body = F.concat(_b("Exif"), _hex("0000"), tiff)
    return F.concat(_hex("FFD8FFE1"), F.substr(_be(F.octet_length(body) + 2), F.lit(3), F.lit(2)), body, _hex("FFDB00040001FFDA00040102A1B2C3FFD9"))


def zip_of(entries: Column, comment: Column) -> Column:
    """An archive of entries (name, method, data), in order."""
    n16 = lambda n: F.substr(_le(n), F.lit(1), F.lit(2))

    def parts(e: Column) -> Column:
        size = lambda n: F.concat(_hex("0000000000000000"), n, n, n16(F.octet_length(e["name"])), _hex("0000"))
        return F.struct(n16(e["method"]).alias("method"), let(_le(F.octet_length(e["data"])), size).alias("sizes"), e["name"].cast("binary").alias("name"), e["data"].alias("data"))

    def add(s: Column, e: Column) -> Column:
        local = F.concat(_hex("504B030414000000"), e["method"], e["sizes"], e["name"], e["data"])
        central = F.concat(_hex("504B0102140014000000"), e["method"], e["sizes"], _hex("00000000000000000000"), _le(F.octet_length(s["body"])), e["name"])
        return F.struct(F.concat(s["body"], local).alias("body"), F.concat(s["central"], central).alias("central"))

    def end(s: Column) -> Column:
        n = n16(F.size(entries))
        return F.concat(s["body"], s["central"], _hex("504B050600000000"), n, n, _le(F.octet_length(s["central"])), _le(F.octet_length(s["body"])), n16(F.octet_length(comment)), comment.cast("binary"))

    return F.aggregate(F.transform(entries, parts), F.struct(_hex("").alias("body"), _hex("").alias("central")), add, end)


def box(tag: str | Column, *parts: Column) -> Column:
    body = F.concat(*parts)
    return F.concat(_be(F.octet_length(body) + 8), _hex(tag) if isinstance(tag, str) else tag, body)


#: Names of keys that a phone writes, by their place.
FILM_KEYS = ("com.apple.quicktime.location.ISO6709", "com.apple.quicktime.make", "com.apple.quicktime.model", "com.apple.quicktime.creationdate")


def film_of(values: list[Column], places: Column, stamped: Column) -> Column:
    """A film with a directory of keys and an item for each of ``places`` (numbers of keys, from 1) with the value of that number; a time where ``stamped``."""
    names = F.concat(*[F.concat(_be(F.lit(8 + len(n))), _b("mdta"), _b(n)) for n in FILM_KEYS])
    keys = box("6B657973", _hex("00000000"), _be(F.lit(len(FILM_KEYS))), names)
    one = lambda k: box(_be(k), box("64617461", _hex("0000000100000000"), F.get(F.array(*values), k - 1).cast("binary")))
    items = F.aggregate(F.transform(places, one), _hex(""), lambda a, x: F.concat(a, x))
    meta = box("6D657461", _hex("00000000"), keys, box("696C7374", items))
    time = box("6D766864", _hex("00000000"), F.when(stamped, _hex("DEADBEEFDEADBEEF")).otherwise(_hex("0000000000000000")), _hex("00" * 20))
    return F.concat(box("66747970", _b("qt  "), _hex("00000200"), _b("qt  ")), box("6D6F6F76", time, meta), box("6D646174", _hex("010203")))
