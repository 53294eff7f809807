"""Chunked container formats read and cleaned with column expressions on BINARY.

A walk is a fold over as many steps as the file can have chunks (bounded); a
broken file gives a row with an error, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspane.functions.magic import be32, id3_size, le32
from glasspane.functions.text import shown
from glasspane.functions.values import bound, let

#: Chunks followed in one file (more are an error), blocks of a FLAC file, and bytes of one chunk.
MOST_CHUNKS, MOST_BLOCKS, MOST_BYTES = 100_000, 10_000, 64 << 20
#: Items that a fold gathers before they go to a list of lists, so that it does not copy all at each step.
GATHERED = 256
#: PNG chunks that an image needs.
PNG_KEPT = ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "gAMA", "cHRM", "sRGB")
_CHUNK = "array<struct<tag:string,start:bigint,size:bigint>>"


def _gather(state: Column, item: Column) -> Column:
    """A fold's state (full: lists of ``GATHERED`` items, open: the next ones) with one item more."""
    room = F.size(state["open"]) < GATHERED
    full = F.when(room, state["full"]).otherwise(F.concat(state["full"], F.array(state["open"])))
    return F.struct(full.alias("full"), F.when(room, F.concat(state["open"], F.array(item))).otherwise(F.array(item)).alias("open"))


def _nothing(kind: str) -> Column:
    none = F.array().cast(kind)
    return F.struct(F.array().cast(f"array<{kind}>").alias("full"), none.alias("open"))


def _all_of(state: Column) -> Column:
    return F.flatten(F.concat(state["full"], F.array(state["open"])))


#: What a reader gives of a file: why it is broken, or its findings.
FINDINGS = "array<struct<ord:int,kind:string,location:string,value:string,severity:int>>"
_ITEM = "struct<kind:string,location:string,value:string,severity:int>"


def item(kind: Column | str, place: Column | str, value: Column | None = None, severity: Column | int = 0) -> Column:
    """A finding without its place in the file."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(kind).alias("kind"), col(place).alias("location"), col(value).alias("value"), col(severity).alias("severity")).cast(_ITEM)


def numbered(items: Column) -> Column:
    """Findings in order, those that are null left out."""
    made = F.transform(F.array_compact(items), lambda f, i: F.struct(i.alias("ord"), f["kind"].alias("kind"), f["location"].alias("location"), shown(f["value"]).alias("value"), f["severity"].alias("severity")))
    return made.cast(FINDINGS)


def size_text(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" bytes"))


def report(walk: Column, told: Callable[[Column], Column], error: Callable[[Column], Column] = lambda w: w["error"]) -> Column:
    """``error`` of a walk, or else the ``findings`` that it gives: both from one walk."""
    found = lambda e, w: F.struct(e.alias("error"), F.when(e.isNull(), told(w)).cast(FINDINGS).alias("findings"))
    return let(walk, lambda w: let(error(w), lambda e: found(e, w)))


def filled(data: Column) -> Column:
    """Whether a filler holds anything but zero bytes."""
    return F.rlike(F.hex(data), F.lit("[^0]"))


def _walk(data: Column, first: int | Column, head: int, read: Callable[[Column, Column], tuple[Column, Column, Column]], last: str | None, most: int = MOST_CHUNKS, tail: str | None = None) -> Column:
    """``chunks`` (tag, start of the body from 0, size) and ``error``; ``read`` gives tag, size and bytes to the next chunk (or these as a function of the chunk).

    The walk ends with a chunk named ``last``; ``tail`` is the error of a file that goes on behind it.
    """
    end = F.octet_length(data)

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        state = lambda at, got, error, over: F.struct(at.alias("at"), got.alias("got"), error.alias("error"), over.alias("over"))
        tag, size, advance = read(data, at)

        def one(s: Column, c: Column) -> Column:
            following = at + (c["advance"] if isinstance(advance, Column) else advance(c))
            fault = F.when(at + head > end, "truncated head").when(c["size"] > MOST_BYTES, "chunk too large").when(following > end, "truncated chunk")
            chunk = F.struct(c["tag"].alias("tag"), (at + head).alias("start"), c["size"].alias("size"))
            goes_on = state(following, _gather(s["got"], chunk), F.lit(None).cast("string"), F.lit(last is not None) & (c["tag"] == (last or "")))
            return F.when(fault.isNotNull(), state(at, s["got"], fault, F.lit(True))).otherwise(goes_on)

        # the chunk is named by a fold of one step, since ``let`` would copy the whole state
        chunk = F.struct(*[c.alias(k) for k, c in zip(("tag", "size", "advance"), (tag, size, advance)) if isinstance(c, Column)])
        after = F.when(at >= end, state(at, s["got"], s["error"], F.lit(True))).otherwise(F.aggregate(F.array(chunk), s, one))
        return F.when(s["over"], s).otherwise(after)

    first = first if isinstance(first, Column) else F.lit(first)
    start = F.struct(first.cast("long").alias("at"), _nothing(_CHUNK).alias("got"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("over"))
    steps = F.when(end.isNotNull(), F.sequence(F.lit(1), F.least(F.lit(most), (end / head).cast("int") + 1)))

    def finish(s: Column) -> Column:
        fault = lambda got: F.when(s["error"].isNotNull(), s["error"]).when(F.size(got) == 0, "no chunks").when(~s["over"] & (s["at"] < end), "too many chunks").when(s["at"] < end, F.lit(tail))
        return let(_all_of(s["got"]), lambda got: F.struct(got.alias("chunks"), fault(got).alias("error")))

    return F.aggregate(steps, start, step, finish)


@bound
def png_chunks(data: Column) -> Column:
    def read(d: Column, at: Column) -> tuple[Column, Column, Column]:
        size = be32(d, at.cast("int"))
        return F.substr(d, at.cast("int") + 5, F.lit(4)).cast("string"), size, lambda c: c["size"] + 12

    return _walk(data, 8, 8, read, "IEND", tail="bytes behind the end")


@bound
def riff_chunks(data: Column, first: int = 12) -> Column:
    """Chunks of a RIFF body; bodies are padded to even lengths."""

    def read(d: Column, at: Column) -> tuple[Column, Column, Column]:
        size = le32(d, at.cast("int") + 4)
        return F.substr(d, at.cast("int") + 1, F.lit(4)).cast("string"), size, F.least(size + 8 + F.pmod(size, F.lit(2)), F.greatest(F.octet_length(d) - at, size + 8))

    return _walk(data, first, 8, read, None)


def _byte(data: Column, at: Column) -> Column:
    """The byte at an offset from 0, or null behind the end."""
    return F.conv(F.nullif(F.hex(F.substr(data, at.cast("int") + 1, F.lit(1))), F.lit("")), 16, 10).cast("int")


@bound
def flac_start(data: Column) -> Column:
    """Bytes of an ID3 tag before the stream's mark; a reader of the stream alone would miss it."""
    return F.when(F.substr(data, F.lit(1), F.lit(3)) == F.lit("ID3").cast("binary"), id3_size(data)).otherwise(0)


@bound
def flac_blocks(data: Column) -> Column:
    """Metadata blocks of a FLAC file, named by their type number; the audio frames are skipped.

    A chain of which no block is marked as the last is an error.
    """

    def read(d: Column, at: Column) -> tuple[Column, Column, Column]:
        word = be32(d, at.cast("int"))
        size = F.pmod(word, F.lit(1 << 24))
        kind = F.pmod((word / (1 << 24)).cast("long"), F.lit(128)).cast("string")
        stop = word >= (1 << 31)
        return kind, size, F.when(stop & (at + size + 4 <= F.octet_length(d)), F.octet_length(d) - at).otherwise(size + 4)

    def closed(walk: Column) -> Column:
        end = F.try_element_at(walk["chunks"], F.lit(-1))
        open_end = F.hex(F.substr(data, (end["start"] - 3).cast("int"), F.lit(1))) < "80"
        return F.struct(walk["chunks"].alias("chunks"), F.coalesce(walk["error"], F.when(open_end, "no last block")).alias("error"))

    return let(_walk(data, flac_start(data) + 4, 4, read, None, MOST_BLOCKS), closed)


#: Types of FLAC blocks.
FLAC_PADDING, FLAC_APPLICATION, FLAC_COMMENT, FLAC_CUES, FLAC_PICTURE = "1", "2", "4", "5", "6"
FLAC_PLAIN = ("0", FLAC_PADDING, "3")


@bound
def tag_tail(data: Column) -> Column:
    """Bytes of the tags at a file's end, found backwards: ID3v1 (128 bytes), before it APEv2 (by the size in its footer)."""
    end = F.octet_length(data)
    last = F.when((end >= 128) & (F.substr(data, end - 127, F.lit(3)) == F.lit("TAG").cast("binary")), 128).otherwise(0)

    def ape(stop: Column) -> Column:
        foot = (stop - 32).cast("int")
        there = (stop >= 32) & (F.substr(data, foot + 1, F.lit(8)) == F.lit("APETAGEX").cast("binary"))
        headed = F.when(be32(data, foot + 20).isNotNull() & (_byte(data, foot + 23) >= 128), 32).otherwise(0)
        return F.when(there, F.least(stop.cast("long"), le32(data, foot + 12) + headed)).otherwise(0)

    return let(last.cast("long"), lambda v1: let(ape(end - v1), lambda a: F.struct(v1.alias("id3v1"), a.alias("ape"), (v1 + a).alias("size"))))


@bound
def flac_cleaned(data: Column) -> Column:
    """Telling blocks and what padding holds become empty padding of the same size, tags before and behind the stream go; null where the file is broken."""

    def part(c: Column) -> Column:
        at = c["start"] - 4
        same = F.substr(data, (at + 1).cast("int"), (c["size"] + 4).cast("int"))
        mark = F.when(F.hex(F.substr(same, F.lit(1), F.lit(1))) >= "80", F.unhex(F.lit("81"))).otherwise(F.unhex(F.lit("01")))
        blank = F.concat(mark, F.substr(same, F.lit(2), F.lit(3)), F.unhex(F.repeat(F.lit("00"), c["size"].cast("int"))))
        return F.when(c["tag"].isin(FLAC_APPLICATION, FLAC_COMMENT, FLAC_PICTURE, FLAC_PADDING), blank).otherwise(same)

    def whole(walk: Column) -> Column:
        end = F.try_element_at(walk["chunks"], F.lit(-1))
        behind = end["start"] + end["size"]
        sound = F.substr(data, (behind + 1).cast("int"), (F.octet_length(data) - behind - tag_tail(data)["size"]).cast("int"))
        return F.when(walk["error"].isNull(), F.concat(F.substr(data, (flac_start(data) + 1).cast("int"), F.lit(4)), _join_bytes(F.transform(walk["chunks"], part)), sound))

    return let(flac_blocks(data), whole)


@bound
def stanzas(data: Column, first: int = 0) -> Column:
    """Recipient stanzas of an envelope: type byte in hex, length in two bytes, body; bodies over 4096 bytes are refused."""

    def read(d: Column, at: Column) -> tuple[Column, Column, Column]:
        p = at.cast("int")
        size = F.conv(F.hex(F.substr(d, p + 2, F.lit(2))), 16, 10).cast("long")
        return F.hex(F.substr(d, p + 1, F.lit(1))), size, F.when(size <= 4096, size + 3).otherwise(F.octet_length(d) + 1)

    return _walk(data, first, 3, read, None)


@bound
def tlv_fields(data: Column) -> Column:
    """Fields (tag in hex, start, size) of a strict record: tags must ascend; an error says where they do not."""
    def strict(walk: Column) -> Column:
        tags = F.transform(walk["chunks"], lambda c: c["tag"])
        ascending = F.forall(F.zip_with(tags, F.slice(tags, 2, MOST_CHUNKS), lambda a, b: b.isNull() | (a < b)), lambda x: x)
        return F.struct(walk["chunks"].alias("fields"), F.coalesce(walk["error"], F.when(~ascending, "tags out of order")).alias("error"))

    return let(stanzas(data), strict)


def body(data: Column, chunk: Column, most: int | None = None) -> Column:
    size = chunk["size"].cast("int")
    return F.substr(data, (chunk["start"] + 1).cast("int"), size if most is None else F.least(size, F.lit(most)))


def _z_text(data: Column) -> Column:
    """Bytes up to the first zero, as text; null if they are no UTF-8."""
    at = F.locate("\0", F.decode(data, "ISO-8859-1"))
    return F.try_validate_utf8(F.substr(data, F.lit(1), F.when(at > 0, at - 1).otherwise(F.octet_length(data))).cast("string"))


#: Sizes that PNG chunks of a fixed form have.
PNG_SIZES = {"IHDR": 13, "IEND": 0, "gAMA": 4, "cHRM": 32, "sRGB": 1}


def _png_told(data: Column, walk: Column) -> Column:
    odd = lambda c: F.coalesce(F.create_map(*[F.lit(x) for pair in PNG_SIZES.items() for x in pair])[c["tag"]] != c["size"], F.lit(False))
    chunks = F.filter(walk["chunks"], lambda c: ~c["tag"].isin(*PNG_KEPT) | odd(c))

    def finding(c: Column) -> Column:
        tag, size = c["tag"], size_text(c["size"])
        text = tag.isin("tEXt", "zTXt", "iTXt")
        kind = F.when(text, "comment").when(tag == "eXIf", "gps").when(tag == "tIME", "timestamp").when(tag == "iCCP", "color profile").otherwise("unknown extension")
        value = F.when(text, _z_text(body(data, c, 80))).when(tag == "eXIf", size).when(~tag.isin("tIME", "iCCP"), size)
        severity = F.when(tag == "eXIf", 2).when(text | (tag == "tIME"), 1).otherwise(0)
        return item(kind, F.concat(F.lit("PNG:"), tag), value, severity)

    return numbered(F.transform(chunks, finding))


@bound
def png_findings(data: Column) -> Column:
    """Findings of the chunks that an image does not need, or that hold more than they may: ord, kind, location, value, severity."""
    return let(png_chunks(data), lambda w: _png_told(data, w))


@bound
def png_report(data: Column) -> Column:
    return report(png_chunks(data), lambda w: _png_told(data, w))


def _join_bytes(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


@bound
def png_cleaned(data: Column) -> Column:
    """The file with the needed chunks alone, copied byte for byte; null where it is broken."""
    def whole(walk: Column) -> Column:
        kept = F.filter(walk["chunks"], lambda c: c["tag"].isin(*PNG_KEPT))
        parts = F.transform(kept, lambda c: F.substr(data, (c["start"] - 7).cast("int"), (c["size"] + 12).cast("int")))
        return F.when(walk["error"].isNull(), F.concat(F.substr(data, F.lit(1), F.lit(8)), _join_bytes(parts)))

    return let(png_chunks(data), whole)


def _info_of(data: Column, walk: Column) -> Column:
    lists = F.filter(walk["chunks"], lambda c: (c["tag"] == "LIST") & (F.substr(data, (c["start"] + 1).cast("int"), F.lit(4)) == F.lit("INFO").cast("binary")))

    def fields(c: Column) -> Column:
        of = lambda inner: F.transform(riff_chunks(inner, 4)["chunks"], lambda x: F.struct(x["tag"].alias("tag"), _z_text(body(inner, x)).alias("value")))
        return let(body(data, c), of)

    return F.flatten(F.transform(lists, fields))


@bound
def riff_info(data: Column) -> Column:
    """Fields of the INFO lists of a RIFF file: tag, value, in file order."""
    return let(riff_chunks(data), lambda w: _info_of(data, w))


#: RIFF chunks that tell about people and devices; their place is kept when they go.
RIFF_REMOVED = ("LIST", "bext", "iXML", "_PMX", "aXML", "id3 ", "ID3 ", "cset")
#: Chunks of a sound file that say how it sounds; fields of a broadcast chunk: name, offset, length, kind, severity.
WAV_KEPT = ("fmt ", "data", "fact", "cue ", "smpl", "inst", "plst", "PEAK", "JUNK", "PAD ")
BEXT = (
    ("description", 0, 256, "comment", 2), ("originator", 256, 32, "author", 2), ("reference", 288, 32, "device", 2),
    ("date", 320, 10, "timestamp", 1), ("time", 330, 8, "timestamp", 1), ("history", 602, 1 << 30, "software", 1),
)


#: Chunks that only fill space; whatever they hold but zero bytes is a finding.
FILLERS = ("JUNK", "PAD ")


def _wav_told(data: Column, walk: Column) -> Column:
    from glasspane.operators.findings import RIFF_INFO, named

    def of(c: Column) -> Column:
        def told(b: Column) -> Column:
            tag, size = c["tag"], size_text(c["size"])
            field = lambda at, n: F.trim(_z_text(F.substr(b, F.lit(at + 1), F.lit(n))))
            bext = [F.when((tag == "bext") & (F.coalesce(field(at, n), F.lit("?")) != ""), item(kind, f"WAV:bext/{name}", field(at, n), severity)) for name, at, n, kind, severity in BEXT]
            umid = (tag == "bext") & filled(F.substr(b, F.lit(339), F.lit(64)))
            xml = tag.isin("iXML", "_PMX", "aXML") & F.rlike(F.regexp_replace(F.decode(b, "ISO-8859-1"), "<[^>]*>", ""), F.lit(r"[^\s\x00]"))
            info = (tag == "LIST") & (F.substr(b, F.lit(1), F.lit(4)) == F.lit("INFO").cast("binary"))
            other = ~tag.isin(*WAV_KEPT, *RIFF_REMOVED[1:7]) & ~info
            return F.array_compact(F.array(
                *bext, F.when(umid, item("device", "WAV:bext/UMID", None, 2)),
                F.when(tag.isin("id3 ", "ID3 "), item("unknown extension", "WAV:id3", size, 1)),
                F.when(xml, item("comment", F.concat(F.lit("WAV:"), F.trim(tag)), size, 2)),
                F.when(tag.isin(*FILLERS) & filled(b), item("unknown extension", "WAV:filler", size, 1)),
                F.when(other, item("unknown extension", F.concat(F.lit("WAV:"), tag), size, 0)),
            ))

        # the samples are no field: their bytes are not taken out
        return let(F.when(c["tag"] == "data", F.unhex(F.lit(""))).otherwise(body(data, c)), told)

    info = F.transform(named(_info_of(data, walk), "tag", "WAV", RIFF_INFO), lambda f: item(f["kind"], f["location"], f["value"], f["severity"]))
    return numbered(F.concat(F.flatten(F.transform(walk["chunks"], of)), info))


@bound
def wav_findings(data: Column) -> Column:
    """Findings of a sound file: broadcast fields, tags, XML, INFO fields, fillers that are not empty, and every chunk that sound does not need."""
    return let(riff_chunks(data), lambda w: _wav_told(data, w))


@bound
def wav_report(data: Column) -> Column:
    return report(riff_chunks(data), lambda w: _wav_told(data, w))


@bound
def riff_cleaned(data: Column) -> Column:
    """The file with telling chunks and fillers overwritten by empty JUNK of the same length, so no offset moves; null where it is broken."""
    def part(c: Column) -> Column:
        telling = c["tag"].isin(*RIFF_REMOVED[1:], *FILLERS) | ((c["tag"] == "LIST") & (F.substr(data, (c["start"] + 1).cast("int"), F.lit(4)) == F.lit("INFO").cast("binary")))
        size = F.least(c["size"] + F.pmod(c["size"], F.lit(2)), F.octet_length(data) - c["start"]).cast("int")
        same = F.substr(data, (c["start"] - 7).cast("int"), size + 8)
        blank = F.unhex(F.repeat(F.lit("00"), size))
        return F.when(telling, F.concat(F.lit("JUNK").cast("binary"), F.substr(data, (c["start"] - 3).cast("int"), F.lit(4)), blank)).otherwise(same)

    whole = lambda walk: F.when(walk["error"].isNull(), F.concat(F.substr(data, F.lit(1), F.lit(12)), _join_bytes(F.transform(walk["chunks"], part))))
    return let(riff_chunks(data), whole)


@bound
def vorbis_comments(block: Column) -> Column:
    """``vendor``, ``entries`` (key, value) and ``whole`` of a comment block; repeats and order stay, no '=' means an empty key.

    ``whole`` is false where the block is cut short or says it has more entries than it has.
    """
    size = le32(block, F.lit(0))
    vendor = F.substr(block, F.lit(5), size.cast("int")).cast("string")
    count = le32(block, (size + 4).cast("int"))
    most = F.least(F.coalesce(count, F.lit(0)), (F.octet_length(block) / 4).cast("long"))  # the count is untrusted: no more steps than there is room for

    def step(s: Column, _: Column) -> Column:
        n = le32(block, s["at"].cast("int"))
        good = (s["at"] + 4 <= F.octet_length(block)) & (s["at"] + 4 + n <= F.octet_length(block))
        text = F.substr(block, (s["at"] + 5).cast("int"), n.cast("int")).cast("string")
        return F.struct(F.when(good, s["at"] + 4 + n).otherwise(F.octet_length(block).cast("long") + 1).alias("at"), F.when(good, _gather(s["got"], text)).otherwise(s["got"]).alias("got"))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), most.cast("int")))
    texts = F.aggregate(steps, F.struct((size + 8).alias("at"), _nothing("array<string>").alias("got")), step, lambda s: _all_of(s["got"]))
    texts = F.when(F.coalesce(count, F.lit(0)) > 0, texts).otherwise(F.array().cast("array<string>"))
    pair = lambda t: F.struct(F.when(F.contains(t, F.lit("=")), F.substring_index(t, "=", 1)).otherwise("").alias("key"), F.when(F.contains(t, F.lit("=")), F.substr(t, F.locate("=", t) + 1)).otherwise(t).alias("value"))  # noqa: E731,E501
    whole = lambda got: F.coalesce((size + 8 <= F.octet_length(block)) & (F.size(got) == count), F.lit(False))
    return let(texts, lambda got: F.struct(vendor.alias("vendor"), F.transform(got, pair).alias("entries"), whole(got).alias("whole")))


def _flac_told(data: Column, walk: Column) -> Column:
    from glasspane.operators.findings import VORBIS, named

    before = let(flac_start(data), lambda skip: F.array(F.when(skip > 0, item("unknown extension", "FLAC:ID3v2", size_text(skip), 2))))
    tail = lambda t: F.array(F.when(t["ape"] > 0, item("unknown extension", "FLAC:APEv2", size_text(t["ape"]), 2)), F.when(t["id3v1"] > 0, item("unknown extension", "FLAC:ID3v1", size_text(t["id3v1"]), 2)))

    def told_by(c: Column, v: Column) -> Column:
        tag, size = c["tag"], size_text(c["size"])
        comment = tag == FLAC_COMMENT
        mine = F.array(
            F.when(comment & (v["vendor"] != ""), item("software", "FLAC:vendor", v["vendor"], 1)),
            F.when(comment & ~v["whole"], item("unknown extension", "FLAC:comments", F.lit("not readable"), 1)),
            F.when(tag == FLAC_PICTURE, item("embedded preview", "FLAC:picture", size, 2)),
            F.when(tag == FLAC_APPLICATION, item("unknown extension", "FLAC:application", F.concat(F.coalesce(_z_text(body(data, c, 4)), F.lit("?")), F.lit(", "), size), 2)),
            F.when(tag == FLAC_CUES, item("comment", "FLAC:cue sheet", size, 1)),
            F.when((tag == FLAC_PADDING) & filled(body(data, c)), item("unknown extension", "FLAC:padding", size, 1)),
            F.when(~tag.isin(*FLAC_PLAIN, FLAC_APPLICATION, FLAC_COMMENT, FLAC_CUES, FLAC_PICTURE), item("unknown extension", F.concat(F.lit("FLAC:block "), tag), size, 1)),
        )
        entries = F.when(comment, v["entries"]).otherwise(F.slice(v["entries"], 1, 0))
        # an embedded picture is shown by its size, not by its bytes in base64
        shown_of = lambda f: F.when(f["kind"] == "embedded preview", F.concat(F.length(f["value"]).cast("string"), F.lit(" characters"))).otherwise(f["value"])
        return F.concat(mine, F.transform(named(entries, "key", "FLAC", VORBIS), lambda f: item(f["kind"], f["location"], shown_of(f), f["severity"])))

    none = F.unhex(F.lit("0000000000000000"))
    of = lambda c: let(vorbis_comments(F.when(c["tag"] == FLAC_COMMENT, body(data, c)).otherwise(none)), lambda v: told_by(c, v))
    return numbered(F.concat(before, F.flatten(F.transform(walk["chunks"], of)), let(tag_tail(data), tail)))


@bound
def flac_findings(data: Column) -> Column:
    """Findings of a FLAC file: tags before and behind the stream, comments with their writer, pictures, padding that is not empty, and every block that sound does not need."""
    return let(flac_blocks(data), lambda w: _flac_told(data, w))


@bound
def flac_report(data: Column) -> Column:
    return report(flac_blocks(data), lambda w: _flac_told(data, w))


#: Byte patterns of a PDF and what they tell.
PDF_FLAGS = (
    ("/ID", "identifier", "unknown extension", 1), ("/ByteRange", "signature", "unknown extension", 1), ("/FontFile", "embedded fonts", "software", 0),
    ("/EmbeddedFile", "attachment", "unknown extension", 2), ("/JavaScript", "script", "unknown extension", 2),
)


#: What hides values from a reader of plain bytes: packed objects, encryption, names in hex.
PDF_HIDDEN = r"/ObjStm\b|/XRef\b|/Encrypt\b|/[A-Za-z0-9]*#[0-9A-Fa-f]{2}"


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _pdf_open(text: Column) -> Column:
    return ~F.rlike(text, F.lit(PDF_HIDDEN))


def pdf_open(data: Column) -> Column:
    """Whether all objects of a PDF stand in the clear; of others nothing can be said."""
    return _pdf_open(_latin(data))


def _pdf_fault(text: Column) -> Column:
    return F.when(~F.contains(text, F.lit("endobj")), "no object").when(~F.contains(text, F.lit("%%EOF")), "no end mark")


def _pdf_told(text: Column) -> Column:
    from glasspane.operators.findings import PDF_INFO

    known = [name for names in PDF_INFO.values() for name in names]
    out = []
    for (kind, severity), names in PDF_INFO.items():
        for name in names:
            there = F.regexp_extract(text, f"/{name}(?![A-Za-z0-9])\\s*+(?!\\(\\)|<>)(.)", 1) != ""
            plain = F.nullif(F.regexp_extract(text, f"/{name}\\s*\\(((?:[^()\\\\]|\\\\.)+)\\)", 1), F.lit(""))
            digits = F.regexp_replace(F.regexp_extract(text, f"/{name}\\s*<([0-9A-Fa-f\\s]+)>", 1), r"\s", "")
            of_hex = lambda d: F.when(F.rlike(d, F.lit("^(?i)feff([0-9a-c]...|d[0-7]..|[ef]...)*$")), F.decode(F.unhex(F.substr(d, F.lit(5))), "UTF-16BE")).when(d != "", F.decode(F.unhex(d), "ISO-8859-1"))
            out.append(F.when(there, item(kind, f"PDF:{name}", F.coalesce(plain, let(digits, of_hex)), severity)))
    out.append(F.when(F.rlike(text, F.lit(r"<x:xmpmeta|<\?xpacket|/Metadata(?![A-Za-z0-9])")), item("author", "PDF:XMP", None, 2)))
    out += [F.when(F.contains(text, F.lit(p)), item(kind, f"PDF:{place}", None, severity)) for p, place, kind, severity in PDF_FLAGS]
    ends = F.regexp_count(text, F.lit("%%EOF"))
    out.append(F.when(ends > 1, item("tracked change", "PDF:history", F.concat(ends.cast("string"), F.lit(" revisions")), 2)))
    # what else stands in the information dictionary that the trailer names
    number = F.regexp_extract(text, r"/Info\s+(\d+)\s+\d+\s+R", 1)
    # an object begins behind "<number> <generation> obj"
    begins = F.call_function("regexp_instr", text, F.concat(F.lit(r"(?<![0-9])"), F.when(number == "", F.lit("x")).otherwise(number), F.lit(r"\s+[0-9]+\s+obj\b")))
    entry = F.when((number != "") & (begins > 0), F.substring_index(F.substr(text, begins), "endobj", 1)).otherwise("")
    keys = F.regexp_extract_all(entry, F.lit(r"/([A-Za-z0-9_.:+-]+)\s*+(?!\(\)|<>)[(<0-9]"), F.lit(1))
    custom = F.transform(F.filter(keys, lambda k: ~k.isin(*known)), lambda k: item("comment", F.concat(F.lit("PDF:Info/"), k), None, 1))
    bare = F.regexp_replace(text, r"(?s)(?<![a-z])stream\r?\n.*?endstream", "")
    comments = lambda b: F.regexp_count(b, F.lit(r"(?m)^[ \t]*%(?!PDF-\d\.\d\s*$|%EOF\s*$|[\x80-\xFF]{4,}\s*$)[^\r\n]*\S"))
    tail = F.length(F.regexp_replace(F.substring_index(text, "%%EOF", -1), r"^[\r\n]{1,2}", ""))
    more = lambda b: F.array(
        F.when(comments(b) > 0, item("comment", "PDF:comments", comments(b).cast("string"), 1)),
        F.when(F.rlike(b, F.lit(r"/Annots?(?![A-Za-z0-9])")), item("comment", "PDF:annotations", None, 1)),
        F.when(tail > 0, item("unknown extension", "PDF:tail", size_text(tail), 1)),
    )
    return numbered(F.concat(F.array(*out), custom, let(bare, more)))


@bound
def pdf_findings(data: Column) -> Column:
    """Findings that the bytes of an open PDF show: flags, information fields, XMP, comments, annotations, an edit history, a tail.

    A field's value is a text in brackets (nested ones must be escaped), one in hex,
    or somewhere else (then it is not shown); a field with an empty value tells nothing.
    Comments count where they begin a line outside streams; page contents are not judged.
    """
    return let(_latin(data), _pdf_told)


@bound
def pdf_report(data: Column) -> Column:
    """As the other reports, and ``open``: whether all objects stand in the clear."""
    of = lambda text: let(report(text, _pdf_told, _pdf_fault), lambda r: F.struct(r["error"].alias("error"), r["findings"].alias("findings"), _pdf_open(text).alias("open")))
    return let(_latin(data), of)


@bound
def pdf_revisions(data: Column, most: int = 64) -> Column:
    """End (bytes) of each revision, of the first ``most``: after every %%EOF and the line break behind it."""
    text = F.decode(data, "ISO-8859-1")
    parts = F.slice(F.split(text, "(?<=%%EOF(?:\\r\\n|\\r(?!\\n)|\\n|(?![\\r\\n])))", -1), 1, most)
    ends = F.filter(parts, lambda p: F.contains(p, F.lit("%%EOF")))
    return F.transform(ends, lambda p, i: F.aggregate(F.slice(ends, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)))


def exploded(artifacts: DataFrame, findings: Column, key: str = "artifact_id") -> DataFrame:
    """One row for each finding; artifacts without one have none."""
    return artifacts.select(key, F.explode(findings).alias("f")).select(key, "f.*")
