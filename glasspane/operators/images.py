"""JPEG, WebP and BMP files read and cleaned with column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspane.functions.magic import be16, le16, le32
from glasspane.functions.values import bound, let
from glasspane.operators import tiff
from glasspane.operators.chunks import _ITEM, _join_bytes, _walk, body, filled, item, numbered, report, riff_chunks, size_text

#: JPEG segments that an image needs (frames, tables, restarts, scan), by the second marker byte.
JPEG_KEPT = ("C0", "C1", "C2", "C3", "C4", "C5", "C6", "C7", "C9", "CA", "CB", "CD", "CE", "CF", "DB", "DD", "DA")
#: Telling chunks of WebP: kind and severity; bits of the feature byte that announce them.
WEBP_TELLING = (("EXIF", "device", 1), ("XMP ", "author", 2), ("ICCP", "color profile", 0))
WEBP_KEPT = ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF")
WEBP_BITS = 0x20 | 0x08 | 0x04
#: Colour spaces of a BMP header ("MBED" embedded, "LINK" linked profile).
EMBEDDED, LINKED = 0x4D424544, 0x4C494E4B


@bound
def jpeg_segments(data: Column) -> Column:
    """Segments up to the scan, named by their marker byte in hex."""

    def read(d: Column, at: Column) -> tuple[Column, Column, Column]:
        p = at.cast("int")
        marker = F.when(F.hex(F.substr(d, p + 1, F.lit(1))) == "FF", F.hex(F.substr(d, p + 2, F.lit(1))))
        size = F.conv(F.hex(F.substr(d, p + 3, F.lit(2))), 16, 10).cast("long")
        # no marker byte, or a length that does not cover itself: reaches beyond the end, an error
        return marker, size - 2, F.when(marker.isNotNull() & (size >= 2), size + 2).otherwise(F.octet_length(d) + 1)

    return _walk(data, 2, 4, read, "DA")


#: Scans of one picture that are followed to its end mark; a file with more is an error.
MOST_SCANS = 2000


def _jpeg_end(data: Column, walk: Column) -> Column:
    """``end`` of the picture (null: it has no end mark) and the markers of ``between``: segments behind the first scan that no scan needs.

    Within a scan a byte FF is followed by zero or a restart mark; the next other marker is a table, the next scan or the end.
    """
    last = F.try_element_at(walk["chunks"], F.lit(-1))
    latin = F.decode(data, "ISO-8859-1")

    def follow(text: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def read(k: Column) -> Column:
                at = s["at"] + k - 1
                marker = F.hex(F.substr(data, (at + 2).cast("int"), F.lit(1)))
                size = be16(data, (at + 2).cast("int"))
                stop = (k == 0) | (marker == "D9") | size.isNull() | (size < 2)
                foreign = ~stop & ~marker.isin(*JPEG_KEPT, "DC", "CC")
                return F.struct(
                    F.when(stop, s["at"]).otherwise(at + 2 + size).alias("at"),
                    F.when((k > 0) & (marker == "D9"), at + 2).alias("end"),
                    F.when(foreign, F.concat(s["between"], F.array(marker))).otherwise(s["between"]).alias("between"),
                    stop.alias("over"),
                )

            return F.when(s["over"], s).otherwise(let(F.regexp_instr(F.substr(text, (s["at"] + 1).cast("int")), F.lit("\u00ff[\u0001-\u00cf\u00d8-\u00fe]")).cast("long"), read))

        start = F.struct((last["start"] + last["size"]).alias("at"), F.lit(None).cast("long").alias("end"), F.array().cast("array<string>").alias("between"), F.lit(False).alias("over"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SCANS)), start, step)

    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("end"), F.array().cast("array<string>").alias("between"), F.lit(True).alias("over"))
    return F.when(walk["error"].isNull() & (last["tag"] == "DA"), let(latin, follow)).otherwise(none)


def _jpeg_told(data: Column, walk: Column) -> Column:
    segments = F.filter(walk["chunks"], lambda c: ~c["tag"].isin(*JPEG_KEPT))

    def of(c: Column) -> Column:
        def told(b: Column) -> Column:
            tag, latin = c["tag"], F.decode(b, "ISO-8859-1")
            exif = (tag == "E1") & F.startswith(latin, F.lit("Exif\0\0"))
            xmp = (tag == "E1") & F.startswith(latin, F.lit("http://ns.adobe.com/xap/"))
            size = size_text(c["size"])
            app = F.concat(F.lit("APP"), F.conv(F.substr(tag, F.lit(2), F.lit(1)), 16, 10))
            located = F.contains(latin, F.lit("\u0088%")) | F.contains(latin, F.lit("%\u0088"))

            def inside(found: Column) -> Column:
                # what its directories tell; where they cannot be read, the block itself, and a location if its tag's bytes occur
                block = F.array(item("device", "APP1:Exif", size, 1), F.when(located, item("gps", "APP1:Exif/GPS", None, 2)))
                tags = F.transform(found, lambda f: item(f["kind"], F.concat(F.lit("APP1:Exif/"), f["location"]), f["value"], f["severity"]))
                preview = F.when(F.contains(latin, F.lit("ÿØ")), item("embedded preview", "APP1:Exif/thumbnail", None, 2))
                return F.concat(F.when(F.size(found) > 0, tags).otherwise(block), F.array(preview))

            readable = lambda t: F.when(t["error"].isNull(), F.array_compact(tiff.told(t)))
            exif_told = let(F.coalesce(let(tiff.directories(F.substr(b, F.lit(7))), readable), F.array().cast(f"array<{_ITEM}>")), inside)
            plain = F.array(
                F.when(xmp, item("software", "APP1:XMP", None, 1)),
                F.when((tag == "E1") & ~exif & ~xmp, item("unknown extension", "APP1", None, 0)),
                F.when(tag == "ED", item("author", "APP13:IPTC", None, 2)),
                F.when(tag == "E2", item("color profile", "APP2:ICC", None, 0)),
                F.when(tag == "FE", item("comment", "COM", F.try_validate_utf8(b.cast("string")), 1)),
                F.when(F.startswith(tag, F.lit("E")) & ~tag.isin("E1", "E2", "ED"), item("unknown extension", app, size, 0)),
                F.when(~F.startswith(tag, F.lit("E")) & (tag != "FE"), item("unknown extension", F.concat(F.lit("marker 0x"), tag), None, 0)),
            )
            return F.when(exif, exif_told).otherwise(plain)

        return F.array_compact(let(body(data, c), told))

    def behind(end: Column) -> Column:
        rest = F.octet_length(data) - end["end"]
        between = F.transform(end["between"], lambda m: item("unknown extension", F.concat(F.lit("between scans 0x"), m), None, 1))
        return F.concat(between, F.array(F.when(rest > 0, item("unknown extension", "JPEG:tail", size_text(rest), 1))))

    return numbered(F.concat(F.flatten(F.transform(segments, of)), let(_jpeg_end(data, walk), behind)))


@bound
def jpeg_findings(data: Column) -> Column:
    """Findings of the segments that an image does not need, the tags of an Exif block, segments between scans and bytes behind the picture."""
    return let(jpeg_segments(data), lambda w: _jpeg_told(data, w))


@bound
def jpeg_report(data: Column) -> Column:
    return report(jpeg_segments(data), lambda w: _jpeg_told(data, w))


@bound
def jpeg_cleaned(data: Column) -> Column:
    """The needed segments and the scans up to the end mark, byte for byte; null where the file is broken."""

    def whole(walk: Column) -> Column:
        kept = F.filter(walk["chunks"], lambda c: c["tag"].isin(*JPEG_KEPT))
        parts = F.transform(kept, lambda c: F.substr(data, (c["start"] - 3).cast("int"), (c["size"] + 4).cast("int")))
        last = F.try_element_at(walk["chunks"], F.lit(-1))
        first = last["start"] + last["size"]
        end = F.coalesce(_jpeg_end(data, walk)["end"], F.octet_length(data).cast("long"))
        scan = F.substr(data, (first + 1).cast("int"), (end - first).cast("int"))
        return F.when(walk["error"].isNull() & (last["tag"] == "DA"), F.concat(F.substr(data, F.lit(1), F.lit(2)), _join_bytes(parts), scan))

    return let(jpeg_segments(data), whole)


def _webp_told(data: Column, walk: Column) -> Column:
    def of(c: Column) -> Column:
        kind, severity = F.lit("unknown extension"), F.lit(0)
        for tag, k, s in WEBP_TELLING:
            kind, severity = F.when(c["tag"] == tag, k).otherwise(kind), F.when(c["tag"] == tag, s).otherwise(severity)
        return item(kind, F.concat(F.lit("WebP:"), F.rtrim(c["tag"])), size_text(c["size"]), severity)

    return numbered(F.transform(F.filter(walk["chunks"], lambda c: ~c["tag"].isin(*WEBP_KEPT)), of))


@bound
def webp_findings(data: Column) -> Column:
    """Findings of the chunks that an image does not need; those of unknown names are extensions."""
    return let(riff_chunks(data), lambda w: _webp_told(data, w))


@bound
def webp_report(data: Column) -> Column:
    return report(riff_chunks(data), lambda w: _webp_told(data, w))


def _le(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substr(h, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)]))


@bound
def webp_cleaned(data: Column) -> Column:
    """Without telling chunks, their feature bits cleared and the size set anew; null where the file is broken."""
    def part(c: Column) -> Column:
        b = body(data, c)
        first = F.conv(F.hex(F.substr(b, F.lit(1), F.lit(1))), 16, 10).cast("int").bitwiseAND(255 - WEBP_BITS)
        b = F.when((c["tag"] == "VP8X") & (c["size"] > 0), F.concat(F.unhex(F.lpad(F.hex(first.cast("long")), 2, "0")), F.substr(b, F.lit(2), F.octet_length(b)))).otherwise(b)
        pad = F.when(F.pmod(c["size"], F.lit(2)) == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
        return F.concat(c["tag"].cast("binary"), _le(c["size"]), b, pad)

    kept = lambda walk: F.filter(walk["chunks"], lambda c: ~c["tag"].isin(*[t for t, _, _ in WEBP_TELLING]))
    headed = lambda rest: F.concat(F.lit("RIFF").cast("binary"), _le(F.octet_length(rest) + 4), F.lit("WEBP").cast("binary"), rest)
    return let(riff_chunks(data), lambda walk: F.when(walk["error"].isNull(), let(_join_bytes(F.transform(kept(walk), part)), headed)))


def _bmp_head(data: Column) -> Column:
    """``start`` and ``size`` of the picture (null: the head does not say it), ``used`` bytes of head, masks and palette before it."""
    dib, bits = le32(data, F.lit(14)), F.when(le32(data, F.lit(14)) == 12, le16(data, F.lit(24))).otherwise(le16(data, F.lit(28)))
    core = dib == 12
    packing = F.when(core, 0).otherwise(le32(data, F.lit(30)))
    wide = F.when(core, le16(data, F.lit(18))).otherwise(le32(data, F.lit(18)))
    high = F.when(core, le16(data, F.lit(20))).otherwise(le32(data, F.lit(22)))
    high = F.when(~core & (high >= 1 << 31), (1 << 32) - high).otherwise(high)  # from the top down
    rows = F.coalesce(F.try_multiply(((wide * bits + 31) / 32).cast("long") * 4, high), F.lit(1 << 62))  # more than any file has
    said = F.when(~core, F.nullif(le32(data, F.lit(34)), F.lit(0).cast("long")))
    size = F.coalesce(F.when(packing.isin(0, 3, 6), rows), said)
    colours = F.when(bits <= 8, F.when(~core & (le32(data, F.lit(46)) > 0), le32(data, F.lit(46))).otherwise(F.get(F.lit([1 << i for i in range(9)]), bits.cast("int")).cast("long"))).otherwise(F.when(core, 0).otherwise(le32(data, F.lit(46))))
    masks = F.when((dib == 40) & (packing == 3), 12).when((dib == 40) & (packing == 6), 16).otherwise(0)
    return F.struct(le32(data, F.lit(10)).alias("start"), size.alias("size"), F.least(le32(data, F.lit(10)), 14 + dib + masks + colours * F.when(core, 3).otherwise(4)).alias("used"))


def _bmp_tail(data: Column, head: Column) -> Column:
    return F.when((head["start"] > 0) & (head["size"] > 0) & (head["start"] + head["size"] <= F.octet_length(data)), F.octet_length(data) - head["start"] - head["size"])


def _bmp_fault(data: Column, head: Column) -> Column:
    end = F.octet_length(data)
    return F.when(end < 14 + le32(data, F.lit(14)), "truncated head").when(head["start"] + F.coalesce(head["size"], F.lit(0)) > end, "truncated picture")


def _bmp_told(data: Column, head: Column) -> Column:
    space = F.when(le32(data, F.lit(14)) >= 108, le32(data, F.lit(70)))
    tail = _bmp_tail(data, head)
    gap = F.substr(data, (head["used"] + 1).cast("int"), F.greatest(head["start"] - head["used"], F.lit(0)).cast("int"))
    reserved = F.substr(data, F.lit(7), F.lit(4))
    return numbered(F.array(
        F.when(space == EMBEDDED, item("color profile", "BMP:profile", None, 0)),
        F.when(space == LINKED, item("author", "BMP:profile", None, 2)),
        F.when(filled(reserved), item("unknown extension", "BMP:reserved", F.lower(F.hex(reserved)), 1)),
        F.when(filled(gap), item("unknown extension", "BMP:gap", size_text(F.octet_length(gap)), 1)),
        F.when(head["size"].isNull(), item("unknown extension", "BMP:length", F.lit("not said"), 1)),
        F.when(tail > 0, item("unknown extension", "BMP:tail", size_text(tail), 1)),
    ))


@bound
def bmp_findings(data: Column) -> Column:
    """Profiles, reserved fields, what stands between the head and the picture, bytes behind it; a picture of unknown length is a finding too."""
    return let(_bmp_head(data), lambda h: _bmp_told(data, h))


@bound
def bmp_report(data: Column) -> Column:
    return report(_bmp_head(data), lambda h: _bmp_told(data, h), lambda h: _bmp_fault(data, h))


@bound
def bmp_cleaned(data: Column) -> Column:
    """Without the bytes behind the image, with zeros in the reserved fields and between head and picture; a profile stays, so such a file is cleaned in part only."""

    def whole(head: Column) -> Column:
        gap = F.greatest(head["start"] - head["used"], F.lit(0)).cast("int")
        until = F.least(head["used"], head["start"]).cast("int")
        front = F.concat(F.substr(data, F.lit(1), F.lit(6)), F.unhex(F.lit("00000000")), F.substr(data, F.lit(11), until - 10), F.unhex(F.repeat(F.lit("00"), gap)))
        end = F.octet_length(data) - F.coalesce(_bmp_tail(data, head), F.lit(0))
        return F.when(_bmp_fault(data, head).isNull(), F.concat(front, F.substr(data, (head["start"] + 1).cast("int"), (end - head["start"]).cast("int"))))

    return let(_bmp_head(data), whole)
