"""Formats by content: one CASE over magic bytes, most specific first. A file name never counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspane.functions.values import bound

#: Brands of ISO base media files.
VIDEO_BRANDS = ("isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "M4V ", "M4A ", "M4B ", "qt  ", "mmp4")
IMAGE_COMPATIBLE = ("heic", "heix", "mif1", "msf1", "avif")
IMAGE_BRANDS = ("heic", "heix", "hevc", "heim", "heis", "mif1", "msf1", "avif", "avis")
#: Magic bytes of formats that are named but not judged.
HINTS = (
    ("255044462D", "PDF"), ("504B0304", "ZIP container"), ("474946383761", "GIF"), ("474946383961", "GIF"), ("424D", "BMP"),
    ("464C5601", "Flash video"), ("000001BA", "MPEG program stream"), ("D0CF11E0A1B11AE1", "legacy office document"), ("38425053", "Photoshop document"),
    ("0000000C6A502020", "JPEG 2000"), ("FF4FFF51", "JPEG 2000 code stream"), ("0000000C4A584C20", "JPEG XL"), ("FF0A", "JPEG XL code stream"),
    ("1F8B", "gzip"), ("3C3F786D6C", "XML"),
)


#: Formats whose findings are read; all others are named at most.
READ = ("PNG", "JPEG", "WebP", "GIF", "BMP", "AVI", "WAV", "FLAC", "PDF", "TIFF")


def understood(form: Column) -> Column:
    """Whether a statement about the contents can be made at all."""
    return F.coalesce(form.isin(*READ), F.lit(False))


def at(data: Column, offset: int, magic: str) -> Column:
    """Whether the bytes (in hex) stand at an offset."""
    return F.substr(data, F.lit(offset + 1), F.lit(len(magic) // 2)) == F.unhex(F.lit(magic))


def _ascii(s: str) -> str:
    return s.encode().hex().upper()


def le32(data: Column, offset: Column) -> Column:
    """Little-endian 32-bit number at an offset from 0."""
    byte = [F.hex(F.substr(data, offset + (1 + i), F.lit(1))) for i in (3, 2, 1, 0)]
    return F.conv(F.concat(*byte), 16, 10).cast("long")


def be16(data: Column, offset: Column) -> Column:
    return F.conv(F.hex(F.substr(data, offset + 1, F.lit(2))), 16, 10).cast("long")


def le16(data: Column, offset: Column) -> Column:
    return F.conv(F.concat(F.hex(F.substr(data, offset + 2, F.lit(1))), F.hex(F.substr(data, offset + 1, F.lit(1)))), 16, 10).cast("long")


def be32(data: Column, offset: Column) -> Column:
    return F.conv(F.hex(F.substr(data, offset + 1, F.lit(4))), 16, 10).cast("long")


def id3_size(data: Column) -> Column:
    """Bytes of the ID3 tag at the start, its head of ten included; lengths have seven bits in a byte."""
    size = [F.conv(F.hex(F.substr(data, F.lit(i), F.lit(1))), 16, 10).cast("int").bitwiseAND(0x7F) for i in (7, 8, 9, 10)]
    return 10 + ((size[0] * 128 + size[1]) * 128 + size[2]) * 128 + size[3]


def head_text(data: Column, n: int = 1024) -> Column:
    """The first code points as text, or null if the bytes are no UTF-8."""
    return F.left(F.try_validate_utf8(data.cast("string")), F.lit(n))


@bound
def detect(data: Column) -> Column:
    """Format name, or null."""
    brand = F.substr(data, F.lit(9), F.lit(4)).cast("string")
    # compatible brands follow the minor version, up to the end of the first box
    brands = F.substr(data, F.lit(17), F.greatest(F.least(be32(data, F.lit(0)), F.lit(1024)) - 16, F.lit(0)).cast("int")).cast("string")
    ftyp = at(data, 4, _ascii("ftyp"))
    among = lambda names: F.rlike(brands, F.lit("(?s)^(....)*(" + "|".join(names) + ")"))
    image = brand.isin(*IMAGE_BRANDS) | among(IMAGE_COMPATIBLE)
    video = brand.isin(*VIDEO_BRANDS) | F.startswith(brand, F.lit("3g")) | among(VIDEO_BRANDS)
    text = head_text(data)
    trimmed = F.regexp_replace(text, r"^\s+", "")
    svg = F.rlike(trimmed, F.lit(r"^(<\?xml|<svg|<!--)")) & F.contains(text, F.lit("<svg"))
    riff = at(data, 0, _ascii("RIFF"))
    second = F.conv(F.hex(F.substr(data, F.lit(2), F.lit(1))), 16, 10).cast("int")
    third = F.conv(F.hex(F.substr(data, F.lit(3), F.lit(1))), 16, 10).cast("int")
    frame = at(data, 0, "FF") & (second >= 0xE0) & (second.bitwiseAND(0x18) != 0x08) & (second.bitwiseAND(0x06) != 0) & (third.bitwiseAND(0xF0) != 0xF0) & (third.bitwiseAND(0x0C) != 0x0C)
    tagged = at(data, 0, _ascii("ID3"))
    flac = at(data, 0, _ascii("fLaC")) | (tagged & (F.substr(data, id3_size(data) + 1, F.lit(4)) == F.unhex(F.lit(_ascii("fLaC")))))
    dib = le32(data, F.lit(14)).isin(12, 40, 52, 56, 64, 108, 124)
    bmp = at(data, 0, _ascii("BM")) & dib & ((le32(data, F.lit(2)) == 0) | (le32(data, F.lit(2)) <= F.octet_length(data)))
    return (
        F.when(at(data, 0, "89504E470D0A1A0A"), "PNG")
        .when(at(data, 0, "FFD8"), "JPEG")
        .when(riff & at(data, 8, _ascii("WEBP")), "WebP")
        .when(at(data, 0, _ascii("GIF87a")) | at(data, 0, _ascii("GIF89a")), "GIF")
        .when(bmp, "BMP")
        .when(at(data, 0, "49492A00") | at(data, 0, "49492B00") | at(data, 0, "4D4D002A") | at(data, 0, "4D4D002B"), "TIFF")
        .when(ftyp & video, "video")
        .when(ftyp & image, "HEIC/AVIF")
        .when(riff & at(data, 8, _ascii("AVI ")), "AVI")
        .when(riff & at(data, 8, _ascii("WAVE")), "WAV")
        .when(at(data, 0, "1A45DFA3"), "Matroska")
        .when(flac, "FLAC")
        .when((tagged & (F.conv(F.hex(F.substr(data, F.lit(4), F.lit(1))), 16, 10).cast("int") < 5)) | frame, "MP3")
        .when(at(data, 0, _ascii("OggS")), "Ogg")
        .when(svg, "SVG")
        .when(F.contains(F.hex(F.substr(data, F.lit(1), F.lit(1024))), F.lit(_ascii("%PDF-"))), "PDF")
        .when(at(data, 0, "504B0304") | at(data, 0, "504B0506"), "ZIP")
    )


@bound
def hint(data: Column) -> Column:
    """What an unjudged file seems to be; a label, never a verdict."""
    out = F.when(at(data, 4, _ascii("ftyp")), "ISO base media")
    for magic, name in reversed(HINTS):
        out = F.when(at(data, 0, magic), name).otherwise(out)
    return out


#: Media types of OpenDocument files begin so.
ODF = "application/vnd.oasis.opendocument."


def odf_kind(mimetype: Column) -> Column:
    """The kind of OpenDocument file that the content of its type entry names, or null."""
    kind = F.trim(F.regexp_replace(mimetype, r"^\s+|\s+$", ""))
    last = F.substring_index(kind, ".", -1)
    return F.when(F.startswith(kind, F.lit(ODF)), F.when(last.isin("text", "spreadsheet", "presentation"), F.concat(F.lit("ODF "), last)).otherwise("ODF"))


def archive_kind(names: Column, mimetype: Column | None = None) -> Column:
    """What the entry names of a ZIP, and the content of its entry ``mimetype`` (null: none), say it is.

    An office document, a package, a container with a type of its own, or a plain archive.
    """
    said = F.regexp_replace(F.lit(None).cast("string") if mimetype is None else mimetype, r"^\s+|\s+$", "")
    has = lambda prefix: F.exists(names, lambda n: F.startswith(n, F.lit(prefix)))
    types = F.array_contains(names, "[Content_Types].xml")
    return (
        F.when(types & has("word/"), "Word")
        .when(types & has("xl/"), "Excel")
        .when(types & has("ppt/"), "PowerPoint")
        .when(odf_kind(said).isNotNull(), odf_kind(said))
        .when(said == "application/epub+zip", "EPUB")
        .when(said != "", "typed container")
        .when(F.array_contains(names, "META-INF/container.xml"), "EPUB")
        .when(F.array_contains(names, "AndroidManifest.xml"), "APK")
        .when(F.array_contains(names, "META-INF/MANIFEST.MF"), "JAR")
        .otherwise("archive")
    )
