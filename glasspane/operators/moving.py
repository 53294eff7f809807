"""GIF and AVI files: findings and cleaning by column expressions.

A broken file gives an error and null instead of findings or bytes. Whatever a
file holds beside what its pictures need is a finding, also where its name is
unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspane.functions.magic import le32
from glasspane.functions.values import bound, let
from glasspane.operators.chunks import _CHUNK, FILLERS, _all_of, _byte, _gather, _join_bytes, _nothing, _walk, _z_text, filled, item, numbered, report, size_text
from glasspane.operators.findings import RIFF_INFO

#: Steps of one walk through a GIF file; a file that needs more is an error.
MOST_STEPS = 4_000_000
#: Application blocks of a GIF file that steer its pictures.
GIF_KEPT = ("NETSCAPE", "ANIMEXTS")
#: Chunks that an AVI file needs.
AVI_KEPT = ("RIFF", "LIST", "avih", "strh", "strf", "JUNK", "idx1", "indx", "dmlh", "vprp")

def _colours(packed: Column) -> Column:
    """Bytes of the colour table that a packed field announces."""
    return F.when(packed >= 128, F.get(F.lit([6 << i for i in range(8)]), packed.bitwiseAND(7))).otherwise(0)


@bound
def gif_blocks(data: Column) -> Column:
    """``head`` (bytes before the first block), ``blocks`` (label in hex, start, size), ``end`` of the last one and ``error``.

    Pictures have the label 2C, the end mark 3B; a step reads the head of a block or one of its sub-blocks.
    """
    size = F.octet_length(data)
    head = 13 + _colours(_byte(data, F.lit(10)))

    def step(s: Column, _: Column) -> Column:
        def read(b: Column) -> Column:
            at, inside = s["at"], s["tag"].isNotNull()
            label = F.hex(F.substr(data, at.cast("int") + 2, F.lit(1)))
            # behind the introducer of an extension stands a part of fixed length, for some labels
            fixed = F.when(label == "01", 13).when(label == "FF", _byte(data, at + 2) + 1).otherwise(0)
            picture = 11 + _colours(_byte(data, at + 9))
            mark = F.when(b == 0x21, F.nullif(label, F.lit(""))).when(b == 0x2C, F.lit("2C"))
            jump = F.when(inside, b + 1).when(b == 0x3B, 1).when(b == 0x21, fixed + 2).when(b == 0x2C, picture)
            closed = F.when(inside & (b == 0), F.struct(s["tag"].alias("tag"), s["start"].alias("start"), (at + 1 - s["start"]).alias("size")))
            block = F.when(~inside & (b == 0x3B), F.struct(F.lit("3B").alias("tag"), at.alias("start"), F.lit(1).cast("long").alias("size"))).otherwise(closed)
            fault = (
                F.when(b.isNull() & inside, "sub-block past the end")
                .when(b.isNotNull() & ~inside & ~b.isin(0x21, 0x2C, 0x3B), "unknown block")
                .when(b.isNotNull() & jump.isNull(), "truncated block")
                .when(at + jump > size, "sub-block past the end")
            )
            opened = F.when(inside & (b != 0), s["tag"]).when(~inside, mark)
            return F.struct(
                F.coalesce(at + jump, at).alias("at"),
                opened.alias("tag"),
                F.when(inside, s["start"]).otherwise(at).alias("start"),
                F.when(block.isNotNull() & fault.isNull(), _gather(s["got"], block)).otherwise(s["got"]).alias("got"),
                fault.alias("error"),
                (fault.isNotNull() | b.isNull() | (~inside & (b == 0x3B))).alias("over"),
            )

        return F.when(s["over"], s).otherwise(let(_byte(data, s["at"]), read))

    cut = F.coalesce(head > size, F.lit(True))
    start = F.struct(
        head.cast("long").alias("at"), F.lit(None).cast("string").alias("tag"), F.lit(0).cast("long").alias("start"), _nothing(_CHUNK).alias("got"),
        F.when(cut, "truncated head").alias("error"), cut.alias("over"),
    )

    def finish(s: Column) -> Column:
        error = F.coalesce(s["error"], F.when(~s["over"], "too many blocks"))
        return F.struct(head.alias("head"), _all_of(s["got"]).alias("blocks"), s["at"].alias("end"), error.alias("error"))

    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(MOST_STEPS), size + 2)), start, step, finish)


def _sub_blocks(data: Column, block: Column) -> Column:
    """The joined bytes of the sub-blocks of an extension without a fixed part."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), (block["size"] / 2).cast("int")))

    def step(s: Column, _: Column) -> Column:
        n = _byte(data, s["at"])
        part = F.substr(data, (s["at"] + 2).cast("int"), n)
        return F.when(n > 0, F.struct((s["at"] + 1 + n).alias("at"), _gather(s["got"], part).alias("got"))).otherwise(s)

    start = F.struct((block["start"] + 2).alias("at"), _nothing("array<binary>").alias("got"))
    return _join_bytes(F.aggregate(steps, start, step, lambda s: _all_of(s["got"])))


def _gif_item(data: Column, block: Column) -> Column:
    """The finding of a block, or null for one that the pictures need."""
    tag, nothing = block["tag"], F.lit(None).cast("string")
    fixed = F.least(F.lit(8), _byte(data, block["start"] + 2))
    name = F.decode(F.substr(data, (block["start"] + 4).cast("int"), fixed), "ISO-8859-1")
    place = F.concat(F.lit("GIF:application/"), F.trim(name))
    application = (
        F.when(F.startswith(name, F.lit("XMP ")), item("author", place, nothing, 2))
        .when(~F.left(name, F.lit(8)).isin(*GIF_KEPT), item("unknown extension", place, nothing, 1))
    )
    comment = F.trim(F.make_valid_utf8(_sub_blocks(data, block).cast("string")))
    return (
        F.when(tag.isin("2C", "3B", "F9"), F.lit(None))
        .when(tag == "FE", item("comment", "GIF:comment", comment, 1))
        .when(tag == "01", item("comment", "GIF:plain text", nothing, 1))
        .when(tag == "FF", application)
        .otherwise(item("unknown extension", F.concat(F.lit("GIF:block "), tag), nothing, 0))
    )


def _gif_told(data: Column, walk: Column) -> Column:
    rest = F.octet_length(data) - walk["end"]
    tail = F.when(rest > 0, item("unknown extension", "GIF:tail", size_text(rest), 1))
    return numbered(F.concat(F.transform(walk["blocks"], lambda b: _gif_item(data, b)), F.array(tail)))


@bound
def gif_findings(data: Column) -> Column:
    """Comments, texts, foreign application blocks, unknown blocks and bytes behind the end mark."""
    return let(gif_blocks(data), lambda w: _gif_told(data, w))


@bound
def gif_report(data: Column) -> Column:
    return report(gif_blocks(data), lambda w: _gif_told(data, w))


@bound
def gif_cleaned(data: Column) -> Column:
    """The file without blocks that are findings and without what follows its end mark, which is added where it is missing."""

    def whole(walk: Column) -> Column:
        kept = F.filter(walk["blocks"], lambda b: (b["tag"] != "3B") & _gif_item(data, b).isNull())
        parts = F.transform(kept, lambda b: F.substr(data, (b["start"] + 1).cast("int"), b["size"].cast("int")))
        return F.when(walk["error"].isNull(), F.concat(F.substr(data, F.lit(1), walk["head"].cast("int")), _join_bytes(parts), F.unhex(F.lit("3B"))))

    return let(gif_blocks(data), whole)


def _avi_kind(data: Column, chunk: Column) -> Column:
    """The kind of a list."""
    return F.substr(data, (chunk["start"] + 1).cast("int"), F.lit(4)).cast("string")


#: Chunks of a stream within ``movi``, and of its index.
AVI_STREAM = r"^([0-9]{2}..|ix[0-9]{2})$"


@bound
def avi_chunks(data: Column, whole: tuple[str, ...] = ()) -> Column:
    """All chunks of an AVI file, those within lists behind their list; lists of a kind in ``whole`` are not entered.

    The size of a list is 4, the bytes of its kind.
    """

    def read(d: Column, at: Column) -> tuple[Column, Column, Column]:
        p = at.cast("int")
        tag, size = F.substr(d, p + 1, F.lit(4)).cast("string"), le32(d, p + 4)
        group = tag.isin("LIST", "RIFF")
        entered = group & ~F.substr(d, p + 9, F.lit(4)).cast("string").isin(*whole)
        over = F.least(size + 8 + F.pmod(size, F.lit(2)), F.greatest(F.octet_length(d) - at, size + 8))
        # a list that is longer than the file is an error, though what is within it may not be
        within = F.when(at + 8 + size > F.octet_length(d), F.octet_length(d) + 1).otherwise(12).cast("long")
        return tag, F.when(group, F.lit(4).cast("long")).otherwise(size), F.when(entered, within).otherwise(over)

    return _walk(data, 12, 8, read, None, MOST_STEPS)


def _avi_told(data: Column, walk: Column) -> Column:
    def of(c: Column) -> Column:
        tag = c["tag"]
        inner = F.substr(data, (c["start"] + 1).cast("int"), c["size"].cast("int"))
        text = F.trim(_z_text(inner))
        other = ~tag.isin(*AVI_KEPT) & ~F.rlike(tag, F.lit(AVI_STREAM))
        out = F.when(other, item("unknown extension", F.concat(F.lit("AVI:"), tag), size_text(c["size"]), 0))
        for (kind, severity), names in RIFF_INFO.items():
            out = F.when(tag.isin(*names), item(kind, F.concat(F.lit("AVI:INFO/"), tag), text, severity)).otherwise(out)
        out = F.when(tag.isin(*FILLERS) & filled(inner), item("unknown extension", "AVI:filler", size_text(c["size"]), 1)).otherwise(out)
        return F.when(tag == "strn", item("comment", "AVI:strn", text, 1)).otherwise(out)

    return numbered(F.transform(walk["chunks"], of))


@bound
def avi_findings(data: Column) -> Column:
    """Track names, INFO fields wherever they stand, fillers that are not empty, and every chunk that the pictures do not need."""
    return let(avi_chunks(data), lambda w: _avi_told(data, w))


@bound
def avi_report(data: Column) -> Column:
    return report(avi_chunks(data), lambda w: _avi_told(data, w))


@bound
def avi_cleaned(data: Column) -> Column:
    """The file with INFO lists, track names, fillers and INFO fields elsewhere overwritten by JUNK of the same length; null where it is broken."""
    fields = [n for names in RIFF_INFO.values() for n in names]

    def part(c: Column) -> Column:
        group, kind = c["tag"].isin("LIST", "RIFF"), F.substr(data, (c["start"] + 1).cast("int"), F.lit(4)).cast("string")
        size = le32(data, (c["start"] - 4).cast("int"))
        length = F.least(size + F.pmod(size, F.lit(2)), F.octet_length(data) - c["start"]).cast("int")
        at = (c["start"] - 7).cast("int")
        junk = F.concat(F.lit("JUNK").cast("binary"), F.substr(data, at + 4, F.lit(4)), F.unhex(F.repeat(F.lit("00"), length)))
        telling = c["tag"].isin("strn", *FILLERS, *fields) | (group & (kind == "INFO"))
        return F.when(telling, junk).when(group, F.substr(data, at, F.lit(12))).otherwise(F.substr(data, at, length + 8))

    whole = lambda walk: F.when(walk["error"].isNull(), F.concat(F.substr(data, F.lit(1), F.lit(12)), _join_bytes(F.transform(walk["chunks"], part))))
    return let(avi_chunks(data, ("INFO",)), whole)
