"""Films and sound in nested boxes (ISO base media): a walk with a stack of box ends, and a directory of keys joined by position.

The walk is a fold. Its state has the ends of the boxes that it is in; where no
further box fits before the innermost end, it goes on behind that box.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspane.functions.magic import be32
from glasspane.functions.values import bound, let
from glasspane.operators.chunks import _all_of, _byte, _gather, _nothing, filled, item, numbered, report, size_text

#: Boxes of one file (more are an error), levels that are entered, keys and track descriptions that are read.
MOST_BOXES, MOST_DEPTH, MOST_KEYS, MOST_TRACKS = 200_000, 12, 4096, 64
#: Boxes that hold boxes; what stands in each item of ``ilst`` does too.
HOLDERS = ("moov", "trak", "mdia", "minf", "udta", "meta", "ilst", "edts", "stbl")
TIMES = ("mvhd", "tkhd", "mdhd")
#: Items of a tag list, and the last parts of the names of keys: kind, severity.
ITEMS = {
    ("author", 2): ("©ART", "aART", "©wrt"), ("comment", 2): ("©cmt",), ("comment", 1): ("©nam", "desc", "ldes"), ("software", 1): ("©too", "©swr"),
    ("timestamp", 1): ("©day",), ("device", 1): ("©mak", "©mod"),
}
KEYS = {
    ("gps", 2): ("ISO6709",), ("device", 2): ("identifier",), ("author", 2): ("artist", "author", "director", "producer", "performer"),
    ("comment", 2): ("comment", "description", "information"), ("device", 1): ("make", "model"), ("software", 1): ("software", "encoder", "creationsoftware"),
    ("timestamp", 1): ("creationdate", "year"), ("organization", 1): ("copyright", "publisher"),
}
_BOX = "struct<tag:string,start:bigint,body:bigint,end:bigint,depth:int>"
_OPEN = "struct<end:bigint,tag:string>"


def _text(data: Column) -> Column:
    """Bytes as text without zeros and white space around it; null if there is none."""
    return F.nullif(F.regexp_replace(F.make_valid_utf8(data.cast("string")), r"^[\s\x00]+|[\s\x00]+$", ""), F.lit(""))


def _part(data: Column, start: Column, end: Column) -> Column:
    return F.substr(data, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


@bound
def boxes(data: Column) -> Column:
    """``error`` and ``boxes`` (tag, start, body, end, depth), each before those within it; tags as Latin text."""
    end = F.octet_length(data).cast("long")

    def step(s: Column, _: Column) -> Column:
        top = F.try_element_at(s["open"], F.lit(-1))

        def read(p: Column) -> Column:
            def of(tag: Column) -> Column:
                said = be32(data, p)
                high = be32(data, p + 8)
                wide = F.when(high < (1 << 30), high * (1 << 32) + be32(data, p + 12))
                head = F.when(said == 1, 16).otherwise(8)
                size = F.when(said == 1, wide).when(said == 0, top["end"] - s["at"]).otherwise(said)
                fault = (
                    F.when(size.isNull(), "size not readable").when(size < head, "box smaller than its head").when(s["at"] + size > top["end"], "box past its range")
                    .when(s["n"] >= MOST_BOXES, "too many boxes")
                )
                box = F.struct(tag.alias("tag"), s["at"].alias("start"), (s["at"] + head).alias("body"), (s["at"] + size).alias("end"), (F.size(s["open"]) - 1).alias("depth")).cast(_BOX)
                enter = (tag.isin(*HOLDERS) | (top["tag"] == "ilst")) & (F.size(s["open"]) <= MOST_DEPTH)
                inner = s["at"] + head + F.when(tag == "meta", 4).otherwise(0)
                good = F.struct(
                    F.when(enter, inner).otherwise(s["at"] + size).alias("at"), F.when(enter, F.concat(s["open"], F.array(F.struct((s["at"] + size).alias("end"), tag.alias("tag")).cast(_OPEN)))).otherwise(s["open"]).alias("open"),
                    _gather(s["got"], box).alias("got"), (s["n"] + 1).alias("n"), s["error"].alias("error"),
                )
                bad = F.struct(s["at"].alias("at"), F.slice(s["open"], 1, 0).alias("open"), s["got"].alias("got"), s["n"].alias("n"), fault.alias("error"))
                return F.when(fault.isNull(), good).otherwise(bad)

            return let(F.decode(F.substr(data, p + 5, F.lit(4)), "ISO-8859-1"), of)

        left = F.struct(top["end"].alias("at"), F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1).alias("open"), s["got"].alias("got"), s["n"].alias("n"), s["error"].alias("error"))
        return F.when(F.size(s["open"]) == 0, s).when(s["at"] + 8 > top["end"], left).otherwise(let(s["at"].cast("int"), read))

    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array(F.struct(end.alias("end"), none.alias("tag")).cast(_OPEN)).alias("open"), _nothing(f"array<{_BOX}>").alias("got"), F.lit(0).alias("n"), none.alias("error"))
    steps = F.sequence(F.lit(1), F.least(F.lit(2 * MOST_BOXES), (end / 8).cast("int") * 2) + 2)
    finish = lambda s: F.struct(F.coalesce(s["error"], F.when(F.size(s["open"]) > 0, "too many boxes"), F.when(s["n"] == 0, "no boxes")).alias("error"), _all_of(s["got"]).alias("boxes"))
    return F.aggregate(steps, start, step, finish)


def _records(data: Column, box: Column, most: int, least: int) -> Column:
    """Starts and ends of the records behind a box's version and count, each with its length in front."""
    count = F.least(F.coalesce(be32(data, (box["body"] + 4).cast("int")), F.lit(0)), F.lit(most))

    def step(s: Column, _: Column) -> Column:
        size = be32(data, s["at"].cast("int"))
        fits = (s["at"] + 4 <= box["end"]) & (size >= least)
        end = F.least(s["at"] + size, box["end"])
        return F.when(fits, F.struct(end.alias("at"), F.concat(s["got"], F.array(F.struct(s["at"].alias("start"), end.alias("end")))).alias("got"))).otherwise(s)

    begin = F.struct((box["body"] + 8).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("got"))
    return F.when(count > 0, F.aggregate(F.sequence(F.lit(1), count.cast("int")), begin, step, lambda s: s["got"])).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _first(w: Column, tag: str) -> Column:
    return F.get(F.filter(w["boxes"], lambda b: b["tag"] == tag), F.lit(0))


def _within(w: Column, outer: Column) -> Column:
    return F.filter(w["boxes"], lambda b: (b["start"] > outer["start"]) & (b["end"] <= outer["end"]))


def key_names(data: Column, w: Column) -> Column:
    """The names of the first directory of keys, in order; null without one."""
    of = lambda k: F.when(k.isNotNull(), F.transform(_records(data, k, MOST_KEYS, 8), lambda r: F.make_valid_utf8(_part(data, r["start"] + 8, r["end"]).cast("string"))))
    return let(_first(w, "keys"), of)


def _value(data: Column, w: Column, box: Column) -> Column:
    """The text of the first ``data`` box within an item."""
    inner = F.get(F.filter(_within(w, box), lambda b: b["tag"] == "data"), F.lit(0))
    return let(inner, lambda d: _text(_part(data, d["body"] + 8, d["end"])))


def keyed_items(data: Column, w: Column) -> Column:
    """Items of the tag list whose type is a number, with the name that stands at this place of the directory: name, value."""

    def of(names: Column, tags: Column) -> Column:
        mine = F.filter(_within(w, tags), lambda b: b["depth"] == tags["depth"] + 1)
        pair = lambda b: F.struct(F.get(names, (be32(data, (b["start"] + 4).cast("int")) - 1).cast("int")).alias("name"), _value(data, w, b).alias("value"))
        return F.filter(F.transform(F.filter(mine, lambda b: be32(data, (b["start"] + 4).cast("int")).between(1, MOST_KEYS)), pair), lambda x: x["name"].isNotNull())

    none = F.array().cast("array<struct<name:string,value:string>>")
    return let(key_names(data, w), lambda names: let(_first(w, "ilst"), lambda tags: F.when(names.isNotNull() & tags.isNotNull(), of(names, tags)).otherwise(none)))


def _told(data: Column, w: Column) -> Column:
    named = [n for names in ITEMS.values() for n in names]

    def of(b: Column) -> Column:
        tag = b["tag"]
        out = F.lit(None)
        for (kind, severity), names in ITEMS.items():
            out = F.when(tag.isin(*names), item(kind, F.concat(F.lit("Video:ilst/"), tag), _value(data, w, b), severity)).otherwise(out)
        time = _part(data, b["body"] + 4, b["body"] + F.when(_byte(data, b["body"]) == 1, 12).otherwise(8))
        handler = _text(_part(data, b["body"] + 24, b["end"]))
        return (
            F.when(tag == "©xyz", item("gps", "Video:udta/©xyz", _text(_part(data, b["body"] + 4, b["end"])), 2))
            .when(tag.isin(*TIMES) & filled(time), item("timestamp", F.concat(F.lit("Video:"), tag), None, 1))
            .when((tag == "hdlr") & handler.isNotNull(), item("software", "Video:hdlr", handler, 1))
            .otherwise(out)
        )

    writers = F.flatten(F.transform(F.filter(w["boxes"], lambda b: b["tag"] == "stsd"), lambda s: F.transform(_records(data, s, MOST_TRACKS, 24), lambda r: _text(_part(data, r["start"] + 20, r["start"] + 24)))))
    writers = F.transform(F.array_compact(writers), lambda x: item("software", "Video:stsd", x, 1))

    def by_key(x: Column) -> Column:
        last = F.substring_index(x["name"], ".", -1)
        kind, severity = F.lit("comment"), F.lit(1)
        for (k, s), names in KEYS.items():
            kind, severity = F.when(last.isin(*names), k).otherwise(kind), F.when(last.isin(*names), s).otherwise(severity)
        return item(kind, F.concat(F.lit("Video:"), x["name"]), x["value"], severity)

    def with_keys(keyed: Column) -> Column:
        known = lambda u: (F.size(keyed) > 0) | F.exists(_within(w, u), lambda b: b["tag"].isin("©xyz", *named))
        users = F.filter(w["boxes"], lambda b: (b["tag"] == "udta") & (b["end"] - b["start"] > 8) & ~known(b))
        rest = F.transform(users, lambda u: item("unknown extension", "Video:udta", size_text(u["end"] - u["start"]), 1))
        raw = F.array(F.when(F.substr(data, F.lit(9), F.lit(4)) == F.lit("crx ").cast("binary"), item("unknown extension", "Video:raw photo", None, 1)))
        return numbered(F.concat(F.transform(w["boxes"], of), writers, F.transform(keyed, by_key), rest, raw))

    return let(keyed_items(data, w), with_keys)


@bound
def video_findings(data: Column) -> Column:
    """Places, times, tags, handlers, writers of tracks, keys with their values and other users' data, in this order."""
    return let(boxes(data), lambda w: _told(data, w))


@bound
def video_report(data: Column) -> Column:
    return report(boxes(data), lambda w: _told(data, w))
