"""TIFF files and Exif blocks: a walk over a graph of directories, in either byte order, by column expressions.

Directories point to one another and to their values by offsets that may lead
anywhere. The walk keeps a list of directories still to read and one of those it
has read, so a circle is an error and every directory is read once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspane.functions.values import bound, let
from glasspane.operators.chunks import filled, item, numbered, report, size_text

#: Directories of one file and entries of one directory; more are an error.
MOST_DIRECTORIES, MOST_ENTRIES = 64, 4096
#: Bytes of a value by its type number.
TYPE_SIZES = (1, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4)
#: Tags that tell something: name, kind, severity.
TAGS = {
    0x010D: ("DocumentName", "comment", 1), 0x010E: ("ImageDescription", "comment", 1), 0x010F: ("Make", "device", 1), 0x0110: ("Model", "device", 1),
    0x0131: ("Software", "software", 1), 0x0132: ("DateTime", "timestamp", 1), 0x013B: ("Artist", "author", 2), 0x013C: ("HostComputer", "device", 2),
    0x02BC: ("XMP", "author", 2), 0x8298: ("Copyright", "author", 1), 0x83BB: ("IPTC", "author", 2), 0x8649: ("Photoshop", "software", 1),
    0x8769: ("Exif-IFD", "device", 1), 0x8773: ("ICC", "color profile", 0), 0x8825: ("GPS-IFD", "gps", 2), 0x9C9B: ("XPTitle", "comment", 1),
    0x9C9D: ("XPAuthor", "author", 2), 0x9C9E: ("XPKeywords", "comment", 1), 0xA005: ("Interoperability-IFD", "device", 0), 0xC4A5: ("PrintIM", "software", 0),
}
#: Tags that point to directories; to picture data with the tag of its lengths; that mark raw photos.
SUB_DIRECTORIES, SUB_IFDS = (0x8769, 0x8825, 0xA005, 0x014A), 0x014A
PICTURES = ((0x0111, 0x0117), (0x0144, 0x0145), (0x0201, 0x0202))
DNG, CFA, INTERPRETATION, RAW_MEANINGS, REDUCED = 0xC612, (0x828E, 0x828D), 0x0106, (32803, 34892), 0x00FE

_ENTRY = "struct<dir:int,main:boolean,tag:int,type:int,count:bigint,at:bigint,size:bigint>"
_TODO, _DIR = "struct<at:bigint,main:boolean,seen:boolean>", "struct<main:boolean,at:bigint,size:bigint>"


def place(at: Column) -> Column:
    """An offset as an argument of ``substr``; one that no file reaches stays behind every end."""
    return F.least(at, F.lit((1 << 31) - 2)).cast("int")


def number(data: Column, at: Column, width: int, small: Column) -> Column:
    """A number of 2 or 4 bytes at an offset from 0; ``small``: its low byte comes first."""
    digits = lambda h: F.when(small, F.concat(*[F.substr(h, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(width))])).otherwise(h)
    return F.conv(let(F.hex(F.substr(data, place(at + 1), F.lit(width))), digits), 16, 10).cast("long")


def _numbers(data: Column, e: Column, small: Column) -> Column:
    """The values of an entry of 16- or 32-bit numbers; null for other types."""
    all_of = lambda width: F.transform(F.sequence(F.lit(0).cast("long"), e["count"] - 1), lambda i: number(data, e["at"] + i * width, width, small))
    some = F.when(e["type"] == 3, all_of(2)).when(e["type"].isin(4, 13), all_of(4))
    return F.when(e["count"] > 0, some).when(e["type"].isin(3, 4, 13), F.array().cast("array<bigint>"))


@bound
def directories(data: Column) -> Column:
    """``error``, ``small`` (byte order), ``dirs`` (main, at, size) and ``entries`` (dir, main, tag, type, count, at, size) in reading order.

    ``main`` directories are those of the chain; the others hang on a tag. A
    directory off the chain that cannot be read is left out.
    """
    end = F.octet_length(data)
    order = F.substr(data, F.lit(1), F.lit(2)).cast("string")

    def walk(small: Column) -> Column:
        num = lambda at, width: number(data, at, width, small)

        def entry(dir: Column, main: Column, at: Column) -> Column:
            kind, count = num(at + 2, 2), num(at + 4, 4)
            size = count * F.coalesce(F.get(F.lit(list(TYPE_SIZES)), kind.cast("int")), F.lit(1))
            return let(size, lambda n: F.struct(
                dir.alias("dir"), main.alias("main"), num(at, 2).cast("int").alias("tag"), kind.cast("int").alias("type"), count.alias("count"),
                F.when(n <= 4, at + 8).otherwise(num(at + 8, 4)).alias("at"), n.alias("size"),
            ).cast(_ENTRY))

        def read(s: Column, first: Column) -> Column:
            at, main = first["at"], first["main"]

            def with_count(count: Column) -> Column:
                length = 2 + 12 * count + 4
                none = F.array().cast(f"array<{_ENTRY}>")
                there = count.isNotNull() & (at + length <= end) & (count <= MOST_ENTRIES)
                got = F.when(there & (count > 0), F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: entry(F.size(s["dirs"]), main, at + 2 + 12 * i))).otherwise(none)

                def with_entries(e: Column) -> Column:
                    past = F.exists(e, lambda x: F.coalesce(x["at"] + x["size"] > end, F.lit(True)))
                    fault = (
                        F.when(first["seen"], "directories in a circle")
                        .when(F.size(s["dirs"]) >= MOST_DIRECTORIES, "too many directories")
                        .when(F.coalesce(count, F.lit(0)) > MOST_ENTRIES, "too many entries")
                        .when(~there, "directory past the end")
                        .when(past, "value past the end")
                    )
                    follow = F.filter(e, lambda x: x["tag"].isin(*SUB_DIRECTORIES) & x["type"].isin(3, 4, 13) & (x["count"] <= MOST_DIRECTORIES))
                    subs = F.flatten(F.transform(follow, lambda x: _numbers(data, x, small)))
                    known = lambda p: F.array_contains(s["seen"], p) | (p == at)
                    onward = F.transform(F.filter(subs, lambda p: (p > 0) & ~known(p)), lambda p: F.struct(p.alias("at"), F.lit(False).alias("main"), F.lit(False).alias("seen")).cast(_TODO))
                    chain = F.filter(F.array(num(at + length - 4, 4)), lambda p: main & (p > 0))
                    chain = F.transform(chain, lambda p: F.struct(p.alias("at"), F.lit(True).alias("main"), known(p).alias("seen")).cast(_TODO))
                    rest = F.slice(s["todo"], 2, MOST_DIRECTORIES * MOST_DIRECTORIES)
                    fine = F.struct(
                        F.concat(rest, chain, onward).alias("todo"), F.concat(s["seen"], F.array(at)).alias("seen"), F.concat(s["dirs"], F.array(F.struct(main.alias("main"), at.alias("at"), length.alias("size")).cast(_DIR))).alias("dirs"),
                        F.concat(s["entries"], e).alias("entries"), s["error"].alias("error"),
                    )
                    skipped = F.struct(rest.alias("todo"), s["seen"].alias("seen"), s["dirs"].alias("dirs"), s["entries"].alias("entries"), F.when(main, fault).otherwise(s["error"]).alias("error"))
                    # a directory that two tags point to is read once
                    again = ~main & F.array_contains(s["seen"], at)
                    return F.when(fault.isNull() & ~again, fine).otherwise(skipped)

                return let(got, with_entries)

            return let(num(at, 2), with_count)

        first = num(F.lit(4), 4)
        fault = F.when(end < 8, "truncated head").when(num(F.lit(2), 2) == 43, "BigTIFF is not read").when(num(F.lit(2), 2) != 42, "wrong mark").when(first == 0, "no directory")
        start = F.struct(
            F.array(F.struct(first.alias("at"), F.lit(True).alias("main"), F.lit(False).alias("seen")).cast(_TODO)).alias("todo"), F.array().cast("array<bigint>").alias("seen"),
            F.array().cast(f"array<{_DIR}>").alias("dirs"), F.array().cast(f"array<{_ENTRY}>").alias("entries"), F.when(~order.isin("II", "MM"), "no byte order").otherwise(fault).alias("error"),
        )
        step = lambda s, _: F.when((F.size(s["todo"]) == 0) | s["error"].isNotNull(), s).otherwise(let(F.get(s["todo"], F.lit(0)), lambda first: read(s, first)))
        finish = lambda s: F.struct(
            F.coalesce(s["error"], F.when(F.exists(s["todo"], lambda t: t["main"]), "too many directories")).alias("error"), small.alias("small"), s["dirs"].alias("dirs"),
            F.transform(s["entries"], lambda e: e.withField("value", _value(data, e, small))).alias("entries"),
        )
        return F.aggregate(F.sequence(F.lit(1), F.lit(2 * MOST_DIRECTORIES)), start, step, finish)

    return let(order == "II", walk)


def _value(data: Column, e: Column, small: Column) -> Column:
    """What a finding or a rule needs of an entry: its text, or its first number."""
    text = F.trim(F.regexp_replace(F.make_valid_utf8(F.substr(data, place(e["at"] + 1), F.least(e["size"], F.lit(4096)).cast("int")).cast("string")), "\\x00+$", ""))
    first = number(data, e["at"], 2, small)
    return F.when(e["type"] == 2, F.nullif(text, F.lit(""))).when((e["type"] == 3) & e["tag"].isin(INTERPRETATION, REDUCED), first.cast("string")).when((e["type"] == 4) & e["tag"].isin(INTERPRETATION, REDUCED), number(data, e["at"], 4, small).cast("string"))


def _of(t: Column, dir: Column) -> Column:
    return F.filter(t["entries"], lambda e: e["dir"] == dir)


def _reduced(entries: Column) -> Column:
    """Whether a directory says that its picture is a smaller copy."""
    return F.exists(entries, lambda e: (e["tag"] == REDUCED) & (F.pmod(e["value"].cast("long"), F.lit(2)) == 1))


def raw_photo(t: Column) -> Column:
    """Why the directories are those of a raw photo, or null: sensor data, or a first directory that is only a preview."""
    sensor = F.exists(t["entries"], lambda e: e["tag"].isin(DNG, *CFA) | ((e["tag"] == INTERPRETATION) & e["value"].isin(*map(str, RAW_MEANINGS))))
    first = _of(t, F.lit(0))
    return F.when(sensor, "sensor data").when(_reduced(first) & F.exists(first, lambda e: e["tag"] == SUB_IFDS), "the first directory is a preview")


def told(t: Column) -> Column:
    """Findings of the directories of the chain, by their tags; those behind the first are named by their number."""
    names = F.create_map(*[F.lit(x) for tag, (name, *_) in TAGS.items() for x in (tag, name)])
    kinds = F.create_map(*[F.lit(x) for tag, (_, kind, _) in TAGS.items() for x in (tag, kind)])
    severities = F.create_map(*[F.lit(x) for tag, (*_, severity) in TAGS.items() for x in (tag, severity)])
    chain = F.filter(F.transform(t["dirs"], lambda d, i: F.struct(d["main"].alias("main"), i.alias("dir"))), lambda d: d["main"])

    def of(d: Column, nr: Column) -> Column:
        named = lambda name: F.when(nr == 0, name).otherwise(F.concat(F.lit("IFD"), nr.cast("string"), F.lit("/"), name))

        def with_entries(entries: Column) -> Column:
            beside = F.exists(entries, lambda e: e["tag"].isin(PICTURES[0][0], PICTURES[1][0])) | (nr > 0)
            one = lambda e: (
                F.when(names[e["tag"]].isNotNull(), item(kinds[e["tag"]], named(names[e["tag"]]), F.coalesce(e["value"], size_text(e["size"])), severities[e["tag"]]))
                .when(e["tag"] == SUB_IFDS, item("embedded preview", named(F.lit("SubIFDs")), F.concat(e["count"].cast("string"), F.lit(" directories")), 2))
                .when((e["tag"] == PICTURES[2][0]) & beside, item("embedded preview", named(F.lit("preview")), None, 2))
            )
            smaller = F.when((nr > 0) & _reduced(entries), item("embedded preview", named(F.lit("directory")), None, 2))
            return F.concat(F.transform(entries, one), F.array(smaller))

        return let(_of(t, d["dir"]), with_entries)

    return F.flatten(F.transform(chain, of))


def _pictures(data: Column, t: Column) -> Column:
    """Intervals (start, end) of picture data; an end of null where offsets and lengths do not pair."""

    def pair(d: Column, i: Column) -> Column:
        entries = _of(t, i)
        both = lambda a, b: F.struct(F.get(F.filter(entries, lambda e: e["tag"] == a), F.lit(0)).alias("a"), F.get(F.filter(entries, lambda e: e["tag"] == b), F.lit(0)).alias("b"))
        spans = lambda ab: F.when(
            ab["a"].isNotNull() & ab["b"].isNotNull(),
            F.zip_with(_numbers(data, ab["a"], t["small"]), _numbers(data, ab["b"], t["small"]), lambda x, n: F.struct(F.coalesce(x, F.lit(0)).alias("start"), (x + n).alias("end"))),
        )
        return F.flatten(F.array_compact(F.array(*[let(both(a, b), spans) for a, b in PICTURES])))

    return F.flatten(F.transform(t["dirs"], pair))


def _fault(data: Column, t: Column) -> Column:
    end = F.octet_length(data)
    past = let(_pictures(data, t), lambda p: F.exists(p, lambda x: x["end"].isNull() | (x["end"] > end)))
    return F.coalesce(t["error"], F.when(past, "picture data past the end"))


def _uncovered(data: Column, t: Column) -> Column:
    """Bytes between the parts that nothing points to and that are not zero, and bytes behind the last part."""
    span = lambda start, end: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
    parts = F.concat(
        F.array(span(F.lit(0), F.lit(8))), F.transform(t["dirs"], lambda d: span(d["at"], d["at"] + d["size"])),
        F.transform(F.filter(t["entries"], lambda e: e["size"] > 4), lambda e: span(e["at"], e["at"] + e["size"])), _pictures(data, t),
    )

    def add(s: Column, p: Column) -> Column:
        gap = F.substr(data, place(s["to"] + 1), place(p["start"] - s["to"]))
        open_ = (p["start"] > s["to"]) & filled(gap)
        return F.struct(F.greatest(s["to"], p["end"]).alias("to"), (s["lost"] + F.when(open_, p["start"] - s["to"]).otherwise(0)).alias("lost"))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.sort_array(parts), F.struct(zero.alias("to"), zero.alias("lost")), add)


def _all_told(data: Column, t: Column) -> Column:
    rest = lambda u: F.array(
        F.when(u["lost"] > 0, item("unknown extension", "gap", size_text(u["lost"]), 1)),
        F.when(F.octet_length(data) > u["to"], item("unknown extension", "tail", size_text(F.octet_length(data) - u["to"]), 1)),
    )
    raw = let(raw_photo(t), lambda r: F.array(F.when(r.isNotNull(), item("unknown extension", "raw photo", r, 0))))
    every = F.array_compact(F.concat(told(t), raw, let(_uncovered(data, t), rest)))
    return numbered(F.transform(every, lambda f: item(f["kind"], F.concat(F.lit("TIFF:"), f["location"]), f["value"], f["severity"])))


@bound
def tiff_findings(data: Column) -> Column:
    """Findings of the directories' tags, previews, a raw photo's marks, and bytes that nothing points to."""
    return let(directories(data), lambda t: _all_told(data, t))


@bound
def tiff_report(data: Column) -> Column:
    return report(directories(data), lambda t: _all_told(data, t), lambda t: _fault(data, t))


@bound
def camera_raw(data: Column) -> Column:
    """Why a TIFF file is a raw photo, or null; a broken one is none."""
    return let(directories(data), lambda t: F.when(t["error"].isNull(), raw_photo(t)))
