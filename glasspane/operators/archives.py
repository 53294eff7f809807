"""ZIP archives read from their bytes: the directory at the end, entries as rows, what entries and their names tell.

The end record is searched backwards, since a comment of any content may follow
it; it points to the central directory, which is walked record by record. Entries
that are stored as they are can be taken out and inspected as files of their own;
nothing is unpacked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspane.functions import magic
from glasspane.functions.magic import le16, le32
from glasspane.functions.text import path_leak
from glasspane.functions.values import bound, let
from glasspane.operators.chunks import _walk, item, numbered, size_text

#: Entries of one archive (more are an error) and bytes of its end in which the end record is searched.
MOST_ENTRIES, END_BYTES = 20_000, 22 + 65_535
_END, _DIRECTORY, _LOCAL = "504B0506", "504B0102", "504B0304"
_ENTRY = "struct<name:string,folder:boolean,method:int,packed:bigint,size:bigint,offset:bigint>"


def _le64(data: Column, offset: Column) -> Column:
    high = le32(data, offset + 4)
    return F.when(high < (1 << 31), le32(data, offset) + high * (1 << 32))


def _mark(data: Column, at: Column) -> Column:
    return F.hex(F.substr(data, at.cast("int") + 1, F.lit(4)))


@bound
def end_record(data: Column) -> Column:
    """Offset of the end record, or null: the last one whose comment reaches just to the end, else the last one whose comment fits."""
    size = F.octet_length(data)
    first = F.greatest(size - END_BYTES, F.lit(0))
    text = F.decode(F.substr(data, first + 1), "ISO-8859-1")

    def among(parts: Column) -> Column:
        # the mark stands before each part but the first
        at = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: first + 4 * (k - 1) + F.length(F.array_join(F.slice(parts, F.lit(1), k), "")))
        fits = F.filter(at, lambda p: p + 22 + F.coalesce(le16(data, p + 20), F.lit(1 << 20)) <= size)
        exact = F.filter(fits, lambda p: p + 22 + le16(data, p + 20) == size)
        return F.when(F.size(parts) > 1, F.coalesce(F.try_element_at(exact, F.lit(-1)), F.try_element_at(fits, F.lit(-1))))

    return let(F.split(text, "PK\\x05\\x06", -1), among)


@bound
def zip_directory(data: Column) -> Column:
    """``error``, ``entries`` (name, folder, method, packed, size, offset from the file's start), ``comment`` and ``tail`` (bytes of each).

    Archives of more than 65 535 entries or 4 GB have a second end record, which
    the first one's place leads to. Bytes before the archive shift all offsets.
    """

    def with_end(end: Column) -> Column:
        wide = _mark(data, end - 20) == "504B0607"
        far = F.when((end >= 20) & wide, _le64(data, (end - 12).cast("int")))
        far = F.when((far >= 0) & (far + 56 <= end), far)

        def with_far(at: Column) -> Column:
            p = at.cast("int")
            count = F.coalesce(_le64(data, p + 32), le16(data, end + 10))
            size = F.coalesce(_le64(data, p + 40), le32(data, end + 12))
            said = F.coalesce(_le64(data, p + 48), le32(data, end + 16))
            return let(F.struct(F.coalesce(at, end.cast("long")).alias("stop"), count.alias("count"), size.alias("size"), said.alias("said")), walked)

        def walked(d: Column) -> Column:
            start = d["stop"] - d["size"]
            shift = start - d["said"]
            fault = F.when(d["count"] > MOST_ENTRIES, "too many entries").when((start < 0) | (shift < 0), "directory past the end")

            def read(b: Column, at: Column) -> tuple[Column, Column, Callable[[Column], Column]]:
                p = at.cast("int")
                size = le16(b, p + 28) + le16(b, p + 30) + le16(b, p + 32)
                return _mark(b, at), size, lambda c: F.when(c["tag"] == _DIRECTORY, 46 + c["size"]).otherwise(F.octet_length(b) + 1)

            def entries(b: Column) -> Column:
                none = F.array().cast(f"array<{_ENTRY}>")

                def entry(c: Column) -> Column:
                    p = (c["start"] - 46).cast("int")
                    raw = F.substr(b, p + 47, le16(b, p + 28).cast("int"))
                    name = F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))
                    return let(name, lambda n: F.struct(
                        n.alias("name"), F.endswith(n, F.lit("/")).alias("folder"), le16(b, p + 10).cast("int").alias("method"), le32(b, p + 20).alias("packed"),
                        le32(b, p + 24).alias("size"), (le32(b, p + 42) + shift).alias("offset"),
                    ).cast(_ENTRY))

                def checked(walk: Column) -> Column:
                    got = F.when(d["count"] == 0, none).otherwise(F.transform(walk["chunks"], entry))
                    return let(got, lambda got: judged(walk, got))

                def judged(walk: Column, got: Column) -> Column:
                    off = F.when((d["count"] > 0) & walk["error"].isNotNull(), "broken directory").when(F.size(got) != d["count"], "wrong number of entries")
                    outside = F.exists(got, lambda e: (e["offset"] + 30 > start) | (_mark(data, F.least(e["offset"], F.octet_length(data).cast("long"))) != _LOCAL))
                    error = F.coalesce(off, F.when(outside, "entry past the directory"))
                    return let(F.struct(error.alias("error"), le16(data, end + 20).alias("rest")), lambda s: told(got, s["error"], s["rest"]))

                def told(got: Column, e: Column, rest: Column) -> Column:
                    return F.struct(e.alias("error"), F.when(e.isNull(), got).otherwise(none).alias("entries"), rest.cast("long").alias("comment"), (F.octet_length(data) - end - 22 - rest).cast("long").alias("tail"))

                return let(_walk(b, 0, 46, read, None, MOST_ENTRIES + 1), checked)

            return F.when(fault.isNotNull(), _failed(fault)).otherwise(let(F.substr(data, (F.greatest(start, F.lit(0)) + 1).cast("int"), d["size"].cast("int")), entries))

        return F.when(end.isNull(), _failed(F.lit("no end record"))).otherwise(let(far, with_far))

    return let(end_record(data), with_end)


def _failed(error: Column) -> Column:
    none, zero = F.array().cast(f"array<{_ENTRY}>"), F.lit(0).cast("long")
    return F.struct(error.alias("error"), none.alias("entries"), zero.alias("comment"), zero.alias("tail"))


def stored(data: Column, entry: Column) -> Column:
    """The bytes of an entry that is stored as it is; null for packed ones, folders, and where they reach beyond the end."""

    def content(start: Column) -> Column:
        return F.when(start + entry["packed"] <= F.octet_length(data), F.substr(data, (start + 1).cast("int"), entry["packed"].cast("int")))

    at = entry["offset"].cast("int")
    start = at + 30 + le16(data, at + 26) + le16(data, at + 28)
    return F.when((entry["method"] == 0) & ~entry["folder"], let(start, content))


def type_entry(data: Column, entries: Column) -> Column:
    """The text of the entry ``mimetype``, or null."""
    mine = F.get(F.filter(entries, lambda e: e["name"] == "mimetype"), F.lit(0))
    return let(mine, lambda e: F.try_validate_utf8(stored(data, e).cast("string")))


@bound
def zip_kind(data: Column) -> Column:
    """What an archive is, by its entries' names and its type entry; null for one that is broken."""
    of = lambda d: F.when(d["error"].isNull(), magic.archive_kind(F.transform(d["entries"], lambda e: e["name"]), type_entry(data, d["entries"])))
    return let(zip_directory(data), of)


@bound
def zip_findings(data: Column) -> Column:
    """A container with a type of its own, names that stay readable, paths of users in them, archives within, a comment, bytes behind the end; null for a broken archive."""

    def told(d: Column) -> Column:
        kind = magic.archive_kind(F.transform(d["entries"], lambda e: e["name"]), type_entry(data, d["entries"]))
        files = F.size(F.filter(d["entries"], lambda e: ~e["folder"]))

        def of(e: Column) -> Column:
            place = F.concat(F.lit("ZIP:"), e["name"])
            head = lambda b: _mark(b, F.lit(0)).isin(_LOCAL, _END)
            inner = F.coalesce(let(stored(data, e), lambda b: head(b) & F.coalesce(zip_kind(b) == "archive", F.lit(True))), F.lit(False))
            return F.array(
                let(path_leak(e["name"]), lambda p: F.when(p.isNotNull(), item("author", place, p, 2))),
                F.when(inner, item("unknown extension", place, F.lit("an archive within"), 1)),
            )

        first = F.array(
            F.when(kind.isin("EPUB", "APK", "JAR", "typed container"), item("unknown extension", "ZIP:container", kind, 2)),
            F.when(files > 0, item("comment", "ZIP:entry names", F.concat(files.cast("string"), F.lit(" names")), 1)),
        )
        last = F.array(F.when(d["comment"] > 0, item("comment", "ZIP:comment", size_text(d["comment"]), 1)), F.when(d["tail"] > 0, item("unknown extension", "ZIP:tail", size_text(d["tail"]), 1)))
        return F.when(d["error"].isNull(), numbered(F.concat(first, F.flatten(F.transform(d["entries"], of)), last)))

    return let(zip_directory(data), told)


def entries(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each entry: ``key, i, name, folder, method, packed, size, offset``; a broken archive has one row with its ``error``."""
    got = files.select(F.col(key), zip_directory(F.col(content)).alias("d"))
    return got.select(key, F.col("d.error").alias("error"), F.posexplode_outer("d.entries").alias("i", "e")).where("e is not null or error is not null").select(key, "i", "e.*", "error")


def members(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The stored entries as files: ``key, name, content``, ready to be inspected like any other; packed entries have none."""
    def taken(data: Column) -> Column:
        made = F.transform(zip_directory(data)["entries"], lambda e: F.struct(e["name"].alias("name"), stored(data, e).alias("content")))
        return F.filter(made, lambda m: m["content"].isNotNull())

    # an inner explode, or a filter on its content, would be pushed down and work the directory or the entry out twice
    got = files.select(key, F.explode_outer(let(F.col(content), taken)).alias("m")).where("m is not null")
    return got.select(key, "m.name", "m.content")
