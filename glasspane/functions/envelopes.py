"""What a message shows without a key, and how files of the old version are told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suites by number.
SUITE_NAMES = ((1, "classical"), (2, "hybrid"))


def old_format(data: Column) -> Column:
    """'message' (base64 of JSON) or 'key file' (JSON) of the old version by the first bytes that are no blanks, or null."""
    text = F.decode(data, "ISO-8859-1")
    return F.when(F.rlike(text, F.lit(r"^[ \t\n\f\r]*eyJ")), "message").when(F.rlike(text, F.lit(r"^[ \t\n\f\r]*\{")), "key file")


def outside_view(data: Column, magic: bytes) -> Column:
    """``version, suite, stanzas, bytes, exposes`` and ``error`` of a message: magic, suite in two bytes, number of stanzas in one.

    The number of stanzas is an upper bound of the number of recipients; an old
    message shows its whole header.
    """
    number = lambda at, n: F.conv(F.nullif(F.hex(F.substr(data, F.lit(at), F.lit(n))), F.lit("")), 16, 10).cast("int")
    size, suite, old = F.octet_length(data), number(3, 2), F.coalesce(old_format(data) == "message", F.lit(False))
    name = F.lit(None).cast("string")
    for k, n in SUITE_NAMES:
        name = F.when(suite == k, n).otherwise(name)
    error = (
        F.when(old, F.lit(None).cast("string"))
        .when(F.hex(F.substr(data, F.lit(1), F.lit(len(magic)))) != magic.hex().upper(), "bad magic")
        .when(size < 4, "truncated")
        .when(name.isNull(), "unsupported suite")
        .when(size < 5, "truncated")
    )
    new = ~old & error.isNull()
    return F.struct(
        F.when(old, 1).when(new, 2).alias("version"),
        F.when(old, "classical").when(new, name).alias("suite"),
        F.when(new, number(5, 1)).alias("stanzas"),
        size.alias("bytes"),
        F.when(old, "header").when(new, "number of stanzas").alias("exposes"),
        error.alias("error"),
    )
