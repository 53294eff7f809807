"""Message headers as strict records: their fields, or the first rule that they break."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspane.functions.text import filename_fault
from glasspane.functions.values import bound, let
from glasspane.operators.chunks import body, tlv_fields

#: Types of header fields.
PADDING, CONTENT_TYPE, PLAINTEXT_SIZE, PADDING_LEN, SIGNED, SENDER_KEY, FILENAME, TIMESTAMP, RESERVED = "00", "01", "02", "03", "04", "05", "06", "07", "09"
LONGEST_NAME = 255


#: Names of the fields that are given.
FIELDS = {
    "content_type": CONTENT_TYPE, "plaintext_size": PLAINTEXT_SIZE, "padding_len": PADDING_LEN, "signed": SIGNED,
    "sender_key": SENDER_KEY, "filename": FILENAME, "sent_at": TIMESTAMP,
}


def _fault(data: Column, f: Column) -> Column:
    """What is wrong with one field, or null."""
    tag, size = f["tag"], f["size"]
    value = F.hex(body(data, f))
    length = lambda tags, n: tag.isin(*tags) & (size != n)
    name = lambda s: F.when(s.isNull(), "name is no UTF-8").otherwise(F.concat(F.lit("name: "), filename_fault(s)))
    return (
        F.when((tag == PADDING) & F.rlike(value, F.lit("[^0]")), "padding not zero")
        .when(length((CONTENT_TYPE, SIGNED), 1) | length((PLAINTEXT_SIZE, PADDING_LEN, TIMESTAMP), 8) | length((SENDER_KEY,), 32), F.concat(F.lit("wrong length of "), tag))
        .when((tag == CONTENT_TYPE) & ~value.isin("00", "01"), "unknown content type")
        .when((tag == SIGNED) & ~value.isin("00", "01"), "signed is not 0 or 1")
        .when((tag == FILENAME) & (size > LONGEST_NAME), "name too long")
        .when(tag == FILENAME, let(F.try_validate_utf8(body(data, f).cast("string")), name))
        .when(tag == RESERVED, "reserved type")
        .when(~tag.isin(PADDING, CONTENT_TYPE, PLAINTEXT_SIZE, PADDING_LEN, SIGNED, SENDER_KEY, TIMESTAMP), "unknown type")
    )


@bound
def header_fields(data: Column) -> Column:
    """``content_type, plaintext_size, padding_len, signed, sender_key, filename, sent_at`` and ``error``.

    The error is the first in the order of the fields, then a record that ends
    early, then a field that is missing; with an error all else is null. A name
    that a receiver must not use is an error.
    """

    def read(record: Column) -> Column:
        return let(F.transform(record["fields"], lambda f: f["tag"]), lambda tags: among(record, tags))

    def among(record: Column, tags: Column) -> Column:
        fields = record["fields"]
        late = lambda f, i: F.coalesce(f["tag"] <= F.get(tags, i - 1), F.lit(False))
        faults = F.array_compact(F.transform(fields, lambda f, i: F.when((i > 0) & late(f, i), "tags out of order").otherwise(_fault(data, f))))
        of = lambda tag: let(F.get(fields, F.array_position(tags, tag).cast("int") - 1), lambda f: body(data, f))
        fault = F.coalesce(F.get(faults, F.lit(0)), F.when(record["error"] != "no chunks", record["error"]))
        return let(F.struct(fault.alias("fault"), *[of(tag).alias(k) for k, tag in FIELDS.items()]), told)

    def told(v: Column) -> Column:
        error = (
            F.when(v["fault"].isNotNull(), v["fault"])
            .when(v["signed"].isNull(), "signed missing")
            .when((F.hex(v["signed"]) == "01") != v["sender_key"].isNotNull(), "signed flag and key disagree")
            .when(v["content_type"].isNull(), "content type missing")
            .when(v["plaintext_size"].isNull(), "size missing")
            .when(v["padding_len"].isNull(), "padding length missing")
        )
        return let(error, lambda e: given(v, e))

    def given(v: Column, error: Column) -> Column:
        number = lambda c: F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")
        got = {
            "content_type": F.when(F.hex(v["content_type"]) == "00", "text").otherwise("file"), "plaintext_size": number(v["plaintext_size"]), "padding_len": number(v["padding_len"]),
            "signed": F.hex(v["signed"]) == "01", "sender_key": v["sender_key"], "filename": v["filename"].cast("string"), "sent_at": number(v["sent_at"]),
        }
        return F.struct(*[F.when(error.isNull(), c).alias(k) for k, c in got.items()], error.alias("error"))

    return let(tlv_fields(data), read)
