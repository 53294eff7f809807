"""Message-size arithmetic: size classes, chunks, stanzas, headers, whole envelopes.

Integer arithmetic only; lengths are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the envelope format.
LEAST_CLASS = 256
CHUNK = 65536
TAG = 16
STANZA_CAP = 16
HEADER_STEP = 256
PROLOGUE, STANZA_HEAD, LENGTH_FIELD, SIGNATURE = 5, 3, 4, 80
SUITES = ((1, "classical", 32, 32, 80), (2, "hybrid", 1120, 1216, 1168))  # id, name, capsule, key, stanza


def size_class(length: Column) -> Column:
    """The padded length: the top floor(log2(log2 n)) + 1 bits below the leading one stay, the rest is rounded up."""
    exponent = F.length(F.bin(length)) - 1
    free = exponent - F.length(F.bin(exponent.cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), free) - 1
    rounded = (length + mask).bitwiseAND(F.bitwise_not(mask))
    return F.when(length <= LEAST_CLASS, F.lit(LEAST_CLASS).cast("long")).otherwise(rounded)


def padding(length: Column) -> Column:
    return size_class(length) - length


def _steps(length: Column, step: int) -> Column:
    """Whole steps that cover the length."""
    return ((length + step - 1 - F.pmod(length + step - 1, F.lit(step))) / step).cast("long")


def chunk_count(length: Column) -> Column:
    """An empty input still has one chunk."""
    return F.greatest(F.lit(1).cast("long"), _steps(length, CHUNK))


def cipher_length(length: Column) -> Column:
    return length + TAG * chunk_count(length)


def padded_stanzas(recipients: Column) -> Column:
    """Next power of two, two at least; sixteen or more stay as they are."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin((F.greatest(recipients, F.lit(1)) - 1).cast("long"))))
    return F.when(recipients >= STANZA_CAP, recipients.cast("long")).when(recipients <= 2, F.lit(2).cast("long")).otherwise(power)


def header_length(name_bytes: Column, signed: Column, stamped: Column) -> Column:
    """Header fields with their three-byte heads, padded to a multiple of 256."""
    fields = F.lit(3 + 4 + 11 + 11 + 4).cast("long")
    fields += F.when(signed, 35).otherwise(0) + F.when(stamped, 11).otherwise(0)
    fields += F.when(name_bytes.isNull(), 0).otherwise(name_bytes + 3)
    return _steps(fields, HEADER_STEP) * HEADER_STEP


def envelope_length(length: Column, recipients: Column, stanza: Column, header: Column, signed: Column) -> Column:
    """All bytes of an envelope for that many recipients."""
    stanzas = padded_stanzas(recipients) * (stanza + STANZA_HEAD)
    return PROLOGUE + stanzas + LENGTH_FIELD + header + TAG + cipher_length(length) + F.when(signed, SIGNATURE).otherwise(0)
