"""String functions: base32, armor, path and name checks, truncation, sizes, outside references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspane.functions.values import bound, let

#: Fixed values.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
SHOWN = 200
BIDI = "‪‫‬‭‮⁦⁩"
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
CLOUDS = (
    ("onedrive", "OneDrive"), ("dropbox", "Dropbox"), ("google drive", "Google Drive"), ("googledrive", "Google Drive"),
    ("icloud", "iCloud"), ("nextcloud", "Nextcloud"), ("pcloud", "pCloud"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


#: Digits of ``conv`` in base 32, in the order of the alphabet; what is read for each of them.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_READ = dict(zip(ALPHABET + "OIL", _DIGITS + "011"))


def base32(data: Column) -> Column:
    """Crockford base32 without padding, most significant bit first, five bits a character."""
    digits = F.regexp_extract_all(F.concat(F.hex(data), F.lit("0" * 14)), F.lit(".{15}"), F.lit(0))  # 60 bits are 12 characters
    joined = F.array_join(F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 32), 12, "0")), "")
    return F.left(F.translate(joined, _DIGITS, ALPHABET), F.ceil(F.octet_length(data) * 8 / 5).cast("int"))


def grouped(s: Column, n: int = 4) -> Column:
    return F.regexp_replace(s, f"(.{{{n}}})(?=.)", "$1-")


@bound
def base32_bytes(s: Column) -> Column:
    """The bytes of base32 text, or null where it is not canonical: case, dashes and spaces do not matter; O is 0, I and L are 1."""

    def read(plain: Column) -> Column:
        n = F.length(plain)
        groups = F.regexp_extract_all(F.translate(F.concat(plain, F.lit("0" * 11)), "".join(_READ), "".join(_READ.values())), F.lit(".{12}"), F.lit(0))
        digits = F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 32, 16), 15, "0")), "")
        whole = F.floor(n * 5 / 8).cast("int") * 2
        good = F.rlike(plain, F.lit(f"^[{''.join(_READ)}]*$")) & (F.pmod(n * 5, F.lit(8)) < 5)
        return F.when(good, let(digits, lambda d: F.when(~F.rlike(F.substr(d, whole + 1), F.lit("[^0]")), F.unhex(F.left(d, whole)))))

    return let(F.upper(F.regexp_replace(s, "[- ]", "")), read)


def shown(value: Column) -> Column:
    """At most 200 code points, then an ellipsis."""
    return F.when(F.length(value) > SHOWN, F.concat(F.left(value, F.lit(SHOWN)), F.lit("…"))).otherwise(value)


def path_leak(name: Column) -> Column:
    """What an entry name gives away about its place on a disk, or null."""
    low = F.replace(ascii_lower(name), F.lit("\\"), F.lit("/"))
    inside = lambda part: F.startswith(low, F.lit(part)) | F.contains(low, F.lit("/" + part))
    return (
        F.when(inside("users/"), "windows user path")
        .when(inside("home/"), "unix home directory")
        .when(F.rlike(name, F.lit(r"^[A-Za-z]:[/\\]")), "absolute path with drive letter")
    )


def filename_fault(name: Column) -> Column:
    """Why a received file name is refused, or null if it may be used."""
    stem = F.translate(F.get(F.split(name, "\\."), F.lit(0)), LOWER, UPPER)
    return (
        F.when(name == "", "empty")
        .when(F.rlike(name, F.lit(r"[/\\:]")), "separator")
        .when(name.isin(".", ".."), "path element")
        .when(F.rlike(name, F.lit(r"[\x00-\x1F\x7F\u0080-\u009F]")), "control character")
        .when(F.rlike(name, F.lit(f"[{BIDI}]")), "bidi override")
        .when(stem.isin(*RESERVED), "reserved name")
    )


def cloud_hint(path: Column) -> Column:
    """The first synchronisation service that a path names, or null."""
    low, out = F.lower(path), F.lit(None).cast("string")
    for part, name in reversed(CLOUDS):
        out = F.when(F.contains(low, F.lit(part)), name).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """Bytes, or steps of 1024 with one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        tenths = F.floor((n * 10 + 1024**i / 2) / 1024**i).cast("long")
        out = F.when(n >= 1024**i, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def points_outside(reference: Column) -> Column:
    """Whether a reference leaves its document: all but empty ones, fragments and embedded data."""
    r = F.regexp_replace(F.regexp_replace(reference, r"^\s+", ""), r"\s+$", "")
    return ~((r == "") | F.startswith(r, F.lit("#")) | F.startswith(r, F.lit("data:")))


def armored(data: Column, head: str, foot: str) -> Column:
    """Base64 in lines of 64 between two marker lines."""
    body = F.regexp_replace(F.base64(data), "[\\r\\n]", "")
    return F.concat(F.lit(head + "\n"), F.regexp_replace(body, "(.{1,64})", "$1\n"), F.lit(foot))


def armored_bytes(text: Column, head: str, foot: str) -> Column:
    """The bytes between the marker lines, or null; white space and quoting marks inside do not matter."""
    start = F.locate(head, text) + len(head)
    rest = F.substr(text, start)
    inner = F.substr(rest, F.lit(1), F.locate(foot, rest) - 1)
    clean = F.regexp_replace(inner, r"[ \t\n\f\r>]", "")
    good = F.contains(text, F.lit(head)) & F.contains(rest, F.lit(foot)) & F.rlike(clean, F.lit("^[A-Za-z0-9+/]*={0,2}$")) & (F.pmod(F.length(clean), F.lit(4)) == 0)
    return F.when(good, F.try_to_binary(clean, F.lit("base64")))


def cleaned_name(name: Column, suffix: str = "clean") -> Column:
    """The suffix before the extension (a leading dot starts no extension)."""
    return F.when(F.rlike(name, F.lit(r"^.+\.[^.]+$")), F.regexp_replace(name, r"^(.+)\.([^.]+)$", f"$1.{suffix}.$2")).otherwise(F.concat(name, F.lit(f".{suffix}")))
