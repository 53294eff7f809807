"""Format-preserving pseudonyms for personal numbers, dates, addresses in texts.

Values are found by form and validated (check digits, calendar, ranges); what
does not validate stays. A value is read as an integer of its format's domain
and moved by a keyed Feistel permutation of that domain (cycle walking keeps it
inside), so the pseudonym is valid in the same format, equal values stay equal
in all documents, different ones stay different, and the key's owner can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glasspane.llm.rows import append_columns

ROUNDS = 8
DAY_ONE, DAY_END = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()


def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it is inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    tweak = f"{kind}:{size}:".encode()

    def f(step: int, x: int) -> int:
        got = hashlib.blake2b(tweak + bytes([step]) + x.to_bytes((half + 7) // 8, "big"), key=key, digest_size=(half + 7) // 8)
        return int.from_bytes(got.digest(), "big") & mask

    while True:
        a, b = value >> half, value & mask
        if back:
            for step in reversed(range(ROUNDS)):
                a, b = b ^ f(step, a), a
        else:
            for step in range(ROUNDS):
                a, b = b, a ^ f(step, b)
        value = a << half | b
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in form)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


Move = Callable[[int, int, str], int]


def _card(s: str, move: Move) -> str | None:
    d = _digits(s)
    if not (13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1):
        return None
    n = len(d) - 1
    body = f"{move(int(d[:-1]), 10**n, f'card{n}'):0{n}d}"
    return _refill(s, body + luhn_digit(body))


#: Country codes of one and of two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(s: str, move: Move) -> str | None:
    d = _digits(s)
    if not 7 <= len(d) <= 15:
        return None
    # the country code stays; it is told by its digits, so every spelling of a number has one pseudonym
    keep = (1 if d[:1] in ONE_DIGIT else 2 if d[:2] in TWO_DIGITS else 3) if s[0] == "+" else 0
    n = len(d) - keep
    return _refill(s, d[:keep] + f"{move(int(d[keep:]), 10**n, f'phone{n}'):0{n}d}")


def _ip(s: str, move: Move) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(s: str, move: Move) -> str | None:
    area, group, serial = (int(x) for x in s.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    area -= area > 666  # 898 areas, 99 groups, 9999 serials
    value = move(((area - 1) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    area, group, serial = value // 9999 // 99 + 1, value // 9999 % 99 + 1, value % 9999 + 1
    return f"{area + (area >= 666):03d}-{group:02d}-{serial:04d}"


def _iban(s: str, move: Move) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    size, value = 1, 0
    for c in reversed(plain[4:]):  # mixed radix: digits stay digits, letters stay letters
        radix, digit = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - 65)
        value, size = value + digit * size, size * radix
    value, out = move(value, size, f"iban{plain[:2]}{size}"), []
    for c in reversed(plain[4:]):
        value, digit = divmod(value, 10 if c.isdigit() else 26)
        out.append(chr(digit + (48 if c.isdigit() else 65)))
    body = "".join(reversed(out))
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    new = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def _date(s: str, move: Move) -> str | None:
    a, sep, b, _, c = re.split(r"([-./])", s)
    orders = [("y", "m", "d")] if len(a) == 4 else [("d", "m", "y"), ("m", "d", "y")] if sep != "/" else [("m", "d", "y"), ("d", "m", "y")]
    for order in orders:
        v = dict(zip(order, (a, b, c)))
        try:
            day = datetime.date(int(v["y"]), int(v["m"]), int(v["d"])).toordinal()
        except ValueError:
            continue
        if DAY_ONE <= day < DAY_END:
            new = datetime.date.fromordinal(DAY_ONE + move(day - DAY_ONE, DAY_END - DAY_ONE, "date"))
            fields = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return sep.join(fields[k] for k in order)
    return None


def _email(s: str, move: Move) -> str | None:
    local, domain = s.rsplit("@", 1)
    size, value = 1, 0
    classes = {**{c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "0123456789" for c in "0123456789"}}
    lowered = local.lower()
    for c in reversed(lowered):
        if c in classes:
            value, size = value + classes[c].index(c) * size, size * len(classes[c])
    if size == 1:
        return None
    value, out = move(value, size, f"mail{size}"), []
    for c in reversed(lowered):
        if c in classes:
            value, digit = divmod(value, len(classes[c]))
            c = classes[c][digit]
        out.append(c)
    return f"{''.join(reversed(out))}@{domain}"


@dataclass(frozen=True)
class Kind:
    name: str
    form: re.Pattern
    make: Callable[[str, Move], str | None]


#: Tried in this order on each candidate.
KINDS = (
    Kind("iban", re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", re.ASCII), _iban),
    Kind("ip", re.compile(r"\d{1,3}(?:\.\d{1,3}){3}", re.ASCII), _ip),
    Kind("date", re.compile(r"\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d{4}\.\d\d\.\d\d|\d\d([-./])\d\d\1\d{4}", re.ASCII), _date),
    Kind("ssn", re.compile(r"\d{3}-\d\d-\d{4}", re.ASCII), _ssn),
    Kind("card", re.compile(r"\d{13,19}|\d{4}(?: \d{4}){2,3}(?: \d{1,4})?|\d{4}(?:-\d{4}){2,3}(?:-\d{1,4})?|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}", re.ASCII), _card),
    Kind("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ ./-]?\d{2,4}){1,4}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}|\d{3}[.-]\d{3}[.-]\d{4}", re.ASCII), _phone),
)
#: Lengths by country, where a group behind the IBAN could be read as its end.
IBAN_LENGTHS = dict(AD=24, AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GI=23, GR=27, HR=21, HU=28, IE=22, IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, SE=24, SI=19, SK=24, SM=27)
_CANDIDATE = re.compile(r"[A-Z]{2}\d\d[A-Z0-9 ]{9,40}|[+(]?\d[\d ().\-/]*\d", re.ASCII)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


class Pseudonymizer:
    """Replaces the values of a text; equal values are computed once per worker."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back
        self.value = lru_cache(1 << 16)(self._value)

    def _move(self, value: int, size: int, kind: str) -> int:
        return permute(value, size, self.key, kind, self.back)

    def _value(self, s: str) -> tuple[str, str] | None:
        if "@" in s:
            new = _email(s, self._move)
            return ("email", new) if new else None
        for kind in KINDS:
            if kind.form.fullmatch(s):
                new = kind.make(s, self._move)
                if new is not None:
                    return kind.name, new
        return None

    def _in_run(self, text: str, start: int, end: int, out: list) -> None:
        """Values in a run of candidate characters: from each word of it the longest that validates."""
        words = [(m.start(), m.end()) for m in re.finditer(r"[^ ]+", text[start:end])]
        i = 0
        while i < len(words):
            for j in range(min(len(words), i + 9), i, -1):
                a, b = start + words[i][0], start + words[j - 1][1]
                while b > a and text[b - 1] in ".,-/)(" and not text[b - 1].isdigit():
                    b -= 1
                if (a and (text[a - 1].isalnum() or text[a - 1] == "_")) or (b < len(text) and (text[b].isalnum() or text[b] == "_")):
                    continue
                got = self.value(text[a:b])
                if not got and text[a] == "(":  # a bracket around the value, not a part of it
                    a += 1
                    got = self.value(text[a:b])
                if got:
                    out.append((a, b, *got))
                    break
            else:
                j = i + 1
            i = j

    def _iban_at(self, text: str, start: int, end: int) -> tuple[int, int, str, str] | None:
        """The IBAN that begins here: of its country's length, else the longest that validates; it ends with a word."""
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            return None
        ends = [b for b in range(end, start, -1) if text[b - 1] != " " and (b == len(text) or not (text[b].isalnum() or text[b] == "_"))]
        usual = IBAN_LENGTHS.get(text[start : start + 2])
        for b in sorted(ends, key=lambda b: len(text[start:b].replace(" ", "")) != usual):
            got = self.value(text[start:b])
            if got:
                return start, b, *got
        return None

    def _in_part(self, text: str, at: int, end: int, out: list) -> None:
        """Values of a part without e-mail addresses; the search goes on right behind an IBAN, or inside what is none."""
        while m := _CANDIDATE.search(text, at, end):
            at = m.end()
            if m[0][0].isalpha():
                got = self._iban_at(text, m.start(), m.end())
                if got:
                    out.append(got)
                at = got[1] if got else m.start() + 2  # at the two digits
            elif at - m.start() >= 7:
                self._in_run(text, m.start(), at, out)

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and pseudonym of each value, in order."""
        out: list[tuple[int, int, str, str]] = []
        mails = [m.span() for m in _MAIL.finditer(text)] if "@" in text else []
        at = 0
        for a, b in [*mails, (len(text), len(text))]:
            self._in_part(text, at, a, out)
            if b > a:
                got = self.value(text[a:b])
                if got:
                    out.append((a, b, *got))
            at = b
        return out

    def text(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        found = self.spans(text)
        parts, at = [], 0
        for a, b, _, new in found:
            parts += [text[at:a], new]
            at = b
        return "".join([*parts, text[at:]]), found


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii``: the spans (code points of the old text) and kinds.

    Null stays null with no spans, empty stays empty; texts without values stay
    as they are; repeated rows stay; an own column ``pii`` is replaced. E-mail
    addresses keep their domain, phone numbers their country code; e-mail
    pseudonyms are lower case. ``back`` restores the values.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        p = _worker(key, back)
        got = [(None, []) if t is None else p.text(t) for t in batch.column(text).to_pylist()]
        spans = [[{"start": a, "end": b, "kind": k} for a, b, k, _ in s] for _, s in got]
        return [pa.array([t for t, _ in got], pa.string()), pa.array(spans, _SPANS)]

    new = T.StructType([T.StructField(text, T.StringType()), T.StructField("pii", T.ArrayType(_SPAN))])
    return append_columns(docs, new, compute).select(*[c for c in docs.columns if c != "pii"], "pii")


@lru_cache(4)
def _worker(key: bytes, back: bool) -> Pseudonymizer:
    return Pseudonymizer(key, back)
