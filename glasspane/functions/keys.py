"""Key fingerprints, their display forms, safety numbers and exchange payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspane.functions.text import base32, base32_bytes, grouped
from glasspane.functions.values import bound, let

#: Fixed lengths in bytes: encryption, signing and post-quantum keys.
ENC, SIG, PQ = 32, 32, 1216
#: Domain tags; a deployment that must agree with another one passes that one's.
TAG, PAIR_TAG, DIGITS_TAG, PREFIX = "fp-v2", "sn-v2", "sn-digits", "keys:v2"


def _optional(key: Column, size: int) -> Column:
    """A presence byte and the key, or zeros of its length: no key and an all-zero key stay different."""
    return F.when(key.isNull(), F.unhex(F.lit("00" * (size + 1)))).otherwise(F.concat(F.unhex(F.lit("01")), key))


def fingerprint(enc: Column, sig: Column, pq: Column, tag: str = TAG) -> Column:
    """SHA-256 over tag, encryption key and the optional keys; null where a key has the wrong length."""
    data = F.concat(F.lit(tag).cast("binary"), enc, _optional(sig, SIG), _optional(pq, PQ))
    fits = (F.octet_length(enc) == ENC) & F.coalesce(F.octet_length(sig) == SIG, F.lit(True)) & F.coalesce(F.octet_length(pq) == PQ, F.lit(True))
    return F.when(fits, F.unhex(F.sha2(data, 256)))


def display_full(fp: Column) -> Column:
    return grouped(base32(fp))


def display(fp: Column) -> Column:
    """32 characters, the least to compare."""
    return grouped(F.left(base32(fp), F.lit(32)))


def short(fp: Column) -> Column:
    """Eight characters, to tell entries of a list apart only."""
    return F.left(base32(fp), F.lit(8))


def _padded(key: Column, byte: str) -> Column:
    """A key of 32 bytes, filled up with zeros to 64, each byte of it combined with the same byte by exclusive or."""
    digits, h = "0123456789ABCDEF", F.hex(key)
    of = lambda at, with_: F.translate(F.substr(h, at, F.lit(1)), digits, "".join(f"{d ^ int(with_, 16):X}" for d in range(16)))
    pairs = F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.concat(of(i, byte[0]), of(i + 1, byte[1])))
    return F.unhex(F.concat(F.array_join(pairs, ""), F.lit(byte * 32)))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC with SHA-256 for keys of 32 bytes."""
    inner = lambda k: F.unhex(F.sha2(F.concat(_padded(k, "36"), message), 256))
    return let(key, lambda k: F.unhex(F.sha2(F.concat(_padded(k, "5C"), inner(k)), 256)))


def _number(h: Column) -> Column:
    """Eight bytes in hex as a number without a sign, modulo 100 000, in five digits."""
    half = lambda at: F.conv(F.substr(h, F.lit(at), F.lit(8)), 16, 10).cast("long")
    return F.lpad(F.pmod(F.pmod(half(1), F.lit(100_000)) * ((1 << 32) % 100_000) + half(9), F.lit(100_000)).cast("string"), 5, "0")


def safety_number(a: Column, b: Column, pair_tag: str = PAIR_TAG, digits_tag: str = DIGITS_TAG) -> Column:
    """Twelve groups of five digits that both sides of a pair see alike: HKDF over the hash of both, in order."""
    pair = F.concat(F.lit(pair_tag).cast("binary"), F.least(a, b), F.greatest(a, b))
    base = F.when(a.isNotNull() & b.isNotNull(), F.unhex(F.sha2(pair, 256)))
    tag = F.lit(digits_tag).cast("binary")
    step = lambda prk, before, i: hmac_sha256(prk, F.concat(before, tag, F.unhex(F.lit(f"{i:02X}"))))

    def digits(blocks: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(177), F.lit(16)), lambda i: _number(F.substr(blocks, i, F.lit(16)))), " ")

    def expand(prk: Column) -> Column:
        rest = lambda t1, t2: F.concat(F.hex(t1), F.hex(t2), F.hex(step(prk, t2, 3)))
        return let(step(prk, F.unhex(F.lit("")), 1), lambda t1: let(step(prk, t1, 2), lambda t2: let(rest(t1, t2), digits)))

    return let(base, lambda key: F.when(key.isNotNull(), let(hmac_sha256(F.unhex(F.lit("00" * 32)), key), expand)))


def payload(enc: Column, sig: Column, pq: Column, prefix: str = PREFIX, tag: str = TAG) -> Column:
    """Keys and a checksum in one line."""
    none = F.lit("")
    return F.concat_ws(":", F.lit(prefix), base32(enc), F.coalesce(base32(sig), none), F.coalesce(base32(pq), none), short(fingerprint(enc, sig, pq, tag)))


@bound
def read_payload(text: Column, prefix: str = PREFIX, tag: str = TAG) -> Column:
    """``status`` (read, foreign, damaged), keys and fingerprint; the checksum is computed anew, never trusted."""

    def split(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        key = lambda i: F.when(part(i) != "", base32_bytes(part(i)))
        keys = F.struct(key(2).alias("enc"), key(3).alias("sig"), key(4).alias("pq"))

        def told(k: Column, fp: Column) -> Column:
            whole = all_of(k["enc"].isNotNull(), (part(3) == "") | k["sig"].isNotNull(), (part(4) == "") | k["pq"].isNotNull(), fp.isNotNull())
            mine = (F.size(parts) == 6) & (F.concat_ws(":", part(0), part(1)) == prefix)
            status = F.when(~F.coalesce(mine, F.lit(False)), "foreign").when(F.coalesce(whole & (short(fp) == part(5)), F.lit(False)), "read").otherwise("damaged")
            return F.struct(status.alias("status"), k["enc"].alias("enc_pub"), k["sig"].alias("sig_pub"), k["pq"].alias("pq_pub"), fp.alias("fingerprint"))

        return let(keys, lambda k: let(fingerprint(k["enc"], k["sig"], k["pq"], tag), lambda fp: told(k, fp)))

    return let(F.split(text, ":", -1), split)


def all_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
