"""Column functions on keys: trailing white space, hashes, buckets and name-based ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


# White space by Java's rules, which leave out the no-break spaces.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680" + "".join(chr(c) for c in range(0x2000, 0x200B) if c != 0x2007) + "\u2028\u2029\u205f\u3000"


def strip_trailing(key: Column) -> Column:
    """The key without white space at its end, no-break spaces excepted; null stays null, blanks become empty."""
    return F.rtrim(key, F.lit(_WHITE))


def _signed(x: Column) -> Column:
    """A number from 0 to 2**32 - 1 as a signed 32-bit one."""
    return F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)


def _hash_code(key: Column) -> Column:
    """Sum of characters times powers of 31 modulo 2**32, for characters of the basic plane.

    The last 8 or 16 characters are one sum, in which places before the key's begin count 0; Spark compiles that, and interprets the fold that longer keys take.
    """
    chars = F.when(F.length(key) > 0, F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.ascii(F.substring(key, i, F.lit(1))).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    folded = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32)))

    def last(n: int) -> Column:
        return F.pmod(sum((F.ascii(F.substring(key, -i, 1)).cast("long") * F.lit(31 ** (i - 1) % 2**32) for i in range(1, n + 1)), F.lit(0).cast("long")), F.lit(2**32))

    return F.when(F.length(key) <= 8, last(8)).when(F.length(key) <= 16, last(16)).otherwise(folded)


def string_hash(key: Column) -> Column:
    """The 32-bit string hash of the basic plane's characters, as a signed number."""
    return _signed(_hash_code(key))


def bucket_of(key: Column, buckets: int) -> Column:
    """The key's bucket from 0 to ``buckets`` - 1; 0 if there are none; a null key fails."""
    if buckets <= 0:
        return F.lit(0)
    return F.when(key.isNull(), F.raise_error(F.lit("a bucket needs a key")).cast("int")).otherwise(F.pmod(string_hash(key), F.lit(buckets)).cast("int"))


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32, in two steps that stay within a long."""
    high = F.pmod(x * (factor >> 16), F.lit(2**32))
    return F.pmod(high * 65536 + x * (factor & 0xFFFF), F.lit(2**32))


def sub_index_of(match_key: Column, group_key: Column, fanout: int) -> Column:
    """A second, independent division of a bucket's keys: the hash is scrambled before the remainder is taken."""
    if fanout <= 1:
        return F.lit(0)
    h = _hash_code(F.coalesce(match_key, group_key))
    # Shifts and factors of the scramble.
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        h = _times(h.bitwiseXOR(F.shiftright(h, shift)), factor)
    h = h.bitwiseXOR(F.shiftright(h, 16))
    return F.coalesce(F.pmod(_signed(h), F.lit(fanout)), F.lit(0)).cast("int")


def name_uuid(name: Column) -> Column:
    """The version-3 id of a name: its md5 with the version and variant bits set."""
    m = F.md5(name.cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(m, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)).cast("long")))
    return F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.concat(F.lit("3"), F.substring(m, 14, 3)), F.concat(variant, F.substring(m, 19, 2)), F.substring(m, 21, 12))


def fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the parts, joined by ``|``; backslashes and bars within parts are escaped and null is ``∅``."""

    def escaped(part: Column | str) -> Column:
        part = F.lit(part) if isinstance(part, str) else part
        return F.coalesce(F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("∅"))

    return F.sha2(reduce(lambda a, b: F.concat(a, F.lit("|"), b), map(escaped, parts)), 256)
