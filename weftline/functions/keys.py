"""Keys that several tables write differently, and compact identities of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space around a key.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(column: Column | str) -> Column:
    """`column` without white space of any kind at both ends."""
    return F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(WHITE))


def norm_key(column: Column | str) -> Column:
    """The comparable form of a key, or null where it refers to nothing.

    Trimmed, lower-cased and without a leading `sha256:`. Null, blank and 64 zeros give null.
    """
    low = F.lower(strip(column))
    bare = F.when(low.startswith("sha256:"), F.substring(low, 8, 1 << 20)).otherwise(low)
    return F.when((bare != "") & (bare != "0" * 64), bare)


def key128(column: Column) -> Column:
    """16 bytes that stand for a key where its text would only be carried along; equal keys, equal bytes."""
    return F.unhex(F.md5(column.cast("string")))


def packed_key(column: Column) -> Column:
    """A key as bytes that give it back: digests of 64 hexadecimal places as 32 bytes behind a 1, others as their own bytes behind a 0."""
    return F.when(column.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"\x01"), F.unhex(column))).otherwise(F.concat(F.lit(b"\x00"), F.encode(column, "UTF-8")))


def unpacked_key(column: Column) -> Column:
    """The key that packed_key has made these bytes of."""
    rest = F.substring(column, 2, 2147483647)
    return F.when(F.substring(column, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def norm_word(column: Column | str) -> Column:
    """Trimmed lower case, null as the empty text: how states and severities are compared."""
    return F.coalesce(F.lower(strip(column)), F.lit(""))
