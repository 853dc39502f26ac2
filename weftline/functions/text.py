"""Text expressions made of built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text; a line feed at its end begins no further one."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def line_count(text: Column) -> Column:
    """The number of lines, 0 for null and empty texts."""
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(lines(text)))


def collapse(text: Column) -> Column:
    """Without blanks at the ends, runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def drop_comments(text: Column) -> Column:
    """Without //, # and /* */ comments (by pattern: a mark inside a literal counts too)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"(?m)(//|#)[^\n]*", "")


def words(text: Column, least: int = 1) -> Column:
    """Words of letters and digits of any script and underscores, in lower case, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\pL\pN_]+"), 0)
    return F.filter(found, lambda w: F.length(w) >= least) if least > 1 else found


def ngrams(items: Column, n: int, separator: str = " ") -> Column:
    """Runs of `n` items, none for shorter arrays. The array is shifted as a whole, so the work grows with its length only."""
    count = F.greatest(F.size(items) - (n - 1), F.lit(0))
    joined = F.slice(items, F.lit(1), count)
    for k in range(1, n):
        joined = F.zip_with(joined, F.slice(items, F.lit(k + 1), count), lambda a, b: F.concat(a, F.lit(separator), b))
    return joined


def code_words(text: Column, stops: list[str]) -> Column:
    """Names in code, in lower case, without comments, literals, `stops` and single letters."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"(//|#)[^\n]*", " "), r"\"[^\"\n]*\"|'[^'\n]*'", " ")
    found = F.regexp_extract_all(F.lower(bare), F.lit(r"[a-z_][a-z0-9_]*"), 0)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stops)) if stops else F.filter(found, lambda w: F.length(w) > 1)


def numbered(items: Column) -> Column:
    """The items with the number of their occurrence, so that sets of them are multisets: sorted, each behind its place among its equals."""
    # the sorted array is bound as the one item of an outer array: inside the inner function it would be made again for every item
    number = lambda ordered: F.transform(ordered, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(ordered, x).cast("int")).cast("string")))
    return F.transform(F.array(F.array_sort(items)), number)[0]


def canonical_json(*columns: str) -> Column:
    """The columns as JSON with sorted keys, without blanks, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def fnv1a(column: str) -> Column:
    """FNV-1a of 32 bits over the characters' codes (of single-byte characters: over the bytes)."""
    codes = F.transform(F.split(F.col(column), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, x: F.pmod(a.bitwiseXOR(x) * 16777619, F.lit(4294967296)))


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, inside the row: no explosion and no exchange."""
    size = F.length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.when(size > 0, F.aggregate(F.filter(parts, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def normal_header(name: str) -> str:
    """How column headers and their aliases are compared."""
    return name.strip().lstrip("﻿").lower().replace(" ", "_")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors of doubles; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
