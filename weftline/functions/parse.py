"""Parsing written values: dates, amounts, versions, addresses. Nothing here raises; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in the order in which they are tried (month first before day first).
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


def parse_date(text: Column) -> Column:
    """The first format that fits the first 19 characters."""
    cut = F.substring(F.trim(text), 1, 19)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(cut, F.lit(f))) for f in DATE_FORMATS])


def parse_money(text: Column) -> Column:
    """A number without currency signs and group marks."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def parse_utc(text: Column) -> Column:
    """ISO 8601 as a time in UTC; texts without zone are UTC (the session's zone must be UTC)."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def version_key(version: Column) -> Column:
    """What orders versions: all numbers but zeros at the end, then the rank of a release or pre-release, then the number after it.

    Null for texts that begin with no number, so comparisons with them are inconclusive.
    """
    bare = F.regexp_replace(F.lower(F.trim(version)), r"^v", "")
    release = F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)", 1)
    pre = F.regexp_extract(bare, r"^\d+(?:\.\d+)*[-._]?(a|alpha|b|beta|c|rc|pre|preview|dev)", 1)
    number = F.regexp_extract(bare, r"(?:a|alpha|b|beta|c|rc|pre|preview|dev)[-._]?(\d+)", 1)
    parts = F.transform(F.split(release, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(0).cast("long")))
    # zeros at the end say nothing: they are dropped from the last place that is none
    kept = F.array_max(F.transform(parts, lambda p, i: F.when(p != 0, i + 1).otherwise(0)))
    numbers = F.slice(parts, F.lit(1), kept)
    rank = F.when(pre == "", 4).when(pre.isin("rc", "c", "pre", "preview"), 3).when(pre.isin("b", "beta"), 2).when(pre.isin("a", "alpha"), 1).otherwise(0).cast("long")
    return F.when(release != "", F.struct(numbers.alias("numbers"), rank.alias("rank"), F.coalesce(number.try_cast("long"), F.lit(0).cast("long")).alias("n")))


def in_range(version: Column, spec: Column) -> Column:
    """Whether a version meets a range: clauses `< <= > >= = !=`, all of those between commas, any of those between ||.

    Three-valued: null where the version or a deciding clause can't be read.
    """
    own = version_key(version)

    def clause(c: Column) -> Column:
        op = F.regexp_extract(F.trim(c), r"^(<=|>=|==|!=|<|>|=)?", 1)
        other = version_key(F.regexp_replace(F.trim(c), r"^(<=|>=|==|!=|<|>|=)\s*", ""))
        return F.when(op == "<", own < other).when(op == "<=", own <= other).when(op == ">", own > other).when(op == ">=", own >= other).when(op == "!=", own != other).otherwise(own == other)

    both = lambda a, x: a & x
    either = lambda a, x: a | x
    group = lambda g: F.aggregate(F.transform(F.split(g, ","), clause), F.lit(True), both)
    return F.aggregate(F.transform(F.split(spec, r"\|\|"), group), F.lit(False), either)


def canonical_url(url: Column) -> Column:
    """http(s) only, no user, lower-case host, no default port, no tracking parameters, sorted query, no fragment; '' if it is none."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#@:]+)(?::\d+)?(?:[/?#]|$)", 1))
    port = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#@:]+:(\d+)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[a-z]+|gclid|fbclid|mc_[a-z]+|ref)(=|$)")))
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    whole = F.concat(scheme, F.lit("://"), host, shown, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), whole).otherwise("")
