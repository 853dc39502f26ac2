"""Joins beyond plain equality.

Each keeps an equality to partition by: ranges are cut into buckets, prefixes into their lengths, similarities into
shared tokens. None is a cross join of two growing tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.parse import in_range


def valid_at(facts: DataFrame, periods: DataFrame, on: Column, until: Column, as_of: Column) -> DataFrame:
    """`facts` left-joined with the periods that are still open `as_of`. The time is part of the join, so facts without one stay."""
    return facts.join(periods, on & (until > as_of), "left")


def near(left: DataFrame, right: DataFrame, key: str, position: str, distance: int, *, other: str) -> DataFrame:
    """Pairs of rows of one key whose positions differ by `distance` at most.

    Positions fall into buckets of that width; the right side is put into its own and both neighbouring buckets, so the
    join is on key and bucket. `other` is the position column of `right`.
    """
    width = max(1, distance)
    own = left.withColumn("_b", F.floor(F.col(position) / width))
    spread = right.withColumnRenamed(key, "_k").withColumn("_c", F.explode(F.array(*[F.floor(F.col(other) / width) + d for d in (-1, 0, 1)])))
    return own.join(spread, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & (F.abs(F.col(position) - F.col(other)) <= distance)).drop("_b", "_c", "_k")


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, position: str, start: str, end: str, *, width: int = 64) -> DataFrame:
    """Points inside a range of their key, both ends included. Ranges are unfolded to the buckets that they touch."""
    spread = ranges.withColumnRenamed(key, "_k").withColumn("_c", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    own = points.withColumn("_b", F.floor(F.col(position) / width))
    return own.join(spread, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & (F.col(position) >= F.col(start)) & (F.col(position) <= F.col(end))).drop("_b", "_c", "_k")


def innermost(points: DataFrame, ranges: DataFrame, point_id: str, key: str, position: str, start: str, end: str, label: str) -> DataFrame:
    """For each point the enclosing range of its key that starts last: point_id, label. Points in no range are left out."""
    inside = in_ranges(points.select(point_id, key, position), ranges.select(key, start, end, label), key, position, start, end)
    return inside.groupBy(point_id).agg(F.max(F.struct(F.col(start), F.col(label)))[label].alias(label))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, *, name: str = "as_of") -> DataFrame:
    """`left` with the last `value` of `right` at or before each row's time: one union and one window, no join on time."""
    both = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    window = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(window)).where("_side = 1").drop("_v", "_side")


def longest_prefix(df: DataFrame, column: str, prefixes: DataFrame, prefix: str, value: str, default) -> DataFrame:
    """`df` with the value of the longest prefix of `column`, or `default`.

    `prefixes` is a small rule table. Each distinct text is unfolded to its beginnings of the lengths that prefixes have, which
    are joined by equality, so neither side is compared with all of the other.
    """
    lengths = F.broadcast(prefixes.agg(F.array_sort(F.collect_set(F.length(F.col(prefix)))).alias("_lengths")))
    texts = df.select(F.col(column).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    starts = texts.join(lengths).select("_t", F.explode("_lengths").alias("_n")).where((F.col("_n") > 0) & (F.col("_n") <= F.length("_t")))
    starts = starts.withColumn("_p", F.expr("substring(_t, 1, _n)"))
    best = starts.join(prefixes.select(F.col(prefix).alias("_q"), F.col(value).alias("_v")), F.col("_p") == F.col("_q")).groupBy("_t").agg(F.max(F.struct("_n", "_v"))["_v"].alias("_v"))
    return df.join(best, F.col(column) == F.col("_t"), "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_t", "_v")


def affected_versions(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """id, advisory, state: packages (id, name, version) in the range of an advisory (n, spec, advisory).

    Names are equal without regard to case; a package whose whole name no advisory has is looked up by the last part of it. `affected`
    where the range holds, `inconclusive` where version or range cannot be read; others are left out.
    """
    feed = advisories.select(F.lower("n").alias("_n"), "spec", "advisory")
    whole = F.lower(F.col("name"))
    named = packages.select("id", "version", whole.alias("_w"), F.regexp_extract(whole, "([^/]*)$", 1).alias("_b"))
    known = feed.select(F.col("_n").alias("_k")).distinct()
    keyed = named.join(known, F.col("_w") == F.col("_k"), "left").select("id", "version", F.when(F.col("_k").isNotNull(), F.col("_w")).otherwise(F.col("_b")).alias("_key"))
    met = keyed.join(feed, F.col("_key") == F.col("_n")).withColumn("_in", in_range(F.col("version"), F.col("spec")))
    return met.where(F.coalesce("_in", F.lit(True))).select("id", "advisory", F.when(F.col("_in").isNull(), "inconclusive").otherwise("affected").alias("state"))


def unique_match(left: DataFrame, left_id: str, left_key: str, right: DataFrame, right_id: str, right_key: str) -> DataFrame:
    """left_id, state, match: `linked` to the only candidate, `ambiguous` with several, `unlinked` with none."""
    names = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min(right_id).alias("_m"))
    joined = left.select(left_id, left_key).join(names, F.col(left_key) == F.col("_k"), "left")
    state = F.when(F.col("_n").isNull(), "unlinked").when(F.col("_n") == 1, "linked").otherwise("ambiguous")
    return joined.select(left_id, state.alias("state"), F.when(F.col("_n") == 1, F.col("_m")).alias("match"))


def wildcard_paths(calls: DataFrame, call: str, routes: DataFrame, route: str) -> DataFrame:
    """Calls and the route templates they fit: as many segments, each equal or a parameter (`<x>`, `{x}`, `:x`) in the template."""
    left = calls.withColumn("_cs", F.split(F.trim(F.col(call), F.lit("/")), "/")).withColumn("_n", F.size("_cs"))
    right = routes.withColumn("_rs", F.split(F.trim(F.col(route), F.lit("/")), "/")).withColumn("_m", F.size("_rs"))
    # the first segment is fixed in most templates: it joins by equality where it is
    first = F.element_at("_rs", 1)
    right = right.withColumn("_first", F.when(~first.rlike(r"^[<{:]"), first))
    fits = F.forall(F.zip_with("_cs", "_rs", lambda c, r: (c == r) | r.rlike(r"^[<{:]")), lambda ok: ok)
    fixed = left.join(right.where("_first is not null"), (F.col("_n") == F.col("_m")) & (F.element_at("_cs", 1) == F.col("_first")))
    free = left.join(right.where("_first is null"), F.col("_n") == F.col("_m"))
    return fixed.unionByName(free).where(fits).drop("_cs", "_rs", "_n", "_m", "_first")


def overlapping(df: DataFrame, key: str, row: str, start: str, end: str, *, width: float) -> DataFrame:
    """Pairs (a < b) of rows of one key whose half-open intervals overlap. Intervals are unfolded to buckets of `width`; a pair
    is taken in the first bucket that both touch."""
    cut = df.select(key, row, start, end).withColumn("_c", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    a = cut.select(key, F.col(row).alias("a"), F.col(start).alias("_as"), F.col(end).alias("_ae"), "_c")
    b = cut.select(F.col(key).alias("_k"), F.col(row).alias("b"), F.col(start).alias("_bs"), F.col(end).alias("_be"), F.col("_c").alias("_d"))
    first = F.floor(F.greatest("_as", "_bs") / width) == F.col("_c")
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("_c") == F.col("_d")) & (F.col("a") < F.col("b")) & (F.col("_as") < F.col("_be")) & (F.col("_bs") < F.col("_ae")) & first).select(key, "a", "b")


def label_by_basename(files: DataFrame, path: str, labels: DataFrame, label_path: str) -> DataFrame:
    """`files` with the labels whose path has the same last part."""
    own = files.withColumn("_base", F.substring_index(F.col(path), "/", -1))
    named = labels.withColumn("_name", F.substring_index(F.col(label_path), "/", -1))
    return own.join(named, F.col("_base") == F.col("_name"), "left").drop("_base", "_name")


def nearest_ancestor(wanted: DataFrame, path: str, name: str, installed: DataFrame, at: str, has: str, version: str) -> DataFrame:
    """For each (path, name) the version at the deepest folder on the way up to the root: path, name, version."""
    parts = F.split(F.col(path), "/")
    ups = wanted.select(path, name, F.explode(F.sequence(F.size(parts), F.lit(0))).alias("_d"), parts.alias("_p")).withColumn("_at", F.array_join(F.expr("slice(_p, 1, _d)"), "/"))
    found = ups.join(installed.select(F.col(at).alias("_i"), F.col(has).alias("_h"), F.col(version).alias("_v")), (F.col("_at") == F.col("_i")) & (F.col(name) == F.col("_h")))
    return found.groupBy(path, name).agg(F.max(F.struct("_d", "_v"))["_v"].alias(version))
