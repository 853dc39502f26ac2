"""Filling containers of fixed capacity with items of varying length.

First-fit decreasing inside random groups of items. A tournament tree over the containers of a group holds in
each node the greatest free space below it, so the first container with room is found in log2 steps. Items
above the capacity are the only ones that are split: into full containers and a rest, which is then an
ordinary item. Groups are drawn by a hash of the item, so no source or length gathers in one; each is packed
by itself, and only its last few containers stay partly empty.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, ship

#: Expected items of a group.
GROUP_ITEMS = 4096


class TournamentTree:
    """Free space of up to `bins` containers of one capacity."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts an item into the first container with room and returns its number, or -1 where none has."""
        free, node = self.free, 1
        if free[1] < size:
            return -1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        leaf = node - self.leaves
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
        return leaf


def first_fit_decreasing(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, part, start, length, bin) of every part of `items`, which are (item, size).

    Only items above `capacity` have more than one part. Equal sizes are placed in the order of the item. An
    item of size 0 goes into the first container, which it opens if there is none.
    """
    out, rest, full = [], [], 0
    for item, size in items:
        parts = (size - 1) // capacity if size > capacity else 0
        for k in range(parts):
            out.append((item, k, k * capacity, capacity, full))
            full += 1
        rest.append((-(size - parts * capacity), item, parts))
    rest.sort()
    tree = TournamentTree(len(rest), capacity)
    for negative, item, part in rest:
        out.append((item, part, part * capacity, -negative, full + tree.place(-negative)))
    return out


def pack(items: DataFrame, containers: DataFrame, *, item: str = "doc_id", size: str = "tokens", group_items: int = GROUP_ITEMS, seed: int = 0) -> DataFrame:
    """Every part of every item in every kind of container: container, grp, bin, doc_id, part, start, tokens.

    `containers` (container, capacity) is a short list of settings; each row is packed for itself. A
    container is named by its kind, grp and bin. Null sizes count as 0, null items and negative sizes are not
    allowed; an item that occurs twice is packed twice. Containers without a positive capacity are refused.
    """
    spark = items.sparkSession
    ship(spark)
    kinds = [(r[0], r[1]) for r in containers.select("container", "capacity").distinct().limit(1001).collect()]
    if len(kinds) > 1000 or any(capacity is None or capacity <= 0 for _, capacity in kinds):
        raise ValueError("containers are a list of at most 1000 settings with positive capacities")
    kinds.sort(key=str)
    chosen = items.select(F.col(item).cast("long").alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("tokens"))
    chosen = cut(chosen)  # sizes are costly to come by, and both the number of groups and the groups need them
    groups = max(1, math.ceil(chosen.count() / group_items))
    grouped = chosen.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).cast("int"))

    def fill(table: pa.Table) -> pa.Table:
        own = list(zip(table["doc_id"].to_pylist(), table["tokens"].to_pylist(), strict=True))
        group = table["grp"][0].as_py()
        parts = []
        for name, capacity in kinds:
            rows = first_fit_decreasing(own, capacity)
            ids, part, start, length, at = zip(*rows, strict=True)
            parts.append(
                pa.table(
                    {
                        "container": pa.array([name] * len(rows), pa.string()),
                        "grp": pa.array([group] * len(rows), pa.int32()),
                        "bin": pa.array(at, pa.int32()),
                        "doc_id": pa.array(ids, pa.int64()),
                        "part": pa.array(part, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "tokens": pa.array(length, pa.int64()),
                    }
                )
            )
        return pa.concat_tables(parts)

    schema = "container string, grp int, bin int, doc_id long, part int, start long, tokens long"
    if not kinds:
        return spark.createDataFrame([], schema)
    # packing costs far more than the few bytes of a group, so the groups are spread by number and not by size
    cores = spark.sparkContext.defaultParallelism
    return grouped.repartition(min(groups, max(3 * cores, groups // 16)), "grp").groupBy("grp").applyInArrow(fill, schema)


def fill_rates(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container, capacity, bins, tokens, fill: how full the containers of each kind are."""
    bins = packed.groupBy("container", "grp", "bin").agg(F.sum("tokens").alias("t"))
    per_kind = bins.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"))
    kinds = containers.select(F.col("container").alias("_c"), "capacity").distinct()
    return per_kind.join(kinds, F.col("container") == F.col("_c")).select("container", "capacity", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("fill"))
