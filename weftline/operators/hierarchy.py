"""Parent-child links to full hierarchies.

Subtree sizes are summed upward, siblings then get their preorder ranges by prefix sums downward, and the
nested-set ranges [lo, hi] answer every question about ancestors and descendants: a node's depth is the number
of ranges that are open where it stands, its root the one that opened last at depth 0, its path the open ranges
in order. Both passes double their reach each round, so a tree of depth d takes log2(d) rounds rather than d, and
a round moves only nodes that are not finished yet, as pairs of numbers. Nodes that the upward pass never
finishes are in a ring or below one.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, ship

#: Siblings are numbered in groups and the groups then by prefix sums: no task orders all children of a node.
SIBLING_GROUPS = 64
SIBLINGS_A_GROUP = 100_000
#: Preorder positions of one block of the last scan: between these bounds, by the number of nodes.
BLOCK_LEAST, BLOCK_MOST = 4096, 1 << 18
#: Parent of the roots.
NOBODY = -1


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sizes(tree: DataFrame) -> tuple[DataFrame, int]:
    """id, above, h, size of every node that a root is above of, and the number of the others.

    After round k a waiting node knows its ancestor 2^k links up and the size of the 2^k levels below itself, which it
    hands to that ancestor. A node without such an ancestor is finished and no longer takes part.
    """
    active = tree.where(F.col("above") != NOBODY).select("id", F.col("above").alias("up"), F.lit(1).cast("long").alias("size"))
    handed = []
    waiting = active.count()
    while waiting:
        handed.append(active)
        given = active.groupBy(F.col("up").alias("taker")).agg(F.sum("size").alias("given"))
        carried = active.join(given, F.col("id") == F.col("taker"), "left").select("id", "up", (F.col("size") + F.coalesce("given", F.lit(0))).alias("size"))
        above = active.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"))
        active = cut(carried.join(above, F.col("up") == F.col("a_id")).select("id", F.col("a_up").alias("up"), "size"))
        before, waiting = waiting, active.count()
        if waiting == before:  # no node met a root in this round, so none ever will
            break
    if waiting:
        tree = tree.join(active.select(F.col("id").alias("r_id")), F.col("id") == F.col("r_id"), "left_anti")
    if not handed:
        return tree.withColumn("size", F.lit(1).cast("long")), waiting
    total = _union(handed).groupBy(F.col("up").alias("taker")).agg(F.sum("size").alias("given"))
    return cut(tree.join(total, F.col("id") == F.col("taker"), "left").select("id", "above", "h", (F.lit(1) + F.coalesce("given", F.lit(0))).alias("size"))), waiting


def _places(sized: DataFrame, nodes: int) -> DataFrame:
    """id, lo: the preorder position of every node over the whole forest, from 1.

    Siblings stand in the order of a hash of their node, the roots as siblings of each other. A node's position is its
    distance from its parent's plus that position: distances are added up by doubling, finished nodes only looked up.
    """
    groups = max(SIBLING_GROUPS, -(-nodes // SIBLINGS_A_GROUP))
    placed = sized.withColumn("_g", F.pmod("h", F.lit(groups)).cast("int"))
    per_group = placed.groupBy(F.col("above").alias("_p"), F.col("_g").alias("_q")).agg(F.sum("size").alias("_sum"))
    per_group = per_group.withColumn("_ahead", F.sum("_sum").over(Window.partitionBy("_p").orderBy("_q")) - F.col("_sum"))
    inside = Window.partitionBy("above", "_g").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        placed.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
        .join(per_group, (F.col("above") == F.col("_p")) & (F.col("_g") == F.col("_q")))
        .select("id", F.nullif("above", F.lit(NOBODY)).alias("up"), (F.lit(1) + F.col("_ahead") + F.col("_inside")).alias("lo"))
    )
    moved = cut(steps)
    done: list[DataFrame] = []
    while True:
        done.append(moved.where(F.col("up").isNull()).select("id", "lo"))
        active = moved.where(F.col("up").isNotNull())
        if active.isEmpty():
            return _union(done)
        known = active.select(F.col("id").alias("k_id"), F.col("up").alias("k_up"), F.col("lo").alias("k_lo"))
        for part in done:
            known = known.unionByName(part.select(F.col("id").alias("k_id"), F.lit(None).cast("long").alias("k_up"), F.col("lo").alias("k_lo")))
        moved = cut(active.join(known, F.col("up") == F.col("k_id")).select("id", F.col("k_up").alias("up"), (F.col("lo") + F.col("k_lo")).alias("lo")))


def _block_width(df: DataFrame, nodes: int) -> int:
    return max(BLOCK_LEAST, min(BLOCK_MOST, -(-nodes // (2 * df.sparkSession.sparkContext.defaultParallelism))))


def _read_ranges(ranges: DataFrame, nodes: int) -> DataFrame:
    """node, root, depth, size, lo, hi out of nested-set ranges (node, lo, size, top: whether it is a root).

    One scan over the positions in blocks: a range adds one to the depth behind its beginning and takes it back behind its
    end. What is open at the beginning of a block comes from the sums of the blocks before, of which there are few.
    """
    width = _block_width(ranges, nodes)
    block = lambda c: F.floor((c - 1) / width).cast("long")
    own = ranges.select(block(F.col("lo")).alias("block"), F.col("lo").alias("pos"), F.lit(1).alias("rank"), F.when(F.col("size") > 1, 1).otherwise(0).cast("long").alias("delta"), F.when(F.col("top"), F.struct("node", "lo")).alias("root"), "node", "size")
    end = F.col("lo") + F.col("size")
    ends = ranges.where("size > 1").select(block(end).alias("block"), end.alias("pos"), F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("delta"))
    events = own.unionByName(ends, allowMissingColumns=True)
    # the last root of a block by position; of the blocks there are nodes / width
    sums = events.groupBy("block").agg(F.sum("delta").alias("net"), F.max(F.when(F.col("root").isNotNull(), F.struct("pos", "root"))).alias("last"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("block", (F.col("block") * width + 1).alias("pos"), F.lit(-1).alias("rank"), F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("delta"), F.last("last.root", ignorenulls=True).over(earlier).alias("root"))
    order = Window.partitionBy("block").orderBy("pos", "rank")
    scanned = events.unionByName(carried, allowMissingColumns=True).select(
        "node",
        "rank",
        "size",
        "pos",
        F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("depth"),
        F.last("root", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("root"),
    )
    lo = F.col("pos") - F.col("root.lo") + 1
    return scanned.where("rank = 1").select("node", F.col("root.node").alias("root"), "depth", "size", lo.alias("lo"), (lo + F.col("size") - 1).alias("hi"))


def _read_paths(ranges: DataFrame, nodes: int, separator: str) -> DataFrame:
    """The same with the path of every node: a scan with a stack of the open ranges.

    A block begins with the ranges that reach into it from before, so blocks are scanned apart from each other.
    """
    ship(ranges.sparkSession)
    width = min(_block_width(ranges, nodes), 1 << 16)
    first, last = F.floor((F.col("lo") - 1) / width).cast("long"), F.floor((F.col("lo") + F.col("size") - 2) / width).cast("long")
    rows = ranges.select(F.explode(F.sequence(first, last)).alias("block"), F.col("node").cast("string").alias("node"), "lo", "size")

    def scan(table: pa.Table) -> pa.Table:
        begin = table["block"][0].as_py() * width + 1
        opened: list[tuple[str, int, int]] = []
        out = []
        for lo, node, size in sorted(zip(table["lo"].to_pylist(), table["node"].to_pylist(), table["size"].to_pylist(), strict=True)):
            while opened and opened[-1][2] <= lo:
                opened.pop()
            opened.append((node, lo, lo + size))
            if lo >= begin:
                top = opened[0]
                out.append((node, top[0], len(opened) - 1, size, lo - top[1] + 1, lo - top[1] + size, separator.join(o[0] for o in opened)))
        kinds = [("node", pa.string()), ("root", pa.string()), ("depth", pa.int64()), ("size", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("path", pa.string())]
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds)})

    return rows.groupBy("block").applyInArrow(scan, "node string, root string, depth long, size long, lo long, hi long, path string")


def build_hierarchy(links: DataFrame, *, paths: bool = False, separator: str = "/") -> DataFrame:
    """Every node of `links` (node, parent and perhaps key) with root, depth, size, lo, hi (and path).

    `node` is unique and not null. `parent` names the key of another node, or its node where there is no column key; of
    several nodes with one key the least counts. A node whose parent is null or unknown is a root at depth 0. size counts
    the node and its descendants; in each tree the nodes are numbered from 1 in preorder, and node b lies below node a
    exactly if both have the same root and a.lo < b.lo <= a.hi. Siblings are ordered by a hash of the node. Nodes in a ring
    or below one have root '', depth -1 and null for the rest. An empty table gives no rows. With `paths` nodes come out
    as text.
    """
    key = F.col("key") if "key" in links.columns else F.col("node")
    # numbers stand for the nodes in all rounds; the checkpoint keeps them the same for every reader
    named = cut(links.select(F.monotonically_increasing_id().alias("id"), "node", key.alias("key"), "parent"))
    owners = named.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("o_key")).agg(F.min(F.struct("node", "id"))["id"].alias("o_id"))
    tree = cut(named.join(owners, F.col("parent") == F.col("o_key"), "left").select("id", F.coalesce("o_id", F.lit(NOBODY)).alias("above"), F.xxhash64("node").alias("h")))
    nodes = tree.count()
    sized, ringed = _sizes(tree)
    places = _places(sized, nodes).select(F.col("id").alias("p_id"), "lo")
    ranges = sized.join(places, F.col("id") == F.col("p_id")).select(F.col("id").alias("s_id"), "lo", "size", (F.col("above") == NOBODY).alias("top"))
    full = named.select("id", "node").join(ranges, F.col("id") == F.col("s_id"), "left" if ringed else "inner")
    if ringed:
        full = cut(full.select("node", "lo", "size", "top"))
    sound = full.where(F.col("lo").isNotNull())
    out = _read_paths(sound, nodes, separator) if paths else _read_ranges(sound, nodes)
    if not ringed:
        return out
    none = F.lit(None).cast("long")
    rest = full.where(F.col("lo").isNull()).select(F.col("node").cast("string") if paths else F.col("node"), F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), none.alias("size"), none.alias("lo"), none.alias("hi"))
    return out.unionByName(rest.withColumn("path", F.lit(None).cast("string")) if paths else rest)


def descendants(hierarchy: DataFrame, of: DataFrame, *, width: int = 1024) -> DataFrame:
    """All proper descendants of the nodes in `of` (one column, node): ancestor, node.

    A range join inside each tree: the ranges asked for are unfolded to the blocks of `width` positions that they touch, so a tree with a
    third of all rows is spread over its blocks.
    """
    wanted = of.select(F.col(of.columns[0]).alias("_wanted")).distinct()
    top = hierarchy.where("size > 1").join(wanted, F.col("node") == F.col("_wanted"), "left_semi")
    top = top.select(F.col("node").alias("ancestor"), F.col("root").alias("_root"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    top = top.withColumn("_in", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    points = hierarchy.where("depth > 0").withColumn("_at", F.floor(F.col("lo") / width))
    return points.join(top, (F.col("root") == F.col("_root")) & (F.col("_at") == F.col("_in")) & (F.col("lo") > F.col("_lo")) & (F.col("lo") <= F.col("_hi"))).select("ancestor", "node")
