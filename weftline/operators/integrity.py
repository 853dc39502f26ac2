"""Partition plans, digests and chains."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, ship


def shard_of(column: Column, shards: int) -> Column:
    """The shard of a text by the first 32 bits of its SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(column, 256), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def balance(plan: DataFrame, shard: str, cost: str, shards: int) -> DataFrame:
    """One row: total, largest, floor (no plan can stay under it) and imbalance (largest over mean) of a plan."""
    per = plan.groupBy(shard).agg(F.sum(cost).alias("_c"), F.max(cost).alias("_m"))
    return per.agg(F.sum("_c").alias("total"), F.max("_c").alias("largest"), F.greatest(F.max("_m"), F.ceil(F.sum("_c") / shards)).alias("floor"), (F.max("_c") / (F.sum("_c") / shards)).alias("imbalance"))


def longest_first(items: DataFrame, item: str, cost: str, shards: int, *, group_items: int = 100_000, hash_seed: int = 0) -> DataFrame:
    """item, shard: the costliest items first, each to the lightest shard; equal costs by item, equal loads by number.

    The rule is sequential, so it runs in random groups of `group_items` expected items at every size, each over all shards and
    beginning at a shard of its own, so that the groups' loads add up evenly.
    """
    ship(items.sparkSession)
    chosen = cut(items.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(cost), F.lit(0)).cast("double").alias("cost")).where("item is not null"))
    groups = max(1, -(-chosen.count() // group_items))

    def plan(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["cost"].to_pylist(), table["item"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        first = table["g"][0].as_py() % shards
        loads = [(0.0, k) for k in range(shards)]
        out = []
        for c, name in rows:
            load, k = heapq.heappop(loads)
            out.append((name, (k + first) % shards))
            heapq.heappush(loads, (load + c, k))
        return pa.table({"item": pa.array([n for n, _ in out], pa.string()), "shard": pa.array([k for _, k in out], pa.int32())})

    return chosen.withColumn("g", F.pmod(F.xxhash64("item", F.lit(hash_seed)), F.lit(groups)).cast("int")).repartition(groups, "g").groupBy("g").applyInArrow(plan, "item string, shard int")


def cover_problems(plan: DataFrame, item: str, wanted: DataFrame, wanted_item: str) -> DataFrame:
    """problem, item: items that a plan has twice, lacks, or has without being asked."""
    own = plan.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("k"))
    asked = wanted.select(F.col(wanted_item).alias("w")).distinct()
    both = own.join(asked, F.col("item") == F.col("w"), "full_outer")
    problem = F.when(F.col("item").isNull(), "missing").when(F.col("w").isNull(), "foreign").when(F.col("k") > 1, "duplicate")
    return both.select(problem.alias("problem"), F.coalesce("item", "w").alias("item")).where("problem is not null")


def merkle_root(leaves: DataFrame, position: str, digest: str) -> str | None:
    """The root over digests in order of position (0, 1, ...): pairs are hashed level by level, an odd last one goes up as it is."""
    level = cut(leaves.select(F.col(position).cast("long").alias("p"), F.col(digest).alias("d")))
    n = level.count()
    if not n:
        return None
    while n > 1:
        pairs = level.groupBy(F.floor(F.col("p") / 2).alias("p")).agg(F.max(F.when(F.col("p") % 2 == 0, F.col("d"))).alias("l"), F.max(F.when(F.col("p") % 2 == 1, F.col("d"))).alias("r"))
        level = cut(pairs.select("p", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("d")))
        n = -(-n // 2)
    return level.first()["d"]


def chain_breaks(chain: DataFrame, key: list[str], seq: str, previous: str, digest: str, payload: Column) -> DataFrame:
    """The first broken position of each chain: a digest that isn't that of its content, or a link that isn't the digest before."""
    w = Window.partitionBy(*key).orderBy(seq)
    before = F.coalesce(F.lag(digest).over(w), F.lit(""))
    bad = chain.withColumn("_bad", (F.col(previous) != before) | (F.col(digest) != F.sha2(F.concat_ws("|", F.col(previous), payload), 256)))
    return bad.where("_bad").groupBy(*key).agg(F.min(seq).alias("first_broken"))


def build_chain(rows: DataFrame, key: str, seq: str, payload: str) -> DataFrame:
    """`rows` with previous and digest: SHA-256 over the digest before (empty at first) and the payload, in the order of seq.

    A chain can't be cut, so each is one task; it is read in Arrow batches and never held whole.
    """
    import hashlib
    from collections.abc import Iterator

    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = None, ""
        for batch in batches:
            before, own = [], []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if known is None or k != known:
                    known, last = k, ""
                before.append(last)
                last = hashlib.sha256(f"{last}|{p or ''}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[key, seq, payload, "previous", "digest"])

    ordered = rows.select(key, seq, payload).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, seq)
    return ordered.mapInArrow(run, f"{key} {kinds[key]}, {seq} {kinds[seq]}, {payload} {kinds[payload]}, previous string, digest string")


def fold_results(results: DataFrame, shard: str, rows: str, asked: DataFrame, wanted: str) -> DataFrame:
    """state, shards, rows: results added up where exactly one answers for an asked shard; missing, duplicate and foreign ones apart."""
    own = results.groupBy(F.col(shard).alias("_s")).agg(F.count(F.lit(1)).alias("_k"), F.sum(rows).alias("_n"))
    both = own.join(asked.select(F.col(wanted).alias("_w")).distinct(), F.col("_s") == F.col("_w"), "full_outer")
    state = F.when(F.col("_w").isNull(), "foreign").when(F.col("_s").isNull(), "missing").when(F.col("_k") > 1, "duplicate").otherwise("accepted")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


def acceptance(snapshots: DataFrame, key: list[str], order: str, seq: str, digest: str) -> DataFrame:
    """`snapshots` with `verdict`: accepted, repeated (same content), equivocation (same number, other content), rollback (lower number)."""
    w = Window.partitionBy(*key).orderBy(order)
    top = F.max(seq).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = F.max(F.struct(F.col(seq), F.col(digest))).over(w.rowsBetween(Window.unboundedPreceding, -1))[digest]
    verdict = F.when(top.isNull() | (F.col(seq) > top), "accepted").when(F.col(seq) < top, "rollback").when(F.col(digest) == known, "repeated").otherwise("equivocation")
    return snapshots.withColumn("verdict", verdict)
