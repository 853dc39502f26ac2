"""References to records that do not exist.

A Bloom filter over the parent keys is built block by block from their distinct hashes and broadcast. Its size is fixed
beforehand: `bits_per_key` for each distinct key, and never over `max_bits`, whatever the parent holds. A key
that the filter denies is missing for certain. Only the keys it lets through are joined exactly with what
the parent says of them (first arrival, whether the last row deletes it); false positives come out there as
missing too. References are reduced to one row a key before any exchange, so a key that holds a third of all
rows costs no more than another, and the rows themselves are read again only for keys that are in doubt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.keys import norm_key
from weftline.session import ship

#: Bits of one block of a filter, 4 KiB. A key has all its bits in one block, so each block is made by one task and read alone.
BLOCK_BITS = 1 << 15
HASHES = 4


def _positions(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The positions of each hash inside its block, one array for each of the filter's hash functions (double hashing)."""
    low = hashes.view(np.uint64)
    first = low & np.uint64(BLOCK_BITS - 1)
    step = (low >> np.uint64(15)) & np.uint64(BLOCK_BITS - 1) | np.uint64(1)
    for i in range(HASHES):
        yield (first + np.uint64(i) * step) & np.uint64(BLOCK_BITS - 1)


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)


class KeyFilter:
    """A blocked Bloom filter over 64-bit key hashes, held as broadcast bytes."""

    def __init__(self, keys: DataFrame, *, bits_per_key: int = 10, max_bits: int = 1 << 27):
        """`keys`: one column of keys; nulls are left out. Its size follows the number of distinct keys, up to `max_bits`; beyond, more keys go on to the exact join.

        Distinct hashes, eight bytes each, are exchanged by block; every block is then made once, by one task.
        """
        spark = keys.sparkSession
        ship(spark)
        column = keys.columns[0]
        hashes = keys.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
        distinct = hashes.agg(F.approx_count_distinct("h")).first()[0]
        self.blocks = blocks = max(1, min(max_bits // BLOCK_BITS, -(-distinct * bits_per_key // BLOCK_BITS)))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                of = _block(own, blocks)
                order = np.argsort(of, kind="stable")
                own, of = own[order], of[order]
                for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(of)) + 1):
                    if len(part):
                        bits = held.setdefault(int(of[part[0]]), np.zeros(BLOCK_BITS, dtype=np.bool_))
                        for positions in _positions(own[part]):
                            bits[positions] = True
            for block, bits in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "part"])

        place = F.pmod(F.shiftrightunsigned("h", 40), F.lit(blocks))
        whole = bytearray(blocks * BLOCK_BITS // 8)
        for row in hashes.groupBy("h").agg(F.lit(1)).select("h").repartition(min(blocks, 512), place).mapInArrow(mark, "block long, part binary").toLocalIterator():
            whole[row["block"] * BLOCK_BITS // 8 : (row["block"] + 1) * BLOCK_BITS // 8] = row["part"]
        self._shared = spark.sparkContext.broadcast(bytes(whole))

    def may_contain(self, column: Column) -> Column:
        """False only where `column` is certainly no key of the filter."""
        shared, blocks = self._shared, self.blocks

        @F.pandas_udf(T.BooleanType())
        def probe(hashes):
            import pandas as pd

            own = np.frombuffer(shared.value, dtype=np.uint8)
            values = hashes.to_numpy(dtype=np.int64)
            begin = _block(values, blocks) * (BLOCK_BITS // 8)
            found = np.ones(len(values), dtype=bool)
            for positions in _positions(values):
                found &= (own[begin + (positions >> np.uint64(3)).astype(np.int64)] >> (positions & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            return pd.Series(found)

        # not deterministic to the planner, which would otherwise ask for every row below the reduction to keys
        return probe.asNondeterministic()(F.xxhash64(column))


def parent_keys(parent: DataFrame, key: str) -> DataFrame:
    """The comparable keys of `parent`, as KeyFilter takes them."""
    return parent.select(norm_key(F.col(key)).alias("k"))


def find_orphans(
    child: DataFrame,
    child_key: str,
    parent: DataFrame,
    parent_key: str,
    *,
    row_id: str = "row_id",
    arrived: str = "ingested_at",
    deleted: str | None = None,
    known: KeyFilter | None = None,
) -> DataFrame:
    """Rows of `child` whose reference has no valid target: row_id, ref_key, ingested_at, orphan_kind.

    Keys are compared as norm_key gives them; a row whose key refers to nothing is no case. `missing`: no
    parent row has the key. `deleted`: the parent row of the key that arrived last (of equal arrival the one
    with the greater row_id) has a value in `deleted`; with `deleted` None nothing is ever deleted. `late`:
    neither, but the first parent row arrived after the referring row. An unknown arrival of either side is
    not late. Repeated rows each come out. An empty child gives no rows, an empty parent makes every
    reference missing. Further columns of either table, whatever their names, are not touched.
    """
    known = known or KeyFilter(parent_keys(parent, parent_key))
    refs = child.select(F.col(row_id).alias("row_id"), norm_key(F.col(child_key)).alias("ref_key"), F.col(arrived).alias("ingested_at")).where(F.col("ref_key").isNotNull())
    first_use = refs.groupBy("ref_key").agg(F.min("ingested_at").alias("used_at")).withColumn("maybe", known.may_contain(F.col("ref_key")))

    seen = parent.select(
        norm_key(F.col(parent_key)).alias("p_key"),
        F.col(arrived).alias("p_at"),
        *([F.struct(F.col(arrived), F.col(row_id), F.col(deleted).isNotNull().alias("gone")).alias("p_last")] if deleted else []),
    ).where(F.col("p_key").isNotNull())
    facts = seen.groupBy("p_key").agg(F.min("p_at").alias("first_at"), (F.max("p_last")["gone"] if deleted else F.lit(False)).alias("gone"))

    absent = first_use.where(~F.col("maybe")).select("ref_key", F.lit("missing").alias("state"), F.lit(None).cast(dict(child.dtypes)[arrived]).alias("first_at"))
    doubtful = (
        first_use.where("maybe")
        .join(facts, F.col("ref_key") == F.col("p_key"), "left")
        .select("ref_key", F.when(F.col("p_key").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_at") > F.col("used_at"), "late").alias("state"), "first_at")
        .where(F.col("state").isNotNull())
    )
    bad = absent.unionByName(doubtful).withColumnRenamed("ref_key", "bad_key")
    return (
        refs.join(bad, F.col("ref_key") == F.col("bad_key"))
        .where((F.col("state") != "late") | (F.col("first_at") > F.col("ingested_at")))
        .select("row_id", "ref_key", "ingested_at", F.col("state").alias("orphan_kind"))
    )


def orphan_counts(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Orphans per table and month: ref_table, month, orphan_kind, orphans, of_references.

    `refs` has ref_table and ingested_at of every reference, `orphans` also orphan_kind. Months are those of
    ingested_at, `unknown` where that is null. A month without orphans has no row.
    """
    month = F.coalesce(F.date_format("ingested_at", "yyyy-MM"), F.lit("unknown")).alias("month")
    total = refs.groupBy("ref_table", month).agg(F.count(F.lit(1)).alias("of_references"))
    return orphans.groupBy("ref_table", month, "orphan_kind").agg(F.count(F.lit(1)).alias("orphans")).join(total, ["ref_table", "month"])
