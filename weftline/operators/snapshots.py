"""What changed between consecutive full snapshots of a table.

Each snapshot is cut into chunks of its key-sorted records at places that the keys themselves decide, so an
insertion shifts no boundary but its own. Chunks whose digest the neighbouring snapshot has too are dropped
whole; only the records of the others are compared one by one.

All snapshots of a series that share a slice of the key space lie in one partition, hence one exchange of
the records serves the duplicate removal, the sorting, the matching of chunks and the comparison. The number
of slices follows the size of the series, so a series with a third of all rows is spread over many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Expected records of a chunk, and of a slice of a series.
CHUNK_ROWS = 32
SLICE_ROWS = 50_000
#: Snapshot lists up to so many bytes are broadcast; larger ones are joined by an exchange.
BROADCAST_BYTES = 32 << 20


def number_in_series(snapshots: DataFrame, series: str, order: list[str], period: Column) -> DataFrame:
    """`snapshots` with `seq` (1, 2, ... in its series by `order`) and `last_seq`.

    Numbered in two steps: inside each period of a series, then over the periods, so no task sorts a whole series.
    """
    cut = snapshots.withColumn("_period", period)
    offsets = cut.groupBy(series, "_period").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(series).orderBy("_period")
    offsets = offsets.select(
        F.col(series).alias("_series"),
        F.col("_period").alias("_of"),
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(series)).alias("last_seq"),
    )
    inside = F.row_number().over(Window.partitionBy(series, "_period").orderBy(*order))
    return (
        cut.withColumn("_inside", inside)
        .join(offsets, (F.col(series) == F.col("_series")) & F.col("_period").eqNullSafe(F.col("_of")))
        .withColumn("seq", F.col("_before") + F.col("_inside"))
        .drop("_period", "_inside", "_series", "_of", "_before")
    )


def snapshot_changes(records: DataFrame, snapshots: DataFrame, *, chunk_rows: int = CHUNK_ROWS, slice_rows: int = SLICE_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Changes of each snapshot against the one before it: snapshot, key, change_kind.

    `records`: snapshot, key, value, version (any ordered type). A key occurs once in a snapshot, with the
    value of its greatest version. `snapshots`: snapshot, series (16 bytes or any type), seq, last_seq; records of
    others are ignored, and a snapshot may have none. `added`, `removed`, `changed` (the value differs).
    Null snapshots, keys or values must not occur in `records`. Empty tables give no rows; the first snapshot
    of a series has no changes.
    """
    sizes = records.groupBy("snapshot").agg(F.count(F.lit(1)).alias("_rows"))
    listed = snapshots.select(F.col("snapshot").alias("_snap"), F.col("series").alias("_series"), "seq", "last_seq")
    with_rows = listed.join(sizes, F.col("_snap") == F.col("snapshot"), "left").drop("snapshot")
    per_series = with_rows.groupBy("_series").agg(F.sum("_rows").alias("_total")).select(F.col("_series").alias("_key"), F.greatest(F.lit(1), F.ceil(F.coalesce("_total", F.lit(0)) / slice_rows)).cast("int").alias("_slices"))
    listed = listed.join(per_series, F.col("_series") == F.col("_key")).drop("_key")

    # what a row of the list takes: its own texts, and numbers and overhead
    size = snapshots.agg(F.sum(F.octet_length(F.col("snapshot").cast("string")) + F.octet_length(F.col("series").cast("string")) + 96)).first()[0] or 0
    bounded = size <= broadcast_bytes
    side = listed.withColumnRenamed("_series", "series")
    rows = (
        records.join(F.broadcast(side) if bounded else side, F.col("snapshot") == F.col("_snap"))
        .select("series", "seq", "last_seq", "key", "value", "version", F.pmod(F.xxhash64("key"), F.col("_slices")).cast("int").alias("slice"))
        .repartition("series", "slice")
    )
    newest = Window.partitionBy("series", "slice", "seq", "key").orderBy(F.col("version").desc())
    in_order = Window.partitionBy("series", "slice", "seq").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.pmod(F.xxhash64("key", F.lit("chunk")), F.lit(chunk_rows)) == 0, 1).otherwise(0)
    chunks = (
        rows.withColumn("_rank", F.row_number().over(newest))
        .where("_rank = 1")
        .withColumn("chunk", F.sum(starts).over(in_order))
        .groupBy("series", "slice", "seq", "last_seq", "chunk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("key", "value")).alias("d1"),
            F.bit_xor(F.xxhash64(F.lit("second"), "value", "key")).alias("d2"),
            F.collect_list(F.struct("key", "value")).alias("rows"),
        )
    )
    same = Window.partitionBy("series", "slice", "n", "d1", "d2").orderBy("seq")
    alone = chunks.select(
        "series",
        "slice",
        "rows",
        # a chunk speaks for the pair that ends with its snapshot, and for the pair that begins with it
        F.when((F.col("seq") > 1) & ~F.coalesce(F.lag("seq").over(same) == F.col("seq") - 1, F.lit(False)), F.col("seq")).alias("as_new"),
        F.when((F.col("seq") < F.col("last_seq")) & ~F.coalesce(F.lead("seq").over(same) == F.col("seq") + 1, F.lit(False)), F.col("seq") + 1).alias("as_old"),
    ).where(F.col("as_new").isNotNull() | F.col("as_old").isNotNull())
    sides = alone.select("series", "slice", F.explode("rows").alias("r"), "as_new", "as_old").select(
        "series",
        "slice",
        F.col("r.key").alias("key"),
        F.explode(
            F.filter(
                F.array(F.struct(F.col("as_new").alias("pair"), F.col("r.value").alias("new"), F.lit(None).cast("string").alias("old")), F.struct(F.col("as_old").alias("pair"), F.lit(None).cast("string").alias("new"), F.col("r.value").alias("old"))),
                lambda side: side["pair"].isNotNull(),
            )
        ).alias("s"),
    )
    compared = sides.groupBy("series", "slice", F.col("s.pair").alias("seq"), "key").agg(F.max("s.new").alias("new"), F.max("s.old").alias("old"))
    kinds = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    changes = compared.select(F.col("series").alias("_s"), F.col("seq").alias("_q"), "key", kinds.alias("change_kind")).where(F.col("change_kind").isNotNull())
    names = snapshots.select("snapshot", "series", "seq")
    return changes.join(F.broadcast(names) if bounded else names, (F.col("_s") == F.col("series")) & (F.col("_q") == F.col("seq"))).select("snapshot", "key", "change_kind")
