"""What the text operators of this subpackage share: spreading rows over cores, and Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.session import ship


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as the cluster has cores.

    Scans of few small files come as few tasks, which would leave cores idle in front of a costly function.
    Only those are redistributed (round robin, so no key can be hot); larger inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_columns(df: DataFrame, function: Callable[[dict[str, list]], dict[str, pa.Array | list]], schema: str) -> DataFrame:
    """`function` from columns (name -> Python values) to columns, batch by batch.

    `function` may return more or fewer rows than it got; its columns have the order of `schema`.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function({name: column.to_pylist() for name, column in zip(batch.schema.names, batch.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return df.mapInArrow(run, schema)
