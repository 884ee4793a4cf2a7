"""Range-sorted partitions: the common ground of the order-aware operators.

``ranged`` lays rows out in partitions that are contiguous in the given keys, so that one
hot entity spreads over as many partitions as its size asks for. The operators then stream
through each partition and exchange only a few edge rows per partition through the driver,
whose number depends on the number of partitions and never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import ship


#: Bytes of a range, by the optimizer's estimate; more data makes more ranges, never larger ones.
RANGE_BYTES = 128 << 20


def ranges_for(df: DataFrame) -> int | None:
    """How many ranges the estimated size asks for; None where the session's own number is enough."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = -(-size // RANGE_BYTES)
    return int(n) if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < n < 1 << 20 else None


def ranged(df: DataFrame, keys: list[str], sort: list[str | Column] | None = None) -> DataFrame:
    """Range-partition by ``keys``; optionally sort inside partitions. The caller pins what it reads twice."""
    ship(df.sparkSession)
    n = ranges_for(df)
    out = df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    return out.sortWithinPartitions(*sort) if sort else out


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with the number of its partition in ``_part``, for a layout that is about to be pinned.

    The number of a task would not do: in a union it counts the partitions of all sides.
    """
    return df.withColumn("_part", F.spark_partition_id())


def part_of(b: pa.RecordBatch) -> int:
    return b.column("_part")[0].as_py()


def batches_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            yield b
