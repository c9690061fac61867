"""Row numbers in one order over a table of any size.

The rows are range-partitioned by the order, sorted within their ranges and written with their places, so
that no later step can see other ranges. A range's rows begin where the counts of the ranges before it
end: the counts, one number a range, are summed up on the driver and sent back. One exchange of the
rows, no window over all of them, and no task that sees more than its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxograph.functions.stored import stored
from auxograph.functions.values import col

#: Of the ids that Spark gives to the rows of a task, the bits that number them; those above number the task.
_ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[str | Column], rank: str = "rank", by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add ``rank``, the row's number from 1 in ``order``, or in its group of ``by`` (null is a group).

    Of rows that agree in the order a hash of all columns comes first, so reruns agree but for equal rows.
    A group of any size is spread over ranges like the whole table. ``ranges``: number of them (default:
    the session's shuffle partitions). An empty table stays empty.
    """
    spark = df.sparkSession
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = [*[F.col(c) for c in by], *[col(c) for c in order], F.xxhash64(*hashed)]
    tasks = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    # the input's columns are kept in one struct, so that their names don't matter
    written = stored(placed.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "ranked")
    counts = written.groupBy(F.shiftright("id", _ROW_BITS).alias("range")).count().collect()
    start, starts = 0, []
    for r in sorted(counts, key=lambda r: r["range"]):
        starts.append((r["range"], start))
        start += r["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "range long, start long"))
    place = F.col("id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("start") + 1
    numbered = written.join(offsets, F.shiftright("id", _ROW_BITS) == F.col("range")).select("row", place.alias("place"))
    if by:
        group = F.struct(*[F.col(f"row.`{c}`").alias(f"g{i}") for i, c in enumerate(by)])
        grouped = numbered.withColumn("group", group)
        first = grouped.groupBy("group").agg(F.min("place").alias("first")).withColumnRenamed("group", "first_group")
        numbered = grouped.join(first, F.col("group").eqNullSafe(F.col("first_group"))).select("row", (F.col("place") - F.col("first") + 1).alias("place"))
    names = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c != rank]
    return numbered.select(*names, F.col("place").cast(T.LongType()).alias(rank))
