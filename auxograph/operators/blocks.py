"""Windows over series of any length, by blocks of rows.

A window over a series sends the series to one task. Here the rows of each series are numbered over
ranges (``ranking.ranked``) and cut into blocks of so many rows. A window whose frame is bounded sees
all it needs if a block also gets some rows of its neighbours, its halo: the same operators run with
the block as a further key, and rows of the halo are dropped afterwards. What runs on from a series'
beginning (counts, last values) is taken per block first, chained over the blocks, one row each, and
added to the block's own. So a series that holds most of all rows is worked on by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auxograph.operators.ranking import ranked

BLOCK, PLACE, OWN = "_block", "_place", "_own"


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows of ``df`` in blocks of ``rows`` rows of their series, with ``before`` and ``after`` rows of the neighbouring blocks.

    Adds ``_place`` (the row's number in its series, from 0), ``_block`` and ``_own`` (false in the halo).
    """
    if rows < max(1, before, after):
        raise ValueError(f"blocks of {rows} rows are smaller than their halo")
    numbered = ranked(df, order, PLACE, keys).withColumn(PLACE, F.col(PLACE) - 1)
    block, at = F.floor(F.col(PLACE) / rows), F.col(PLACE) % rows
    copies = [F.struct(block.alias(BLOCK), F.lit(True).alias(OWN))]
    if before:
        copies.append(F.when(at >= rows - before, F.struct((block + 1).alias(BLOCK), F.lit(False).alias(OWN))))
    if after:
        copies.append(F.when((at < after) & (block > 0), F.struct((block - 1).alias(BLOCK), F.lit(False).alias(OWN))))
    return numbered.select("*", F.inline(F.array_compact(F.array(*copies))))


def own_rows(df: DataFrame) -> DataFrame:
    """Without the halo and the columns of the blocks."""
    return df.where(OWN).drop(BLOCK, PLACE, OWN)


def _chained(df: DataFrame, keys: Sequence[str], of_block: Column, chain, out: str) -> DataFrame:
    """``df`` with what ``chain`` makes, over the blocks before a row's block, of the blocks' aggregates."""
    blocks = df.groupBy(*keys, BLOCK).agg(of_block.alias(out))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(blocks.select(*keys, BLOCK, chain(F.col(out)).over(earlier).alias(out)), [*keys, BLOCK])


def running_count(df: DataFrame, keys: Sequence[str], condition: Column, out: str) -> DataFrame:
    """Add how many rows of the series, to this one, meet a condition; ``df`` is in blocks without halos, its keys not null."""
    counted = _chained(df, keys, F.count_if(condition), F.sum, out)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.count_if(condition).over(inside))


def carried_forward(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str | Column], out: str, block_rows: int) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the series up to each row, in blocks of rows; keys are not null."""
    rows = in_blocks(df, keys, order, block_rows)
    # the last value of a block is boxed, or a null of a later block would hide it
    place = F.when(F.col(value).isNotNull(), F.col(PLACE))
    last = F.max_by(F.struct(F.col(value).alias("v")), place)
    chained = _chained(rows, keys, last, lambda c: F.last(c, ignorenulls=True), "_carried")
    inside = Window.partitionBy(*keys, BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return own_rows(chained.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried.v"))).drop("_carried"))
