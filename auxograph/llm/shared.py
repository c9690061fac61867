"""What the operators share: the scratch folder, written intermediate tables, prefix sums."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The characters between words, as a Java regular expression class body.
BLANKS = r"\x20\x09-\x0D"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers started for this session import this package from where it lies here."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one is set only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="auxograph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in this block delete the files of their shuffles when they end: a written table needs none of them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_collecting: list[list[Scratch]] = []


@contextlib.contextmanager
def scratch_deleted() -> Iterator[None]:
    """Delete what is written to scratch folders that are made in this block, at its end.

    For a caller that has written the operator's result by then: the result reads those tables.
    """
    made: list[Scratch] = []
    _collecting.append(made)
    try:
        yield
    finally:
        _collecting.pop()
        for scratch in made:
            scratch.drop("")


class Scratch:
    """Intermediate tables written to the shared folder.

    A written table cuts the lineage: an executor that is lost later costs only the tasks that
    were running on it. Names are unique to the instance, so concurrent runs do not meet.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        if _collecting:
            _collecting[-1].append(self)
        importable(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: str | Column) -> Column:
    """Number of maximal runs without blanks; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def spread(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, group: list[str], part: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come before.

    Rows come by ``part``, then by ``order``. Sums of the parts are taken first, and each part's
    offset is joined to its rows on (group, part), the key under which the rows are also sorted and
    summed: one shuffle of the rows, and no task holds more than one part.
    """
    keys = [*group, part]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_part_sum"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_part_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, keys)
        .withColumn(out, (F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_offset")
    )


#: SQL of the table that CRC-32 looks bytes up in: a chain of common table expressions, the last of which is ``crc`` (t).
CRC32_TABLE = (
    "s0 as (select range as i, range::bigint as c from range(0, 256))"
    + "".join(f", s{k + 1} as (select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from s{k})" for k in range(8))
    + ", crc as (select list(c order by i) as t from s8)"
)


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of an expression's UTF-8 bytes, where ``crc`` is joined."""
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {values}), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295)"
