"""Live readings: a folder of plate files as a stream, windowed statistics, and sinks per batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS = "well string, ts timestamp, od double"


def read_stream(spark: SparkSession, folder: str, schema: str = READINGS, fmt: str = "csv", files_per_trigger: int = 100) -> DataFrame:
    """Files that arrive in ``folder``, each once."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("header", True).format(fmt).load(folder)


def windowed(df: DataFrame, time: str, keys: Sequence[str], value: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count, mean and maximum by key and window; the same on tables and streams.

    ``late``: how long a stream waits for late rows before a window is final.
    """
    rows = df.withWatermark(time, late) if late else df
    window = F.window(time, length, slide) if slide else F.window(time, length)
    stats = rows.groupBy(*keys, window.alias("_w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top"))
    return stats.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "mean", "top")


def sessions(df: DataFrame, time: str, keys: Sequence[str], gap: str, late: str | None = None) -> DataFrame:
    """Runs of rows of a key with no gap longer than ``gap``."""
    rows = df.withWatermark(time, late) if late else df
    stats = rows.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("n"))
    return stats.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def each_batch(df: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None):
    """Start a query that hands every batch to ``do``: with no trigger, all that is there, once."""
    writer = df.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def keep_updates(df: DataFrame, folder: str, checkpoint: str, trigger: str | None = None):
    """Start a query that keeps the rows of each batch in a folder of its own; a batch that runs again replaces its rows."""
    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}"))
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def newest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Of what ``keep_updates`` kept, the row of the last batch of each key; a batch has one row of a key at most."""
    kept = spark.read.parquet(folder)
    columns = [c for c in kept.columns if c not in {*keys, "batch"}]
    last = kept.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
