"""Sinks: CSV and JSON files under fixed names, one file per group, SVG plots per series."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auxograph.functions.values import finite, require, without_null_keys
from auxograph.sources.tables import read_folders


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_folder(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A folder of part files, written by all tasks: for results of any size."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """One small file, through the file system of its path."""
    files, p = _filesystem(spark, path)
    out = files.create(p)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def write_file(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """One file of exactly this name; for results that one task can write."""
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    write_folder(df.coalesce(1), folder, fmt)
    files, p = _filesystem(spark, path)
    parts = [s.getPath() for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)) if s.getPath().getName().startswith("part-")]
    files.delete(p, False)
    if parts:
        files.rename(parts[0], p)
    else:
        with_header = files.create(p)
        with_header.close()
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
    return path


def _plain(value: Any) -> Any:
    if isinstance(value, (set, frozenset)):
        return sorted(value)
    raise TypeError(f"{type(value).__name__} can't be written as JSON")


def write_table(df: DataFrame, path: str) -> str:
    """One CSV file; a path that ends in a slash is a folder of part files, in Parquet if it ends in ``.parquet/``."""
    if not path.endswith("/"):
        return write_file(df, path)
    write_folder(df, path, "parquet" if path.endswith(".parquet/") else "csv")
    return path


def write_output(value: Any, path: str | Sequence[str]) -> list[str]:
    """Write a result: tables as CSV; of a tuple, the i-th element to the i-th path, tables as CSV and others as JSON.

    A table whose path ends in a slash is written by all tasks, as a folder. None is skipped. Anything
    else is an error.
    """
    if value is None:
        return []
    if isinstance(path, str):
        if not isinstance(value, DataFrame):
            raise TypeError(f"only a table can be written to {path}, not {type(value).__name__}")
        return [write_table(value, path)]
    if not isinstance(value, (tuple, list)) or len(value) != len(path):
        raise TypeError(f"{len(path)} paths need as many results")
    return [
        write_table(item, target)
        if isinstance(item, DataFrame)
        else write_text(SparkSession.active(), target, json.dumps(item, indent=4, default=_plain))
        for item, target in zip(value, path)
    ]


def group_key(column: str, pattern: str | None, missing_as: str | None = "nan"):
    """The first match of ``pattern`` in the column, or the column itself; a missing value reads as ``missing_as``."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(missing_as))
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit("")) if pattern is not None else F.col(column).cast("string")


def _named_files(spark: SparkSession, staging: str, target: Callable[[str], str]) -> list[str]:
    """Give the file of each value of a folder partitioned by one column its name, and delete the folder."""
    files, root = _filesystem(spark, staging)
    jvm, written = spark._jvm, []
    for status in files.listStatus(root):
        folder = status.getPath()
        _, equals, key = folder.getName().partition("=")
        if not equals:
            continue
        name = target(jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(key))
        to = jvm.org.apache.hadoop.fs.Path(name)
        files.mkdirs(to.getParent())
        files.delete(to, False)
        for part in files.listStatus(folder):
            if part.getPath().getName().startswith("part-"):
                files.rename(part.getPath(), to)
        written.append(name)
    files.delete(root, True)
    return written


def collate_by_group(
    spark: SparkSession,
    folders: Sequence[str],
    name: str,
    column: str = "strain",
    pattern: str | None = None,
    output: str | None = None,
    own_folders: bool = True,
    output_name: str = "report.csv",
) -> DataFrame:
    """Put the same file of several experiments together and write one file per group of ``column``.

    All groups are written by one partitioned job, then each group's files get their names. Returns
    (output_file), in the order of the groups.
    """
    rows = read_folders(spark, folders, name, output)
    require(rows, [column], "collate_by_group")
    parent = output or os.path.dirname(os.path.normpath(folders[0]))
    keyed = rows.withColumn("_key", group_key(column, pattern)).where(F.col("_key").isNotNull())
    staging = os.path.join(parent, f".collate-{uuid.uuid4().hex}")
    keyed.repartition("_key").write.partitionBy("_key").option("header", True).csv(staging)
    target = lambda key: os.path.join(parent, key, output_name) if own_folders else os.path.join(parent, f"{key}_{output_name}")
    written = _named_files(spark, staging, target)
    return spark.createDataFrame([(w,) for w in sorted(written)], "output_file string")


#: Parts that the rows of a series are spread over when they meet its bounds.
SALTS = 16


def plot_points(
    df: DataFrame, keys: Sequence[str], time: str, value: str, fitted: str | None = None, spread: str | None = None, columns: int = 570
) -> DataFrame:
    """(keys, t0, t1, low, high, points, line): what a plot of each series has to show, at most four points per pixel column.

    The time between ``t0`` and ``t1``, the bounds of the series, is cut into ``columns``; of each of them the
    first, last, lowest and highest point stay, which draw the same picture as all points. ``points`` are
    (t, v, s) with values and spreads, ``line`` is (t, v) of the fitted curve. A series may be of any length:
    its rows are reduced where they are, before anything of it meets in one task.
    """
    none = F.lit(None).cast("double")
    rows = without_null_keys(df, keys).select(
        *keys, finite(time).alias("_t"), finite(value).alias("_v"), (finite(fitted) if fitted else none).alias("_f"), (finite(spread) if spread else none).alias("_s")
    )
    bounds = rows.groupBy(*keys).agg(
        F.min("_t").alias("t0"), F.max("_t").alias("t1"), F.least(F.min("_v"), F.min("_f")).alias("low"), F.greatest(F.max("_v"), F.max("_f")).alias("high")
    )
    spread_bounds = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = rows.withColumn("_salt", F.pmod(F.xxhash64("_t", "_v"), F.lit(SALTS).cast("long"))).join(spread_bounds, [*keys, "_salt"])
    length = F.col("t1") - F.col("t0")
    column = F.when(length > 0, F.floor((F.col("_t") - F.col("t0")) / length * columns)).otherwise(F.lit(0)).cast("int")

    def extremes(level: str) -> Column:
        there = F.col("_t").isNotNull() & F.col(level).isNotNull()
        t, v, s = F.col("_t").alias("t"), F.col(level).alias("v"), F.col("_s").alias("s")
        by_time, by_level = F.when(there, F.struct(t, v, s)), F.when(there, F.struct(v, t, s))
        turned = [F.struct(p["t"].alias("t"), p["v"].alias("v"), p["s"].alias("s")) for p in (F.min(by_level), F.max(by_level))]
        return F.array(F.min(by_time), F.max(by_time), *turned)

    reduced = met.groupBy(*keys, "t0", "t1", "low", "high", column.alias("_x")).agg(extremes("_v").alias("points"), extremes("_f").alias("line"))
    merged = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(c)), lambda p: p["t"].isNotNull()))).alias(c)
    return reduced.groupBy(*keys, "t0", "t1", "low", "high").agg(merged("points"), merged("line"))


def _file_name(keys: Sequence[str]) -> Column:
    """All keys; what isn't a letter, a digit, a hyphen or a full stop is written as its code point."""
    plain = lambda c: F.when(c.rlike(r"^[\p{L}\p{N}.-]$"), c).otherwise(F.concat(F.lit("%"), F.lower(F.hex(F.ascii(c))), F.lit(";")))
    parts = [F.array_join(F.transform(F.regexp_extract_all(F.col(k).cast("string"), F.lit("(?s)."), F.lit(0)), plain), "") for k in keys]
    return F.concat(F.concat_ws("_", *parts), F.lit(".svg"))


def svg_plots(
    df: DataFrame, keys: Sequence[str], time: str, value: str, fitted: str | None = None, spread: str | None = None, width: int = 640, height: int = 400
) -> DataFrame:
    """(keys, file_name, svg): a plot per series, points with error bars and the fitted curve, drawn by column expressions.

    A plot shows the points of ``plot_points``, so its size is bounded by its width. File names hold all
    keys, escaped, so two series never share one.
    """
    series = plot_points(df, keys, time, value, fitted, spread, width - 70)
    length, rise = (F.coalesce(F.nullif(F.col(b) - F.col(a), F.lit(0.0)), F.lit(1.0)) for a, b in (("t0", "t1"), ("low", "high")))
    x = lambda t: F.lit(50.0) + (t - F.col("t0")) / length * (width - 70)
    y = lambda v: F.lit(height - 40.0) - (v - F.col("low")) / rise * (height - 70)

    def shape(p: Column) -> Column:
        bar = F.format_string(
            '<line x1="%.1f" x2="%.1f" y1="%.1f" y2="%.1f" stroke="#888"/>', x(p["t"]), x(p["t"]), y(p["v"] - p["s"]), y(p["v"] + p["s"])
        )
        dot = F.format_string('<circle cx="%.1f" cy="%.1f" r="2.5" fill="#246"/>', x(p["t"]), y(p["v"]))
        return F.concat(F.when(p["s"].isNotNull(), bar).otherwise(F.lit("")), dot)

    shapes = [F.array_join(F.transform("points", shape), "")]
    if fitted:
        ends = F.array_join(F.transform("line", lambda p: F.format_string("%.1f,%.1f", x(p["t"]), y(p["v"]))), " ")
        shapes.append(F.concat(F.lit('<polyline points="'), ends, F.lit('" fill="none" stroke="#c42" stroke-width="1.5"/>')))
    title = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(plain), F.lit(written))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="50" y="20">'
    svg = F.concat(F.lit(head), title, F.lit("</text>"), *shapes, F.lit("</svg>"))
    return series.select(*keys, _file_name(keys).alias("file_name"), svg.alias("svg"))


def written_files(texts: DataFrame, folder: str) -> DataFrame:
    """Write each row of (file_name, text) as a file of ``folder`` when the result, (file_name), is asked for.

    Tasks write their files themselves, through pyarrow's file systems: there is no folder per file, and nothing is left to
    rename. A file has its name only when it is whole, so a task that runs twice does no harm.
    """
    place = folder if "://" in folder else os.path.abspath(re.sub("^[a-z0-9]+:/+", "/", folder))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(place)
        local = isinstance(files, fs.LocalFileSystem)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as f:
                    f.write(f"{text or ''}\n".encode())
                if local and os.path.exists(f"{root}/.{name}.crc"):
                    os.remove(f"{root}/.{name}.crc")  # the checksum of a file that Hadoop wrote under this name
                files.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file_name"])

    return texts.toDF("file_name", "text").mapInArrow(write, "file_name string")


def write_files(texts: DataFrame, folder: str) -> None:
    """``written_files`` at once; no name comes to the driver."""
    written_files(texts, folder).write.format("noop").mode("overwrite").save()


def save_plots(plots: DataFrame, folder: str) -> list[str]:
    """Write the plots of ``svg_plots``, each under its name: one job writes them all, from its tasks."""
    return [os.path.join(folder, r["file_name"]) for r in written_files(plots.select("file_name", "svg"), folder).collect()]
