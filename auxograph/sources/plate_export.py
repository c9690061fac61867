"""Plate-reader exports: a preamble, a header line, a line of time labels, and one line per well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxograph.functions.time_labels import with_time
from auxograph.functions.values import number, strip

# How the header line of an export begins.
HEADER = "Well Row,Well Col,Content,Raw Data"


LINE_ENDS = r"\r\n|\r|\n"


def _whole_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value, source_file): each file as one value; exports are small files."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(source_file, line_no, line) of text files; lines are numbered within their file.

    A file is read as one value and split, so numbers need no shuffle.
    """
    return _whole_files(spark, path).select("source_file", F.posexplode(F.split("value", LINE_ENDS)).alias("line_no", "line"))


def split_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(source_file, _lines, _header): the lines of each file that aren't blank, and the place of the header, null if there is none."""
    lines = F.filter(F.split("value", LINE_ENDS), lambda x: F.trim(x) != "")
    files = _whole_files(spark, path).select("source_file", lines.alias("_lines"))
    header = F.array_position(F.transform("_lines", lambda x: F.startswith(F.trim(x), F.lit(HEADER))), True).cast("int")
    return files.withColumn("_header", F.when(header > 0, header))


def read_plate(spark: SparkSession, path: str | Sequence[str], value: str = "od") -> DataFrame:
    """Tidy readings: well_row, well_col, content, time_label, value, well, the time columns, source_file.

    Blank lines are skipped. The labels are the cells of the line after the header from the fourth on,
    without ``time`` and empty cells. A cell that isn't a number is null; a label that is no duration
    has null times. A file without the header is an error. A file is taken apart within its own row,
    so any number of files is read without a join or a shuffle.
    """
    missing = F.raise_error(F.concat(F.lit(f"no line starts with '{HEADER}' in "), F.col("source_file"))).cast("int")
    return readings_of(split_files(spark, path).withColumn("_header", F.coalesce("_header", missing)), value)


def _cells(line):
    return F.transform(F.split(line, ","), lambda c: strip(c))


def _rest(array, begin):
    """From ``begin`` on; a slice that begins after the end is empty."""
    return F.slice(array, begin, F.greatest(F.size(array), F.lit(1)))


def _labels(cells):
    """The labels of times: cells from the fourth on, without ``time`` and empty ones."""
    return F.filter(_rest(cells, F.lit(4)), lambda c: (c != "") & (F.lower(c) != "time"))


def readings_of(files: DataFrame, value: str) -> DataFrame:
    """The readings of files that are split at their lines, each within its own row."""
    first = F.coalesce(_cells(F.get("_lines", F.col("_header"))), F.array().cast("array<string>"))
    found = files.select("source_file", _rest(F.col("_lines"), F.col("_header") + 2).alias("_lines"), _labels(first).alias("_labels"))
    wells = found.select("source_file", "_labels", F.explode(F.transform("_lines", _cells)).alias("cells"))
    return _readings(wells, value)


def readings_of_lines(rows: DataFrame, value: str = "od") -> DataFrame:
    """The readings of rows of the format ``plate_export`` (source_file, labels, line), of a table or a stream."""
    wells = rows.where("line is not null").select("source_file", _labels(_cells(F.col("labels"))).alias("_labels"), _cells(F.col("line")).alias("cells"))
    return _readings(wells, value)


def _readings(wells: DataFrame, value: str) -> DataFrame:
    """A row per well and label of (source_file, _labels, cells)."""
    values = F.slice("cells", F.lit(4), F.size("_labels"))
    tall = wells.select(
        F.try_element_at("cells", F.lit(1)).alias("well_row"),
        F.try_element_at("cells", F.lit(2)).try_cast("double").cast("int").alias("well_col"),
        F.try_element_at("cells", F.lit(3)).alias("content"),
        "source_file",
        F.explode(F.arrays_zip(F.col("_labels").alias("label"), values.alias("value"))).alias("_cell"),
    )
    readings = tall.select(
        "well_row",
        "well_col",
        "content",
        F.col("_cell.label").alias("time_label"),
        number("_cell.value").alias(value),
        F.concat("well_row", F.coalesce(F.col("well_col").cast("string"), F.lit("<NA>"))).alias("well"),
        "source_file",
    )
    # an order only where it is asked for: readings are partitioned by well in all that follows
    return with_time(readings.where(F.col("time_label").isNotNull()))


def in_plate_order(df: DataFrame) -> DataFrame:
    return df.orderBy("well_row", "well_col", "time_min")
