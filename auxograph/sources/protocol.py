"""Protocol files: sections under ``=== Title ===`` lines, one of them a table of wells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auxograph.functions.values import no_blank, number, strip
from auxograph.sources.plate_export import text_lines

# The title of the section that holds the table, its columns and their names here; the
# first five are text, the others volumes.
SECTION = "Experiment Data"
COLUMNS = {
    "Well": "well",
    "Strain": "strain",
    "Strain Well": "strain_well",
    "Media Type": "media_type",
    "Supplements": "supplements",
    "Media Volume (µL)": "media_volume_uL",
    "Water Volume (µL)": "water_volume_uL",
    "Supplement Volume (µL)": "supplement_volume_uL",
    "Volume per Supplement (µL)": "volume_per_supplement_uL",
    "Total Volume (µL)": "total_volume_uL",
}


#: What ``strip`` takes off.
_WHITE = " \t\n\x0b\x0c\r\u00a0\u2009"


def stripped(line: str) -> str:
    """``values.strip`` of one line, for readers."""
    return line.strip(_WHITE)


def is_title(line: str) -> bool:
    return line.startswith("===") and line.endswith("===")


def title_of(line: str) -> str:
    return line.strip("= ")


def sections(lines: DataFrame) -> DataFrame:
    """Lines (source_file, line_no, line) with the title they stand under; titles and blanks are left out.

    Of sections with the same title the last one counts.
    """
    rows = lines.withColumn("line", strip("line")).where("line <> ''")
    is_title = F.startswith("line", F.lit("===")) & F.endswith("line", F.lit("==="))
    w = Window.partitionBy("source_file").orderBy("line_no")
    titled = (
        rows.withColumn("_is_title", is_title)
        .withColumn("section", F.sum(F.col("_is_title").cast("int")).over(w))
        .withColumn("title", F.last(F.when(F.col("_is_title"), F.regexp_replace("line", "^[= ]+|[= ]+$", "")), ignorenulls=True).over(w))
    )
    latest = F.max("section").over(Window.partitionBy("source_file", "title"))
    return titled.withColumn("_latest", latest).where("not _is_title and section = _latest").select("source_file", "title", "section", "line_no", "line")


def read_protocol(spark: SparkSession, path: str) -> DataFrame:
    """One row per well of the section whose title contains ``Experiment Data``.

    Only columns that the file has are returned, and ``is_blank`` (strain is "blank"). Volumes that are
    no numbers are null; of repeated wells the first counts.
    """
    found = sections(text_lines(spark, path)).where(F.contains("title", F.lit(SECTION)))
    head = found.orderBy("section", "line_no").select("section", "line_no", "line").first()
    if head is None:
        raise ValueError(f'no section "{SECTION}" in {path}')
    names = [c.strip() for c in head["line"].split(",")]
    if "Well" not in names:
        raise ValueError(f'the section "{SECTION}" of {path} has no column "Well"')
    body = found.where((F.col("section") == head["section"]) & (F.col("line_no") > head["line_no"]))
    cells = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(len(names)))))
    rows = body.select("line_no", cells.alias("cells"))
    columns = [
        (number(f"cells.c{names.index(k)}") if k.endswith("(µL)") else strip(f"cells.c{names.index(k)}")).alias(v)
        for k, v in COLUMNS.items()
        if k in names
    ]
    first = Window.partitionBy("well").orderBy("line_no")
    tidy = rows.select("line_no", *columns).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "line_no")
    if "strain" in tidy.columns:
        tidy = tidy.withColumn("is_blank", F.coalesce(F.lower(no_blank("strain")) == "blank", F.lit(False)))
    return tidy
