"""Many experiments at once: raw exports and protocols read together, each raw file with its own protocol.

A table of pairs says which protocol belongs to which raw file. All files of a kind are read by one
scan, whatever their number and however their columns differ; readings and wells carry their
experiment, so every later operator takes it as a further key. A file that can't be read stops
nothing: what is wrong with it goes to a table of errors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auxograph.functions.stored import stored
from auxograph.functions.values import known, no_blank, number, strip
from auxograph.operators.joins import paired_by_rank
from auxograph.operators.plates import PARSED
from auxograph.sources.plate_export import HEADER, readings_of, split_files, text_lines
from auxograph.sources.protocol import COLUMNS, SECTION, sections

PAIRS = "experiment string, raw_file string, protocol_file string"
#: Columns that a protocol may have.
WIDEST = 256

Paths = str | Sequence[str]


@dataclass(frozen=True)
class Experiments:
    """``parsed``: readings with their protocol and experiment; ``errors``: (experiment, file, error)."""

    parsed: DataFrame
    errors: DataFrame


def _named(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def pairs_by_rank(spark: SparkSession, folder: str, raw_pattern: str, protocol_pattern: str) -> DataFrame:
    """Pairs of a folder's files: the n-th that matches each pattern, in the order of their paths; the rest has no partner.

    Files are listed by Spark, so the folder may be in any store; the experiment is the raw file's name
    without its ending.
    """

    def listed(pattern: str, name: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias(name))

    paired = paired_by_rank(listed(raw_pattern, "raw_file"), "raw_file", listed(protocol_pattern, "protocol_file"), "protocol_file")
    return paired.select(F.regexp_replace(_named(F.col("raw_file")), r"\.[^.]*$", "").alias("experiment"), "raw_file", "protocol_file")


def pairs_of(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """Pairs from a dictionary of raw file to protocol file, as ``load_mapping`` and ``pair_files`` give them."""
    rows = [(r.rsplit("/", 1)[-1].rsplit(".", 1)[0], r, p) for r, p in mapping.items()]
    return spark.createDataFrame(rows, PAIRS)


def read_protocols(spark: SparkSession, path: Paths) -> tuple[DataFrame, DataFrame]:
    """Wells of many protocols, and errors (source_file, error).

    Each file has its own columns, in its own order: what a file lacks is null in its rows. Of repeated wells
    of a file the first counts. A file without the section, or whose section has no column Well, is an error.
    """
    return _wells(stored(text_lines(spark, path), "protocol-lines"))


def _wells(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = sections(lines).where(F.contains("title", F.lit(SECTION)))
    cells = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(WIDEST))))
    by_file = Window.partitionBy("source_file")
    rows = found.withColumn("_first", F.min("section").over(by_file)).where("section = _first")
    rows = rows.withColumn("_n", F.row_number().over(by_file.orderBy("line_no"))).withColumn("_cells", cells)
    array = F.transform(F.array(*[F.col(f"_cells.c{i}") for i in range(WIDEST)]), lambda c: strip(c))
    rows = rows.select("source_file", "line_no", "_n", array.alias("_cells"))
    heads = rows.where("_n = 1").select("source_file", F.transform("_cells", lambda c: F.coalesce(c, F.lit(""))).alias("_names"))
    rows = rows.where("_n > 1").join(heads, "source_file")
    place = lambda name: F.nullif(F.array_position("_names", F.lit(name)).cast("int"), F.lit(0))
    cell = lambda name: F.try_element_at("_cells", place(name))
    columns = [(number(cell(k)) if k.endswith("(µL)") else cell(k)).alias(v) for k, v in COLUMNS.items()]
    blank = F.when(place("Strain").isNotNull(), F.coalesce(F.lower(no_blank(cell("Strain"))) == "blank", F.lit(False)))
    wells = rows.where(place("Well").isNotNull()).select("source_file", "line_no", *columns, blank.alias("is_blank"))
    first = Window.partitionBy("source_file", "well").orderBy("line_no")
    wells = wells.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "line_no")
    files = lines.select("source_file").distinct().join(heads, "source_file", "left")
    wrong = F.when(F.col("_names").isNull(), f'no section "{SECTION}"').when(place("Well").isNull(), f'the section "{SECTION}" has no column "Well"')
    return wells, files.select("source_file", wrong.alias("error")).where("error is not null")


def read_plates(spark: SparkSession, path: Paths, value: str = "od") -> tuple[DataFrame, DataFrame]:
    """Readings of many exports, as ``read_plate`` has them, and errors (source_file, error) in place of a failure."""
    return _readings(stored(split_files(spark, path), "plate-lines"), value)


def _readings(files: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    errors = files.where("_header is null").select("source_file", F.lit(f"no line starts with '{HEADER}'").alias("error"))
    return readings_of(files.where("_header is not null"), value), errors


def _files(pairs: DataFrame, column: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(experiment, source_file) of the pairs' files among those ``found``, and errors of files that are none or several.

    A pair names a file by its path or the end of it. Names are joined by their last part, then compared as wholes.
    """
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    asked = pairs.select("experiment", F.col(column).alias("file"), _named(F.col(column)).alias("_name"))
    there = found.select("source_file", _named(F.col("source_file")).alias("_name"))
    ends = F.endswith(F.concat(F.lit("/"), plain(F.col("source_file"))), F.concat(F.lit("/"), F.ltrim(plain(F.col("file")), F.lit("/"))))
    met = asked.join(there, "_name").where(ends).select("experiment", "file", "source_file")
    n = asked.select("experiment", "file").join(met.groupBy("experiment", "file").count(), ["experiment", "file"], "left")
    wrong = F.when(F.col("count").isNull(), "no such file").when(F.col("count") > 1, "the name stands for several files")
    errors = n.select("experiment", "file", wrong.alias("error")).where("error is not null")
    good = n.where("count = 1").select("experiment", "file")
    return met.join(good, ["experiment", "file"], "left_semi"), errors


def read_experiments(spark: SparkSession, raw: Paths, protocols: Paths, pairs: DataFrame, value: str = "od") -> Experiments:
    """The experiments of ``pairs`` (experiment, raw_file, protocol_file) among the files of two folders, lists or globs.

    ``parsed`` has experiment, the columns of ``plates.parse`` (all that any protocol may have) and
    ``value``. An experiment with an error in either file has no rows in it. Errors: a file without its
    header, section or well column; a name that is no file or several; an experiment that comes twice. Several
    experiments may share a protocol. Files that no pair names are not looked at.
    """
    pairs = stored(pairs.select(*[c.split()[0] for c in PAIRS.split(", ")]), "pairs")
    twice = pairs.groupBy("experiment").agg(F.count("*").alias("n"), F.max("raw_file").alias("file")).where("n > 1")
    errors = twice.select("experiment", "file", F.lit("the experiment comes twice").alias("error"))
    once = pairs.join(twice, "experiment", "left_anti")
    # every file is opened once: what follows reads their lines from tables
    exports, lines = stored(split_files(spark, raw), "plate-lines"), stored(text_lines(spark, protocols), "protocol-lines")
    readings, bad_plates = _readings(exports, value)
    wells, bad_protocols = _wells(lines)
    good = []
    for column, found, bad in (("raw_file", exports, bad_plates), ("protocol_file", lines, bad_protocols)):
        met, unknown = _files(once, column, found.select("source_file").distinct())
        broken = met.join(bad, "source_file").select("experiment", "file", "error")
        errors = errors.unionByName(unknown).unionByName(broken)
        good.append(met.select("experiment", F.col("source_file").alias(column)))
    errors = stored(errors, "errors")
    kept = good[0].join(good[1], "experiment").join(errors.select("experiment"), "experiment", "left_anti")
    read = kept.select("experiment", F.col("raw_file").alias("source_file")).join(readings, "source_file").drop("source_file")
    known_wells = kept.select("experiment", F.col("protocol_file").alias("source_file")).join(wells, "source_file").drop("source_file")
    joined = read.join(known_wells, ["experiment", "well"], "left")
    return Experiments(joined.select("experiment", *known(joined, [*PARSED, value])), errors)


def parsed_experiments(spark: SparkSession, src: str, raw_pattern: str = "*raw*.csv", protocol_pattern: str = "*protocol*.csv", value: str = "od") -> DataFrame:
    """For plans: the readings of all experiments in a folder, paired by rank; an error of any file is raised."""
    root = src.rstrip("/")
    pairs = pairs_by_rank(spark, root, raw_pattern, protocol_pattern)
    found = read_experiments(spark, f"{root}/{raw_pattern}", f"{root}/{protocol_pattern}", pairs, value)
    if wrong := found.errors.limit(5).collect():
        raise ValueError("; ".join(f"{r['experiment']}, {r['file']}: {r['error']}" for r in wrong))
    return found.parsed
