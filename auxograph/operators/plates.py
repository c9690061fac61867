"""Plates: readings joined with their protocol, quality reports, and statistics of replicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auxograph.functions.values import first_non_null, joined_distinct, known, require, without_null_keys
from auxograph.operators.joins import many_to_one, missing_keys, top_by
from auxograph.operators.ranking import ranked
from auxograph.operators.series import TIME_COLUMNS
from auxograph.sources.plate_export import read_plate
from auxograph.sources.protocol import read_protocol

# The order of the columns of a parsed plate; the value comes last.
PARSED = (
    "well", "well_row", "well_col", "content", "strain", "strain_well", "is_blank", "media_type", "supplements",
    "media_volume_uL", "water_volume_uL", "supplement_volume_uL", "volume_per_supplement_uL", "total_volume_uL",
    "time_label", "time_h", "time_min_int", "time_h_int", "time_min",
)
# Columns of the protocol that replicates carry along.
METADATA = (
    "strain", "strain_well", "is_blank", "media_type", "supplements", "media_volume_uL", "water_volume_uL",
    "supplement_volume_uL", "volume_per_supplement_uL", "total_volume_uL", "content",
)
#: Wells that a report lists.
LISTED = 96


def parse(readings: DataFrame | str, protocol: DataFrame | str, value: str = "od") -> DataFrame:
    """Readings with the protocol of their well; a well that the protocol has twice is an error.

    Either may be the path of its file, which is read first.
    """
    if isinstance(readings, str):
        readings = read_plate(SparkSession.active(), readings, value)
    if isinstance(protocol, str):
        protocol = read_protocol(SparkSession.active(), protocol)
    joined = many_to_one(readings, protocol, ["well"])
    return joined.select(*known(joined, [*PARSED, value]))


def first_names(df: DataFrame, name: str, by: Sequence[str] = (), most: int = LISTED, out: str = "names") -> DataFrame:
    """Per group of ``by`` its ``most`` smallest distinct names, in order, as one text.

    Every task leaves out all but its own smallest names before they are gathered.
    """
    top = top_by(df.where(F.col(name).isNotNull()).select(*by, name).distinct(), by, [name], most, "_n")
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", name))), lambda s: s[name]), ";").alias(out))


def report(readings: DataFrame, protocol: DataFrame, value: str = "od") -> DataFrame:
    """Issues found: (issue, count, wells). Clean data has no rows."""

    def listed(df: DataFrame, issue: str) -> DataFrame:
        counted = df.agg(F.count("*").cast("int").alias("count"), F.lit(None).cast("string").alias("wells"))
        named = first_names(df, "well", out="wells").select(F.lit(None).cast("int").alias("count"), "wells")
        return counted.unionByName(named).agg(F.lit(issue).alias("issue"), F.max("count").alias("count"), F.max("wells").alias("wells"))

    nothing = F.lit(None).cast("string").alias("wells")
    found = [
        listed(missing_keys(readings, protocol, "well"), "wells_missing_in_metadata"),
        listed(missing_keys(protocol, readings, "well"), "wells_missing_in_raw"),
        readings.agg(F.lit(f"non_numeric_{value}_values").alias("issue"), F.count_if(F.col(value).isNull() | F.isnan(value)).cast("int").alias("count"), nothing),
        protocol.agg(F.lit("duplicate_wells_in_metadata").alias("issue"), (F.count("*") - F.count_distinct("well") - F.max(F.col("well").isNull().cast("int"))).cast("int").alias("count"), nothing),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where(F.col("count") > 0)


def standard_deviation(value: str, ddof: int) -> Column:
    """Aggregate: the standard deviation with ``n - ddof`` in the denominator; null if that isn't positive."""
    if ddof == 1:
        return F.stddev_samp(value)
    if ddof == 0:
        return F.stddev_pop(value)
    n = F.count(value)
    return F.when(n > ddof, F.sqrt(F.var_pop(value) * n / (n - ddof)))


def _is_alphabetical(direction: str) -> bool:
    kind = direction.lower()
    if kind not in ("alphabetical", "alpha", "numerical", "num"):
        raise ValueError(f"direction must be alphabetical or numerical, not {direction!r}")
    return kind.startswith("alpha")


def _group_id(alphabetical: Column) -> Column:
    """Name of a group of wells, from their names in order: ``A_1-3``, or ``ABC_1`` for a column."""
    columns = F.transform("_wells", lambda w: F.regexp_extract(w, r"(\d+)$", 1).cast("int"))
    letters = F.transform("_wells", lambda w: F.regexp_extract(w, r"^(\D+)", 1))
    low, high = F.array_min(columns), F.array_max(columns)
    across = F.concat_ws("_", letters[0], F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high)))
    down = F.concat_ws("_", F.array_join(letters, ""), columns[0])
    return F.when(alphabetical, across).otherwise(down)


def _grouped(df: DataFrame, wells: DataFrame, value: str, ddof: int, lead: Sequence[str]) -> DataFrame:
    """Statistics of ``df`` by the groups that ``wells`` (well, lead, _number, _alpha, _wells) defines."""
    times = known(df, TIME_COLUMNS)
    rows = df.join(wells, ["well", *lead])
    for t in times:
        rows = rows.where(F.col(t).isNotNull())
    order = F.struct("well_row", "well_col")
    metadata = known(df, [c for c in METADATA if c not in lead])
    stats = rows.groupBy(*lead, "_number", "_alpha", "_wells", *times).agg(
        joined_distinct("well").alias("wells"),
        joined_distinct("well_row").alias("well_rows"),
        joined_distinct("well_col").alias("well_cols"),
        F.avg(value).alias(f"{value}_mean"),
        standard_deviation(value, ddof).alias(f"{value}_std"),
        F.count(value).alias("n_replicates"),
        *[first_non_null(c, order).alias(c) for c in metadata],
    )
    named = stats.withColumn("group_id", _group_id(F.col("_alpha")))
    return named.select(*lead, "group_id", "wells", "well_rows", "well_cols", f"{value}_mean", f"{value}_std", "n_replicates", *times, *metadata)


def replicates_by_well(
    df: DataFrame, direction: str = "alphabetical", sample_size: int = 3, ddof: int = 1, value: str = "od", by: Sequence[str] = ()
) -> DataFrame:
    """Statistics of groups of ``sample_size`` neighbouring wells at each time.

    Alphabetical: neighbours along a row, numerical: down a column. Wells are numbered by ``ranked``, so
    there may be any number of them; with ``by`` (an experiment, say) they are numbered within each
    of its groups, all of which must be divisible. The readings are grouped in one aggregate.
    """
    require(df, ["well", "well_row", "well_col", value, *by], "replicates_by_well")
    if sample_size < 1:
        raise ValueError("sample_size must be at least 1")
    alphabetical = _is_alphabetical(direction)
    wells = without_null_keys(df.select(*by, "well", "well_row", "well_col"), by).distinct()
    placed = ranked(wells, ["well_row", "well_col"] if alphabetical else ["well_col", "well_row"], "_place", by)
    for r in placed.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") % sample_size > 0).limit(5).collect():
        group = "".join(f" of {r[c]}" for c in by)
        raise ValueError(f"{r['n']} wells{group} can't be divided into groups of {sample_size}")
    placed = placed.withColumn("_place", F.col("_place") - 1)
    numbered = placed.withColumn("_number", F.floor(F.col("_place") / sample_size)).withColumn("_alpha", F.lit(alphabetical))
    return _grouped(df, _with_members(numbered, list(by)), value, ddof, list(by))


def _with_members(numbered: DataFrame, lead: list[str]) -> DataFrame:
    """Wells with the ordered names of their group: at most ``sample_size`` names."""
    names = numbered.groupBy(*lead, "_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "well"))), lambda s: s["well"]).alias("_wells"))
    return numbered.join(names, [*lead, "_number"]).select(*lead, "well", "_number", "_alpha", "_wells")


def replicates_by_rules(
    df: DataFrame,
    strain_pattern: str | None = None,
    rules: Mapping[str, Mapping[str, int | str]] | None = None,
    ddof: int = 1,
    value: str = "od",
    missing_as: str | None = "nan",
) -> DataFrame:
    """Statistics of replicates with a rule (direction, sample_size) for each group of strains.

    The strain group is the first match of ``strain_pattern`` in the strain, or the strain itself;
    groups without a rule are left out. A missing strain is read as the text ``missing_as`` (null:
    such rows have no group). The rules are a small table that is joined, so all strains are
    grouped in one pass.
    """
    require(df, ["well", "well_row", "well_col", "strain", value], "replicates_by_rules")
    spark = df.sparkSession
    table = []
    for name, rule in (rules or {}).items():
        size = int(rule.get("sample_size", 3))
        if size < 1:
            raise ValueError(f"sample_size of {name} must be at least 1")
        table.append((name, size, _is_alphabetical(str(rule.get("direction", "alphabetical")))))
    strain = F.coalesce(F.col("strain").cast("string"), F.lit(missing_as))
    group = F.nullif(F.regexp_extract(strain, f"({strain_pattern})", 1), F.lit("")) if strain_pattern is not None else F.col("strain")
    rows = df.withColumn("strain_group", group)
    ruled = rows.join(F.broadcast(spark.createDataFrame(table, "strain_group string, _size int, _alpha boolean")), "strain_group")
    wells = ruled.select("strain_group", "well", "well_row", "well_col", "_size", "_alpha").distinct()
    uneven = wells.groupBy("strain_group", "_size").count().where("count % _size <> 0").collect()
    if uneven:
        raise ValueError("; ".join(f"{r['strain_group']}: {r['count']} wells can't be divided into groups of {r['_size']}" for r in uneven))
    # a strain group has one direction: rows first where it is alphabetical, else columns
    order = [F.when(F.col("_alpha"), F.col("well_row")), F.col("well_col"), F.col("well_row")]
    placed = ranked(wells, order, "_place", ["strain_group"]).withColumn("_place", F.col("_place") - 1)
    numbered = placed.withColumn("_number", F.floor(F.col("_place") / F.col("_size")))
    # the group takes the place of the strain; a well of several strains is in a group of each
    readings = rows.drop("strain").withColumnRenamed("strain_group", "strain")
    members = _with_members(numbered, ["strain_group"]).withColumnRenamed("strain_group", "strain")
    return _grouped(readings, members, value, ddof, ["strain"])
