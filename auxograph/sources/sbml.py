"""Exchange reactions and their bounds from SBML, read with Spark's XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auxograph.functions.growth import capped_bound, exchange_name

_SPECIES = "_id string, _name string"
_PARAMETER = "_id string, _value string"
_REACTION = """_id string, _name string, _upperFluxBound string, `_fbc:upperFluxBound` string,
  listOfReactants struct<speciesReference: array<struct<_species: string>>>,
  kineticLaw struct<listOfParameters: struct<parameter: array<struct<_id: string, _value: string>>>,
                    listOfLocalParameters: struct<localParameter: array<struct<_id: string, _value: string>>>>"""
#: Bound of reactions that name none.
DEFAULT_BOUND = 1000


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _value(c) -> Column:
    """A number of a model, where ``INF`` and ``-INF`` are infinite."""
    text = F.upper(F.trim(c))
    return F.when(text == "INF", float("inf")).when(text == "-INF", float("-inf")).otherwise(text.try_cast("double"))


def _exchanges(spark: SparkSession, path: str) -> DataFrame:
    """Reactions whose id, without a leading ``R_``, begins with ``EX_``; ``_n`` is the order of files and in a file."""
    rows = _rows(spark, path, "reaction", _REACTION).withColumn("_n", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")))
    return rows.withColumn("exchange_reaction", F.regexp_replace("_id", "^R_", "")).where(F.startswith("exchange_reaction", F.lit("EX_")))


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """(name, exchange_reaction): a key for each metabolite of each exchange reaction.

    The key is the species' name, or its id, or the reaction's name where it lists no species; the last
    reaction with a key counts.
    """
    named = _exchanges(spark, path).select(
        "_n", "exchange_reaction", F.col("_name").alias("reaction_name"), F.explode_outer("listOfReactants.speciesReference._species").alias("species")
    )
    species = _rows(spark, path, "species", _SPECIES).select(F.col("_id").alias("species"), F.col("_name").alias("species_name"))
    keyed = named.join(species, "species", "left")
    key = exchange_name(F.coalesce(F.nullif("species_name", F.lit("")), "species", "reaction_name"))
    return keyed.withColumn("name", key).where("name <> ''").groupBy("name").agg(F.max_by("exchange_reaction", "_n").alias("exchange_reaction"))


def read_bounds(spark: SparkSession, path: str, default_level: int = 1) -> DataFrame:
    """(exchange_reaction, level, max_value) with the upper bound as an integer.

    The bound is the parameter that the reaction's flux bound names, or the last local parameter whose
    id contains ``upper`` or ``ub``; bounds over 10000 and infinite ones are 1000, as is a missing one.
    """
    reactions = _exchanges(spark, path)
    named = F.coalesce("`_fbc:upperFluxBound`", "_upperFluxBound")
    parameters = _rows(spark, path, "parameter", _PARAMETER).groupBy(F.col("_id").alias("_bound")).agg(F.max(_value(F.col("_value"))).alias("_named"))
    local = F.concat(
        F.coalesce("kineticLaw.listOfParameters.parameter", F.array().cast("array<struct<_id:string,_value:string>>")),
        F.coalesce("kineticLaw.listOfLocalParameters.localParameter", F.array().cast("array<struct<_id:string,_value:string>>")),
    )
    upper = F.filter(local, lambda p: F.lower(p["_id"]).rlike("upper|ub"))
    joined = reactions.withColumn("_bound", named).withColumn("_local", _value(F.try_element_at(upper, F.lit(-1))["_value"])).join(parameters, "_bound", "left")
    bound = F.coalesce("_named", "_local", F.lit(float(DEFAULT_BOUND)))
    return joined.select("exchange_reaction", F.lit(default_level).alias("level"), capped_bound(bound).alias("max_value"))
