"""Queries that go through files: tables are written in the formats of instruments, models and plans, and read back.

Files are bounded: a plate holds 96 users, so more data make more plates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxograph.functions.tables import use_table_functions
from auxograph.operators import plates, sinks
from auxograph.plans.yaml_plans import build, build_shipped
from auxograph.registered import ORACLES, event_series, folder, query, r6, table
from auxograph.sources import exchanges, experiments, formats, plate_export, protocol, sbml, tables

HOURS_OF_DAY = range(24)


def _write_lines(lines: DataFrame, path: str, file: str | None = None) -> str:
    """Write (n, line), or (file, n, line) with a file for each value of ``file``, in the order of ``n``."""
    if file is None:
        lines.repartition(1).sortWithinPartitions("n").select("line").write.text(path)
    else:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
        texts = lines.groupBy(file).agg(F.array_join(ordered, "\n").alias("text"))
        sinks.write_files(texts.select(F.concat(F.lit(f"{file}="), F.col(file).cast("string"), F.lit(".csv")).alias("name"), "text"), path)
    return path


def _write_model(lines: DataFrame, path: str, begin: str, end: str) -> str:
    """Write (n, line) as documents between ``begin`` and ``end``, each a range of ``n``: no task has all, neither here nor where they are read."""

    def document(batches):
        yield pa.RecordBatch.from_pydict({"line": [begin]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"line": [end]})

    lines.repartitionByRange("n").sortWithinPartitions("n").select("line").mapInArrow(document, "line string").write.text(path)
    return path


def _cells(*columns):
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def plate_files(spark: SparkSession, sf_dir: str) -> str:
    """Plate exports, 96 users each: the sum of a user's values in each hour of the day."""
    events = table(spark, sf_dir, "events").select("user_id", F.hour(F.col("ts").cast("timestamp")).alias("h"), "value")
    wells = events.groupBy("user_id").pivot("h", list(HOURS_OF_DAY)).agg(F.round(F.sum("value"), 2))
    row, column = F.char((65 + F.floor(F.col("user_id") % 96 / 12)).cast("int")), F.col("user_id") % 12 + 1
    body = wells.select(
        F.floor(F.col("user_id") / 96).cast("int").alias("plate"),
        (10 + F.col("user_id")).alias("n"),
        _cells(row, column, F.concat(F.lit("Sample X"), F.col("user_id").cast("string")), *[F.col(f"`{h}`") for h in HOURS_OF_DAY]).alias("line"),
    )
    # fixed values: the header of an export
    head = ["User: somebody", "", "Well Row,Well Col,Content" + ",Raw Data (600)" * 24, ",,Time," + ",".join(f"{h} h 0 min" for h in HOURS_OF_DAY)]
    lines = F.array(*[F.struct(F.lit(i).cast("long").alias("n"), F.lit(x).alias("line")) for i, x in enumerate(head)])
    return _write_lines(body.select("plate").distinct().select("plate", F.inline(lines)).unionByName(body), folder(spark, "plates"), "plate")


_PLATES = """u as (select distinct user_id from events), h as (select range::int as h from range(0, 24)), s as (
  select user_id, hour(ts) as h, round(sum(value), 2) as od from events group by 1, 2
), r as (
  select (user_id // 96)::int as plate, chr((65 + user_id % 96 // 12)::int) as well_row, (user_id % 12 + 1)::int as well_col, 'Sample X' || user_id as content,
    h || ' h 0 min' as time_label, od, chr((65 + user_id % 96 // 12)::int) || (user_id % 12 + 1) as well, h::double as time_h, h as time_h_int, 0 as time_min_int, 60.0 * h as time_min
  from u cross join h left join s using (user_id, h)
)"""


def _of_plate(df: DataFrame) -> DataFrame:
    return df.withColumn("plate", F.regexp_extract("source_file", "plate=([0-9]+)", 1).cast("int")).drop("source_file")


@query(f"with {_PLATES} select plate, well_row, well_col, content, time_label, round(od, 6) as od, well, time_h, time_h_int, time_min_int, time_min::double as time_min from r")
def read_plate(spark, sf_dir):
    return _of_plate(plate_export.read_plate(spark, plate_files(spark, sf_dir))).withColumn("od", F.round("od", 6))


def _as_lines(spark: SparkSession, path: str, most: int):
    """The lines of plates as the format ``plate_export`` has them, of a table and of a stream."""
    formats.register_formats(spark)
    return [r.format("plate_export").option("maxBytes", most).option("settle", 0).load(path) for r in (spark.read, spark.readStream)]


@query(ORACLES["read_plate"])
def plates_by_range(spark, sf_dir):
    """Plates read by ranges of bytes, small files of which share a task."""
    path = plate_files(spark, sf_dir)
    return _of_plate(plate_export.readings_of_lines(_as_lines(spark, path, 1_500_000)[0])).withColumn("od", F.round("od", 6))


@query(ORACLES["read_plate"])
def plates_by_stream(spark, sf_dir):
    """Plates that a stream takes from their folder, kept as Parquet."""
    table_of, stream = (plate_export.readings_of_lines(x) for x in _as_lines(spark, plate_files(spark, sf_dir), 16 << 20))
    out, seen = folder(spark, "plates-kept"), folder(spark, "plates-seen")
    stream.writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
    return _of_plate(spark.read.schema(table_of.schema).parquet(out)).withColumn("od", F.round("od", 6))


def protocol_file(spark: SparkSession, sf_dir: str) -> str:
    """A protocol of 96 wells from all customers; its section comes twice, and a well of it twice."""
    wells = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 96).alias("k")).agg(
        F.max("c_mktsegment").alias("strain"), F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("volume")
    )
    well = F.concat(F.char((65 + F.floor(F.col("k") / 12)).cast("int")), (F.col("k") % 12 + 1).cast("string"))
    strain = F.when(F.col("k") % 5 == 0, " Blank ").otherwise(F.col("strain"))
    body = wells.select((100 + F.col("k")).alias("n"), _cells(well, strain, F.lit('"NaCl, water"'), F.when(F.col("k") % 7 != 0, F.col("volume").cast("string")).otherwise("n/a"), F.col("n_customers")).alias("line"))
    # fixed values: titles and columns of a protocol
    head = "Well,Strain,Supplements,Media Volume (µL),Unknown"
    fixed = [(1, "=== General ==="), (2, "by,somebody"), (3, "=== Experiment Data ==="), (4, head), (5, "A1,old,,1,1"), (6, "=== Experiment Data ==="), (7, head), (500, "A2,twice,,1,1"), (501, "")]
    lines = spark.createDataFrame(fixed, "n long, line string").unionByName(body)
    return _write_lines(lines, folder(spark, "protocol"))


_PROTOCOL = """w as (
  select c_custkey % 96 as k, max(c_mktsegment) as strain, round(sum(c_acctbal), 2) as volume from customer group by 1
), protocol as (
  select chr((65 + k // 12)::int) || (k % 12 + 1) as well, case when k % 5 = 0 then 'Blank' else strain end as strain, 'NaCl, water' as supplements,
    case when k % 7 <> 0 then volume end as "media_volume_uL", k % 5 = 0 as is_blank from w
)"""


@query(f'with {_PROTOCOL} select * replace (round("media_volume_uL", 6) as "media_volume_uL") from protocol')
def read_protocol(spark, sf_dir):
    return protocol.read_protocol(spark, protocol_file(spark, sf_dir)).withColumn("media_volume_uL", F.round("media_volume_uL", 6))


@query(
    f"""with {_PLATES}, {_PROTOCOL} select well, well_row, well_col, content, strain, is_blank, supplements, round("media_volume_uL", 6) as "media_volume_uL",
    time_label, time_h, time_min_int, time_h_int, time_min::double as time_min, round(od, 6) as od from r left join protocol using (well)"""
)
def parse_plate(spark, sf_dir):
    done = plates.parse(plate_files(spark, sf_dir), protocol_file(spark, sf_dir))
    return done.withColumns({c: F.round(c, 6) for c in ("media_volume_uL", "od")})


def experiment_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Plates of 12 users and a protocol for each, with columns of its own; some plates and protocols are broken.

    Plate 5k + 1 lacks its header, the protocol of plate 5k + 2 its wells; protocols of odd plates have their columns turned round.
    """
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("v"), F.count("*").alias("c"))
    rows = users.select(F.floor(F.col("user_id") / 12).cast("int").alias("plate"), (10 + F.col("user_id")).alias("n"), (F.col("user_id") % 12 + 1).alias("k"), "v", "c")
    raw = rows.select("plate", "n", _cells(F.lit("A"), F.col("k"), F.lit("X"), F.col("v"), F.col("c")).alias("line"))
    # fixed values: the header of an export, titles and columns of protocols
    head = F.when(F.col("plate") % 5 == 1, "nothing").otherwise("Well Row,Well Col,Content,Raw Data (600),Raw Data (600)")
    title = F.lit("=== Experiment Data ===")
    columns = F.when(F.col("plate") % 5 == 2, "Strain,Total Volume (µL)").when(F.col("plate") % 2 == 1, "Total Volume (µL),Note,Strain,Well").otherwise("Well,Strain")
    strain = F.concat(F.lit("S"), (F.col("plate") % 7).cast("string"), F.lit("x"), F.col("k").cast("string"))
    well = F.concat(F.lit("A"), F.col("k").cast("string"))
    said = F.when(F.col("plate") % 2 == 1, _cells(F.col("k"), F.lit("note"), strain, well)).otherwise(_cells(well, strain))
    body = rows.where("k <> 12").select("plate", "n", said.alias("line"))

    def written(lines: list, body: DataFrame, label: str) -> str:
        heads = F.array(*[F.struct(F.lit(i).cast("long").alias("n"), x.alias("line")) for i, x in enumerate(lines)])
        return _write_lines(rows.select("plate").distinct().select("plate", F.inline(heads)).unionByName(body), folder(spark, label), "plate")

    return written([head, F.lit(",,Time,0 h 0 min,1 h 30 min")], raw, "raws"), written([title, columns], body, "protocols")


_EXPERIMENTS = """u as (
  select user_id, (user_id // 12)::int as plate, (user_id % 12 + 1)::int as k, round(sum(value), 2) as v, count(*) as c from events group by 1
)"""


def _experiments(spark: SparkSession, sf_dir: str) -> experiments.Experiments:
    raw, protocols = experiment_files(spark, sf_dir)
    number = lambda root: spark.read.format("binaryFile").load(root).select(F.regexp_extract("path", "plate=([0-9]+)[.]", 1).alias("experiment"), "path")
    pairs = number(raw).withColumnRenamed("path", "raw_file").join(number(protocols).withColumnRenamed("path", "protocol_file"), "experiment")
    missing = spark.createDataFrame([("none", "no/such.csv", "neither.csv")], experiments.PAIRS)
    return experiments.read_experiments(spark, raw, protocols, pairs.select(missing.columns).unionByName(missing))


@query(
    f"""with {_EXPERIMENTS} select plate::varchar as experiment, 'A' || k as well, case when k < 12 then 'S' || (plate % 7) || 'x' || k end as strain,
      case when k < 12 and plate % 2 = 1 then k::double end as "total_volume_uL", t as time_h, case when t = 0 then round(v, 6) else c::double end as od
    from u, unnest([0.0::double, 1.5::double]) as x(t) where plate % 5 not in (1, 2)"""
)
def parse_experiments(spark, sf_dir):
    """Many plates in one job, each with the protocol of its own; broken ones are left out."""
    done = _experiments(spark, sf_dir).parsed
    return done.select("experiment", "well", "strain", "total_volume_uL", "time_h", r6("od", "od"))


@query(
    f"""with {_EXPERIMENTS}, p as (select distinct plate from u)
    select plate::varchar as experiment, 'raws' as kind, 'no line starts with ' || chr(39) || 'Well Row,Well Col,Content,Raw Data' || chr(39) as error from p where plate % 5 = 1
    union all select plate::varchar, 'protocols', 'the section "Experiment Data" has no column "Well"' from p where plate % 5 = 2
    union all select 'none', '', 'no such file' union all select 'none', '', 'no such file'"""
)
def experiment_errors(spark, sf_dir):
    """What is wrong with the others."""
    errors = _experiments(spark, sf_dir).errors
    return errors.select("experiment", F.regexp_extract("file", "/(raws|protocols)-", 1).alias("kind"), "error")


def model_file(spark: SparkSession, sf_dir: str) -> str:
    """Parts as reactions of a model: every third exchanges nothing; bounds by name, by the law's own parameters, or none."""
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    bound = F.when(k % 4 == 1, text(' fbc:upperFluxBound="b', k, '"')).otherwise("")
    law = F.when(
        k % 4 == 2, text('<kineticLaw><listOfLocalParameters><localParameter id="low" value="-5"/><localParameter id="UPPER_BOUND" value="', F.col("p_size"), '"/></listOfLocalParameters></kineticLaw>')
    ).otherwise("")
    kind = F.when(k % 3 == 0, "R_tr_").otherwise("R_EX_")
    part = table(spark, sf_dir, "part").select(
        k.alias("k"),
        text('<species id="s', k, '" name="', F.col("p_name"), " ", k, '_e"/>').alias("species"),
        text('<parameter id="b', k, '" value="', F.when(k % 8 == 1, "INF").otherwise((F.col("p_retailprice") * 12).cast("string")), '"/>').alias("parameter"),
        text('<reaction id="', kind, "p", k, '_e"', bound, '><listOfReactants><speciesReference species="s', k, '"/></listOfReactants>', law, "</reaction>").alias("reaction"),
    )
    big = 1 << 40
    lines = part.select(
        F.inline(F.array(*[F.struct((F.col("k") + 1 + i * big).alias("n"), F.col(c).alias("line")) for i, c in enumerate(("parameter", "species", "reaction"))]))
    )
    begin = '<sbml xmlns:fbc="http://www.sbml.org/sbml/level3/version1/fbc/version2"><model>'
    return _write_model(lines, folder(spark, "model"), begin, "</model></sbml>")


@query("""select lower(p_name) || ' ' || p_partkey as name, 'EX_p' || p_partkey || '_e' as exchange_reaction from part where p_partkey % 3 <> 0""")
def sbml_exchanges(spark, sf_dir):
    return sbml.read_exchanges(spark, model_file(spark, sf_dir))


@query(
    """select 'EX_p' || p_partkey || '_e' as exchange_reaction, 1 as level, case when p_partkey % 8 = 1 then 1000
      when p_partkey % 4 = 1 then case when p_retailprice * 12 > 10000 then 1000 else trunc(p_retailprice * 12)::int end when p_partkey % 4 = 2 then p_size else 1000 end as max_value
    from part where p_partkey % 3 <> 0"""
)
def sbml_bounds(spark, sf_dir):
    return sbml.read_bounds(spark, model_file(spark, sf_dir))


@query(
    """select lower(p_name) || ' ' || p_partkey as name, 'EX_p' || p_partkey || '_e' as exchange_reaction from part where p_partkey % 2 = 0
    union all select 'q' || p_partkey, 'EX_p' || p_partkey || '_e' from part where p_partkey % 2 = 1"""
)
def sbml_fallback(spark, sf_dir):
    """A model without names of species: reactions with a species have its id as key, those without have their own name."""
    k = F.col("p_partkey")
    species = F.when(k % 2 == 1, F.concat(F.lit('<listOfReactants><speciesReference species="q'), k.cast("string"), F.lit('"/></listOfReactants>'))).otherwise("")
    line = F.concat(F.lit('<reaction id="R_EX_p'), k.cast("string"), F.lit('_e" name="'), "p_name", F.lit(" "), k.cast("string"), F.lit('_e">'), species, F.lit("</reaction>"))
    lines = table(spark, sf_dir, "part").select(k.cast("long").alias("n"), line.alias("line"))
    return sbml.read_exchanges(spark, _write_model(lines, folder(spark, "model"), "<sbml><model>", "</model></sbml>"))


@query("select n_name as name, case when n_regionkey > 0 then 'iupac ' || n_nationkey end as iupac_name, 'EX_' || n_nationkey || '_e' as exchange_reaction from nation")
def name_exchanges(spark, sf_dir):
    """A static table of names and exchanges, as a file."""
    k = F.col("n_nationkey").cast("string")
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("iupac "), k)).alias("iupac_name"), F.concat(F.lit("EX_"), k, F.lit("_e")).alias("exchange_reaction")
    )
    path = folder(spark, "names")
    sinks.write_folder(rows, path)
    return exchanges.read_name_exchanges(spark, path)


@query(
    """with r as (select c_mktsegment as strain, c_name as name, c_acctbal as bal, 'customers' as experiment from customer
      union all select s_name, s_name, s_acctbal, 'suppliers' from supplier)
    select regexp_extract(strain, '[A-Za-z]+') as file, experiment, name, round(bal, 6) as bal from r"""
)
def collate_by_pattern(spark, sf_dir):
    root = folder(spark, "collate")
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("strain"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("strain"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    for experiment, rows in (("customers", customers), ("suppliers", suppliers)):
        sinks.write_folder(rows, f"{root}/{experiment}/growth.csv")
    written = sinks.collate_by_group(spark, [f"{root}/customers", f"{root}/suppliers"], "growth.csv", pattern="[A-Za-z]+", output=f"{root}/out")
    files = tables.read_csv(spark, [r["output_file"] for r in written.collect()], "strain string, name string, bal double, experiment string")
    file = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/report.csv$", 1)
    return files.select(file.alias("file"), "experiment", "name", r6("bal", "bal"))


@query(
    """with r as (select c_mktsegment as strain, c_name as name, c_acctbal as bal, 'first' as experiment from customer where c_custkey % 3 <> 0
      union all select c_mktsegment, c_name, c_acctbal, 'second' from customer where c_custkey % 3 = 0
      union all select s_name, s_name, s_acctbal, 'second' from supplier)
    select regexp_extract(strain, '[A-Za-z]+') as file, experiment, name, round(bal, 6) as bal from r"""
)
def shipped_collate(spark, sf_dir):
    """The shipped plan that puts the growth tables of experiments together, a file for each strain."""
    root = folder(spark, "shipped")
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("strain"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), "c_custkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("strain"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    third = F.col("c_custkey") % 3 == 0
    for experiment, rows in (("first", customers.where(~third).drop("c_custkey")), ("second", customers.where(third).drop("c_custkey").unionByName(suppliers))):
        sinks.write_folder(rows, f"{root}/in/{experiment}/growth_rates.csv")
    build_shipped("models.yaml", "collate_per_strain_pipeline", output_dir=f"{root}/out", sources={"folders_list": f"{root}/in"}).run(spark)
    written = tables.read_csv(spark, f"{root}/out/report.csv", "output_file string")
    files = tables.read_csv(spark, [r["output_file"] for r in written.collect()], "strain string, name string, bal double, experiment string")
    file = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/report.csv$", 1)
    return files.select(file.alias("file"), "experiment", "name", r6("bal", "bal"))


@query(
    """with e as (select user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9 as t, value as v from events),
    b as (select *, min(t) over (partition by user_id) as t0, max(t) over (partition by user_id) as t1 from e),
    x as (select *, case when t1 > t0 then floor((t - t0) / (t1 - t0) * 570)::int else 0 end as x from b where t is not null and v is not null and isfinite(v)),
    r as (
      select *, row_number() over (partition by user_id, x order by t, v) as n1, row_number() over (partition by user_id, x order by t desc, v desc) as n2,
        row_number() over (partition by user_id, x order by v, t) as n3, row_number() over (partition by user_id, x order by v desc, t desc) as n4 from x
    )
    select distinct user_id, round(t, 6) as t, round(v, 6) as v from r where least(n1, n2, n3, n4) = 1"""
)
def written_plots(spark, sf_dir):
    """What plots of each user's values show, written and read back: a file per plot, whose circles are counted and placed."""
    series = event_series(spark, sf_dir)
    root = folder(spark, "plots")
    sinks.write_files(sinks.svg_plots(series, ["user_id"], "t", "v").select("file_name", "svg"), root)
    drawn = spark.read.text(root, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]+)[.]svg$", 1).cast("long").alias("user_id"), F.regexp_count("value", F.lit("<circle")).alias("n")
    )
    shown = sinks.plot_points(series, ["user_id"], "t", "v").join(drawn, "user_id").where(F.col("n") == F.size("points"))
    return shown.select("user_id", F.explode("points").alias("p")).select("user_id", r6("p.t", "t"), r6("p.v", "v")).distinct()


@query("select p_partkey, p_name, p_brand, p_size, round(p_retailprice, 6) as p_retailprice from part")
def written_table(spark, sf_dir):
    """A table as one CSV file under its name, read back with inferred types."""
    path = folder(spark, "table") + ".csv"
    sinks.write_output(table(spark, sf_dir, "part").drop("p_type"), path)
    done = tables.read_csv(spark, path)
    return done.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", "p_size", r6("p_retailprice", "p_retailprice"))


PLAN = """
pipelines:
  - rates:
      Inputs:
        - readings: [{src: none}, {package: tables}, {method: read_csv}, {schema: "user_id long, t double, v double, event_id long"}]
      Processes:
        - logs: {package: growth_rates, method: transform_to_log_n_n0, parameters: {df: readings, value_col: v, transformed_col: y, group_cols: [user_id], time_col: t, OD_0_averaging_window: 4, ties: [event_id]}}
        - rates: {package: growth_rates, method: fit_max_growth_rate_per_series, parameters: {df: logs, time_col: t, value_col: y, group_cols: [user_id], smoothing_iterations: 1, metadata: [], ties: [event_id]}}
        - raw: {package: utils, method: smart_join, parameters: {left_df: rates, right_df: rates, on_cols: [user_id]}}
      Outputs:
        - raw: rates.parquet/
"""


@query(
    """with ts as (select user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9 as t, value as v, event_id from events), nb as (
      select *, row_number() over (partition by user_id order by t, event_id) as rn from ts
    ), b as (
      select *, avg(v) filter (rn <= 4) over (partition by user_id) as n0 from nb
    ), lg as (
      select user_id, t, event_id, n0, ln(v / n0) as y from b where n0 > 0 and v > 0
    ), s0 as (
      select *, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by t, event_id) as k from lg
    ), s1 as (
      select user_id, t, event_id, n0, n, case when k > 2 and k <= n - 2 then (sum(y) over w - max(y) over w - min(y) over w) / 3 else y end as y
      from s0 window w as (partition by user_id order by t, event_id rows between 2 preceding and 2 following)
    ), g as (
      select user_id, any_value(n) as n, any_value(n) >= 5 and max(y) - min(y) > exp(0.1) as ok, max(exp(y) * n0) as top from s1 group by user_id
    ), m as (
      select user_id, case when count(*) over w = 5 then regr_slope(y, t) over w end as slope from s1 window w as (partition by user_id order by t, event_id rows between current row and 4 following)
    ), f as (select user_id, max(slope) as slope from m group by user_id)
    select user_id, coalesce(n, 0)::int as n, coalesce(ok, false) as success, round(case when ok then slope end, 6) as mv_mu_max, round(case when ok then top end, 6) as max_value
    from (select distinct user_id from events) left join g using (user_id) left join f using (user_id)"""
)
def plan_rates(spark, sf_dir):
    """A YAML plan from files to a folder: logarithms, rates, and a join of equal tables."""
    root = folder(spark, "plan")
    sinks.write_folder(event_series(spark, sf_dir), f"{root}/in")
    build(PLAN, "rates", f"{root}/out", {"readings": f"{root}/in"}).run(spark)
    done = spark.read.parquet(f"{root}/out/rates.parquet")
    return done.select("user_id", "n", "success", r6("mv_mu_max", "mv_mu_max"), r6("max_value", "max_value"))


RUNS = """
pipelines:
  - runs:
      Inputs:
        - readings: [{src: none}, {package: tables}, {method: read_csv}, {schema: "user_id long, t double, v double, event_id long"}]
      Processes:
        - runs: {package: tables, method: table_function, parameters: {df: readings, function: rising_runs, partition_by: [user_id], order_by: [t, event_id], key: user_id, value: v}}
      Outputs:
        - runs: runs.parquet/
"""

_RUNS = """with e as (select user_id, ts, event_id, value as v from events where value is not null),
    s as (select *, case when v >= lag(v) over w then 0 else 1 end as first from e window w as (partition by user_id order by ts, event_id)),
    r as (select *, sum(first) over (partition by user_id order by ts, event_id rows unbounded preceding)::int as run from s)
    select user_id as series, run, count(*) as n, round(min(v), 6) as first_value, round(max(v), 6) as last_value from r group by 1, 2"""


@query(_RUNS)
def rising_runs_of_plan(spark, sf_dir):
    """A plan calls a table function on groups of a table."""
    root = folder(spark, "runs")
    sinks.write_folder(event_series(spark, sf_dir), f"{root}/in")
    build(RUNS, "runs", f"{root}/out", {"readings": f"{root}/in"}).run(spark)
    return _rounded_runs(spark.read.parquet(f"{root}/out/runs.parquet"))


@query(_RUNS)
def rising_runs_of_sql(spark, sf_dir):
    """SQL calls the same table function by its name."""
    use_table_functions(spark)
    event_series(spark, sf_dir).createOrReplaceTempView("_readings")
    called = "rising_runs(table(select * from _readings) partition by user_id order by (t, event_id), key => 'user_id', value => 'v')"
    return _rounded_runs(spark.sql(f"select * from {called}"))


def _rounded_runs(runs: DataFrame) -> DataFrame:
    return runs.select("series", "run", "n", r6("first_value", "first_value"), r6("last_value", "last_value"))
