"""The registered queries of the growth-analytics operators and their DuckDB oracles.

Each query applies an operator to whole tables. ``events`` stands in for growth series (series: user,
time: hours since 2024-01-01), users for wells of a plate (8 rows), TPC-H-like tables for metadata,
mappings and matrices. Floating-point results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxograph import catalogue_files
from auxograph.functions import chemistry, growth, time_labels, values
from auxograph.operators import gompertz, joins, mapping, matrices, plates, ranking, series
from auxograph.registered import HOURS, ORACLES, QUERIES, Query, event_series, folder, query, r6, table
from auxograph.sources.compounds import Compound, CompoundTable
from auxograph.sources.exchanges import MINIMAL_MEDIUM, supplement_exchanges
from auxograph.sources.protocol import sections
from auxograph.streaming import growth as live_growth
from auxograph.streaming import live

__all__ = ["catalogue_files", "queries", "oracle_sql"]


def queries() -> dict[str, Query]:
    """Each query by name; called with (spark, folder of the tables)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the rows of the query of the same name."""
    return dict(ORACLES)


# Series of events

_TS = "ts as (select user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9 as t, value as v, event_id from events)"
_LOG = f"""{_TS}, nb as (
  select *, row_number() over (partition by user_id order by t, event_id) as rn from ts
), b as (
  select *, avg(v) filter (rn <= 4) over (partition by user_id) as n0 from nb
), lg as (
  select *, case when n0 > 0 and v > 0 then ln(v / n0) end as y from b
)"""


def log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.log_ratio(event_series(spark, sf_dir), "v", "y", ["user_id"], "t", 4, "n0", ["event_id"])


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the value of one curve at its time."""
    rows = event_series(spark, sf_dir)
    params = rows.select("user_id").distinct().select("user_id", F.lit(0.05).alias("y0"), F.lit(2.0).alias("A"), F.lit(0.4).alias("mu_max"), F.lit(3.0).alias("lambda"))
    return gompertz.predict_gompertz(rows, params, "t", "v", ["user_id"], fitted="fitted")


def _smooth_sql(times: int) -> str:
    parts = ["s0 as (select user_id, t, event_id, v as y, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by t, event_id) as rn from ts)"]
    for i in range(times):
        w = "(partition by user_id order by t, event_id rows between 2 preceding and 2 following)"
        parts.append(
            f"s{i + 1} as (select user_id, t, event_id, n, rn, case when rn > 2 and rn <= n - 2 then (sum(y) over {w} - max(y) over {w} - min(y) over {w}) / 3 else y end as y from s{i})"
        )
    return ", ".join(parts)


@query(
    f"""with {_TS} select event_id, round(case when count(*) over w = 5 then regr_slope(v, t) over w end, 6) as slope,
    round(case when count(*) over w = 5 then case when regr_syy(v, t) over w = 0 then 0 else regr_r2(v, t) over w end end, 6) as r2
    from ts window w as (partition by user_id order by t, event_id rows between current row and 4 following)"""
)
def moving_window_slope(spark, sf_dir):
    done = series.moving_slope(event_series(spark, sf_dir), "v", ["user_id"], "t", 5, ["event_id"])
    return done.select("event_id", r6("slope", "slope"), r6("slope_r2", "r2"))


_MAX_RATE = f"""with {_LOG}, u as (
  select user_id, t, event_id, y, n0 from lg where y is not null and n0 is not null
), s0 as (
  select *, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by t, event_id) as k from u
), {", ".join(
    f"s{i + 1} as (select user_id, t, event_id, n0, n, k, case when k > 2 and k <= n - 2 then (sum(y) over w - max(y) over w - min(y) over w) / 3 else y end as y "
    f"from s{i} window w as (partition by user_id order by t, event_id rows between 2 preceding and 2 following))" for i in range(4)
)}, m as (
  select *, case when count(*) over w = 5 then regr_slope(y, t) over w end as slope,
         case when count(*) over w = 5 then case when regr_syy(y, t) over w = 0 then 0 else regr_r2(y, t) over w end end as r2,
         case when count(*) over w = 5 then sqrt(greatest(0, regr_syy(y, t) over w - power(regr_sxy(y, t) over w, 2) / regr_sxx(y, t) over w) / 5) end as rmse,
         max(y) over (partition by user_id) - min(y) over (partition by user_id) as span
  from s4 window w as (partition by user_id order by t, event_id rows between current row and 4 following)
), best as (
  select *, row_number() over (partition by user_id order by slope desc nulls last, t) as rn from m
), top as (
  select user_id, exp(y) * n0 as max_value, t as max_time, row_number() over (partition by user_id order by round(y, 12) desc, t) as rn from s4
), found as (
  select best.user_id, best.n, best.n >= 5 and best.span > exp(0.1) as ok, slope, r2, rmse, best.t as began, max_value, max_time
  from best join top using (user_id) where best.rn = 1 and top.rn = 1
)
select user_id, coalesce(n, 0)::int as n, coalesce(ok, false) as success, case when ok then 'ok' else 'insufficient or flat data' end as message,
  round(case when ok then slope end, 6) as mv_mu_max, round(case when ok then r2 end, 6) as mv_r2, round(case when ok then rmse end, 6) as mv_rmse,
  round(case when ok then began end, 6) as window_start, round(case when ok then max_value end, 6) as max_value, round(case when ok then max_time end, 6) as max_time
from (select distinct user_id from events) left join found using (user_id)"""

_RATES = ("mv_mu_max", "mv_r2", "mv_rmse", "window_start", "max_value", "max_time")


@query(_MAX_RATE)
def max_growth_rate(spark, sf_dir):
    fits = series.max_growth_rate(log_series(spark, sf_dir), "t", "y", ["user_id"], window=5, smoothing=4, metadata=[], ties=["event_id"])
    return fits.select("user_id", "n", "success", "message", *[r6(c, c) for c in _RATES])


@query(f"with {_LOG} select event_id, round(n0, 6) as n0, round(y, 6) as y from lg")
def baseline_log_ratio(spark, sf_dir):
    return log_series(spark, sf_dir).select("event_id", r6("n0", "n0"), r6("y", "y"))


@query(f"with {_TS}, {_smooth_sql(1)} select event_id, round(y, 6) as y from s1")
def trimmed_smoothing(spark, sf_dir):
    return series.smoothed(event_series(spark, sf_dir), "v", ["user_id"], "t", "y", 2, 1, ["event_id"]).select("event_id", r6("y", "y"))


@query(f"with {_TS}, {_smooth_sql(4)} select event_id, round(y, 6) as y from s4")
def trimmed_smoothing_4(spark, sf_dir):
    return series.smoothed(event_series(spark, sf_dir), "v", ["user_id"], "t", "y", 2, 4, ["event_id"]).select("event_id", r6("y", "y"))


@query(
    f"""with {_LOG}, g as (select user_id, count(y) as n, max(y) - min(y) as span from lg group by user_id)
    select user_id, n, round(span, 6) as value_range, n >= 5 and coalesce(span, 0) > exp(0.1) as usable,
    case when n >= 5 and coalesce(span, 0) > exp(0.1) then '' else 'insufficient or flat data' end as message from g"""
)
def series_quality_gate(spark, sf_dir):
    gate = series.quality_gate(log_series(spark, sf_dir), "y", ["user_id"])
    return gate.select("user_id", "n", r6("value_range", "value_range"), "usable", "message")


@query(
    f"""with {_LOG}, d as (
      select *, (lead(y) over w - y) / nullif(lead(t) over w - t, 0) as slope from lg where y is not null window w as (partition by user_id order by t, event_id)
    ), p as (
      select user_id, quantile_cont(y, 0.05) as y0, quantile_cont(y, 0.95) as p95, max(slope) as top, min(t) as t0, max(t) as t1, max(y) as y1 from d group by user_id
    ), l as (
      select d.user_id, min(d.t) as lag from d join p using (user_id) where d.slope = p.top group by d.user_id
    )
    select user_id, round(greatest(0, least(greatest(2, 2 * y1), y0)), 6) as y0_start, round(greatest(1e-5, least(greatest(1e-3, 2 * y1), greatest(p95 - y0, 1e-3))), 6) as "A_start",
           round(least(10, coalesce(greatest(top, 1e-3), 0.1)), 6) as mu_max_start, round(greatest(0, least(1.5 * t1 + 1, coalesce(lag, t0))), 6) as lambda_start,
           0.0::double as y0_lower, 1e-5::double as "A_lower", 1e-5::double as mu_max_lower, 0.0::double as lambda_lower,
           round(greatest(2, 2 * y1), 6) as y0_upper, round(greatest(1e-3, 2 * y1), 6) as "A_upper", 10.0::double as mu_max_upper, round(1.5 * t1 + 1, 6) as lambda_upper
    from p left join l using (user_id)"""
)
def initial_guess(spark, sf_dir):
    found = gompertz.initial_guesses(log_series(spark, sf_dir), "t", "y", ["user_id"], ties=["event_id"])
    return found.where("n > 0").select("user_id", *[r6(f"{p}_{k}", f"{p}_{k}") for k in ("start", "lower", "upper") for p in gompertz.PARAMETERS])


@query(
    f"""with {_TS} select event_id, round(0.05 + 2.0 * exp(-exp(greatest(-50, least(50, 0.4 * exp(1) / 2.0 * (3.0 - t) + 1)))), 6) as fitted,
    round(v - (0.05 + 2.0 * exp(-exp(greatest(-50, least(50, 0.4 * exp(1) / 2.0 * (3.0 - t) + 1))))), 6) as residual from ts"""
)
def gompertz_predict(spark, sf_dir):
    return predicted(spark, sf_dir).select("event_id", r6("fitted", "fitted"), r6("residual", "residual"))


@query(
    f"""with {_LOG}, g as (
      select user_id, count(*) as n, max(y) - min(y) > exp(0.1) and count(*) >= 5 as ok, arg_max(t, (y, -t)) as top, max(y) as y, any_value(n0) as n0
      from lg where y is not null group by user_id
    ) select user_id, coalesce(n, 0)::int as n, coalesce(ok, false) as success, case when ok then 'ok' else 'insufficient or flat data' end as message,
      case when ok then 0.0::double end as y0, round(case when ok then exp(y) * n0 end, 6) as max_value, round(case when ok then top end, 6) as max_time, ok as within_bounds
    from (select distinct user_id from events) left join g using (user_id)"""
)
def gompertz_fit(spark, sf_dir):
    # these series are no growth curves, so their parameters have no closed form: gompertz_recovery compares parameters
    fits = gompertz.fit_gompertz(log_series(spark, sf_dir), "t", "y", ["user_id"], fixed={"y0": 0.0}, metadata=[], ties=["event_id"])
    inside = F.col("A").between(1e-5, F.greatest(F.lit(1e-3), 2 * F.ln("max_value") + 40)) & F.col("mu_max").between(1e-5, 10.0) & (F.col("lambda") >= 0) & (F.col("rmse") >= 0)
    return fits.select("user_id", "n", "success", "message", "y0", r6("max_value", "max_value"), r6("max_time", "max_time"), inside.alias("within_bounds"))


_PLANTED = "0.25 * (user_id % 4) as y0, 1.5 + 0.25 * (user_id % 7) as a, 0.2 + 0.05 * (user_id % 9) as mu, 1 + 0.5 * (user_id % 5) as lag"


@query(
    f"""with u as (select distinct user_id from events), p as (select user_id, {_PLANTED} from u)
    select user_id, 97 as n, true as success, y0::double as y0, a::double as "A", mu::double as mu_max, lag::double as "lambda", 1.0::double as r2, 0.0::double as rmse from p"""
)
def gompertz_recovery(spark, sf_dir):
    """Curves of known parameters, a point every quarter of an hour: the fit must find them, whatever it starts from."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().selectExpr("user_id", *_PLANTED.split(", "))
    points = users.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(96)))).withColumn("t", F.col("t") / 4)
    rows = points.withColumn("y", growth.gompertz("t", "y0", "a", "mu", "lag")).select("user_id", "t", "y")
    fits = gompertz.fit_gompertz(rows, "t", "y", ["user_id"], log_transformed=False, metadata=[])
    r4 = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return fits.select("user_id", "n", "success", *[r4(c) for c in (*gompertz.PARAMETERS, "r2", "rmse")])


@query(
    f"""with {_TS}, f as (select user_id, v, 0.05 + 2.0 * exp(-exp(greatest(-50, least(50, 0.4 * exp(1) / 2.0 * (3.0 - t) + 1)))) as fitted from ts)
    select user_id, count(*)::int as n, round(1 - sum((v - fitted) ** 2) / nullif(regr_syy(v, 0), 0), 6) as r2,
    round(sqrt(sum((v - fitted) ** 2) / greatest(1, count(*) - 4)), 6) as rmse from f group by user_id"""
)
def fit_quality_r2_rmse(spark, sf_dir):
    return gompertz.fit_quality(predicted(spark, sf_dir), "v", "fitted", ["user_id"], 4).select("user_id", "n", r6("r2", "r2"), r6("rmse", "rmse"))


@query(
    f"""with {_TS} select event_id, round((lead(v) over w - v) / nullif(lead(t) over w - t, 0), 6) as difference from ts
    window w as (partition by user_id order by t, event_id)"""
)
def first_difference(spark, sf_dir):
    return series.differences(event_series(spark, sf_dir), "v", ["user_id"], "t", ties=["event_id"]).select("event_id", r6("difference", "difference"))


# Plates: users as wells, whole days as times

_PLATE = """plate as (
  select chr((65 + user_id % 8)::int) as well_row, (user_id // 8 + 1)::int as well_col, chr((65 + user_id % 8)::int) || (user_id // 8 + 1) as well,
         (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 86400000000 as time_h, value as od,
         ['SLAB', 'WT', 'BLANK'][(user_id % 3 + 1)::int] || user_id as strain, event_type as content
  from events where user_id < {users}
)"""


def plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    row = F.char(65 + F.col("user_id") % 8)
    column = (F.floor(F.col("user_id") / 8) + 1).cast("int")
    strain = F.concat(F.element_at(F.array(F.lit("SLAB"), F.lit("WT"), F.lit("BLANK")), (F.col("user_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"))
    return events.select(
        row.alias("well_row"),
        column.alias("well_col"),
        F.concat(row, column.cast("string")).alias("well"),
        F.floor(F.expr(HOURS) / 24).alias("time_h"),
        F.col("value").alias("od"),
        strain.alias("strain"),
        F.col("event_type").alias("content"),
    )


def _stats(df: DataFrame, *lead: str) -> DataFrame:
    return df.select(*lead, "group_id", "wells", "well_rows", "well_cols", r6("od_mean", "od_mean"), r6("od_std", "od_std"), "n_replicates", F.col("time_h").cast("long").alias("time_h"))


def _replicates_sql(order: str, size: int, std: str, alphabetical: bool) -> str:
    label = "w[1][1] || '_' || case when lo = hi then lo::varchar else lo || '-' || hi end" if alphabetical else "list_aggregate(list_transform(w, lambda x: x[1]), 'string_agg', '') || '_' || regexp_extract(w[1], '[0-9]+$')"
    return f"""with {_PLATE.replace(" where user_id < {users}", "")}, wells as (
      select well, well_row, well_col, row_number() over (order by {order}) - 1 as place from (select distinct well, well_row, well_col from plate)
    ), g as (
      select well, place, well_col as wcol, place // {size} as num from wells
    ), m as (
      select num, list(well order by place) as w, min(wcol) as lo, max(wcol) as hi from g group by num
    ), st as (
      select num, time_h, string_agg(distinct well, ',' order by well) as wells, string_agg(distinct well_row, ',' order by well_row) as well_rows,
             string_agg(distinct well_col::varchar, ',' order by well_col::varchar) as well_cols, round(avg(od), 6) as od_mean, round({std}(od), 6) as od_std, count(od) as n_replicates
      from plate join g using (well) group by num, time_h
    )
    select {label} as group_id, wells, well_rows, well_cols, od_mean, od_std, n_replicates, time_h from st join m using (num)"""


@query(_replicates_sql("well_row, well_col", 1, "stddev_samp", True))
def replicate_stats_single(spark, sf_dir):
    return _stats(plates.replicates_by_well(plate(spark, sf_dir), "alphabetical", 1, 1))


def _group_size(df: DataFrame) -> int:
    """The least divisor over 1 of the number of wells, so that whole plates of any size can be grouped."""
    n = df.select("well").distinct().count()
    return next((k for k in (2, 3, 5, 7) if n % k == 0), 1)


_SIZE = "case when n % 2 = 0 then 2 when n % 3 = 0 then 3 when n % 5 = 0 then 5 when n % 7 = 0 then 7 else 1 end"


def _sized(sql: str) -> str:
    return sql.replace("place // 0 as num", f"place // (select {_SIZE} from (select count(*) as n from wells)) as num")


@query(_sized(_replicates_sql("well_row, well_col", 0, "stddev_samp", True)))
def replicate_stats_alphabetical(spark, sf_dir):
    rows = plate(spark, sf_dir)
    return _stats(plates.replicates_by_well(rows, "alphabetical", _group_size(rows), 1))


@query(_sized(_replicates_sql("well_col, well_row", 0, "stddev_pop", False)))
def replicate_stats_numerical_ddof0(spark, sf_dir):
    rows = plate(spark, sf_dir)
    return _stats(plates.replicates_by_well(rows, "numerical", _group_size(rows), 0))


@query(
    f"""with {_PLATE.replace(" where user_id < {users}", "")}, p as (
      select *, regexp_extract(strain, '[A-Za-z]+') as grp from plate where regexp_extract(strain, '[A-Za-z]+') in ('SLAB', 'WT')
    ), wells as (
      select *, count(*) over (partition by grp) as n, row_number() over (partition by grp order by case when grp = 'SLAB' then well_row end, well_col, well_row) - 1 as place
      from (select distinct grp, well, well_row, well_col from p)
    ), g as (
      select *, place // ({_SIZE}) as num from wells
    ), m as (
      select grp, num, list(well order by place) as w, min(well_col) as lo, max(well_col) as hi from g group by grp, num
    )
    select p.grp as strain, case when p.grp = 'SLAB' then w[1][1] || '_' || case when lo = hi then lo::varchar else lo || '-' || hi end
        else list_aggregate(list_transform(w, lambda x: x[1]), 'string_agg', '') || '_' || regexp_extract(w[1], '[0-9]+$') end as group_id,
      string_agg(distinct p.well, ',' order by p.well) as wells, string_agg(distinct p.well_row, ',' order by p.well_row) as well_rows,
      string_agg(distinct p.well_col::varchar, ',' order by p.well_col::varchar) as well_cols,
      round(avg(od), 6) as od_mean, round(stddev_pop(od), 6) as od_std, count(od) as n_replicates, time_h
    from p join g on g.well = p.well join m on m.grp = g.grp and m.num = g.num group by p.grp, g.num, w, lo, hi, time_h"""
)
def replicate_stats_custom_rules(spark, sf_dir):
    rows = plate(spark, sf_dir)
    size = lambda s: _group_size(rows.where(F.startswith("strain", F.lit(s))))
    rules = {"SLAB": {"direction": "alphabetical", "sample_size": size("SLAB")}, "WT": {"direction": "numerical", "sample_size": size("WT")}}
    return _stats(plates.replicates_by_rules(rows, "[A-Za-z]+", rules, 0), "strain")


@query(
    f"""with {_PLATE.replace(" where user_id < {users}", "")}, p as (
      select * replace (case when content in ('view', 'login') then 'WT' else 'SLAB' end as strain) from plate
    ), wells as (
      select *, row_number() over (partition by strain order by case when strain = 'SLAB' then well_row end, well_col, well_row) - 1 as place
      from (select distinct strain, well, well_row, well_col from p)
    )
    select strain, case when strain = 'SLAB' then well_row || '_' || well_col else well_row || '_' || well_col end as group_id, well as wells, well_row as well_rows, well_col::varchar as well_cols,
      round(avg(od), 6) as od_mean, round(stddev_pop(od), 6) as od_std, count(od) as n_replicates, time_h
    from p join wells using (strain, well, well_row, well_col) group by strain, well, well_row, well_col, time_h"""
)
def replicate_stats_two_strains(spark, sf_dir):
    """Every well is under two strains, with rules of their own."""
    rows = plate(spark, sf_dir).withColumn("strain", F.when(F.col("content").isin("view", "login"), "WT").otherwise("SLAB"))
    rules = {"SLAB": {"direction": "alphabetical", "sample_size": 1}, "WT": {"direction": "numerical", "sample_size": 1}}
    return _stats(plates.replicates_by_rules(rows, "[A-Za-z]+", rules, 0), "strain")


EVENT_TYPES = ["click", "login", "logout", "purchase", "view"]


@query(
    """select user_id, """ + ", ".join(f"""coalesce(bool_or(event_type = '{e}'), false)::int as "EX_{e}" """ for e in EVENT_TYPES) + """, 1 as "EX_water", count(*) as n from events group by user_id"""
)
def long_to_wide_matrix(spark, sf_dir):
    """Types of events as supplements of a user."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws(" ; ", F.collect_set("event_type")).alias("supplements"), F.count("*").alias("n"))
    exchanges = spark.createDataFrame([(e, f"EX_{e}") for e in EVENT_TYPES], "name string, exchange_reaction string")
    rows = users.withColumn("both", F.struct("user_id", "n"))
    return matrices.supplement_matrix(rows, exchanges, ["EX_water"], growth_rate="both").select("both.user_id", "EX_water", *[f"EX_{e}" for e in EVENT_TYPES], "both.n")


@query(
    """with l as (select event_id, case event_id % 5 when 0 then (event_id % 30) || ' h ' || (event_id % 70) || ' min' when 1 then (event_id % 30) || ' h'
       when 2 then (event_id % 90) || ' min' when 3 then 'n/a' else '' end as label from events), p as (
      select event_id, label, regexp_matches(label, '^\\s*(?:(\\d+)\\s*h)?\\s*(?:(\\d+)\\s*min)?\\s*$') as ok,
        coalesce(nullif(regexp_extract(label, '(\\d+)\\s*h', 1), '')::int, 0) * 60 + coalesce(nullif(regexp_extract(label, '(\\d+)\\s*min', 1), '')::int, 0) as m from l)
    select event_id, label, case when ok then round(m // 60 + (m % 60) / 60.0, 6) end as time_h, case when ok then m // 60 end as time_h_int,
           case when ok then m % 60 end as time_min_int, case when ok then m::double end as time_min from p"""
)
def time_label_parse(spark, sf_dir):
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    label = (
        F.when(e % 5 == 0, F.concat(text(e % 30), F.lit(" h "), text(e % 70), F.lit(" min")))
        .when(e % 5 == 1, F.concat(text(e % 30), F.lit(" h")))
        .when(e % 5 == 2, F.concat(text(e % 90), F.lit(" min")))
        .when(e % 5 == 3, "n/a")
        .otherwise("")
    )
    return time_labels.with_time(table(spark, sf_dir, "events").select("event_id", label.alias("label")), "label").select(
        "event_id", "label", r6("time_h", "time_h"), "time_h_int", "time_min_int", r6("time_min", "time_min")
    )


@query("select event_id, round(try_cast(trim(json_extract_string(props, '$.k')) as double), 6) as k, try_cast(event_type as double) as bad from events")
def numeric_coercion(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", r6(values.number(F.get_json_object("props", "$.k")), "k"), values.number("event_type").alias("bad"))


@query("select event_id, user_id, value, c_name, c_mktsegment from events left join customer on user_id = c_custkey")
def metadata_left_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "value")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment")
    return joins.many_to_one(events, customers, ["key"]).select("event_id", F.col("key").alias("user_id"), "value", "c_name", "c_mktsegment")


@query(
    """with e as (select distinct 'U' || user_id as well from events), c as (select 'U' || c_custkey as well from customer),
    a as (select well from e except select well from c), b as (select well from c except select well from e)
    select * from (
      select 'wells_missing_in_metadata' as issue, count(*)::int as count, array_to_string(list_slice(list(well order by well), 1, 96), ';') as wells from a
      union all select 'wells_missing_in_raw', count(*)::int, array_to_string(list_slice(list(well order by well), 1, 96), ';') from b
      union all select 'non_numeric_od_values', count(*)::int, null from events where value is null
    ) where count > 0"""
)
def qc_report(spark, sf_dir):
    readings = table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("well"), F.col("value").alias("od"))
    protocol = table(spark, sf_dir, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("well"))
    return plates.report(readings, protocol)


# Joins and sets

@query("select p_partkey, p_brand, p_size, p_size % 7 as p_size_right from part")
def smart_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    right = part.select("p_partkey", "p_brand", (F.col("p_size") % 7).alias("p_size"))
    return joins.smart_join(part.select("p_partkey", "p_brand", "p_size"), right, ["p_partkey"])


@query("select o_orderkey, c_custkey, o_orderpriority as label, c_name from orders join customer on o_custkey = c_custkey")
def smart_join_drop_right(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("label"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"), "c_name")
    return joins.smart_join_drop_right(orders, customers, ["c_custkey"])


@query(
    """select o_orderkey, o_totalprice, l_linenumber, l_quantity from orders left join (
      select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem) on l_orderkey = o_orderkey and rn = 1"""
)
def first_match_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    found = joins.first_match(table(spark, sf_dir, "orders"), lines, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return found.select("o_orderkey", "o_totalprice", "l_linenumber", "l_quantity")


@query(
    """select l_partkey, l_orderkey, l_linenumber from (
      select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as rn from lineitem) where rn = 1"""
)
def dedup_keep_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return joins.keep_first(lines, ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("select c_custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_difference(spark, sf_dir):
    return joins.missing_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select n_name as name, n_regionkey as region, null::double as bal from nation union all select s_name, null, s_acctbal from supplier")
def union_by_name(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return joins.union_by_name(nations, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))


@query("select distinct lower(trim(token)) as token from (select unnest(string_split(p_name, ' ')) as token from part) where trim(token) <> ''")
def token_explode(spark, sf_dir):
    return mapping.supplement_tokens(table(spark, sf_dir, "part"), "p_name", " ")


@query("select n_nationkey, p_partkey from nation join part on p_brand = 'Brand#' || n_nationkey or p_type = 'Brand#' || n_nationkey")
def either_key_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("word"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return joins.by_either_key(nations, "word", part, ["p_brand", "p_type"], []).select("n_nationkey", "p_partkey")


@query(
    """with t as (select distinct lower(unnest(string_split(p_name, ' '))) as token from part), w as (
      select token as word, token as match, 1.0::double as score from t union all
      select token || '7', token, 2.0 * length(token) / (2 * length(token) + 1) from t union all select '94', null, null)
    select word, match, round(score, 6) as score from w"""
)
def fuzzy_top1(spark, sf_dir):
    # a word with a digit more is most similar to the word itself; a number is similar to none
    tokens = mapping.supplement_tokens(table(spark, sf_dir, "part"), "p_name", " ")
    words = tokens.select(F.explode(F.array("token", F.concat("token", F.lit("7")))).alias("word")).unionByName(spark.createDataFrame([("94",)], "word string"))
    return mapping.fuzzy_top(words, "word", tokens, "token").select("word", "match", r6("score", "score"))


@query(
    """with t as (select distinct lower(unnest(string_split(p_name, ' '))) as token from part), m as (select token, 'EX_' || token as e, row_number() over (order by token) % 2 = 0 as known from t)
    select token || case when known then '' else '7' end as token, case when known then 'exact' else 'fuzzy' end as result, token as match,
           round(case when known then 1 else 2.0 * length(token) / (2 * length(token) + 1) end, 6) as score, e as exchange_reaction from m
    union all select '94', 'unmapped', null, null, null"""
)
def mapping_audit(spark, sf_dir):
    tokens = mapping.supplement_tokens(table(spark, sf_dir, "part"), "p_name", " ")
    exact = F.col("rank") % 2 == 0
    rows = ranking.ranked(tokens, ["token"]).select(F.when(exact, F.col("token")).otherwise(F.concat("token", F.lit("7"))).alias("supplements"))
    rows = rows.unionByName(spark.createDataFrame([("94",)], "supplements string"))
    exchanges = tokens.select(F.col("token").alias("name"), F.concat(F.lit("EX_"), "token").alias("exchange_reaction"))
    return matrices.mapping_audit(rows, exchanges).select("token", "result", "match", r6("score", "score"), "exchange_reaction")


# Mappings and matrices: order priorities as supplements

#: name, IUPAC name, exchange, concentration, bound, source
MAPPING_ROWS = [
    ("1-urgent", "", "EX_a_e", 4.0, 0.0, "supplement"),
    ("2-high", "", "EX_b_e", 2.0, 0.0, "supplement"),
    ("medium", "3-medium", "EX_c_e", 1.5, 0.0, "supplement"),
    ("salt", "", "EX_b_e", 9.0, 0.0, "medium"),
    ("broth", "", "EX_d_e", 6.0, 0.0, "medium"),
    ("water", "", "EX_e_e", 0.0, 1000.0, "fixed"),
    ("air", "", "EX_f_e", 0.0, 20.0, "unstated"),
]
EXCHANGES = ["EX_a_e", "EX_b_e", "EX_c_e", "EX_d_e", "EX_e_e"]


def small_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPING_ROWS, "name string, iupac_name string, exchange_reaction string, mmol_concentration double, flux_upper_bound double, source string")


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, shuffled, as experiments: two supplements each, the time of the maximum, and whether the fit succeeded."""
    orders = table(spark, sf_dir, "orders").repartition(7)
    return orders.select(
        "o_orderkey",
        F.concat_ws(" ; ", "o_orderpriority", F.lit("2-HIGH")).alias("supplements"),
        (F.col("o_orderkey") % 24).cast("double").alias("max_time"),
        (F.col("o_orderkey") % 3 != 0).alias("success"),
    )


_EXPERIMENT = """x as (select o_orderkey, lower(o_orderpriority) as s, (o_orderkey % 24)::double as t from orders where o_orderkey % 3 <> 0)"""


@query(
    f"""with {_EXPERIMENT} select o_orderkey,
      round(case when s = '1-urgent' and t > 0 then 4.0 / t else 0 end, 6) as "EX_a_e", round(case when t > 0 then 2.0 / t else 0 end, 6) as "EX_b_e",
      round(case when s = '3-medium' and t > 0 then 1.5 / t else 0 end, 6) as "EX_c_e", round(case when t > 0 then 6.0 / t else 0 end, 6) as "EX_d_e", 1000.0::double as "EX_e_e" from x"""
)
def flux_matrix(spark, sf_dir):
    done = matrices.flux_matrix(experiments(spark, sf_dir), small_mapping(spark), "o_orderkey")
    return done.select("o_orderkey", *[r6(e, e) for e in EXCHANGES])


@query(
    f"""with {_EXPERIMENT} select o_orderkey, (s = '1-urgent')::int as "EX_a_e_i", 1 as "EX_b_e_i", (s = '3-medium')::int as "EX_c_e_i", 1 as "EX_d_e_i", 1 as "EX_e_e_i" from x"""
)
def presence_matrix(spark, sf_dir):
    return matrices.presence_matrix(experiments(spark, sf_dir), small_mapping(spark), "o_orderkey", "_i")


@query(
    f"""with {_EXPERIMENT}, f as (select max(case when s = '1-urgent' and t > 0 then 4.0 / t else 0 end) as a, max(case when t > 0 then 2.0 / t else 0 end) as b,
      max(case when s = '3-medium' and t > 0 then 1.5 / t else 0 end) as c, max(case when t > 0 then 6.0 / t else 0 end) as d from x)
    select 'level' as name, 100.0::double as "EX_a_e_i", 7.0::double as "EX_b_e_i", 100.0::double as "EX_c_e_i", 100.0::double as "EX_d_e_i", 100.0::double as "EX_e_e_i"
    union all select 'max_value', round(a, 6), 70.0, round(c, 6), round(d, 6), 1000.0 from f union all select 'ratio_drawing', 0, 0, 0, 0, 0"""
)
def bounds_template(spark, sf_dir):
    growth_rows, mapped = experiments(spark, sf_dir), small_mapping(spark)
    present = matrices.presence_matrix(growth_rows, mapped, "o_orderkey", "_i")
    fluxes = matrices.flux_matrix(growth_rows, mapped, "o_orderkey")
    done = matrices.bounds_matrix(present, mapped, fluxes, "o_orderkey", custom_bounds={"EX_b_e_i": (7, 70)}, suffix="_i")
    return done.select("name", *[r6(f"{e}_i", f"{e}_i") for e in EXCHANGES])


@query(
    """with m as (select l_partkey, max(l_discount) as v from lineitem group by l_partkey)
    select 'EX_' || p_partkey as exchange_reaction,
      case when p_size > 45 then 7 when m.v > 0.05 then 100 when p_size < 10 then 3 else 1 end as level,
      round(case when p_size > 45 then 70 when m.v > 0.05 then m.v when p_size < 10 then 30 else 1000 end, 6) as max_value
    from part left join m on l_partkey = p_partkey"""
)
def bounds_precedence(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("EX_"), F.col("p_partkey").cast("string")).alias("exchange_reaction"), "p_size")
    bound = lambda rows, level, top: rows.select("exchange_reaction", F.lit(level).alias("level"), F.lit(top).cast("double").alias("max_value"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("EX_"), F.col("l_partkey").cast("string")).alias("exchange_reaction"))
    mapped = lines.agg(F.max("l_discount").alias("max_value")).where("max_value > 0.05")
    done = matrices.bounds_precedence(part.select("exchange_reaction"), bound(part.where("p_size > 45"), 7, 70), mapped, bound(part.where("p_size < 10"), 3, 30))
    return done.select("exchange_reaction", "level", r6("max_value", "max_value"))


@query(
    f"""with {_EXPERIMENT} select o_orderkey, exchange_reaction, round(value::double, 6) as value, present from (
      select o_orderkey, unnest(['EX_a_e', 'EX_b_e', 'EX_c_e', 'EX_d_e', 'EX_e_e']) as exchange_reaction,
        unnest([case when s = '1-urgent' and t > 0 then 4.0 / t else 0 end, case when t > 0 then 2.0 / t else 0 end, case when s = '3-medium' and t > 0 then 1.5 / t else 0 end,
                case when t > 0 then 6.0 / t else 0 end, 1000.0]) as value,
        unnest([(s = '1-urgent')::int, 1, (s = '3-medium')::int, 1, 1]) as present from x)"""
)
def long_matrices(spark, sf_dir):
    rows, mapped = experiments(spark, sf_dir), small_mapping(spark)
    present = matrices.presence_long(rows, mapped).select("o_orderkey", "exchange_reaction", F.col("value").alias("present"))
    return matrices.flux_long(rows, mapped).join(present, ["o_orderkey", "exchange_reaction"]).select("o_orderkey", "exchange_reaction", r6("value", "value"), "present")


@query(
    f"""with {_EXPERIMENT} select o_orderkey, exchange_reaction, round(value::double, 6) as value from (
      select o_orderkey, unnest(['EX_a_e', 'EX_b_e', 'EX_c_e', 'EX_d_e', 'EX_e_e']) as exchange_reaction,
        unnest([case when s = '1-urgent' and t > 0 then 4.0 / t else 0 end, case when t > 0 then 2.0 / t else 0 end, case when s = '3-medium' and t > 0 then 1.5 / t else 0 end,
                case when t > 0 then 6.0 / t else 0 end, 1000.0]) as value from x) where value <> 0"""
)
def sparse_fluxes(spark, sf_dir):
    done = matrices.flux_sparse(experiments(spark, sf_dir), small_mapping(spark))
    return done.select("o_orderkey", F.explode("fluxes").alias("exchange_reaction", "value")).select("o_orderkey", "exchange_reaction", r6("value", "value"))


@query(
    """select 'EX_' || l_partkey as exchange_reaction, count(*) filter (l_returnflag = 'A') as fixed, count(*) as stated, count(distinct l_returnflag = 'A') as sources
    from lineitem where l_returnflag <> 'R' group by l_partkey having count(*) filter (l_returnflag = 'A') > 1 or count(distinct l_returnflag = 'A') <> count(*)"""
)
def source_sanity_having(spark, sf_dir):
    source = F.when(F.col("l_returnflag") == "A", mapping.FIXED).when(F.col("l_returnflag") == "N", mapping.MEDIUM).otherwise(mapping.SUPPLEMENT)
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("EX_"), F.col("l_partkey").cast("string")).alias("exchange_reaction"), source.alias("source"), F.lit(mapping.UPDATED).alias("record_origin")
    )
    return mapping.mapping_conflicts(rows)


#: name, molecular weight, of substances that media are made of
SUBSTANCES = [("nation_0", 180.0), ("nation_1", 90.0), ("nation_2", 45.0), ("nation_3", 20.0)]


def nation_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as metabolites of a model, those of suppliers as supplements, and a medium of three entries and a compound."""
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.concat(F.lit("EX_"), F.col("n_nationkey").cast("string")).alias("exchange_reaction"))
    growth_rows = table(spark, sf_dir, "supplier").select(F.concat_ws("; ", F.lit("NATION_7 "), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).alias("supplements"))
    custom = {
        "NATION_0": {"exchange_name": "EX_0", "mass_per_litre": 3.6, "source": "medium", "other_names": ["zero"]},
        "nation_1 ": {"exchange_name": "EX_1", "flux_upper_bound": 77, "source": "fixed"},
        "broth": {"exchange_name": "EX_24", "mass_per_litre": 9, "source": "medium", "pubchem_name": "nation_2"},
        "lost": {"exchange_name": "EX_99", "source": "medium"},
        "salt": {"is_compound": True, "compounds": ["nation_2", "nation_3"], "mass_per_litre": 13.0, "source": "medium"},
    }
    nothing = "/dev/null"
    return mapping.build_mappings(growth_rows, nations, CompoundTable([Compound(n, molecular_weight=w) for n, w in SUBSTANCES]), custom_file=nothing, custom=custom)


_NATIONS = """s as (select distinct s_nationkey as k from supplier union select 7), m as (
  select lower(n_name) as name, 'EX_' || n_nationkey as exchange_reaction, n_nationkey as k, n_nationkey in (select k from s) as given from nation
), w as (
  select name, exchange_reaction, given, k, case k when 0 then 3.6 when 2 then 9.0 when 3 then 4.0 else 0.0 end as mass, case k when 0 then 20.0 when 2 then 200.0 when 3 then 200.0 else 0.0 end as mmol,
    case when k = 1 then 77.0 else 0.0 end as bound, case when given then 'supplement' when k in (0, 2, 3) then 'medium' when k = 1 then 'fixed' else 'unstated' end as source,
    case when given or k <= 3 then 'updated' else 'smbl' end as origin,
    array_to_string(list_sort(list_distinct(case when k = 0 then ['zero', name] when given or k <= 3 then [name] else [] end)), ';') as others from m
), mapped as (
  select name, '' as iupac_name, others as other_names, exchange_reaction, mass::double as mass_per_litre, mmol::double as mmol_concentration, bound::double as flux_upper_bound, source, origin as record_origin from w
  union all select 'broth', '', '', 'EX_24', 9.0, 200.0, 0.0, 'medium', 'updated'
)"""


@query(f"with {_NATIONS} select * replace (round(mass_per_litre, 6) as mass_per_litre, round(mmol_concentration, 6) as mmol_concentration) from mapped")
def build_mappings(spark, sf_dir):
    done = nation_mapping(spark, sf_dir)
    return done.withColumns({c: F.round(c, 6) for c in ("mass_per_litre", "mmol_concentration")})


@query(f"with {_NATIONS} select name, exchange_reaction, source from mapped where record_origin = 'updated' and source <> 'unstated'")
def mapping_report(spark, sf_dir):
    return mapping.mapping_report(nation_mapping(spark, sf_dir)).select("name", "exchange_reaction", "source")


#: What experiments are given in ``supplement_table_lookup``; the oracle states the exchanges by itself.
GIVEN = ("Glucose; uracil", "l-alanine;ALANINE", "d-lactate ;nothing known", "glycerol", "")


@query(
    """select o_orderkey, (k = 0)::int as "EX_glc__D_e", (k = 0)::int as "EX_ura_e", (k = 1)::int as "EX_ala__L_e_i", (k = 2)::int as "EX_lac__D_e_i", (k = 3)::int as "EX_glyc_e_i",
    0 as "EX_fru_e_i", 1 as "EX_h2o_e_i", 1 as "EX_nh4_e_i", 45 as columns from (select o_orderkey, o_orderkey % 5 as k from orders)"""
)
def supplement_table_lookup(spark, sf_dir):
    """The table of supplements and the minimal medium that come with the package."""
    given = F.element_at(F.array(*[F.lit(g) for g in GIVEN]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", given.alias("supplements"))
    done = matrices.supplement_matrix(rows, supplement_exchanges(spark), list(MINIMAL_MEDIUM), growth_rate="o_orderkey")
    shown = ("EX_glc__D_e", "EX_ura_e", "EX_ala__L_e_i", "EX_lac__D_e_i", "EX_glyc_e_i", "EX_fru_e_i", "EX_h2o_e_i", "EX_nh4_e_i")
    return done.select("o_orderkey", *shown, F.lit(len(done.columns)).alias("columns"))


@query("select l_partkey, arg_max(l_quantity, (l_orderkey, l_linenumber)) as l_quantity from lineitem group by l_partkey")
def last_wins_map(spark, sf_dir):
    return joins.last_wins(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", ["l_orderkey", "l_linenumber"])


# Chemistry and units

SALTS = ["[Na+].[Cl-]", "[NH4+].[Cl-]", "[Ca++].[Cl-].[Cl-]", "OP(=O)([O-])[O-].[Na+].[Na+]"]


@query(
    """select smiles, ion, charge, round(mass::double, 6) as molar_mass, round(mass::double / sum(mass::double) over (partition by smiles), 6) as mass_fraction from (values
      ('[Na+].[Cl-]', 0, 1, 22.98976928), ('[Na+].[Cl-]', 1, -1, 35.453),
      ('[NH4+].[Cl-]', 0, 1, 14.0067 + 4 * 1.00794), ('[NH4+].[Cl-]', 1, -1, 35.453),
      ('[Ca++].[Cl-].[Cl-]', 0, 2, 40.078), ('[Ca++].[Cl-].[Cl-]', 1, -1, 35.453), ('[Ca++].[Cl-].[Cl-]', 2, -1, 35.453),
      ('OP(=O)([O-])[O-].[Na+].[Na+]', 0, -2, 4 * 15.9994 + 30.973761), ('OP(=O)([O-])[O-].[Na+].[Na+]', 1, 1, 22.98976928), ('OP(=O)([O-])[O-].[Na+].[Na+]', 2, 1, 22.98976928)
    ) as t(smiles, ion, charge, mass)"""
)
def ion_masses(spark, sf_dir):
    salts = spark.createDataFrame([(s,) for s in SALTS], "smiles string")
    nothing = spark.createDataFrame([], chemistry.COMPOUND_COLUMNS)
    done = chemistry.with_mass_fractions(chemistry.ions(salts.withColumnRenamed("smiles", "salt"), "salt", nothing), ["salt"])
    return done.select(F.col("salt").alias("smiles"), "ion", "charge", r6("molar_mass", "molar_mass"), r6("mass_fraction", "mass_fraction"))


@query(
    """select l_orderkey, l_linenumber, round(l_quantity * 0.4, 6) as dry_weight, round(l_quantity / nullif(l_discount, 0), 6) as moles,
    round(coalesce(l_quantity / nullif(l_discount, 0) * 1000, 0), 6) as mmol, round(case when l_tax > 0 then l_quantity / l_tax else 0 end, 6) as flux from lineitem"""
)
def unit_conversions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        r6(growth.dry_weight("l_quantity"), "dry_weight"),
        r6(growth.moles("l_quantity", "l_discount"), "moles"),
        r6(growth.millimoles("l_quantity", "l_discount"), "mmol"),
        r6(growth.flux("l_quantity", "l_tax"), "flux"),
    )


@query("select c_mktsegment, array_to_string(list_slice(list(distinct c_name order by c_name), 1, 96), ';') as names from customer group by c_mktsegment")
def ordered_limit_agg(spark, sf_dir):
    return plates.first_names(table(spark, sf_dir, "customer"), "c_name", ["c_mktsegment"])


@query(
    """with s as (select s_name, row_number() over (order by s_name) as rank from supplier), n as (select n_name, row_number() over (order by n_name) as rank from nation)
    select rank::int as rank, s_name, n_name from s join n using (rank)"""
)
def rank_pairing(spark, sf_dir):
    return joins.paired_by_rank(table(spark, sf_dir, "supplier"), "s_name", table(spark, sf_dir, "nation"), "n_name").select(F.col("rank").cast("int").alias("rank"), "s_name", "n_name")


@query(
    """with c as (select conv_id, turn, role, sum((role = 'user')::int) over (partition by conv_id order by turn) as section from conversations),
    t as (select *, max(case when role = 'user' then 'T' || turn end) over (partition by conv_id, section) as title from c)
    select conv_id::varchar as source_file, turn::int as line_no, section::bigint as section, title from t where role <> 'user'"""
)
def section_carry_forward(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("=== T"), F.col("turn").cast("string"), F.lit(" ==="))).otherwise("said")
    lines = turns.select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").cast("int").alias("line_no"), line.alias("line"))
    return sections(lines).select("source_file", "line_no", "section", "title")


@query(
    """select l_orderkey, l_linenumber, case when l_extendedprice > 10000 then 1000 else trunc(l_extendedprice)::int end as bound,
    'EX_' || lower(trim(replace(replace(l_returnflag || '_e', '_e', ''), '_', ' '))) as name from lineitem"""
)
def sbml_bounds_cap(spark, sf_dir):
    key = F.concat(F.lit("EX_"), growth.exchange_name(F.concat("l_returnflag", F.lit("_e"))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", growth.capped_bound("l_extendedprice").alias("bound"), key.alias("name"))


@query(
    """select event_type, time_bucket(interval '1 hour', ts) as hour, count(*) as n, round(avg(value), 6) as mean, round(max(value), 6) as top from events group by 1, 2"""
)
def hourly_windows(spark, sf_dir):
    done = live.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour")
    return done.select("event_type", F.col("start").cast("timestamp_ntz").alias("hour"), "n", r6("mean", "mean"), r6("top", "top"))


@query(
    """with r as (
      select user_id, ts, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9 as t, value as v, row_number() over (partition by user_id order by ts, value) as k
      from events where user_id is not null and ts is not null and isfinite(value)
    ), b as (select user_id, avg(v) filter (k <= 4) as n0 from r group by user_id), u as (
      select user_id, ts, t, v, ln(v) as y from r join b using (user_id) where v > 0 and n0 > 0
    ), m as (
      select *, case when count(*) over w = 5 then regr_slope(y, t) over w end as slope,
        case when count(*) over w = 5 then case when regr_syy(y, t) over w = 0 then 0 else regr_r2(y, t) over w end end as r2,
        case when count(*) over w = 5 then sqrt(greatest(0, regr_syy(y, t) over w - power(regr_sxy(y, t) over w, 2) / regr_sxx(y, t) over w) / 5) end as rmse,
        max(y) over (partition by user_id) - min(y) over (partition by user_id) as span, count(*) over (partition by user_id) as n
      from u window w as (partition by user_id order by ts, v rows between current row and 4 following)
    ), best as (select *, row_number() over (partition by user_id order by slope desc nulls last, t) as rn from m
    ), top as (select user_id, v as max_value, t as max_time, row_number() over (partition by user_id order by round(y, 12) desc, t) as rn from m
    ), found as (
      select best.*, max_value, max_time, best.n >= 5 and span > exp(0.1) as ok from best join top using (user_id) where best.rn = 1 and top.rn = 1
    )
    select user_id, coalesce(n, 0)::int as n, coalesce(ok, false) as success, case when ok then 'ok' else 'insufficient or flat data' end as message,
      round(case when ok then slope end, 6) as mv_mu_max, round(case when ok then r2 end, 6) as mv_r2, round(case when ok then rmse end, 6) as mv_rmse,
      round(case when ok then t end, 6) as window_start, round(case when ok then max_value end, 6) as max_value, round(case when ok then max_time end, 6) as max_time
    from b left join found using (user_id)"""
)
def live_growth_rates(spark, sf_dir):
    """The events as a stream of files in no order of time, and what is known of each user after the last."""
    # a pattern, as a stream takes a single file for a folder otherwise
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1_000).parquet(f"{sf_dir}/events.parque[t]")
    readings = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rates = live_growth.growth_rates(readings, "ts", "value", ["user_id"], averaged=4, late="3650 days")
    kept = folder(spark, "rates")
    live.keep_updates(rates, kept, folder(spark, "rates-progress")).awaitTermination()
    hours = lambda c: F.round(F.expr(HOURS.replace("cast(ts as timestamp)", c)), 6).alias(c)
    plain = [r6(c, c) for c in ("mv_mu_max", "mv_r2", "mv_rmse", "max_value")]
    return live.newest(spark, kept, ["user_id"]).select("user_id", "n", "success", "message", *plain, hours("window_start"), hours("max_time"))


@query("select event_type, user_id, n, rank::int as rank from (select *, row_number() over (partition by event_type order by n desc, user_id) as rank from (select event_type, user_id, count(*) as n from events group by 1, 2)) where rank <= 3")
def top_users(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return joins.top_by(counted, ["event_type"], [F.desc("n"), "user_id"], 3)


@query(
    """with b as (select range as i from range(0, 2)), w as (
      select event_type, value, time_bucket(interval '30 minutes', ts) - i * interval '30 minutes' as start from events, b)
    select event_type, start, count(*) as n, round(avg(value), 6) as mean, round(max(value), 6) as top from w group by 1, 2"""
)
def sliding_windows(spark, sf_dir):
    done = live.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour", "30 minutes")
    return done.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("mean", "mean"), r6("top", "top"))


@query(
    """with e as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) >= interval '6 hours' as gap from events),
    s as (select user_id, ts, sum(coalesce(gap, true)::int) over (partition by user_id order by ts) as session from e)
    select user_id, min(ts) as start, max(ts) + interval '6 hours' as end, count(*) as n from s group by user_id, session"""
)
def sessions(spark, sf_dir):
    done = live.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "6 hours")
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(
    """select p_partkey, case p_type when 'SMALL' then 10.5 when 'LARGE' then 20.25 end::double as molecular_weight from part"""
)
def molecular_weights(spark, sf_dir):
    known = [("Small", 3, None, None, 99.0), ("Small", 1, None, None, 10.5), ("large", 2, None, None, 20.25)]
    compounds = spark.createDataFrame(known, chemistry.COMPOUND_COLUMNS)
    return chemistry.molecular_weights(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", compounds).select("p_partkey", "molecular_weight")
