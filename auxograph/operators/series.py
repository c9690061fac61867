"""Operators on time series: baseline, smoothing, moving regression, maximal growth rate.

A series is the rows that share the group columns, ordered by time and a tie-break. All operators
window over the same partitioning and order, so a chain of them has one exchange and one sort.

A window sends a series to one task. Where a series may be too long for that, ``block_rows`` cuts
series into blocks of so many rows, which has the same results (see ``blocks``): the series is
numbered and written once per operator, and any number of tasks share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auxograph.functions.growth import FLAT_RANGE, exact_ln
from auxograph.functions.values import finite, is_finite, require, without_null_keys
from auxograph.operators.blocks import BLOCK, OWN, PLACE, in_blocks, own_rows, running_count

TIME_COLUMNS = ("time_label", "time_h", "time_min", "time_h_int", "time_min_int")
SHORT_OR_FLAT = "insufficient or flat data"


def ordered(keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time, *ties)


def log_ratio(
    df: DataFrame,
    value: str,
    out: str = "log_od_od0",
    keys: Sequence[str] = ("well",),
    time: str = "time_h",
    window: int = 1,
    baseline: str = "n0",
    ties: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Add the baseline, the mean of a series' first ``window`` finite values, and ln(value / baseline).

    Null where the baseline is missing or not positive, or the value is not positive.
    """
    require(df, [value, time, *keys], "log_ratio")
    rows = without_null_keys(df, keys)
    logarithm = F.when((F.col(baseline) > 0) & (finite(value) > 0), exact_ln(F.col(value) / F.col(baseline)))
    if block_rows:
        counted = running_count(in_blocks(rows, keys, [time, *ties], block_rows), keys, is_finite(value), "_nth")
        early = counted.where(is_finite(value) & (F.col("_nth") <= window)).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(baseline))
        return own_rows(counted.drop("_nth")).join(early, list(keys), "left").withColumn(out, logarithm).select(*rows.columns, baseline, out)
    w = ordered(keys, time, ties)
    nth = F.sum(is_finite(value).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    early = F.when(is_finite(value) & (F.col("_nth") <= window), F.col(value).cast("double"))
    return (
        rows.withColumn("_nth", nth)
        .withColumn(baseline, F.avg(early).over(Window.partitionBy(*keys)))
        .withColumn(out, logarithm)
        .drop("_nth")
    )


def trimmed_mean(value: str, w: WindowSpec, half: int, n: Column) -> Column:
    """Mean of the 2 * half + 1 values around a row without one largest and one smallest; ends stay."""
    around = w.rowsBetween(-half, half)
    inner = (F.sum(value).over(around) - F.max(value).over(around) - F.min(value).over(around)) / (2 * half - 1)
    at = F.row_number().over(w)
    return F.when((at > half) & (at <= n - half), inner).otherwise(F.col(value))


def smoothed(
    df: DataFrame, value: str, keys: Sequence[str], time: str, out: str, half: int = 2, times: int = 1, ties: Sequence[str] = (), block_rows: int | None = None
) -> DataFrame:
    """Apply the trimmed moving average ``times`` times; series shorter than a frame stay as they are."""
    if half < 1:
        raise ValueError("the half window must be at least 1")
    if block_rows:
        # a block's outermost rows stay as series' ends do; each pass carries that inwards by half a window
        rows = in_blocks(df, keys, [time, *ties], block_rows, half * times, half * times)
        return own_rows(smoothed(rows, value, [*keys, BLOCK], time, out, half, times, [*ties, PLACE]))
    w = ordered(keys, time, ties)
    done = df.withColumn(out, F.col(value).cast("double")).withColumn("_size", F.count("*").over(Window.partitionBy(*keys)))
    for _ in range(times):
        done = done.withColumn(out, trimmed_mean(out, w, half, F.col("_size")))
    return done.drop("_size")


def moving_slope(df: DataFrame, value: str, keys: Sequence[str], time: str, window: int = 5, ties: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Add the least-squares slope, r2 and rmse of the ``window`` rows from each row on; null near the end."""
    if block_rows:
        rows = in_blocks(df, keys, [time, *ties], block_rows, 0, window - 1)
        return own_rows(moving_slope(rows, value, [*keys, BLOCK], time, window, [*ties, PLACE]))
    w = ordered(keys, time, ties).rowsBetween(0, window - 1)
    over = lambda f: f(F.col(value), F.col(time)).over(w)
    whole = F.count(F.when(F.col(value).isNotNull() & F.col(time).isNotNull(), 1)).over(w) == window
    rows = df.withColumns(
        {"_whole": whole, "slope": over(F.regr_slope), "_sxx": over(F.regr_sxx), "_sxy": over(F.regr_sxy), "_syy": over(F.regr_syy)}
    )
    flat = F.col("_syy") == 0
    fit = F.col("_sxy") * F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0))
    return rows.withColumns(
        {
            "slope": F.when(F.col("_whole"), F.col("slope")),
            "slope_r2": F.when(F.col("_whole") & (F.col("_sxx") > 0), F.when(flat, 0.0).otherwise(fit / F.nullif(F.col("_syy"), F.lit(0.0)))),
            "slope_rmse": F.when(F.col("_whole"), F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") - fit) / window)),
        }
    ).drop("_whole", "_sxx", "_sxy", "_syy")


def differences(df: DataFrame, value: str, keys: Sequence[str], time: str, out: str = "difference", ties: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Add the slope from each row to the next of its series; null where no time passes."""
    if block_rows:
        return own_rows(differences(in_blocks(df, keys, [time, *ties], block_rows, 0, 1), value, [*keys, BLOCK], time, out, [*ties, PLACE]))
    w = ordered(keys, time, ties)
    step = F.lead(time).over(w) - F.col(time)
    return df.withColumn(out, F.try_divide(F.lead(value).over(w) - F.col(value), F.nullif(step, F.lit(0.0))))


def quality_gate(df: DataFrame, value: str, keys: Sequence[str], min_points: int = 5) -> DataFrame:
    """Per series: its finite values, their range, and whether they suffice for a fit."""
    rows = without_null_keys(df, keys)
    stats = rows.groupBy(*keys).agg(F.count(finite(value)).alias("n"), (F.max(finite(value)) - F.min(finite(value))).alias("value_range"))
    good = (F.col("n") >= min_points) & (F.coalesce("value_range", F.lit(0.0)) > FLAT_RANGE)
    return stats.withColumn("usable", good).withColumn("message", F.when(~good, SHORT_OR_FLAT).otherwise(""))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of each series' first row, nulls included."""
    if not columns:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in columns])


def max_growth_rate(
    df: DataFrame,
    time: str = "time_h",
    value: str = "log_od_od0",
    keys: Sequence[str] = ("well",),
    min_points: int = 5,
    window: int = 5,
    smoothing: int = 0,
    half: int = 2,
    log_transformed: bool = True,
    baseline: str = "n0",
    metadata: Sequence[str] | None = None,
    ties: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Per series: the steepest moving regression of the smoothed values, and their maximum.

    Columns: keys, n, success, message, mv_mu_max, mv_r2, mv_rmse, window_start, max_value, max_time and
    ``metadata`` of the first row (by default all columns but keys, times and value). Rows count
    whose time, value and baseline are finite. ``max_value`` is in units of the baseline where the values are
    logarithms of a ratio. Of equal maxima (to 12 digits, as smoothing sums in any order) the first counts.
    """
    require(df, [time, value, *keys], "max_growth_rate")
    rows = without_null_keys(df, keys)
    if metadata is None:
        metadata = [c for c in df.columns if c not in {*keys, *TIME_COLUMNS, time, value}]
    usable = rows.where(is_finite(value) & is_finite(time))
    if log_transformed or baseline in df.columns:
        usable = usable.where(is_finite(baseline))
    parts, breaks = list(keys), list(ties)
    if block_rows:
        halo = half * smoothing
        usable, parts, breaks = in_blocks(usable, keys, [time, *ties], block_rows, halo, halo + window - 1), [*keys, BLOCK], [*ties, PLACE]
    usable = smoothed(usable, value, parts, time, "_y", half, smoothing, breaks) if smoothing else usable.withColumn("_y", F.col(value).cast("double"))
    sloped = moving_slope(usable, "_y", parts, time, window, breaks)
    if block_rows:
        sloped = sloped.where(OWN)
    original = F.exp("_y") * F.col(baseline) if log_transformed else F.col("_y")
    sloped = sloped.withColumn("_level", original)
    early = F.struct(F.col(time), *[F.col(t) for t in ties])
    best = F.struct(F.col("slope").alias("s"), (-F.col(time)).alias("t"))
    summary = sloped.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n"),
        (F.max("_y") - F.min("_y")).alias("_range"),
        F.max_by(F.struct("slope", "slope_r2", "slope_rmse", F.col(time).alias("start")), F.when(F.col("slope").isNotNull(), best)).alias("_best"),
        F.max_by(F.struct(F.col("_level").alias("level"), F.col(time).alias("at")), F.struct(F.round(F.col("_y") * 1e12).alias("y"), (-F.col(time)).alias("t"))).alias("_top"),
    )
    everything = rows.groupBy(*keys).agg(*_first_row_aggregates(metadata, early)) if metadata else rows.select(*keys).distinct()
    flat = (F.col("n") < min_points) | (F.col("_range") <= FLAT_RANGE) | F.col("n").isNull()
    short = F.col("n") < window
    good = ~flat & ~short & F.col("_best.slope").isNotNull()
    message = F.when(flat, SHORT_OR_FLAT).when(short, F.lit(f"insufficient data for window size {window} (need >= {window} points)"))
    message = message.when(~good, "all windows produced invalid growth rates").otherwise("ok")
    when = lambda c: F.when(good, F.col(c))
    return everything.join(summary, list(keys), "left").select(
        *keys,
        F.coalesce("n", F.lit(0)).cast("int").alias("n"),
        F.coalesce(good, F.lit(False)).alias("success"),
        message.alias("message"),
        when("_best.slope").alias("mv_mu_max"),
        when("_best.slope_r2").alias("mv_r2"),
        when("_best.slope_rmse").alias("mv_rmse"),
        when("_best.start").alias("window_start"),
        when("_top.level").alias("max_value"),
        when("_top.at").alias("max_time"),
        *metadata,
    )


def _first_row_aggregates(columns: Sequence[str], order: Column) -> list[Column]:
    return [F.min_by(F.struct(F.col(c).alias("v")), order)["v"].alias(c) for c in columns]
