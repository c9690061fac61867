"""Fitting the modified Gompertz curve per series, and predicting from fitted parameters.

The points of a series are gathered in one row by an aggregate. A worker then fits many series at once:
it pads series of like length to one array, and takes Levenberg-Marquardt steps for all of them
together, with the curve's own derivatives, until each has converged. A series, the readings of a
well, is held whole by one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxograph.functions.growth import FLAT_RANGE, gompertz
from auxograph.functions.stored import stored
from auxograph.functions.values import is_finite, require, without_null_keys
from auxograph.operators.series import SHORT_OR_FLAT, TIME_COLUMNS, first_row

PARAMETERS = ("y0", "A", "mu_max", "lambda")
FIT = "n int, success boolean, message string, y0 double, A double, mu_max double, lambda double, r2 double, rmse double, max_value double, max_time double"
GUESS = "n int, usable boolean, " + ", ".join(f"{p}_{k} double" for k in ("start", "lower", "upper") for p in PARAMETERS)
#: Points, with those that pad, that are worked on together.
TOGETHER = 400_000
#: A step whose gain is a smaller share of the cost is the last one.
LEAST_GAIN = 1e-12
MOST_EVALUATIONS = 20_000


def curve(t: np.ndarray, p: Sequence[float], clip_exp: float) -> np.ndarray:
    """The curve of parameters y0, A, mu_max, lambda."""
    y0, a, mu, lag = p
    if a == 0:
        return np.full(len(t), float(y0))
    return y0 + a * np.exp(-np.exp(np.clip(mu * math.e / a * (lag - t) + 1, -clip_exp, clip_exp)))


class Curves:
    """Series padded to one length: times, values, and which places hold points."""

    def __init__(self, t: np.ndarray, y: np.ndarray, here: np.ndarray, clip_exp: float):
        self.t, self.y, self.here, self.clip_exp = t, y, here, clip_exp

    def take(self, rows: np.ndarray) -> Curves:
        return Curves(self.t[rows], self.y[rows], self.here[rows], self.clip_exp)

    def parts(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Time before the lag, exp(u), exp(-exp(u)), and where u is clipped."""
        a = np.where(p[:, 1] == 0, 1.0, p[:, 1])
        before = p[:, 3:4] - self.t
        u = (p[:, 2] * math.e / a)[:, None] * before + 1
        clipped = np.abs(u) >= self.clip_exp
        grown = np.exp(np.clip(u, -self.clip_exp, self.clip_exp))
        return before, grown, np.exp(-grown), clipped

    def residual(self, p: np.ndarray) -> np.ndarray:
        _, _, level, _ = self.parts(p)
        return np.where(self.here, self.y - p[:, :1] - p[:, 1:2] * level, 0.0)

    def jacobian(self, p: np.ndarray) -> np.ndarray:
        """Derivatives of the curve at every place by the four parameters."""
        before, grown, level, clipped = self.parts(p)
        a = np.where(p[:, 1] == 0, 1.0, p[:, 1])[:, None]
        steep = np.where(clipped, 0.0, grown * level)
        out = np.empty((*self.t.shape, 4))
        out[..., 0] = 1.0
        out[..., 1] = level + steep * p[:, 2:3] * math.e * before / a
        out[..., 2] = -steep * math.e * before
        out[..., 3] = -steep * math.e * p[:, 2:3]
        out[~self.here] = 0.0
        return out


def _percentile(ordered: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Interpolated percentile of the first ``n`` values of each ascending row."""
    at = (n - 1) * share
    low = np.floor(at).astype(np.int64)
    rows = np.arange(len(n))
    below, above = ordered[rows, low], ordered[rows, np.minimum(low + 1, n - 1)]
    return below + (above - below) * (at - low)


def guesses(t: np.ndarray, y: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, lower and upper bounds of the four parameters of each padded series in order of time."""
    n = here.sum(1)
    rows = np.arange(len(n))
    ordered = np.sort(np.where(here, y, np.inf), axis=1)
    low, high, top = _percentile(ordered, n, 0.05), _percentile(ordered, n, 0.95), ordered[rows, n - 1]
    step, rise = np.diff(t, axis=1), np.diff(y, axis=1)
    there = here[:, 1:] & (step != 0)
    slopes = np.where(there, np.divide(rise, step, out=np.zeros_like(rise), where=there), -np.inf)
    if slopes.shape[1]:
        best = slopes.argmax(1)
        steepest, some = slopes[rows, best], there.any(1)
    else:
        best, steepest, some = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n), bool)
    mu = np.where(some, np.maximum(steepest, 1e-3), 0.1)
    lag = np.where(some, t[rows, best], t[:, 0])
    end = np.where(here, t, -np.inf).max(1)
    zero = np.zeros(len(n))
    lower = np.stack([zero, zero + 1e-5, zero + 1e-5, zero], 1)
    upper = np.stack([np.maximum(2.0, 2 * top), np.maximum(1e-3, 2 * top), zero + 10, 1.5 * end + 1], 1)
    start = np.stack([low, np.maximum(high - low, 1e-3), mu, lag], 1)
    return np.clip(start, lower, upper), lower, upper


def damped_step(p: np.ndarray, gradient: np.ndarray, normal: np.ndarray, damping: np.ndarray, free: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which parameters of each series take part in a Levenberg-Marquardt step, and where the step leads, within the bounds.

    A parameter that is fixed, or at a bound that it would leave, rests for this step.
    """
    part, diagonal = normal.copy(), np.arange(4)
    inside = free & ~((p <= lower) & (gradient < 0)) & ~((p >= upper) & (gradient > 0))
    part[~(inside[:, :, None] & inside[:, None, :])] = 0.0
    scale = np.maximum(normal[:, diagonal, diagonal], 1e-12)
    part[:, diagonal, diagonal] = np.where(inside, part[:, diagonal, diagonal] + damping[:, None] * scale, 1.0)
    step = np.linalg.solve(part, np.where(inside, gradient, 0.0)[:, :, None])[:, :, 0]
    return inside, np.where(free, np.clip(p + step, lower, upper), p)


def bounded_fit(curves: Curves, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, free: np.ndarray, evaluations: int = MOST_EVALUATIONS) -> np.ndarray:
    """Levenberg-Marquardt steps on the free parameters of each series, projected to its bounds.

    Every series has a damping of its own and rests once it has converged.
    """
    p = start.copy()
    residual = curves.residual(p)
    cost = (residual**2).sum(1)
    damping, used = np.full(len(p), 1e-2), np.zeros(len(p), np.int64)
    normal, gradient = np.zeros((len(p), 4, 4)), np.zeros((len(p), 4))
    stale, active = np.ones(len(p), bool), np.isfinite(cost)
    while active.any():
        fresh = np.flatnonzero(active & stale)
        if len(fresh):
            j = curves.take(fresh).jacobian(p[fresh])
            normal[fresh] = np.matmul(j.transpose(0, 2, 1), j)
            gradient[fresh] = np.matmul(residual[fresh][:, None, :], j)[:, 0]
            used[fresh] += 1
            stale[fresh] = False
        at = np.flatnonzero(active)
        inside, trial = damped_step(p[at], gradient[at], normal[at], damping[at], free, lower[at], upper[at])
        left = curves.take(at).residual(trial)
        tried = (left**2).sum(1)
        used[at] += 1
        better = tried < cost[at]
        small = cost[at] - tried <= LEAST_GAIN * np.maximum(cost[at], 1e-300)
        won = at[better]
        p[won], residual[won], cost[won] = trial[better], left[better], tried[better]
        damping[won] = np.maximum(damping[won] / 5, 1e-12)
        stale[won] = True
        damping[at[~better]] *= 4
        active[at[(better & small) | ~inside.any(1)]] = False
        active &= (damping < 1e12) & (used < evaluations)
    return p


def _blocks(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in blocks of like length, whose padded arrays have about ``TOGETHER`` places."""
    order = np.argsort(counts, kind="stable")
    begin = 0
    while begin < len(order):
        widest = np.maximum(1, counts[order[begin:]])
        fits = int(np.searchsorted(widest * np.arange(1, len(widest) + 1), TOGETHER, side="right"))
        end = begin + max(1, fits)
        yield order[begin:end]
        begin = end


def _padded(points: pa.ListArray, rows: np.ndarray, names: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The finite points of some lists of structs as padded arrays, and where they have points."""
    flat = points.flatten()
    columns = [flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names]
    edges = points.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    good = np.isfinite(np.stack(columns)).all(0) if columns else np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(good)])
    kept = [c[good] for c in columns]
    begin, n = total[edges[:-1]][rows], (total[edges[1:]] - total[edges[:-1]])[rows]
    place = np.arange(max(1, int(n.max()) if len(n) else 1))
    here = place < n[:, None]
    source = np.minimum(begin[:, None] + place, max(0, len(kept[0]) - 1))
    return here, {name: np.where(here, c[source] if len(c) else 0.0, 0.0) for name, c in zip(names, kept)}


def _usable(y: np.ndarray, here: np.ndarray, min_points: int) -> np.ndarray:
    span = np.where(here, y, -np.inf).max(1) - np.where(here, y, np.inf).min(1)
    return (here.sum(1) >= min_points) & (span > FLAT_RANGE)


def fit_block(t, y, n0, here, fixed: Mapping[str, float], min_points: int, clip_exp: float) -> dict[str, np.ndarray]:
    """The columns of ``FIT`` for padded series; ``n0``: baselines, or None if the values are no logarithms."""
    n = here.sum(1)
    out: dict[str, np.ndarray] = {name.split()[0]: np.full(len(n), np.nan) for name in FIT.split(", ")}
    out["n"], out["success"], out["message"] = n, np.zeros(len(n), bool), np.full(len(n), SHORT_OR_FLAT, object)
    rows = np.flatnonzero(_usable(y, here, min_points))
    if not len(rows):
        return out
    t, y, here = t[rows], y[rows], here[rows]
    free = np.array([p not in fixed for p in PARAMETERS])
    start, lower, upper = guesses(t, y, here)
    for name, value in fixed.items():
        start[:, PARAMETERS.index(name)] = value
    curves = Curves(t, y, here, clip_exp)
    p = bounded_fit(curves, start, lower, upper, free) if free.any() else start
    residual = curves.residual(p)
    cost, m = (residual**2).sum(1), here.sum(1)
    mean = np.where(here, y, 0.0).sum(1) / m
    spread = (np.where(here, y - mean[:, None], 0.0) ** 2).sum(1)
    top = np.where(here, y, -np.inf).argmax(1)
    each = np.arange(len(rows))
    level = y[each, top]
    good = np.isfinite(cost)
    out["success"][rows], out["message"][rows] = good, np.where(good, "ok", "the fit is not finite").astype(object)
    found = dict(zip(PARAMETERS, p.T)) | {
        "r2": 1 - cost / np.where(spread > 0, spread, np.nan),
        "rmse": np.sqrt(cost / np.maximum(1, m - free.sum())),
        "max_value": np.exp(level) * n0[rows][each, top] if n0 is not None else level,
        "max_time": t[each, top],
    }
    for name, values in found.items():
        out[name][rows[good]] = values[good]
    return out


def guess_block(t, y, n0, here, min_points: int) -> dict[str, np.ndarray]:
    """The columns of ``GUESS`` for padded series."""
    n, usable = here.sum(1), _usable(y, here, min_points)
    out = {"n": n, "usable": usable}
    some = np.flatnonzero(n > 0)
    for kind, values in zip(("start", "lower", "upper"), guesses(t[some], y[some], here[some]) if len(some) else [np.zeros((0, 4))] * 3):
        for i, p in enumerate(PARAMETERS):
            out[f"{p}_{kind}"] = np.full(len(n), np.nan)
            out[f"{p}_{kind}"][some] = values[:, i]
    return out


def _per_series(df: DataFrame, work: Callable[..., dict[str, np.ndarray]], result: str, time: str, value: str, keys: Sequence[str], baseline: str | None, order: Sequence[str]) -> DataFrame:
    """Apply ``work`` to the series of ``df``, many at once: keys and the columns of ``result``."""
    names = ["t", "y", *(["n0"] if baseline else [])]
    of = dict(zip(names, (time, value, baseline)))
    point = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).cast("double").alias(n) for n, c in of.items()])
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_points"))
    series = series.select(*keys, F.transform("_points", lambda x: F.struct(*[F.coalesce(x[n], F.lit(float("nan"))).alias(n) for n in names])).alias("_points"))
    added = T._parse_datatype_string(result)
    schema = T.StructType([*[series.schema[k] for k in keys], *added.fields])
    kinds = {f.name: {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}.get(f.dataType.simpleString(), pa.float64()) for f in added.fields}

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column(batch.num_columns - 1)
            for rows in _blocks(np.diff(points.offsets.to_numpy().astype(np.int64))):
                here, columns = _padded(points, rows, names)
                found = work(columns["t"], columns["y"], columns.get("n0"), here)
                own = [batch.column(i).take(pa.array(rows)) for i in range(len(keys))]
                new = [pa.array(found[n], k, from_pandas=k == pa.float64()) for n, k in kinds.items()]
                yield pa.RecordBatch.from_arrays([*own, *new], names=schema.names)

    return series.mapInArrow(done, schema)


def fit_gompertz(
    df: DataFrame,
    time: str = "time_h",
    value: str = "log_od_od0",
    keys: Sequence[str] = ("well",),
    clip_exp: float = 50.0,
    min_points: int = 5,
    fixed: Mapping[str, float] | None = None,
    log_transformed: bool = True,
    baseline: str = "n0",
    metadata: Sequence[str] | None = None,
    ties: Sequence[str] = (),
    most_points: int | None = None,
) -> DataFrame:
    """Per series: the parameters y0, A, mu_max, lambda of the least-squares curve within bounds.

    Parameters in ``fixed`` keep the given values. A series with too few points, in a range that is
    flat, or whose fit fails has ``success`` false and a message. ``max_value`` is that of the
    unsmoothed values. Points without a finite time, value or baseline do not count. A series is
    fitted in one row of one task; with ``most_points`` those of more rows are fitted by passes of aggregates
    over all tasks instead (see ``large_fit``), to the same parameters.
    """
    fixed = dict(fixed or {})
    if unknown := set(fixed) - set(PARAMETERS):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    require(df, [time, value, *keys] + ([baseline] if log_transformed else []), "fit_gompertz")
    rows = without_null_keys(df, keys)
    if metadata is None:
        metadata = [c for c in df.columns if c not in {*keys, *TIME_COLUMNS, time, value}]
    order = [time, *ties]

    def work(t, y, n0, here):
        return fit_block(t, y, n0, here, fixed, min_points, clip_exp)

    small, large = rows, None
    if most_points is not None:
        from auxograph.operators.large_fit import fit_large

        long = stored(rows.groupBy(*keys).count().where(F.col("count") > most_points).select(*keys), "long-series")
        if long.head(1):
            small, many = rows.join(long, list(keys), "left_anti"), rows.join(long, list(keys), "left_semi")
            large = fit_large(many, time, value, keys, clip_exp, min_points, fixed, baseline if log_transformed else None, ties, most_points)
    fits = _per_series(small, work, FIT, time, value, keys, baseline if log_transformed else None, order)
    if large is not None:
        fits = fits.unionByName(large)
    return fits.join(first_row(rows, keys, order, metadata), list(keys), "left") if metadata else fits


def initial_guesses(
    df: DataFrame, time: str = "time_h", value: str = "log_od_od0", keys: Sequence[str] = ("well",), min_points: int = 5, ties: Sequence[str] = ()
) -> DataFrame:
    """Per series: n, whether it is usable, and the start and bounds from which its fit sets out.

    The start is the 5th percentile, the distance to the 95th, the steepest step and its time.
    """
    require(df, [time, value, *keys], "initial_guesses")

    def work(t, y, n0, here):
        return guess_block(t, y, n0, here, min_points)

    return _per_series(without_null_keys(df, keys), work, GUESS, time, value, keys, None, [time, *ties])


def fit_quality(df: DataFrame, value: str = "log_od_od0", fitted: str = "od600_fit", keys: Sequence[str] = ("well",), parameters: int = 0) -> DataFrame:
    """Per series: n, r2, rmse of fitted values, ``parameters`` of which the fit was free to choose.

    Rows without a finite value or prediction do not count; r2 is null where the values are all equal.
    """
    rows = without_null_keys(df, keys).where(is_finite(value) & is_finite(fitted))
    rest = F.sum(F.pow(F.col(value) - F.col(fitted), F.lit(2)))
    spread = F.var_pop(value) * F.count(value)
    return rows.groupBy(*keys).agg(
        F.count(value).cast("int").alias("n"),
        F.when(F.max(value) > F.min(value), 1 - F.try_divide(rest, spread)).alias("r2"),
        F.sqrt(rest / F.greatest(F.lit(1), F.count(value) - parameters)).alias("rmse"),
    )


def predict_gompertz(
    df: DataFrame,
    params: DataFrame,
    time: str = "time_h",
    value: str = "log_od_od0",
    keys: Sequence[str] = ("well",),
    clip_exp: float = 50.0,
    fitted: str = "od600_fit",
) -> DataFrame:
    """Add the fitted curve and the residual; null where a series has no parameters or its fit failed.

    Of several parameter rows of a series the one with the smallest parameters counts.
    """
    require(params, [*keys, *PARAMETERS], "predict_gompertz")
    good = F.lit(True)
    for p in PARAMETERS:
        good &= is_finite(p)
    one = params.where(good).groupBy(*keys).agg(F.min(F.struct(*PARAMETERS)).alias("_p"))
    joined = df.join(one, list(keys), "left")
    at = lambda p: F.col(f"_p.{p}")
    curve_value = F.when(F.col("_p").isNotNull(), gompertz(F.col(time), at("y0"), at("A"), at("mu_max"), at("lambda"), clip_exp))
    return joined.withColumn(fitted, curve_value).withColumn("residual", F.col(value) - F.col(fitted)).drop("_p")
