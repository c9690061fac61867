"""The modified Gompertz fit for series that are larger than a task.

Of a series only sums are ever gathered. Each pass over the points evaluates, for every series at once,
the squared error, its gradient and the normal matrix of the parameters on trial, as native aggregates
that are summed up in every task before they are exchanged. A row per series carries the state of its
Levenberg-Marquardt iteration, the same as in ``gompertz.bounded_fit``: numpy takes the steps of many
states together, and the state is written after each pass. The guesses come from ranks (percentiles) and
from blocks of time (the steepest step).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auxograph.functions.growth import FLAT_RANGE
from auxograph.functions.stored import stored
from auxograph.functions.values import finite, is_finite, without_null_keys
from auxograph.operators.blocks import OWN, PLACE, in_blocks
from auxograph.operators.gompertz import FIT, LEAST_GAIN, MOST_EVALUATIONS, PARAMETERS, damped_step
from auxograph.operators.ranking import ranked
from auxograph.operators.series import SHORT_OR_FLAT

#: Series whose states are sent to all tasks; more are joined by key.
SENT_SERIES = 10_000
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_SUMS = ["e", *[f"g{i}" for i in range(4)], *[f"n{i}{j}" for i, j in _PAIRS]]
#: State of a series: parameters, those on trial, error, gradient and normal matrix, damping, evaluations, whether it goes on.
_STATE = {"p": 4, "trial": 4, "lower": 4, "upper": 4, "cost": 1, "g": 4, "n": 16, "damping": 1, "used": 1, "active": 1, "first": 1}


def _derivatives(clip_exp: float) -> tuple[Column, list[Column]]:
    """The residual at the parameters on trial, and the derivatives of the curve by each, of points (t, y)."""
    y0, big, mu, lag = (F.col("_s.trial")[i] for i in range(4))
    a = F.when(big == 0, 1.0).otherwise(big)
    before = lag - F.col("t")
    u = mu * math.e / a * before + 1
    grown = F.exp(F.greatest(F.lit(-clip_exp), F.least(F.lit(clip_exp), u)))
    level = F.exp(-grown)
    steep = F.when(F.abs(u) >= clip_exp, 0.0).otherwise(grown * level)
    return F.col("y") - y0 - big * level, [F.lit(1.0), level + steep * mu * math.e * before / a, -steep * math.e * before, -steep * math.e * mu]


def _guesses(points: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """One row per series: its size, range and greatest value, and the start and bounds of its parameters.

    The 5th and 95th percentiles are picked by rank; the steepest step is found in blocks of time. Both
    as ``gompertz.guesses`` has them.
    """
    by_value = ranked(points.select(*keys, "y"), ["y"], "rank", keys)
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"), F.min("y").alias("low_y"), F.max("y").alias("top"), F.max("t").alias("end"))
    shares = {"p5": 0.05, "p95": 0.95}
    wanted = by_value.join(sizes.select(*keys, "n"), keys)
    picked = []
    for name, share in shares.items():
        at = F.floor((F.col("n") - 1) * share)
        picked += [F.max(F.when(F.col("rank") == at + 1, F.col("y"))).alias(f"{name}_low"), F.max(F.when(F.col("rank") == F.least(at + 2, F.col("n")), F.col("y"))).alias(f"{name}_high")]
    ranks = wanted.groupBy(*keys).agg(*picked)
    between = lambda name: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * ((F.col("n") - 1) * shares[name] - F.floor((F.col("n") - 1) * shares[name]))
    blocks = in_blocks(points, keys, ["t", "ties"], block_rows, 0, 1)
    w = Window.partitionBy(*keys, "_block").orderBy(PLACE)
    step = F.lead("t").over(w) - F.col("t")
    slope = F.try_divide(F.lead("y").over(w) - F.col("y"), F.nullif(step, F.lit(0.0)))
    steps = blocks.withColumn("slope", slope).where(OWN)
    # of equal maxima the first counts
    steepest = F.max_by(F.struct("slope", "t"), F.when(F.col("slope").isNotNull(), F.struct(F.col("slope").alias("s"), (-F.col(PLACE)).alias("p"))))
    top = F.max_by(F.struct("t", "n0"), F.struct(F.col("y").alias("y"), (-F.col(PLACE)).alias("p")))
    shapes = steps.groupBy(*keys).agg(steepest.alias("steepest"), top.alias("at_top"), F.min("t").alias("begin"))
    joined = sizes.join(ranks, keys).join(shapes, keys)
    lower = F.array(F.lit(0.0), F.lit(1e-5), F.lit(1e-5), F.lit(0.0))
    upper = F.array(F.greatest(F.lit(2.0), 2 * F.col("top")), F.greatest(F.lit(1e-3), 2 * F.col("top")), F.lit(10.0), 1.5 * F.col("end") + 1)
    some = F.col("steepest").isNotNull()
    start = F.array(
        between("p5"),
        F.greatest(between("p95") - between("p5"), F.lit(1e-3)),
        F.when(some, F.greatest(F.col("steepest.slope"), F.lit(1e-3))).otherwise(0.1),
        F.when(some, F.col("steepest.t")).otherwise(F.col("begin")),
    )
    clipped = F.transform(F.arrays_zip(start.alias("s"), lower.alias("l"), upper.alias("u")), lambda x: F.greatest(x["l"], F.least(x["u"], x["s"])))
    return joined.select(*keys, "n", (F.col("top") - F.col("low_y")).alias("range"), "at_top", F.col("top"), clipped.alias("start"), lower.alias("lower"), upper.alias("upper"))


def _stepped(free: np.ndarray, names: list[str]):
    """Take up what a pass has found at the parameters on trial, and put the next ones on trial."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            state = batch.column("_s")
            part = {k: state.field(k).flatten().to_numpy().reshape(-1, n) if n > 1 else state.field(k).to_numpy() for k, n in _STATE.items()}
            sums = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in _SUMS}
            cost, gradient = sums["e"], np.stack([sums[f"g{i}"] for i in range(4)], 1)
            normal = np.empty((len(cost), 4, 4))
            for i, j in _PAIRS:
                normal[:, i, j] = normal[:, j, i] = sums[f"n{i}{j}"]
            first, active = part["first"] > 0, part["active"] > 0
            better = active & (first | (cost < part["cost"]))
            small = ~first & (part["cost"] - cost <= LEAST_GAIN * np.maximum(part["cost"], 1e-300))
            take = lambda new, old: np.where(better.reshape(-1, *[1] * (old.ndim - 1)), new, old)
            p, n = take(part["trial"], part["p"]), take(normal.reshape(-1, 16), part["n"])
            g, best = take(gradient, part["g"]), take(cost, part["cost"])
            damping = np.where(better & ~first, np.maximum(part["damping"] / 5, 1e-12), np.where(active & ~better, part["damping"] * 4, part["damping"]))
            used = part["used"] + active + better
            inside, trial = damped_step(p, g, n.reshape(-1, 4, 4), damping, free, part["lower"], part["upper"])
            active = active & np.isfinite(best) & ~(better & small) & inside.any(1) & (damping < 1e12) & (used < MOST_EVALUATIONS)
            trial = np.where(active[:, None], trial, p)
            new = {"p": p, "trial": trial, "lower": part["lower"], "upper": part["upper"], "cost": best, "g": g, "n": n, "damping": damping, "used": used, "active": active.astype(float), "first": np.zeros(len(p))}
            arrays = []
            for k, size in _STATE.items():
                flat = pa.array(np.asarray(new[k], np.float64).reshape(-1))
                arrays.append(flat if size == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(p) + 1, size, dtype=np.int32)), flat))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.StructArray.from_arrays(arrays, names=list(_STATE))], names=[*names, "_s"])

    return rows


def fit_large(
    df: DataFrame,
    time: str,
    value: str,
    keys: Sequence[str],
    clip_exp: float = 50.0,
    min_points: int = 5,
    fixed: Mapping[str, float] | None = None,
    baseline: str | None = None,
    ties: Sequence[str] = (),
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Keys and the columns of ``gompertz.FIT`` of each series, as ``fit_gompertz`` has them; no task holds a series.

    ``baseline``: the column of baselines, or None if the values are no logarithms. One pass over the points
    per step of the slowest series; series that have converged are left out of the passes.
    """
    keys, fixed = list(keys), dict(fixed or {})
    order = F.struct(*[F.col(c) for c in ties]) if ties else F.lit(0)
    rows = without_null_keys(df, keys)
    n0 = finite(baseline) if baseline else F.lit(1.0)
    good = is_finite(time) & is_finite(value) & (is_finite(baseline) if baseline else F.lit(True))
    number = lambda c: F.col(c).cast("double")
    points = stored(rows.where(good).select(*keys, number(time).alias("t"), number(value).alias("y"), n0.alias("n0"), order.alias("ties")), "points")
    every = rows.select(*keys).distinct()
    guessed = stored(_guesses(points, keys, block_rows), "guesses")
    usable = guessed.where((F.col("n") >= min_points) & (F.col("range") > FLAT_RANGE))
    start = F.array(*[F.lit(float(fixed[p])) if p in fixed else F.col("start")[i] for i, p in enumerate(PARAMETERS)])
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    begin = {"p": start, "trial": start, "lower": F.col("lower"), "upper": F.col("upper"), "cost": F.lit(math.inf), "g": zeros(4), "n": zeros(16), "damping": F.lit(1e-2), "used": F.lit(0.0), "active": F.lit(1.0), "first": F.lit(1.0)}
    state = stored(usable.select(*keys, F.struct(*[c.alias(k) for k, c in begin.items()]).alias("_s")), "state-0")
    free = np.array([p not in fixed for p in PARAMETERS])
    residual, slopes = _derivatives(clip_exp)
    slim = points.select(*keys, "t", "y")
    schema, finished = state.schema, None
    terms = {"e": residual * residual, **{f"g{i}": residual * d for i, d in enumerate(slopes)}, **{f"n{i}{j}": slopes[i] * slopes[j] for i, j in _PAIRS}}
    few = state.limit(SENT_SERIES + 1).count() <= SENT_SERIES
    passes = 0
    while state.head(1):
        sent = F.broadcast(state) if few else state
        found = slim.join(sent, keys).groupBy(*keys).agg(F.first("_s").alias("_s"), *[F.sum(c).alias(k) for k, c in terms.items()])
        passes += 1
        stepped = stored(found.mapInArrow(_stepped(free, keys), schema), f"state-{passes}")
        done = stepped.where("_s.active = 0")
        finished = done if finished is None else finished.unionByName(done)
        state = stepped.where("_s.active > 0")
        if passes % 20 == 0:
            finished = stored(finished, "finished")
    fitted = (finished if finished is not None else state).join(guessed, keys)
    spread = points.join(fitted.select(*keys), keys, "left_semi").groupBy(*keys).agg((F.var_pop("y") * F.count("*")).alias("spread"))
    fitted = fitted.join(spread, keys)
    cost, ok = F.col("_s.cost"), is_finite("_s.cost")
    level = F.exp("top") * F.col("at_top.n0") if baseline else F.col("top")
    columns = {p: F.col("_s.p")[i] for i, p in enumerate(PARAMETERS)} | {
        "r2": F.when(F.col("spread") > 0, 1 - cost / F.col("spread")),
        "rmse": F.sqrt(cost / F.greatest(F.lit(1), F.col("n") - int(free.sum()))),
        "max_value": level,
        "max_time": F.col("at_top.t"),
    }
    fits = fitted.select(*keys, ok.alias("success"), F.when(ok, "ok").otherwise("the fit is not finite").alias("message"), *[F.when(ok, c).alias(k) for k, c in columns.items()])
    joined = every.join(guessed.select(*keys, "n"), keys, "left").join(fits, keys, "left")
    types = {f.name: f.dataType for f in T._parse_datatype_string(FIT).fields}
    absent = {"n": F.lit(0), "success": F.lit(False), "message": F.lit(SHORT_OR_FLAT)}
    return joined.select(*keys, *[(F.coalesce(F.col(k), absent[k]) if k in absent else F.col(k)).cast(t).alias(k) for k, t in types.items()])
