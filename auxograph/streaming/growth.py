"""Growth rates of live series: the steepest moving regression so far, kept up to date per series.

State of a series: its readings newer than the watermark, which may still get neighbours; the last
``window - 1`` readings before it, from which a later window may begin; and one row of sums and maxima
for all that is older. So state doesn't grow with a series' length, only with its readings within
``late``. A result is the state plus the newer readings, put in order; it is the result of
``series.max_growth_rate`` without smoothing on the table of all readings that came, in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auxograph.functions.growth import FLAT_RANGE
from auxograph.functions.values import is_finite, require, without_null_keys
from auxograph.operators.series import SHORT_OR_FLAT

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3.6e9

RESULT = (
    "n int, success boolean, message string, mv_mu_max double, mv_r2 double, mv_rmse double, window_start timestamp, "
    "max_value double, max_time timestamp, settled boolean"
)
#: what is older than the watermark: readings of the baseline and their sum, logarithms and their range, the best window, the top
_DONE = (
    "early long, early_sum double, n long, low double, high double, slope double, r2 double, rmse double, began long, top double, top_at long, until long"
)
_NAMES = [field.split()[0] for field in _DONE.split(",")]


def _nothing() -> dict[str, Any]:
    return dict.fromkeys(("slope", "r2", "rmse", "began", "top", "top_at", "low", "high")) | {"early": 0, "early_sum": 0.0, "n": 0, "until": None}


def _windows(at: np.ndarray, y: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Slope, r2 and rmse of each ``window`` readings from a reading on; a slope is NaN where no time passes."""
    view = np.lib.stride_tricks.sliding_window_view
    hours = (at - at[0]) / HOUR
    dt, dy = view(hours, window), view(y, window)
    dt, dy = dt - dt.mean(1, keepdims=True), dy - dy.mean(1, keepdims=True)
    sxx, sxy, syy = (dt * dt).sum(1), (dt * dy).sum(1), (dy * dy).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(sxx > 0, sxy / sxx, np.nan)
        fit = sxy * sxy / sxx
        r2 = np.where(syy == 0, 0.0, fit / syy)
    return slope, r2, np.sqrt(np.maximum(0.0, syy - fit) / window)


def advanced(done: dict[str, Any], recent: np.ndarray, rows: np.ndarray, window: int, averaged: int) -> tuple[dict[str, Any], np.ndarray]:
    """``done`` and the recent readings after ``rows``, (at, value) pairs that follow in order of time and value."""
    done = dict(done)
    early = rows["value"][: max(0, averaged - done["early"])]
    done["early"] += len(early)
    done["early_sum"] += float(early.sum())
    rows = rows[rows["value"] > 0]
    if not len(rows):
        return done, recent
    y = np.log(rows["value"])
    done["n"] += len(rows)
    low, high = float(y.min()), float(y.max())
    done["low"] = low if done["low"] is None else min(low, done["low"])
    done["high"] = high if done["high"] is None else max(high, done["high"])
    i = int(np.argmax(np.round(y, 12)))
    if done["top"] is None or round(float(y[i]), 12) > round(math.log(done["top"]), 12):
        done["top"], done["top_at"] = float(rows["value"][i]), int(rows["at"][i])
    seen = np.concatenate([recent, rows])
    if len(seen) >= window:
        slope, r2, rmse = _windows(seen["at"], np.log(seen["value"]), window)
        if not np.isnan(slope).all():
            i = int(np.nanargmax(slope))
            if done["slope"] is None or slope[i] > done["slope"]:
                done |= {"slope": float(slope[i]), "r2": float(r2[i]), "rmse": float(rmse[i]), "began": int(seen["at"][i])}
    return done, seen[max(0, len(seen) - window + 1) :]


def result(done: dict[str, Any], window: int, min_points: int, settled: bool) -> dict[str, Any]:
    """The row of a series, in the columns of ``RESULT``."""
    based = done["early"] > 0 and done["early_sum"] > 0
    n = done["n"] if based else 0
    message, good = "ok", False
    if n < min_points or done["high"] - done["low"] <= FLAT_RANGE:
        message = SHORT_OR_FLAT
    elif n < window:
        message = f"insufficient data for window size {window} (need >= {window} points)"
    elif done["slope"] is None:
        message = "all windows produced invalid growth rates"
    else:
        good = True
    time = lambda at: pd.Timestamp(at, unit="us") if good else pd.NaT
    value = lambda name: done[name] if good else None
    return {
        "n": n, "success": good, "message": message, "mv_mu_max": value("slope"), "mv_r2": value("r2"), "mv_rmse": value("rmse"),
        "window_start": time(done["began"]), "max_value": value("top"), "max_time": time(done["top_at"]), "settled": settled,
    }


_PAIR = np.dtype([("at", "<i8"), ("value", "<f8")])


def _get(state: Any) -> np.ndarray:
    """Readings, which are held as the bytes of one array: one value of a state, however many they are."""
    return np.frombuffer(bytes(state.get()[0]), _PAIR) if state.exists() else np.zeros(0, _PAIR)


def _put(state: Any, rows: np.ndarray) -> None:
    state.update((rows.tobytes(),)) if len(rows) else state.clear()


class GrowthRates(StatefulProcessor):
    """State and results of one series at a time. The last two columns of its rows are microseconds and value."""

    def __init__(self, keys: Sequence[str], window: int, min_points: int, averaged: int):
        self.keys, self.window, self.min_points, self.averaged = list(keys), window, min_points, averaged

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", _DONE)
        self.recent = handle.getValueState("recent", "readings binary")
        self.newer = handle.getValueState("newer", "readings binary")

    def _settle(self, added: np.ndarray, times: Any) -> dict[str, Any]:
        """Take readings up to the watermark into the sums; the result with those that are newer."""
        held = self.done.get() if self.done.exists() else None
        done = dict(zip(_NAMES, held)) if held else _nothing()
        # a series that is new has no other state and no timer: each that isn't asked for saves a round trip
        recent = _get(self.recent) if held else added[:0]
        rows = np.concatenate([_get(self.newer), added]) if held else added
        if done["until"] is not None:
            rows = rows[rows["at"] > done["until"]]
        rows = rows[np.lexsort((rows["value"], rows["at"]))]
        watermark = times.getCurrentWatermarkInMs() * 1000
        ripe = rows["at"] <= watermark
        if ripe.any():
            done, recent = advanced(done, recent, rows[ripe], self.window, self.averaged)
            _put(self.recent, recent)
        done["until"] = watermark if done["until"] is None else max(watermark, done["until"])
        self.done.update(tuple(done[n] for n in _NAMES))
        rows = rows[~ripe]
        if held or len(rows):
            _put(self.newer, rows)
        for at in list(self.handle.listTimers()) if held else ():
            self.handle.deleteTimer(at)
        if len(rows):
            self.handle.registerTimer(int(rows["at"][-1]) // 1000 + 1)
        return result(advanced(done, recent, rows, self.window, self.averaged)[0], self.window, self.min_points, not len(rows))

    def _row(self, key: tuple, found: dict[str, Any]) -> pd.DataFrame:
        row = {k: [v] for k, v in (dict(zip(self.keys, key)) | found).items()}
        row |= {c: np.array(row[c], "float64") for c in ("mv_mu_max", "mv_r2", "mv_rmse", "max_value")}
        return pd.DataFrame(row | {c: np.array([row[c][0].to_datetime64()], "datetime64[us]") for c in ("window_start", "max_time")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = [np.rec.fromarrays([pdf.iloc[:, -2].to_numpy("int64"), pdf.iloc[:, -1].to_numpy("float64")], dtype=_PAIR) for pdf in rows]
        yield self._row(key, self._settle(np.concatenate([np.zeros(0, _PAIR), *parts]), timerValues))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._row(key, self._settle(np.zeros(0, _PAIR), timerValues))

    def close(self) -> None:
        pass


def growth_rates(
    df: DataFrame,
    time: str = "ts",
    value: str = "od",
    keys: Sequence[str] = ("well",),
    window: int = 5,
    min_points: int = 5,
    averaged: int = 1,
    late: str = "1 hour",
) -> DataFrame:
    """Per series (keys, n, success, message, mv_mu_max, mv_r2, mv_rmse, window_start, max_value, max_time, settled) of a stream.

    Readings are positive amounts; their logarithms are regressed on hours. ``averaged``: readings of the
    baseline; a series whose baseline isn't positive has none that count. Rows with a null key, a null time, or a value
    that is null or not finite don't count; readings of equal time come by value. A stream gives a row for each series of a batch, and another when the
    watermark, ``late`` behind the newest reading, has passed all that a series has (``settled``). Readings later than
    that don't count, nor those before 1970, where watermarks begin. The stream's output mode is ``update``. Sets the session's state store to RocksDB, which this kind of state needs.
    """
    require(df, [time, value, *keys], "growth_rates")
    if window < 2 or averaged < 1:
        raise ValueError("a window has two readings, a baseline one at least")
    if not df.isStreaming:
        raise ValueError("growth_rates takes a stream; series.max_growth_rate takes a table")
    df.sparkSession.conf.set(STORE, ROCKS)
    rows = without_null_keys(df, [*keys, time]).where(is_finite(value))
    rows = rows.withWatermark(time, late).select(*keys, time, F.unix_micros(time).alias("_at"), F.col(value).cast("double").alias("_value"))
    schema = T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string(RESULT)])
    processor = GrowthRates(keys, window, min_points, averaged)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "EventTime")
