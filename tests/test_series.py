import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from auxograph import catalogue
from auxograph.operators import blocks, gompertz, series
from auxograph.operators.gompertz import curve
from pyspark.sql import functions as F


def smooth(y, half):
    out = y.copy()
    for i in range(half, len(y) - half):
        around = np.sort(y[i - half : i + half + 1])
        out[i] = around[1:-1].mean()
    return out


@pytest.fixture(scope="module")
def readings():
    """Three curves with noise, one of them flat, in shuffled order."""
    r = np.random.default_rng(42)
    t = np.linspace(0, 24, 49)
    rows = []
    for well, p in (("A1", (0.0, 3.0, 0.5, 4.0)), ("B1", (0.0, 2.2, 0.35, 7.0))):
        y = 0.1 * np.exp(curve(t, p, 50) + r.normal(0, 0.01, len(t)))
        rows += [(well, float(a), float(b)) for a, b in zip(t, y)]
    rows += [("C1", float(a), 0.1 + 0.001 * (i % 3)) for i, a in enumerate(t)]
    return pd.DataFrame(rows, columns=["well", "time_h", "od"]).sample(frac=1, random_state=1)


def brute(df, window=5, times=4, half=2):
    out = {}
    for well, g in df.sort_values("time_h").groupby("well"):
        t, v = g.time_h.to_numpy(), g.od.to_numpy()
        n0 = v[:4].mean()
        y = np.log(v / n0)
        for _ in range(times):
            y = smooth(y, half)
        if y.max() - y.min() <= math.exp(0.1):
            out[well] = None
            continue
        fits = [np.polyfit(t[i : i + window], y[i : i + window], 1) for i in range(len(t) - window + 1)]
        k = int(np.argmax([f[0] for f in fits]))
        tw, yw = t[k : k + window], y[k : k + window]
        rest = yw - np.polyval(fits[k], tw)
        top = int(np.argmax(np.round(y, 12)))
        out[well] = (fits[k][0], 1 - (rest**2).sum() / ((yw - yw.mean()) ** 2).sum(), np.sqrt((rest**2).mean()), np.exp(y[top]) * n0, t[top])
    return out


def test_max_growth_rate(spark, readings):
    log = series.log_ratio(spark.createDataFrame(readings), "od", window=4)
    got = {r.well: r for r in series.max_growth_rate(log, window=5, smoothing=4).collect()}
    for well, want in brute(readings).items():
        r = got[well]
        if want is None:
            assert not r.success and r.message == series.SHORT_OR_FLAT and r.mv_mu_max is None
        else:
            assert r.success and (r.mv_mu_max, r.mv_r2, r.mv_rmse, r.max_value, r.max_time) == pytest.approx(want, rel=1e-7)


def test_one_exchange(spark, readings):
    log = series.log_ratio(spark.createDataFrame(readings), "od", window=4)
    done = series.moving_slope(series.smoothed(log, "log_od_od0", ["well"], "time_h", "y", 2, 4), "y", ["well"], "time_h")
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_baseline_rules(spark):
    rows = [("a", 0.0, float("nan")), ("a", 1.0, 0.0), ("a", 2.0, 2.0), ("a", 3.0, 4.0), (None, 0.0, 1.0), ("b", 0.0, -1.0), ("b", 1.0, 3.0)]
    got = series.log_ratio(spark.createDataFrame(rows, "well string, time_h double, od double"), "od", window=2).orderBy("well", "time_h").collect()
    assert [(r.well, r.n0) for r in got] == [("a", 1.0)] * 4 + [("b", 1.0)] * 2
    assert [r.log_od_od0 for r in got] == pytest.approx([None, None, math.log(2), math.log(4), None, math.log(3)], nan_ok=True)


def test_short_series_and_errors(spark):
    rows = [("a", float(i), float(i * i + 1)) for i in range(4)]
    log = series.log_ratio(spark.createDataFrame(rows, "well string, time_h double, od double"), "od")
    assert series.max_growth_rate(log).first().message == series.SHORT_OR_FLAT
    assert series.max_growth_rate(log, min_points=3, window=9).first().message.startswith("insufficient data for window size 9")
    with pytest.raises(ValueError):
        series.smoothed(log, "od", ["well"], "time_h", "y", 0)
    with pytest.raises(ValueError, match="missing columns"):
        series.max_growth_rate(log.drop("n0").drop("time_h"))


def test_equal_times_have_no_slope(spark):
    rows = [("a", 1.0, float(i)) for i in range(5)]
    got = series.moving_slope(spark.createDataFrame(rows, "well string, t double, y double"), "y", ["well"], "t", 5, ["y"])
    assert all(r.slope is None for r in got.collect())


def test_gompertz_recovers(spark, readings):
    log = series.log_ratio(spark.createDataFrame(readings), "od", window=4)
    got = {r.well: r for r in gompertz.fit_gompertz(log, fixed={"y0": 0.0}).collect()}
    assert (got["A1"].A, got["A1"].mu_max, got["A1"]["lambda"]) == pytest.approx((3.0, 0.5, 4.0), rel=0.03)
    assert (got["B1"].A, got["B1"].mu_max, got["B1"]["lambda"]) == pytest.approx((2.2, 0.35, 7.0), rel=0.03)
    assert got["A1"].r2 > 0.99 and got["A1"].y0 == 0.0 and not got["C1"].success
    free = gompertz.fit_gompertz(log.where("well = 'A1'")).first()
    assert free.rmse <= got["A1"].rmse + 1e-3 and free.max_value == pytest.approx(readings[readings.well == "A1"].od.max())
    with pytest.raises(ValueError, match="unknown parameters"):
        gompertz.fit_gompertz(log, fixed={"slope": 1.0})


def test_predictions(spark, readings):
    log = series.log_ratio(spark.createDataFrame(readings), "od", window=4)
    fits = gompertz.fit_gompertz(log, fixed={"y0": 0.0})
    rows = gompertz.predict_gompertz(log, fits).where("well = 'A1'").orderBy("time_h").toPandas()
    p = fits.where("well = 'A1'").first()
    want = curve(rows.time_h.to_numpy(), (p.y0, p.A, p.mu_max, p["lambda"]), 50)
    assert np.allclose(rows.od600_fit, want) and np.allclose(rows.residual, rows.log_od_od0 - want)
    assert gompertz.predict_gompertz(log, fits).where("well = 'C1' and od600_fit is not null").count() == 0


def test_curve(spark):
    from auxograph.functions.growth import gompertz as expression

    rows = spark.range(50).select(expression(F.col("id").cast("double"), 0.05, 2.0, 0.4, 3.0).alias("y"), expression("id", 0.7, 0.0, 0.4, 3.0).alias("flat")).collect()
    y = [r.y for r in rows]
    assert y == sorted(y) and y[0] == pytest.approx(0.05, abs=0.05) and {r.flat for r in rows} == {0.7}


def test_order_does_not_matter(spark, readings):
    def fitted(df):
        return sorted(map(str, series.max_growth_rate(series.log_ratio(df, "od", window=4), smoothing=2).collect()))

    df = spark.createDataFrame(readings)
    assert fitted(df) == fitted(df.repartition(7)) == fitted(df.orderBy(F.rand(3)))


def test_many_curves_at_once(spark):
    """Curves of unlike lengths and parameters, on exact points, are found to 1e-6; odd series do not disturb them."""
    planted = {f"w{i}": (0.1 * (i % 3), 1.5 + 0.3 * (i % 5), 0.25 + 0.1 * (i % 4), 1.0 + i % 6) for i in range(60)}
    rows = [(w, t / 4, float(curve(np.array([t / 4]), p, 50)[0])) for w, p in planted.items() for t in range(50 + 7 * int(w[1:]) % 90 + 30)]
    rows += [("short", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 2.0, None)] + [("same time", 1.0, float(i)) for i in range(9)] + [("gaps", float(i), float("nan") if i % 2 else float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "well string, t double, y double")
    got = {r.well: r for r in gompertz.fit_gompertz(df, "t", "y", log_transformed=False).collect()}
    assert len(got) == 64
    for w, p in planted.items():
        assert got[w].success and [got[w][k] for k in gompertz.PARAMETERS] == pytest.approx(p, rel=1e-6, abs=1e-6)
    assert not got["short"].success and not got["flat"].success and got["same time"].n == 9 and got["gaps"].n == 10 and got["gaps"].success
    assert gompertz.fit_gompertz(df.where("false"), "t", "y", log_transformed=False).count() == 0
    all_fixed = gompertz.fit_gompertz(df.where("well = 'w1'"), "t", "y", fixed=dict(zip(gompertz.PARAMETERS, planted["w1"])), log_transformed=False).first()
    assert all_fixed.rmse == pytest.approx(0, abs=1e-12)


def test_fit_is_a_minimum(spark, readings):
    """No parameter, moved a little within its bounds, makes the fit better."""
    log = series.log_ratio(spark.createDataFrame(readings), "od", window=4).where("well in ('A1', 'B1')")
    for r in gompertz.fit_gompertz(log).collect():
        rows = log.where(log.well == r.well).orderBy("time_h").toPandas().dropna(subset=["log_od_od0"])
        t, y, p = rows.time_h.to_numpy(), rows.log_od_od0.to_numpy(), np.array([r[k] for k in gompertz.PARAMETERS])
        cost = ((y - curve(t, p, 50)) ** 2).sum()
        for i in range(4):
            for step in (-1e-3, 1e-3):
                moved = p.copy()
                moved[i] = max(0.0, moved[i] + step)
                assert ((y - curve(t, moved, 50)) ** 2).sum() >= cost - 1e-9


def test_quality_and_guesses(spark, readings):
    log = series.log_ratio(spark.createDataFrame(readings), "od", window=4)
    fits = gompertz.fit_gompertz(log, fixed={"y0": 0.0})
    quality = {r.well: r for r in gompertz.fit_quality(gompertz.predict_gompertz(log, fits), parameters=3).collect()}
    for r in fits.where("success").collect():
        assert (quality[r.well].r2, quality[r.well].rmse) == pytest.approx((r.r2, r.rmse), rel=1e-9)
    a1 = gompertz.initial_guesses(log).where("well = 'A1'").first()
    y = log.where("well = 'A1' and log_od_od0 is not null").toPandas().log_od_od0
    assert a1.usable and a1.y0_start == pytest.approx(max(0, np.percentile(y, 5))) and a1.A_start == pytest.approx(np.percentile(y, 95) - np.percentile(y, 5))


def long_series(spark, n):
    """One series of n rows, a short one, one of a single row, and repeated times, nulls and NaN."""
    rows = spark.range(n).selectExpr("case when id % 50 = 49 then id % 7 else -1 end as g", "id", "pmod(hash(id), 100000) / 64.0D as t", "1 + abs(sin(id / 300.0D)) + (id % 13) / 10.0D as v")
    odd = spark.createDataFrame([(9, -1, 1.0, 3.0), (-1, -2, -1.0, None), (-1, -3, -2.0, float("nan"))], rows.schema)
    return rows.unionByName(odd)


def test_blocks_of_a_hot_series(spark):
    """Windows by blocks have the results of windows over whole series, on all operators."""
    df = long_series(spark, 4_000)
    args = {"keys": ["g"], "time": "t", "ties": ["id"]}
    logs = series.log_ratio(df, "v", "y", window=4, **args)
    pairs = [
        (logs, series.log_ratio(df, "v", "y", window=4, block_rows=64, **args)),
        (series.moving_slope(df, "v", window=5, **args), series.moving_slope(df, "v", window=5, block_rows=50, **args)),
        (series.smoothed(df.where("v is not null and not isnan(v)"), "v", out="s", times=3, **args), series.smoothed(df.where("v is not null and not isnan(v)"), "v", out="s", times=3, block_rows=40, **args)),
        (series.differences(df, "v", **args), series.differences(df, "v", block_rows=33, **args)),
        (series.max_growth_rate(logs, value="y", smoothing=2, metadata=["id"], **args), series.max_growth_rate(logs, value="y", smoothing=2, metadata=["id"], block_rows=37, **args)),
    ]
    for plain, blocked in pairs:
        assert blocked.columns == plain.columns
        key = ["g", "id"]
        rounded = lambda f: [tuple(round(x, 9) if isinstance(x, float) and x == x else str(x) for x in r) for r in f.orderBy(*key).collect()]
        assert rounded(blocked) == rounded(plain)
    with pytest.raises(ValueError, match="smaller than their halo"):
        series.moving_slope(df, "v", window=20, block_rows=10, **args)


def test_a_hot_series_is_spread(spark):
    """No task sees much more than its blocks of a series that holds nearly all rows."""
    from pyspark.sql import functions as F

    df = long_series(spark, 40_000)
    done = blocks.in_blocks(df, ["g"], ["t", "id"], 1_000, 5, 5)
    sizes = done.groupBy("g", blocks.BLOCK).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 1_010 and sizes[1] > 40
    assert done.where(blocks.OWN).count() == df.count()
    plan = series.moving_slope(df, "v", ["g"], "t", 5, ["id"], block_rows=1_000)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "_block" in plan


def test_carried_forward(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    df = long_series(spark, 3_000).withColumn("title", F.when(F.col("id") % 211 == 3, F.concat(F.lit("T"), "id")))
    got = blocks.carried_forward(df, "title", ["g"], ["t", "id"], "said", 25)
    want = df.withColumn("said", F.last("title", ignorenulls=True).over(Window.partitionBy("g").orderBy("t", "id")))
    assert got.select("id", "said").exceptAll(want.select("id", "said")).count() == 0 == want.select("id", "said").exceptAll(got.select("id", "said")).count()


def test_large_fit(spark):
    """Passes of aggregates give the parameters of the fit that holds whole series; no array of points, no hot task."""
    from auxograph.operators.large_fit import fit_large

    rng = np.random.default_rng(5)
    rows = []
    for g, (n, y0, a, mu, lag) in enumerate([(900, 0.0, 2.0, 0.4, 3.0), (300, 0.1, 1.2, 0.9, 6.0), (200, 0.3, 3.0, 0.2, 1.0), (4, 0, 1, 1, 1), (60, 0.0, 0.0, 1.0, 1.0)]):
        t = np.sort(rng.uniform(0, 24, n)).round(2)
        y = curve(t, (y0, a, mu, lag), 50.0) + rng.normal(0, 0.02, n)
        rows += [(g, int(i), float(x), float(z), 0.05) for i, (x, z) in enumerate(zip(t, y))]
    rows += [(7, 0, None, 1.0, 0.05), (7, 1, 1.0, float("nan"), 0.05), (0, -1, 30.0, float("inf"), 0.05), (None, 0, 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "g int, i int, t double, y double, n0 double").repartition(5)
    for fixed in ({}, {"y0": 0.0}):
        options = {"time": "t", "value": "y", "keys": ["g"], "fixed": fixed, "metadata": [], "ties": ["i"]}
        want = {r.g: r for r in gompertz.fit_gompertz(df, **options).collect()}
        large = fit_large(df, "t", "y", ["g"], fixed=fixed, baseline="n0", ties=["i"], block_rows=50)
        plan = large._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "SinglePartition" not in plan
        # one way each, to save time
        for got in [gompertz.fit_gompertz(df, most_points=250, **options)] if fixed else [large]:
            found = {r.g: r for r in got.collect()}
            assert got.columns == list(next(iter(want.values())).asDict()) and set(found) == set(want) == {0, 1, 2, 3, 4, 7}
            for g, w in want.items():
                assert (found[g].n, found[g].success, found[g].message) == (w.n, w.success, w.message)
                for name in ("y0", "A", "mu_max", "lambda", "r2", "rmse", "max_value", "max_time"):
                    assert found[g][name] == (None if w[name] is None else pytest.approx(w[name], rel=1e-6, abs=1e-6)), (g, name)
        assert want[0].success and not want[3].success


def test_equal_maxima_are_told_apart_as_in_sql(spark, tmp_path):
    # two maxima are equal to the last digits, where Java's logarithm and the C library's part, and lie at the bound of the 12th
    values = [
        4.09, 33.6, 41.91, 13.94, 38.08, 5.58, 113.41, 49.52, 32.87, 42.21, 8.88, 114.52, 29.97, 33.08, 88.92, 5.6, 36.96, 0.86, 44.29, 53.16, 47.61, 16.67, 114.35,
        2.65, 132.61, 97.23, 122.32, 19.92, 244.86, 21.95, 37.18, 56.09, 119.16, 46.27, 135.73, 26.36, 62.49, 105.29, 13.23, 76.08, 24.68, 13.51, 1.34, 119.59, 19.11,
        20.61, 14.91, 39.11, 40.99, 37.96, 6.21, 96.83, 62.17, 58.86, 94.3, 89.95, 6.44, 95.41, 19.28, 7.92, 63.47, 12.5, 63.28, 53.78, 127.65, 14.75, 58.67, 23.43, 34.24,
    ]
    db = duckdb.connect()
    db.execute("create table events as select i as event_id, timestamp '2024-01-01' + i * interval '1 hour' as ts, 1::bigint as user_id, v as value from (select unnest(range(len($1))) as i, unnest($1) as v)", [values])
    db.execute(f"copy events to '{tmp_path}/events.parquet'")
    want = db.execute(f"select max_time, max_value from ({catalogue.oracle_sql()['max_growth_rate']})").fetchone()
    got = catalogue.queries()["max_growth_rate"](spark, str(tmp_path)).select("max_time", "max_value").first()
    assert tuple(got) == pytest.approx(want, rel=1e-6)
