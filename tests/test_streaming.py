import random

import pytest
from auxograph.operators import series
from auxograph.streaming import growth, live
from pyspark.sql import functions as F


def test_stream_equals_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("well,ts,od\nA1,2024-01-01 00:05:00,1\nA1,2024-01-01 00:50:00,3\nB1,2024-01-01 01:10:00,2\n")
    seen = []
    stream = live.windowed(live.read_stream(spark, str(folder)), "ts", ["well"], "od", "1 hour", late="2 hours")
    q = live.each_batch(stream, lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    (folder / "2.csv").write_text("well,ts,od\nA1,2024-01-01 09:00:00,9\n")
    q = live.each_batch(stream, lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    table = spark.read.schema(live.READINGS).option("header", True).csv(str(folder))
    want = live.windowed(table, "ts", ["well"], "od", "1 hour").where("start < '2024-01-01 06:00:00'").collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, want)) and {r.mean for r in seen} == {2.0}


def test_sessions(spark):
    rows = spark.createDataFrame([("A", f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 9, 30)], "well string, t string").selectExpr("well", "cast(t as timestamp) as ts")
    assert sorted(r.n for r in live.sessions(rows, "ts", ["well"], "10 minutes").collect()) == [1, 3]


def reference_rates(table, window=5, averaged=3):
    hours = (F.unix_micros("ts") - 1_700_000_000_000_000) / 3.6e9
    rows = series.log_ratio(table.withColumn("time_h", hours), "od", keys=["well"], window=averaged, ties=["od"])
    found = series.max_growth_rate(rows, keys=["well"], window=window, metadata=[], ties=["od"]).collect()
    micros = lambda h: None if h is None else 1_700_000_000 + round(h * 3600)
    return {r.well: (r.n, r.success, r.message, r.mv_mu_max, r.mv_r2, r.mv_rmse, micros(r.window_start), r.max_value, micros(r.max_time)) for r in found}


def live_rates(rows):
    seconds = lambda t: None if t is None else round(t.timestamp())
    return {r.well: (r.n, r.success, r.message, r.mv_mu_max, r.mv_r2, r.mv_rmse, seconds(r.window_start), r.max_value, seconds(r.max_time)) for r in rows}


def agree(got, want):
    assert set(got) == set(want)
    for k in want:
        assert all(a == pytest.approx(b, rel=1e-6, abs=1e-9) if isinstance(b, float) else a == b for a, b in zip(got[k], want[k])), (k, got[k], want[k])


def readings():
    """Wells by ten minutes: growing, flat, short, without a positive baseline, with repeated times and with what doesn't count."""
    rnd = random.Random(5)
    rows = []
    for w in range(12):
        for i in range(90):
            level = 0.1 * 2.0 ** (min(i, 20 + 3 * w) / 6) * rnd.uniform(0.9, 1.1)
            rows.append((f"W{w}", i * 600, level))
    rows += [("flat", i * 600, 1.0) for i in range(30)] + [("short", i * 600, 2.0**i) for i in range(4)]
    rows += [("below", i * 600, -5.0 if i < 3 else 2.0**i) for i in range(30)] + [("same", 0, 2.0**i) for i in range(9)]
    rows += [("twice", i // 2 * 600, 1.3**i * rnd.uniform(0.9, 1.1)) for i in range(40)] + [("W1", 1200, None), ("W1", 1800, float("nan")), (None, 0, 1.0), ("holes", 0, 0.0)]
    return rows + [("holes", i * 600, 0.0 if i % 4 == 1 else 1.2**i * rnd.uniform(0.9, 1.1)) for i in range(40)]


def test_growth_rates_of_a_stream(spark, tmp_path):
    """Readings come in any order within two hours, in many files; the last rows are those of the whole table."""
    rnd = random.Random(6)
    folder = tmp_path / "in"
    folder.mkdir()
    table = spark.createDataFrame(readings(), "well string, at long, od double").selectExpr("well", "timestamp_seconds(at + 1700000000) as ts", "od")
    rows = sorted(table.selectExpr("well", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as ts", "od", "unix_seconds(ts) as at").collect(), key=lambda r: r.at + rnd.uniform(0, 7000))
    size = -(-len(rows) // 6)
    seen = []

    def arrive(i, lines):
        (folder / f"{i}.csv").write_text("well,ts,od\n" + "".join(lines))
        stream = growth.growth_rates(live.read_stream(spark, str(folder)), averaged=3, late="2 hours")
        writer = stream.writeStream.foreachBatch(lambda df, n: seen.append(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    # each start reads one file and goes on from the state that the one before left
    for i in range(6):
        arrive(i, [f"{r.well or ''},{r.ts},{'' if r.od is None else r.od}\n" for r in rows[i * size : (i + 1) * size]])
    last = {r.well: r for batch in seen for r in batch}
    want = reference_rates(table)
    agree(live_rates(last.values()), want)
    assert {w for w, r in want.items() if r[1]} >= {"W0", "W11", "twice", "holes"} and {w for w, r in want.items() if not r[1]} == {"flat", "short", "below", "same"}
    # time goes on: what is older is settled, and a reading from before the watermark doesn't count
    arrive(6, ["Z,2024-01-03 00:00:00,1\n"])
    arrive(7, ["W1,2023-11-15 00:00:00,1000000\n"])
    after = {r.well: r for batch in seen for r in batch}
    agree(live_rates(r for w, r in after.items() if w != "Z"), reference_rates(table))
    assert {w for w, r in after.items() if r.settled} == set(last)


def test_growth_rates_of_wrong_arguments(spark, tmp_path):
    stream = live.read_stream(spark, str(tmp_path))
    for bad in ({"window": 1}, {"averaged": 0}, {"keys": ["strain"]}):
        with pytest.raises(ValueError):
            growth.growth_rates(stream, **bad)
    with pytest.raises(ValueError, match="takes a stream"):
        growth.growth_rates(spark.createDataFrame([], live.READINGS))
