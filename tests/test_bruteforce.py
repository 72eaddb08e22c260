"""Operators against straightforward single-process computations on random data."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gustflow.functions import scalars
from gustflow.operators import alerts as al
from gustflow.operators import forecast, windows
from gustflow.operators.clean import with_event_time

SETTINGS = settings(max_examples=8, deadline=None)


def _pandas_series(times, values, step="30min"):
    s = pd.Series(values, index=pd.to_datetime(times, unit="s", utc=True), dtype="float64").sort_index()
    return s.resample(step).mean().interpolate(method="time").dropna()


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 40 * 3600), st.one_of(st.none(), st.floats(-50, 50))),
                min_size=2, max_size=60))
def test_resample_matches_pandas(spark, points):
    rows = [(i, t, "X", v, 1.0, 1.0, "c") for i, (t, v) in enumerate(points)]
    df = spark.createDataFrame(rows, "event_id long, timestamp long, city string, temperature double, "
                                     "humidity double, wind_speed double, weather_condition string")
    got = windows.resample(with_event_time(df), metrics=("temperature",)).orderBy("ds").collect()
    want = _pandas_series([t for t, _ in points], [v if v is not None else np.nan for _, v in points])
    assert len(got) == len(want)
    for row, (ts, v) in zip(got, want.items()):
        assert int(row.ds.replace(tzinfo=None).timestamp()) == int(ts.timestamp()) or \
            pd.Timestamp(row.ds, tz="UTC") == ts
        assert math.isclose(row.y, v, rel_tol=1e-9, abs_tol=1e-9)


def _heat_index_py(t, rh):
    rh = max(0.0, min(100.0, rh))
    tf = t * 9.0 / 5.0 + 32.0
    if tf < 80.0:
        return t
    hi = (-42.379 + 2.04901523 * tf + 10.14333127 * rh - 0.22475541 * tf * rh - 0.00683783 * tf * tf
          - 0.05481717 * rh * rh + 0.00122874 * tf * tf * rh + 0.00085282 * tf * rh * rh
          - 0.00000199 * tf * tf * rh * rh)
    if rh < 13.0 and 80.0 <= tf <= 112.0:
        hi -= ((13.0 - rh) / 4.0) * math.sqrt((17.0 - abs(tf - 95.0)) / 17.0)
    if rh > 85.0 and 80.0 <= tf <= 87.0:
        hi += ((rh - 85.0) / 10.0) * ((87.0 - tf) / 5.0)
    return max((hi - 32.0) * 5.0 / 9.0, t)


@SETTINGS
@given(st.lists(st.tuples(st.floats(-20, 55), st.floats(-5, 105)), min_size=1, max_size=40))
def test_heat_index_matches_formula(spark, pairs):
    df = spark.createDataFrame(pairs, "t double, h double")
    got = [r.hi for r in df.select(scalars.heat_index_celsius("t", "h").alias("hi")).collect()]
    for (t, h), g in zip(pairs, got):
        assert abs(g - _heat_index_py(t, h)) <= 0.05 + 1e-9  # rounded to 0.1


@SETTINGS
@given(st.lists(st.floats(-100, 100), min_size=12, max_size=80), st.integers(1, 8))
def test_linear_forecast_matches_polyfit(spark, ys, periods):
    rows = [("X", "m", i * 1800, y) for i, y in enumerate(ys)]
    s = spark.createDataFrame(rows, "city string, metric string, t long, y double").select(
        "city", "metric", F.timestamp_seconds("t").alias("ds"), "y")
    got = [r.yhat for r in forecast.forecast_linear(s, periods).orderBy("ds").collect()]
    x = np.arange(len(ys))
    slope, intercept = np.polyfit(x, np.array(ys), 1)
    want = slope * np.arange(len(ys), len(ys) + periods) + intercept
    assert np.allclose(got, want, rtol=1e-7, atol=1e-6)


@SETTINGS
@given(st.dictionaries(st.sampled_from(["a", "b", "c"]),
                       st.lists(st.integers(0, 20 * 3600), min_size=1, max_size=40), min_size=1),
       st.sampled_from([1, 600, 3600, 5400]), st.sampled_from([None, 1000, 3600, 7000, 40000]))
def test_cooldown_matches_fold_per_key(spark, times_by_key, cooldown, block):
    rows, want = [], set()
    for k, ts in times_by_key.items():
        last = None
        for seq, t in sorted((i, t) for i, t in enumerate(ts)):
            rows.append((k, t, seq))
        for t, seq in sorted((t, i) for i, t in enumerate(ts)):
            if last is None or t - last >= cooldown:
                want.add((k, t, seq))
                last = t
    df = spark.createDataFrame(rows, "alert_key string, timestamp long, batch_id long")
    got = {(r.alert_key, r.timestamp, r.batch_id) for r in al.cooldown_sent(df, cooldown=cooldown, block_seconds=block).collect()}
    assert got == want


def _detect_py(new, history, z_thr=2.5, days=7, min_n=5):
    """Straight loop over the stated semantics (rows: event_id, ts, city, t, h, w)."""
    metrics = ("temperature", "humidity", "wind_speed")
    def ok(r):
        return r[2] is not None and all(v is not None for v in r[3:6])
    hist = [r for r in history if ok(r)]
    base = {}
    if hist:
        cut = max(r[1] for r in hist) - days * 86400
        win = [r for r in hist if r[1] >= cut]
        for city in {r[2] for r in win}:
            rows = [r for r in win if r[2] == city]
            for i, m in enumerate(metrics):
                vals = [r[3 + i] for r in rows]
                if len(vals) >= min_n:
                    mu = sum(vals) / len(vals)
                    base[(city, m)] = (mu, math.sqrt(sum((v - mu) ** 2 for v in vals) / len(vals)))
    rules = [("temperature", "heat_wave", lambda v: v >= 40), ("temperature", "cold_snap", lambda v: v <= -5),
             ("humidity", "extreme_humidity", lambda v: v >= 95), ("wind_speed", "high_wind", lambda v: v >= 15)]
    seen, out = set(), []
    for r in sorted((r for r in new if ok(r)), key=lambda r: (r[1], r[0])):
        cands = [(m, a) for m, a, f in rules if f(r[3 + metrics.index(m)])]
        for i, m in enumerate(metrics):
            if (r[2], m) in base:
                mu, sd = base[(r[2], m)]
                if sd > 0:
                    z = (r[3 + i] - mu) / sd
                    if abs(z) >= z_thr:
                        cands.append((m, f"{m}_{'spike' if z > 0 else 'drop'}"))
        for m, a in cands:
            if (r[2], m, a) not in seen:
                seen.add((r[2], m, a))
                out.append((r[1], r[2], m, a))
    return sorted(out)


reading = st.tuples(st.integers(0, 10 * 86400), st.sampled_from(["A", "B"]),
                    st.one_of(st.none(), st.floats(-10, 45)), st.floats(0, 100), st.floats(0, 20))


@SETTINGS
@given(st.lists(reading, min_size=0, max_size=60), st.lists(reading, min_size=1, max_size=15))
def test_detect_matches_loop(spark, hist, new):
    from gustflow.operators.anomaly import detect_anomalies
    schema = "event_id long, timestamp long, city string, temperature double, humidity double, " \
             "wind_speed double, weather_condition string"
    h = [(i, *r, "c") for i, r in enumerate(hist)]
    n = [(1000 + i, r[0] + 11 * 86400, *r[1:], "c") for i, r in enumerate(new)]
    got = detect_anomalies(spark.createDataFrame(n, schema), spark.createDataFrame(h, schema) if h else None)
    got = sorted((r.timestamp, r.city, r.metric, r.alert_type) for r in got.collect())
    want = _detect_py([(r[0], r[1], r[2], r[3], r[4], r[5]) for r in n],
                      [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in h])
    assert got == want


def _holt_search(y):
    """(alpha, beta, level, trend) by plain loops over both grids."""
    def run(pairs):
        out = []
        for a, b in pairs:
            level, trend, sse = y[0], y[1] - y[0], 0.0
            for v in y[1:]:
                e = v - (level + trend)
                level, trend, sse = level + trend + a * e, trend + a * b * e, sse + e * e
            out.append((sse, a, b, level, trend))
        return min(out)
    coarse = [k / 20.0 for k in range(1, 20)]
    _, a0, b0, *_ = run([(a, b) for a in coarse for b in coarse])
    fine = [k / 200.0 for k in range(-9, 10)]
    clip = lambda v: max(min(v, 0.999), 0.001)
    return run([(clip(a0 + u), clip(b0 + v)) for u in fine for v in fine])[1:]


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_holt_scan_equals_plain_loops(spark, block):
    """Blocks of one point, of seven and of a whole series give the plain loop's pair and state."""
    from gustflow.operators import holt
    rng = np.random.default_rng(7)
    series = {"walk": np.cumsum(rng.normal(size=53)) + 1e4, "noise": rng.normal(size=40) * 30,
              "trend": np.arange(29) * 0.7 + rng.normal(size=29), "two": np.array([3.0, 5.0])}
    start = 1_700_000_000 // 1800 * 1800
    rows = [(k, "m", start + i * 1800, float(v)) for k, y in series.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "city string, metric string, t long, y double").select(
        "city", "metric", F.timestamp_seconds("t").alias("ds"), "y")
    keys = ("city", "metric")
    blocks = holt.blocks_of(df, keys, 1800, block)
    spans = holt.lengths(blocks, keys).withColumn("n_fit", F.col("n"))
    got = {r.city: r for r in holt.fit(holt.training(blocks, spans, keys, 1800), keys).collect()}
    assert set(got) == set(series)
    for k, y in series.items():
        a, b, level, trend = _holt_search([float(v) for v in y])
        if k != "two":  # two points: every pair fits exactly
            assert (round(got[k].a, 9), round(got[k].b, 9)) == (round(a, 9), round(b, 9)), k
        assert abs(got[k].level - level) < 1e-6 and abs(got[k].trend - trend) < 1e-6, k


def test_auto_falls_through_to_the_line_and_status_says_so(spark):
    """Squared errors of values near 1e200 overflow: the smoothing has no finite
    fit, the line has one.  An infinite value leaves neither."""
    start = 1_700_000_000 // 1800 * 1800
    ys = {"fine": [float(i % 5) for i in range(30)], "huge": [1e200 * (-1) ** i for i in range(30)],
          "inf": [float(i) for i in range(29)] + [float("inf")], "short": [1.0] * 5}
    df = spark.createDataFrame([(k, "m", start + i * 1800, v) for k, y in ys.items() for i, v in enumerate(y)],
                               "city string, metric string, t long, y double").select(
        "city", "metric", F.timestamp_seconds("t").alias("ds"), "y")
    methods = {r.city: r.method for r in forecast.forecast(df, method="auto").collect()}
    assert methods["fine"] == "exponential_smoothing" and methods["huge"] == "linear_trend" and "short" not in methods
    assert {r.city for r in forecast.forecast_holt(df).collect()} == {"fine"}
    auto = {r.city: (r.method, r.message) for r in forecast.forecast_status(df, "auto").collect()}
    assert auto["fine"][0] == "exponential_smoothing" and auto["huge"] == ("linear_trend", "Forecast generated successfully.")
    assert auto["inf"] == ("none", "Could not run auto: no finite fit") and auto["short"][1].startswith("Need at least 12")
    smooth = {r.city: (r.method, r.message) for r in forecast.forecast_status(df, "exponential_smoothing").collect()}
    assert smooth["huge"] == ("none", "Could not run exponential smoothing: no finite fit")
    line = {r.city: r.method for r in forecast.forecast_status(df).collect()}
    assert line == {"fine": "linear_trend", "huge": "linear_trend", "inf": "none", "short": "none"}
    bt = {r.city: (r.n, r.mae) for r in forecast.backtest_holt(df).collect()}
    assert bt["huge"] == (0, None) and bt["fine"][0] == 6 and "short" not in bt
