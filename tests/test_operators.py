"""Hand-made boundary cases and properties of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from gustflow.functions import scalars
from gustflow.operators import alerts as al
from gustflow.operators import anomaly, clean, forecast, windows
from gustflow.operators.live import live_refresh
from gustflow.sources.records import parse_records

OBS = "event_id long, timestamp long, city string, temperature double, humidity double, wind_speed double, weather_condition string"
DAY = 86400


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


def quiet_history(spark, city="X", n=10, t0=0, temp=20.0, hum=50.0, wind=5.0, spread=1.0):
    rows = []
    for i in range(n):
        s = spread if i % 2 else -spread
        rows.append((i, t0 + i * 60, city, temp + s, hum + s, wind + s / 10, "clear"))
    return rows


# --------------------------------------------------------------------------
# absolute rules and z-scores
# --------------------------------------------------------------------------

@pytest.mark.parametrize("temp,hum,wind,expected", [
    (40.0, 50.0, 5.0, {"heat_wave"}),
    (39.9, 50.0, 5.0, set()),
    (-5.0, 50.0, 5.0, {"cold_snap"}),
    (-4.9, 50.0, 5.0, set()),
    (20.0, 95.0, 5.0, {"extreme_humidity"}),
    (20.0, 94.9, 5.0, set()),
    (20.0, 50.0, 15.0, {"high_wind"}),
    (20.0, 50.0, 14.9, set()),
])
def test_absolute_boundaries(spark, temp, hum, wind, expected):
    new = obs(spark, [(1, 100, "X", temp, hum, wind, "c")])
    got = {r.alert_type for r in anomaly.detect_anomalies(new, None).collect()}
    assert got == expected


def test_absolute_message(spark):
    new = obs(spark, [(1, 100, "Delhi", 41.25, 50.0, 5.0, "c")])
    row = anomaly.detect_anomalies(new, None).collect()[0]
    assert row.message == "Delhi: heat wave (temperature=41.2)"
    assert row.severity == "high" and row.baseline_mean is None and row.z_score is None


def _zscore_case(spark, value):
    # history: 10 readings alternating 19/21 -> mean 20, population std 1
    hist = obs(spark, quiet_history(spark))
    new = obs(spark, [(100, 10_000, "X", value, 50.0, 5.0, "c")])
    return {r.alert_type: r for r in anomaly.detect_anomalies(new, hist).collect()}


def test_zscore_threshold_and_severity(spark):
    assert "temperature_spike" not in _zscore_case(spark, 22.49)
    medium = _zscore_case(spark, 22.5)["temperature_spike"]
    assert medium.severity == "medium" and medium.z_score == 2.5
    high = _zscore_case(spark, 23.0)["temperature_spike"]
    assert high.severity == "high" and high.z_score == 3.0
    drop = _zscore_case(spark, 17.0)["temperature_drop"]
    assert drop.message == "X: temperature drop detected (17.0 vs baseline 20.0 ± 1.0, z=-3.00)"


def test_baseline_min_samples(spark):
    new = obs(spark, [(100, 10_000, "X", 30.0, 50.0, 5.0, "c")])
    four = obs(spark, quiet_history(spark, n=4))
    five = obs(spark, quiet_history(spark, n=5))
    assert anomaly.detect_anomalies(new, four).where("alert_type like 'temperature_%'").count() == 0
    assert anomaly.detect_anomalies(new, five).where("alert_type like 'temperature_%'").count() == 1


def test_zero_std_skipped(spark):
    hist = obs(spark, [(i, i * 60, "X", 20.0, 50.0, 5.0, "c") for i in range(10)])
    new = obs(spark, [(100, 10_000, "X", 30.0, 50.0, 5.0, "c")])
    assert anomaly.detect_anomalies(new, hist).count() == 0


def test_row_wise_null_drop_and_global_cutoff(spark):
    rows = quiet_history(spark, n=10)
    # a reading null in humidity contributes to no metric's baseline
    rows.append((50, 700, "X", 1000.0, None, 5.0, "c"))
    # one reading far in the future moves the 7-day window for every city
    rows.append((51, 20 * DAY, "Y", 20.0, 50.0, 5.0, "c"))
    base = anomaly.baseline_stats(obs(spark, rows)).collect()
    assert {(r.city, r.metric) for r in base} == set()  # X's readings are outside Y's window
    base = anomaly.baseline_stats(obs(spark, rows[:-1])).collect()
    t = [r for r in base if r.metric == "temperature"][0]
    assert t.sample_count == 10 and math.isclose(t.mean, 20.0) and math.isclose(t.std, 1.0)


def test_first_alert_wins_in_reading_order(spark):
    new = obs(spark, [(2, 200, "X", 45.0, 50.0, 5.0, "c"), (1, 100, "X", 41.0, 50.0, 5.0, "c"),
                      (3, 100, "X", 42.0, 50.0, 5.0, "c")])
    rows = anomaly.detect_anomalies(new, None).collect()
    assert len(rows) == 1 and rows[0].value == 41.0


def test_rolling_detect_equals_per_batch_detect(spark, sf_dir):
    from gustflow.sources.fixtures import readings
    r = readings(spark, sf_dir)
    roll = anomaly.rolling_detect(r)
    last = roll.agg(F.max("batch_id")).first()[0]
    cut = last * DAY
    direct = anomaly.detect_anomalies(r.where(F.col("timestamp") >= cut), r.where(F.col("timestamp") < cut))
    a = sorted(tuple(x) for x in roll.where(F.col("batch_id") == last).select(*anomaly.ALERT_COLUMNS).collect())
    b = sorted(tuple(x) for x in direct.select(*anomaly.ALERT_COLUMNS).collect())
    assert a == b


# --------------------------------------------------------------------------
# heat index, comfort, formatting
# --------------------------------------------------------------------------

def hi(spark, t, h):
    return spark.createDataFrame([(t, h)], "t double, h double").select(
        scalars.heat_index_celsius("t", "h").alias("hi")).first().hi


def test_heat_index_boundaries(spark):
    below = (79.9 - 32) * 5 / 9
    assert hi(spark, below, 90.0) == round(below, 1)
    assert hi(spark, 26.6667, 90.0) >= 26.7  # 80 F: regression kicks in, never below air temp
    assert hi(spark, 35.0, 12.9) <= hi(spark, 35.0, 13.0)  # dry adjustment lowers it
    assert hi(spark, 29.0, 85.1) >= hi(spark, 29.0, 85.0) - 0.2
    assert hi(spark, 35.0, -1.0) == hi(spark, 35.0, 0.0)  # RH clamped
    assert hi(spark, 35.0, 101.0) == hi(spark, 35.0, 100.0)
    assert hi(spark, 35.0, None) is None
    assert hi(spark, 20.0, None) == 20.0


@pytest.mark.parametrize("value,label", [(26.9, "Comfortable"), (27.0, "Warm"), (32.0, "Hot — caution"),
                                         (39.0, "Very hot — danger"), (46.0, "Extreme heat"), (None, None)])
def test_comfort_bands(spark, value, label):
    got = spark.createDataFrame([(value,)], "v double").select(scalars.comfort_label("v").alias("c")).first().c
    assert got == label


@pytest.mark.parametrize("d,text", [(None, "—"), (1.25, "+1.2"), (-0.35, "-0.3"), (0.0, "0.0"), (2.0, "+2.0")])
def test_format_delta(spark, d, text):
    got = spark.createDataFrame([(d,)], "d double").select(scalars.format_delta("d").alias("t")).first().t
    assert got == text


def test_round_half_up_is_decimal(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.005,), (55538.58044444446,), (None,)], "x double")
    got = [r.r for r in df.select(scalars.round_half_up("x", 2).alias("r")).collect()]
    assert got == [1.01, 2.68, -1.01, 55538.58, None]  # ties away from zero
    six = df.select(scalars.round_half_up("x", 6).alias("r")).collect()[3].r
    assert six == 55538.580444


# --------------------------------------------------------------------------
# cleaning, parsing
# --------------------------------------------------------------------------

def test_permissive_json(spark):
    raw = spark.createDataFrame([('{"timestamp": 5, "city": "A", "temperature": 1}',),
                                 ('{"timestamp": 5.5, "city": "B"}',),
                                 ('{"timestamp": 6, "city": "C", "humidity": "wet", "extra": 1}',),
                                 ('{"timestamp": 7, "ci',)], "value string")
    rows = parse_records(raw).collect()
    assert rows[0].temperature == 1.0
    assert rows[1].timestamp is None and rows[1].city == "B"
    assert rows[2].humidity is None and rows[2].city == "C"
    assert rows[3].city is None and rows[3].timestamp is None


def test_dedupe_keep_last_idempotent(spark):
    df = obs(spark, [(1, 10, "A", 1.0, 1.0, 1.0, "c"), (2, 10, "A", 2.0, 1.0, 1.0, "c"), (3, 11, "A", 3.0, 1.0, 1.0, "c")])
    once = clean.dedupe_last(df)
    twice = clean.dedupe_last(once)
    assert sorted(r.temperature for r in once.collect()) == [2.0, 3.0]
    assert sorted(once.collect()) == sorted(twice.collect())


def test_empty_selection_semantics(spark):
    df = obs(spark, [(1, 10, "A", 1.0, 1.0, 1.0, "c")])
    assert clean.filter_keys(df, [], empty="all").count() == 1
    assert clean.filter_keys(df, [], empty="none").count() == 0


def test_global_rank_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0)], "city string, temperature double")
    got = {r.city: r["rank"] for r in clean.global_rank(df, ["temperature", "city"], ["temperature"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 4}


# --------------------------------------------------------------------------
# cooldown
# --------------------------------------------------------------------------

def _alerts(spark, times, key="k"):
    return spark.createDataFrame([(key, t, i) for i, t in enumerate(times)], "alert_key string, timestamp long, batch_id long")


def test_cooldown_is_greedy(spark):
    sent = al.cooldown_sent(_alerts(spark, [0, 50 * 60, 70 * 60]), cooldown=3600)
    assert sorted(r.timestamp for r in sent.collect()) == [0, 70 * 60]


def test_cooldown_boundary(spark):
    assert al.cooldown_sent(_alerts(spark, [0, 3599]), cooldown=3600).count() == 1
    assert al.cooldown_sent(_alerts(spark, [0, 3600]), cooldown=3600).count() == 2


def test_cooldown_of_alerts_without_time_or_key(spark):
    rows = [("k", None, 1), ("k", 5, 2), (None, 5, 3), ("k", 6, 4), ("j", -3, 5)]
    df = spark.createDataFrame(rows, "alert_key string, timestamp long, batch_id long")
    ids = lambda **kw: sorted(r.batch_id for r in al.cooldown_sent(df, **kw).collect())
    assert ids(cooldown=3600) == [2, 5] and ids(cooldown=0) == [2, 4, 5]
    assert al.cooldown_sent(df.limit(0)).count() == 0


def test_cooldown_of_a_dense_key_over_many_blocks(spark):
    """An alert every second for three days."""
    df = spark.range(3 * 86400).selectExpr("'k' AS alert_key", "id AS timestamp", "id AS batch_id")
    sent = al.cooldown_sent(df, cooldown=600, block_seconds=7200)
    assert sorted(r.timestamp for r in sent.collect()) == list(range(0, 3 * 86400, 600))


def test_cooldown_matches_sequential_fold(spark):
    import random
    rng = random.Random(7)
    times = sorted(rng.randrange(0, 40 * 3600) for _ in range(400))
    last, want = None, []
    for t in times:
        if last is None or t - last >= 3600:
            want.append(t)
            last = t
    got = sorted(r.timestamp for r in al.cooldown_sent(_alerts(spark, times), cooldown=3600).collect())
    assert got == want


# --------------------------------------------------------------------------
# regular series and forecasts
# --------------------------------------------------------------------------

def _series(spark, values, start=0, step=1800, city="X", metric="m"):
    rows = [(city, metric, start + i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "city string, metric string, t long, y double").select(
        "city", "metric", F.timestamp_seconds("t").alias("ds"), "y")


def test_resample_edges(spark):
    rows = [(1, 0, "X", None, 1.0, 1.0, "c"), (2, 1800, "X", 10.0, 1.0, 1.0, "c"),
            (3, 5400, "X", 30.0, 1.0, 1.0, "c"), (4, 9000, "X", None, 1.0, 1.0, "c")]
    out = windows.resample(clean.with_event_time(obs(spark, rows)), metrics=("temperature",))
    got = [(r.ds.timestamp(), r.y) for r in out.orderBy("ds").collect()]
    # leading null dropped, gap interpolated, trailing null holds the last value
    assert [y for _, y in got] == [10.0, 20.0, 30.0, 30.0, 30.0]


def test_linear_forecast_exact_on_line(spark):
    s = _series(spark, [2.0 + 0.5 * i for i in range(20)])
    fc = forecast.forecast_linear(s, periods=3).orderBy("ds").collect()
    assert [round(r.yhat, 9) for r in fc] == [12.0, 12.5, 13.0]
    assert fc[0].ds.timestamp() == 20 * 1800


def test_forecast_needs_min_points(spark):
    assert forecast.forecast_linear(_series(spark, [1.0] * 11)).count() == 0
    assert forecast.forecast_linear(_series(spark, [1.0] * 12)).count() == 6
    st = forecast.forecast_status(_series(spark, [1.0] * 11)).first()
    assert st.method == "none" and st.message.startswith("Need at least 12 points for X.")


def test_backtest_holdout_rule(spark):
    # n = h + 12 -> no metrics; n = h + 13 -> metrics
    n_no = 2 + 12
    no = forecast.backtest_linear(_series(spark, [float(i) for i in range(n_no)]), periods=6).first()
    assert no.mae is None
    yes = forecast.backtest_linear(_series(spark, [float(i) for i in range(17)]), periods=6).first()
    assert yes.n == 4 and abs(yes.mae) < 1e-9


def test_holt_exact_on_line(spark):
    s = _series(spark, [1.0 + 2.0 * i for i in range(30)])
    fc = forecast.forecast_holt(s, periods=2).orderBy("ds").collect()
    assert [round(r.yhat, 6) for r in fc] == [61.0, 63.0]


# --------------------------------------------------------------------------
# live refresh
# --------------------------------------------------------------------------

def test_live_refresh_restamps_and_scores(spark):
    hist = obs(spark, quiet_history(spark, n=20))
    cur = obs(spark, [(999, 5, "X", 45.0, 50.0, 5.0, "c")])
    updated, aggs, alerts = live_refresh(hist, cur, "2024-01-01 00:00:00")
    assert updated.count() == 21
    newest = updated.orderBy(F.desc("timestamp")).first()
    assert newest.event_id == 999 and newest.timestamp == 1704067200
    kinds = {r.alert_type for r in alerts.collect()}
    assert {"heat_wave", "temperature_spike"} <= kinds


def test_select_present(spark):
    df = obs(spark, [(1, 10, "A", 1.0, 1.0, 1.0, "c")])
    assert clean.select_present(df, ["city", "nope", "timestamp"]).columns == ["city", "timestamp"]


def test_method_label(spark):
    df = spark.createDataFrame([("exponential_smoothing",), ("linear_trend",)], "m string")
    assert [r.l for r in df.select(scalars.method_label("m").alias("l")).collect()] == \
        ["Exponential Smoothing", "Linear Trend"]


def test_unknown_forecast_method(spark):
    with pytest.raises(ValueError):
        forecast.forecast(_series(spark, [1.0] * 20), method="arima")
    assert forecast.forecast(_series(spark, [1.0] * 20), method="prophet").count() == 0
    st = forecast.forecast_status(_series(spark, [1.0] * 20), method="prophet").first()
    assert st.method == "none" and "prophet" in st.message
