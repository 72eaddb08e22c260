"""Cases found in review: null order columns, rounding ties, empty refresh,
long batches against a short window, NaN readings, a failing second query."""

import pytest
from pyspark.sql import functions as F

from gustflow.functions.scalars import round_half_up
from gustflow.operators.snapshot import previous_and_latest
from gustflow.operators.windows import resample
from gustflow.streaming.jobs import await_all


def test_rounding_ties(spark):
    values = [(-1.05, 1, -1.1), (-0.25, 1, -0.3), (0.049995, 1, 0.0), (2.504999, 2, 2.5), (1.005, 2, 1.01), (0.115, 2, 0.12), (-0.04, 1, 0.0)]
    for x, places, want in values:
        got = spark.range(1).select(round_half_up(F.lit(x), places)).first()[0]
        assert str(got) == str(want), (x, got)


def test_previous_reading_without_event_id(spark):
    df = spark.createDataFrame([("A", 1, None, 1.0), ("A", 2, None, 4.0)], "city string, timestamp long, event_id long, temperature double")
    row = previous_and_latest(df).first()
    assert (row["now"]["temperature"], row["prev"]["temperature"]) == (4.0, 1.0)


def test_nan_reading_is_missing(spark):
    df = spark.createDataFrame([("A", 0, 1.0), ("A", 60, float("nan")), ("A", 1800, 3.0)], "city string, s long, temperature double")
    out = resample(df.withColumn("t", F.timestamp_seconds("s")), key_cols=["city"], metrics=["temperature"], time_col="t", minutes=30)
    assert [r["y"] for r in out.orderBy("ds").collect()] == [1.0, 3.0]


class Query:
    def __init__(self, turns, fails=False):
        self.turns, self.fails, self.isActive, self.stopped = turns, fails, True, False

    def awaitTermination(self, timeout):
        self.turns -= 1
        if self.turns > 0:
            return False
        self.isActive = False
        if self.fails:
            raise RuntimeError("query failed")
        return True

    def stop(self):
        self.isActive, self.stopped = False, True


def test_second_query_failing_stops_the_first(spark):
    first, second = Query(10**6), Query(2, fails=True)
    with pytest.raises(RuntimeError):
        await_all(spark, [first, second])
    assert first.stopped


def test_every_reading_lies_in_one_payload(spark):
    from gustflow.sources.payloads import forecast_payloads, parse_forecast
    obs = spark.range(30).select(F.lit("A").alias("city"), (F.col("id") * 60).alias("timestamp"), F.col("id").alias("event_id"),
                                 F.col("id").cast("double").alias("temperature"), F.lit(1.0).alias("humidity"), F.lit(2.0).alias("wind_speed"))
    payloads = forecast_payloads(obs, items=12)
    assert sorted((r["payload"], len(r["list"])) for r in payloads.collect()) == [(0, 12), (1, 12), (2, 6)]
    got = parse_forecast(payloads, metrics=["temperature"], steps=5).collect()
    assert sorted(r["yhat"] for r in got) == [*range(5), *range(12, 17), *range(24, 29)]


def _stored(spark, root, batch, value, eid=1):
    from gustflow.sources import lake
    row = [(eid, 1_700_000_000, "Delhi", value, 50.0, 1.0, "view")]
    cols = "event_id long, timestamp long, city string, temperature double, humidity double, wind_speed double, weather_condition string"
    lake.write_events(spark.createDataFrame(row, cols), root, batch=batch)


def test_keep_last_follows_arrival_not_batch_text(spark):
    from gustflow.session import work_path
    from gustflow.sources import lake
    root = work_path(spark, "t-arrival")
    _stored(spark, root, "9", 1.0)
    _stored(spark, root, "10", 2.0)  # later, though "10" < "9" as text
    assert [r.temperature for r in lake.load_events(spark, root).collect()] == [2.0]


def test_correction_after_compaction_wins(spark):
    from gustflow.session import work_path
    from gustflow.sources import lake
    root = work_path(spark, "t-correct")
    _stored(spark, root, "a", 1.0)
    _stored(spark, root, "b", 2.0)
    lake.compact_events(spark, root, lake.latest_partition(spark, root))
    assert [r.temperature for r in lake.load_events(spark, root).collect()] == [2.0]
    _stored(spark, root, "c", 3.0, eid=None)
    assert [r.temperature for r in lake.load_events(spark, root).collect()] == [3.0]


def test_holt_backtest_returns_short_series(spark):
    import datetime as dt
    from gustflow.operators.forecast import backtest_holt, backtest_linear
    t0 = dt.datetime(2024, 1, 1)
    rows = [(c, "temperature", t0 + dt.timedelta(minutes=30 * i), float(i))
            for c, n in (("long", 40), ("short", 13), ("tiny", 5)) for i in range(n)]
    series = spark.createDataFrame(rows, "city string, metric string, ds timestamp, y double")
    holt = {r.city: (r.n, r.mae) for r in backtest_holt(series, alpha=0.5, beta=0.3).collect()}
    linear = {r.city: r.n for r in backtest_linear(series).collect()}
    assert {c: n for c, (n, _) in holt.items()} == linear and set(holt) == {"long", "short"}
    assert holt["short"] == (0, None) and holt["long"][1] < 1e-6


def test_cooldown_suppresses_on_hourly_replay(spark, sf_dir):
    from gustflow.plans.catalog import QUERIES, _hourly_history
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest size with alerts within an hour of each other
    alerts, sent = _hourly_history(spark, sf_dir).count(), QUERIES["cooldown"](spark, sf_dir).count()
    assert 0 < sent < alerts


def test_history_scan_has_a_pushed_lower_bound(spark, sf_dir):
    import re
    from gustflow.operators import anomaly
    from gustflow.sources import fixtures as fx
    history, _ = fx.split_events(spark, sf_dir, since=anomaly.history_cutoff)
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", plan)
    whole, _ = fx.split_events(spark, sf_dir)
    a = sorted(map(tuple, anomaly.baseline_stats(history).collect()))
    b = sorted(map(tuple, anomaly.baseline_stats(whole).collect()))
    assert [r[:2] + r[4:] for r in a] == [r[:2] + r[4:] for r in b]


def test_freshness_status_texts(spark):
    import datetime as dt
    from gustflow.operators.snapshot import freshness_status
    t = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("a", t), ("b", t - dt.timedelta(seconds=121)), ("c", None)], "city string, event_time timestamp")
    now = df.agg(F.max("event_time"))
    got = {r.city: (r.readings, r.status) for r in freshness_status(df, now, key_cols=("city",)).collect()}
    assert got == {"a": (1, "Healthy"), "b": (1, "Stale (121s old)"), "c": (1, "Unknown")}
    (none,) = freshness_status(df.where("false"), "2024-01-01 12:00:00").collect()
    assert (none.readings, none.status) == (0, "No data")
