"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (``readings`` is a projection of
``events``; the generic run reads ``lineitem``) so its work grows with them.
Aggregate-derived doubles are rounded to 6 places so that two engines agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.scalars import round6
from ..operators import anomaly, clean
from ..session import prepare
from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, round6(F.col(c)))
    return df


def _alerts_out(df: DataFrame) -> DataFrame:
    return _r6(df.select(*anomaly.ALERT_COLUMNS), "baseline_mean", "baseline_std")


# --------------------------------------------------------------------------
# Detection
# --------------------------------------------------------------------------

@register("detect_anomalies")
def q_detect_anomalies(spark, sf_dir):
    """Alerts for the last day of readings against all earlier readings."""
    history, batch = fx.split_events(spark, sf_dir, since=anomaly.history_cutoff)
    return _alerts_out(anomaly.detect_anomalies(batch, history))


@register("baseline_stats")
def q_baseline_stats(spark, sf_dir):
    history, _ = fx.split_events(spark, sf_dir, since=anomaly.history_cutoff)
    return _r6(anomaly.baseline_stats(history), "mean", "std")


@register("alerts_absolute")
def q_alerts_absolute(spark, sf_dir):
    """Every absolute-rule hit over the whole table."""
    return anomaly.alerts_absolute(fx.readings(spark, sf_dir)).select(
        "timestamp", "event_id", "city", "metric", "alert_type", "severity", "value", "message")


@register("alerts_zscore")
def q_alerts_zscore(spark, sf_dir):
    """Every z-score hit of the last day against the 7-day baseline."""
    history, batch = fx.split_events(spark, sf_dir, since=anomaly.history_cutoff)
    return _r6(anomaly.alerts_zscore(batch, history).select(
        "timestamp", "event_id", "city", "metric", "alert_type", "severity", "value",
        "baseline_mean", "baseline_std", "z_score", "message"), "baseline_mean", "baseline_std")


@register("score_latest")
def q_score_latest(spark, sf_dir):
    """Latest reading per city scored against all but the last 10 readings."""
    return _alerts_out(anomaly.score_latest(fx.readings(spark, sf_dir)))


@register("baseline_stats_lineitem")
def q_baseline_stats_lineitem(spark, sf_dir):
    """Generic run: baseline per supplier over lineitem's last 365 ship days."""
    li = fx.lineitem_readings(spark, sf_dir)
    metrics = ("l_quantity", "l_extendedprice", "l_discount")
    params = replace(DEFAULT, baseline_days=365)
    cut = anomaly.history_cutoff(li, ("l_suppkey",), metrics, params, prepared=True)
    if cut is not None:  # on the raw column, which Parquet skips row groups by
        li = fx.lineitem_readings(spark, sf_dir, since=cut)
    out = anomaly.baseline_stats(li, key_cols=("l_suppkey",), metrics=metrics, params=params, prepared=True)
    return _r6(out, "mean", "std")


# --------------------------------------------------------------------------
# Projections, parsing, cleaning
# --------------------------------------------------------------------------

def _obs(spark, sf_dir) -> DataFrame:
    return fx.readings(spark, sf_dir)


@register("parse_json")
def q_parse_json(spark, sf_dir):
    """Readings serialised to keyed JSON records and parsed back with the fixed schema."""
    from ..sources.records import parse_records, to_records
    recs = to_records(_obs(spark, sf_dir))
    return parse_records(recs)


@register("to_records")
def q_to_records(spark, sf_dir):
    """Record key text plus the JSON value parsed back (value text is engine-specific)."""
    from ..sources.records import OBSERVATION_SCHEMA, to_records
    recs = to_records(_obs(spark, sf_dir), binary=False)
    return recs.select("key", F.from_json("value", OBSERVATION_SCHEMA).alias("v")).select("key", "v.*")


@register("event_time")
def q_event_time(spark, sf_dir):
    obs = clean.with_event_date(clean.with_event_time(_obs(spark, sf_dir)))
    # dates travel as yyyy-MM-dd text in registered outputs (engine-neutral)
    return obs.select("event_id", "timestamp", "event_time", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@register("prepare_events")
def q_prepare_events(spark, sf_dir):
    return clean.prepare_events(_obs(spark, sf_dir))


@register("unpivot_metrics")
def q_unpivot_metrics(spark, sf_dir):
    return clean.unpivot_metrics(_obs(spark, sf_dir), ["event_id", "timestamp", "city"])


@register("filter_cities")
def q_filter_cities(spark, sf_dir):
    return clean.filter_keys(_obs(spark, sf_dir), ["Delhi", "Tokyo"])


@register("dedupe_last")
def q_dedupe_last(spark, sf_dir):
    """Keep-last on (city, timestamp) over readings with re-delivered copies."""
    return clean.dedupe_last(fx.readings_dup(spark, sf_dir), ("city", "timestamp"), ("event_id",))


@register("latest_per_city")
def q_latest_per_city(spark, sf_dir):
    return clean.latest_per_key(_obs(spark, sf_dir), "city", ("timestamp", "event_id"))


@register("recent_history")
def q_recent_history(spark, sf_dir):
    """The 20 most recent readings (a top-k report)."""
    return clean.tail_rows(_obs(spark, sf_dir), 20, ["timestamp", "event_id"])


@register("distinct_cities")
def q_distinct_cities(spark, sf_dir):
    return clean.distinct_sorted(_obs(spark, sf_dir), "city")


# --------------------------------------------------------------------------
# Windows and regular series
# --------------------------------------------------------------------------

@register("window_agg_5m")
def q_window_agg_5m(spark, sf_dir):
    from ..operators.windows import window_agg
    out = window_agg(clean.with_event_time(_obs(spark, sf_dir)))
    return _r6(out, "avg_temperature", "avg_humidity", "avg_wind_speed")


@register("window_agg_live")
def q_window_agg_live(spark, sf_dir):
    """Newest 200 five-minute windows, means rounded to 2, non-null counts."""
    from ..operators.windows import live_window_agg
    return live_window_agg(clean.with_event_time(_obs(spark, sf_dir)), limit=200)


@register("resample_30m")
def q_resample_30m(spark, sf_dir):
    from ..operators.windows import resample
    return _r6(resample(clean.with_event_time(_obs(spark, sf_dir))), "y")


@register("infer_freq")
def q_infer_freq(spark, sf_dir):
    from ..operators.windows import infer_freq
    return infer_freq(clean.with_event_time(_obs(spark, sf_dir)))


# --------------------------------------------------------------------------
# Enrichment and snapshot views
# --------------------------------------------------------------------------

def _snapshot(spark, sf_dir) -> DataFrame:
    return clean.with_event_time(clean.latest_per_key(_obs(spark, sf_dir), "city", ("timestamp", "event_id")))


@register("attach_coordinates")
def q_attach_coordinates(spark, sf_dir):
    from ..operators.snapshot import attach_coordinates
    return attach_coordinates(_obs(spark, sf_dir)).select("event_id", "city", "lat", "lon")


@register("heat_index")
def q_heat_index(spark, sf_dir):
    from ..functions.scalars import heat_index_celsius
    obs = _obs(spark, sf_dir)
    return obs.select("event_id", "temperature", "humidity",
                      heat_index_celsius("temperature", "humidity").alias("heat_index"))


@register("comfort")
def q_comfort(spark, sf_dir):
    from ..operators.snapshot import with_heat_index
    return with_heat_index(_obs(spark, sf_dir)).select("event_id", "heat_index", "comfort")


@register("enrich")
def q_enrich(spark, sf_dir):
    """Serving snapshot: latest reading per city with coordinates, heat index, comfort."""
    from ..operators.snapshot import enrich
    return enrich(_snapshot(spark, sf_dir)).select(
        "city", "timestamp", "temperature", "humidity", "wind_speed", "weather_condition",
        "lat", "lon", "heat_index", "comfort")


@register("snapshot_delta")
def q_snapshot_delta(spark, sf_dir):
    from ..operators.snapshot import snapshot_delta
    return snapshot_delta(_obs(spark, sf_dir))


@register("snapshot_kpis")
def q_snapshot_kpis(spark, sf_dir):
    from ..operators.snapshot import snapshot_kpis
    return _r6(snapshot_kpis(_snapshot(spark, sf_dir)), "avg_temperature")


@register("temperature_ranking")
def q_temperature_ranking(spark, sf_dir):
    from ..operators.snapshot import temperature_ranking
    return temperature_ranking(_snapshot(spark, sf_dir))


@register("freshness_status")
def q_freshness_status(spark, sf_dir):
    """Per-city freshness against the newest reading of the whole table."""
    obs = clean.with_event_time(_obs(spark, sf_dir))
    from ..operators.snapshot import freshness_status, latest_event_time
    return freshness_status(obs, latest_event_time(obs), DEFAULT.stale_after_seconds, key_cols=("city",))


@register("shift_to_now")
def q_shift_to_now(spark, sf_dir):
    from ..operators.snapshot import shift_to_now
    obs = clean.with_event_time(_obs(spark, sf_dir))
    return shift_to_now(obs, "2026-01-01 00:00:00").select("event_id", "timestamp", "event_time")


@register("map_points")
def q_map_points(spark, sf_dir):
    from ..operators.snapshot import enrich, map_points
    return map_points(enrich(_snapshot(spark, sf_dir)))


@register("format_times")
def q_format_times(spark, sf_dir):
    from ..functions.scalars import format_utc
    obs = clean.with_event_time(_obs(spark, sf_dir))
    return obs.select("event_id", format_utc("event_time").alias("full"),
                      format_utc("event_time", "HH:mm:ss").alias("clock"),
                      format_utc("event_time", "yyyy-MM-dd HH:mm").alias("minute"))


# --------------------------------------------------------------------------
# Provider payloads
# --------------------------------------------------------------------------

@register("parse_current_payload")
def q_parse_current_payload(spark, sf_dir):
    from ..sources.payloads import current_payloads, parse_current
    return parse_current(current_payloads(_obs(spark, sf_dir)))


@register("forecast_api_band")
def q_forecast_api_band(spark, sf_dir):
    from ..sources.payloads import forecast_payloads, parse_forecast
    out = parse_forecast(forecast_payloads(_obs(spark, sf_dir), items=12), steps=12)
    out = out.withColumn("issued", F.date_format("issued", "yyyy-MM-dd"))
    return _r6(out, "yhat_lower", "yhat_upper")


# --------------------------------------------------------------------------
# Alert history, cooldown, outbox, merge, KPIs
# --------------------------------------------------------------------------

def _history(spark, sf_dir) -> DataFrame:
    return anomaly.rolling_detect(_obs(spark, sf_dir))


def _hourly_history(spark, sf_dir) -> DataFrame:
    """Hourly replay: a key's alerts come close enough for the cooldown to act."""
    return anomaly.rolling_detect(_obs(spark, sf_dir), batch_seconds=3600)


def _history_out(df: DataFrame) -> DataFrame:
    return _r6(df, "baseline_mean", "baseline_std")


@register("alert_history")
def q_alert_history(spark, sf_dir):
    """Daily replay of the detector: every day against all earlier readings."""
    return _history_out(_history(spark, sf_dir))


@register("cooldown")
def q_cooldown(spark, sf_dir):
    """Alerts of the hourly replay that pass the one-hour notification cooldown."""
    from ..operators.alerts import cooldown_sent, with_alert_key
    hist = with_alert_key(_hourly_history(spark, sf_dir))
    sent = cooldown_sent(hist, ("alert_key",), "timestamp", ("batch_id",), DEFAULT.cooldown_seconds)
    return sent.select("alert_key", "timestamp", "batch_id", "severity")


@register("notifications")
def q_notifications(spark, sf_dir):
    from ..operators.alerts import notifications
    return notifications(_hourly_history(spark, sf_dir))


@register("merge_alert_history")
def q_merge_alert_history(spark, sf_dir):
    """Session history = all earlier batches, new = the last batch; keep last per key."""
    from ..operators.alerts import merge_history
    hist = _history(spark, sf_dir)
    last = hist.agg(F.max("batch_id").alias("_last"))
    tagged = hist.crossJoin(F.broadcast(last))
    stored = tagged.where(F.col("batch_id") < F.col("_last")).drop("_last")
    new = tagged.where(F.col("batch_id") == F.col("_last")).drop("_last")
    return _r6(merge_history(stored, new), "baseline_mean", "baseline_std")


@register("alert_kpis")
def q_alert_kpis(spark, sf_dir):
    from ..operators.alerts import alert_kpis
    return alert_kpis(_history(spark, sf_dir))


@register("alert_histogram")
def q_alert_histogram(spark, sf_dir):
    from ..operators.alerts import alert_histogram
    return alert_histogram(_history(spark, sf_dir))


@register("alerts_filtered")
def q_alerts_filtered(spark, sf_dir):
    """High-severity alerts detected within 24 hours of the newest detection."""
    from ..operators.alerts import filter_alerts
    hist = _history(spark, sf_dir)
    now = hist.agg(F.max("detected_at").alias("_now"))
    tagged = hist.crossJoin(F.broadcast(now))
    out = filter_alerts(tagged, ["high"], 24, F.col("_now")).drop("_now")
    return _r6(out, "baseline_mean", "baseline_std")


@register("distinct_severities")
def q_distinct_severities(spark, sf_dir):
    return clean.distinct_sorted(_history(spark, sf_dir), "severity")


@register("cooldown_hits_6h")
def q_cooldown_hits_6h(spark, sf_dir):
    """Every absolute-rule hit of the table through a six-hour cooldown (dense
    alert stream: many suppressions)."""
    from ..operators.alerts import cooldown_sent, with_alert_key
    hits = with_alert_key(anomaly.alerts_absolute(_obs(spark, sf_dir)))
    sent = cooldown_sent(hits, ("alert_key",), "timestamp", ("event_id",), 6 * 3600)
    return sent.select("alert_key", "timestamp", "event_id", "value")


# --------------------------------------------------------------------------
# Forecasts
# --------------------------------------------------------------------------

def _series(spark, sf_dir, metrics=("temperature", "humidity", "wind_speed")) -> DataFrame:
    from ..operators.windows import resample
    obs = clean.with_event_time(_obs(spark, sf_dir))
    if "heat_index" in metrics:
        from ..functions.scalars import heat_index_celsius
        obs = obs.withColumn("heat_index", heat_index_celsius("temperature", "humidity"))
    return resample(obs, metrics=metrics)


def _fc_out(df: DataFrame) -> DataFrame:
    return _r6(df, "yhat", "yhat_lower", "yhat_upper")


@register("forecast_linear")
def q_forecast_linear(spark, sf_dir):
    from ..operators.forecast import forecast_linear
    return _fc_out(forecast_linear(_series(spark, sf_dir), periods=6))


@register("forecast_heat_index")
def q_forecast_heat_index(spark, sf_dir):
    from ..operators.forecast import forecast_linear
    return _fc_out(forecast_linear(_series(spark, sf_dir, ("heat_index",)), periods=6))


@register("forecast_next")
def q_forecast_next(spark, sf_dir):
    from ..operators.forecast import forecast_linear, next_value
    return _r6(next_value(forecast_linear(_series(spark, sf_dir), periods=6)), "next_yhat")


@register("forecast_status")
def q_forecast_status(spark, sf_dir):
    from ..operators.forecast import forecast_status
    return forecast_status(_series(spark, sf_dir))


@register("backtest_linear")
def q_backtest_linear(spark, sf_dir):
    from ..operators.forecast import backtest_linear
    return _r6(backtest_linear(_series(spark, sf_dir), periods=6), "mae", "rmse")


@register("forecast_holt_fixed")
def q_forecast_holt_fixed(spark, sf_dir):
    """Holt smoothing with fixed alpha=0.5, beta=0.3 (oracle: recursive SQL)."""
    from ..operators.forecast import forecast_holt
    return _fc_out(forecast_holt(_series(spark, sf_dir), periods=6, alpha=0.5, beta=0.3))


@register("forecast_holt")
def q_forecast_holt(spark, sf_dir):
    """Holt smoothing with (alpha, beta) chosen by one-step SSE."""
    from ..operators.forecast import forecast_holt
    return _fc_out(forecast_holt(_series(spark, sf_dir), periods=6))


@register("backtest_holt")
def q_backtest_holt(spark, sf_dir):
    from ..operators.forecast import backtest_holt
    return _r6(backtest_holt(_series(spark, sf_dir), periods=6), "mae", "rmse")


@register("forecast_auto")
def q_forecast_auto(spark, sf_dir):
    from ..operators.forecast import forecast
    return _fc_out(forecast(_series(spark, sf_dir), periods=6, method="auto"))


# --------------------------------------------------------------------------
# Lake I/O (S2-S5, S7, S9) — tables are written below the shared folder
# --------------------------------------------------------------------------

def _lake_path(spark, name: str) -> str:
    from ..session import work_path
    return work_path(spark, "lake", name)


@register("lake_roundtrip")
def q_lake_roundtrip(spark, sf_dir):
    """Write readings to the partitioned events lake and scan them back."""
    from ..sources import lake
    root = _lake_path(spark, "events")
    lake.write_events(_obs(spark, sf_dir), root, batch="0")
    out = lake.scan_events(spark, root)
    return out.select(*fx.OBSERVATION_COLUMNS, "event_time",
                      F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@register("load_events")
def q_load_events(spark, sf_dir):
    """Two writer batches (readings, then re-delivered copies); the loader keeps the last."""
    from ..sources import lake
    root = _lake_path(spark, "events")
    dup = fx.readings_dup(spark, sf_dir)
    lake.write_events(dup.where(F.col("event_id") < 1_000_000_000), root, batch="0")
    lake.write_events(dup.where(F.col("event_id") >= 1_000_000_000), root, batch="1")
    return lake.load_events(spark, root).select(*fx.OBSERVATION_COLUMNS)


@register("lake_scan_recent")
def q_lake_scan_recent(spark, sf_dir):
    """Date-pruned scan: the last 7 stored dates (the cut is one scalar lookup)."""
    from ..sources import lake
    root = _lake_path(spark, "events")
    lake.write_events(_obs(spark, sf_dir), root, batch="0")
    latest = lake.latest_partition(spark, root)  # directory listing, no scan
    import datetime as dt
    since = (latest - dt.timedelta(days=6)).isoformat() if latest else None
    return lake.scan_events(spark, root, since).select(*fx.OBSERVATION_COLUMNS)


@register("load_aggregates")
def q_load_aggregates(spark, sf_dir):
    from ..operators.windows import window_agg
    from ..sources import lake
    root = _lake_path(spark, "aggregates")
    lake.write_aggregates(window_agg(clean.with_event_time(_obs(spark, sf_dir))), root)
    out = lake.load_aggregates(spark, root, limit=200)
    return _r6(out, "avg_temperature", "avg_humidity", "avg_wind_speed")


@register("alerts_roundtrip")
def q_alerts_roundtrip(spark, sf_dir):
    from ..sources import lake
    root = _lake_path(spark, "alerts")
    lake.persist_alerts(_history(spark, sf_dir).drop("batch_id"), root)
    return _r6(lake.scan_alerts(spark, root), "baseline_mean", "baseline_std")


@register("load_alerts")
def q_load_alerts(spark, sf_dir):
    from ..sources import lake
    root = _lake_path(spark, "alerts")
    lake.persist_alerts(_history(spark, sf_dir).drop("batch_id"), root)
    return _r6(lake.load_alerts(spark, root, limit=100), "baseline_mean", "baseline_std")


# --------------------------------------------------------------------------
# Live refresh
# --------------------------------------------------------------------------

def _live(spark, sf_dir):
    """One refresh: the session buffer (the newest 2000 readings, an exact top-k
    over the whole table) merged with the latest reading of every city,
    re-stamped one minute after the newest reading."""
    from ..operators.live import live_refresh
    obs = _obs(spark, sf_dir)
    now = obs.agg(F.timestamp_seconds(F.max("timestamp") + 60).alias("_now"))
    current = clean.latest_per_key(obs, "city", ("timestamp", "event_id")).crossJoin(F.broadcast(now))
    buffer = clean.tail_rows(obs, DEFAULT.live_history_rows, ["timestamp", "event_id"])
    updated, aggs, alerts = live_refresh(buffer, current, F.col("_now"))
    return updated, aggs, alerts


@register("live_history")
def q_live_history(spark, sf_dir):
    updated, _, _ = _live(spark, sf_dir)
    return updated.select(*fx.OBSERVATION_COLUMNS, "event_time")


@register("live_aggregates")
def q_live_aggregates(spark, sf_dir):
    _, aggs, _ = _live(spark, sf_dir)
    return aggs


@register("live_refresh")
def q_live_refresh(spark, sf_dir):
    _, _, alerts = _live(spark, sf_dir)
    return _r6(alerts, "baseline_mean", "baseline_std")


# --------------------------------------------------------------------------
# Structured Streaming (S1, S8, S14, S15, T1-T9, T11, A15) — staged JSON files,
# availableNow trigger, results read back from the sinks
# --------------------------------------------------------------------------

def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def _staged(spark, df: DataFrame, files: int = 4, **kw) -> str:
    from ..session import work_path
    from ..streaming.jobs import stage_records
    path = work_path(spark, "stage")
    stage_records(df, path, files=files, **kw)
    return path


@register("stream_window_agg")
def q_stream_window_agg(spark, sf_dir):
    """Readings replayed as 4 JSON files (one per micro-batch) through watermark,
    dedupe and the 5-minute window aggregate (append mode, parquet sink)."""
    from ..session import work_path
    from ..streaming.jobs import parse_stream, source, start_aggregate_stream
    stage = _staged(spark, _obs(spark, sf_dir))
    out = work_path(spark, "sink")
    q = start_aggregate_stream(parse_stream(source(spark, "files", stage, max_files=1)), out, out + "-ckpt")
    _finish(q)
    res = spark.read.parquet(out).drop("window_date")
    return _r6(res, "avg_temperature", "avg_humidity", "avg_wind_speed")


@register("stream_dedupe")
def q_stream_dedupe(spark, sf_dir):
    """The parsed, watermarked, de-duplicated stream written to a parquet sink."""
    from ..session import work_path
    from ..streaming.jobs import parse_stream, source, start_sink_stream
    stage = _staged(spark, _obs(spark, sf_dir))
    out = work_path(spark, "sink")
    _finish(start_sink_stream(parse_stream(source(spark, "files", stage, max_files=1)), out, out + "-ckpt"))
    res = spark.read.parquet(out)
    return res.select("event_id", *[c for c in fx.OBSERVATION_COLUMNS if c != "event_id"], "event_time",
                      F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


def _serve_run(spark, sf_dir, history: DataFrame | None, stream_rows: DataFrame, files: int = 4):
    from ..session import work_path
    from ..sources import lake
    from ..streaming.jobs import EventsBatch, parse_stream, source, start_events_stream
    root = work_path(spark, "serve")
    body = EventsBatch(root)
    if history is not None:
        body.ingest(history, batch="history")
    stage = _staged(spark, stream_rows, files=files)
    _finish(start_events_stream(parse_stream(source(spark, "files", stage, max_files=1)), body, root + "-ckpt"))
    return body


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Stream -> foreachBatch -> events lake (batch-keyed, replay-safe); lake read back."""
    from ..sources import lake
    body = _serve_run(spark, sf_dir, None, _obs(spark, sf_dir))
    res = lake.scan_events(spark, body.events)
    return res.select(*fx.OBSERVATION_COLUMNS, "event_time", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


def _stream_alert_run(spark, sf_dir, files: int = 1):
    history, batch = fx.split_events(spark, sf_dir)
    return _serve_run(spark, sf_dir, history, batch, files=files)


@register("stream_alerts")
def q_stream_alerts(spark, sf_dir):
    """The last day streamed (one micro-batch) against a lake pre-loaded with the
    earlier readings."""
    body = _stream_alert_run(spark, sf_dir, files=1)
    res = body.read_alerts(spark)
    return _r6(res.select(*anomaly.ALERT_COLUMNS, "detected_at"), "baseline_mean", "baseline_std")


@register("stream_redelivery")
def q_stream_redelivery(spark, sf_dir):
    """History delivered, its purchase readings delivered again with another
    temperature, the newest history date compacted, then the last day streamed:
    it is scored against moments of the de-duplicated history."""
    from ..session import work_path
    from ..sources import lake
    from ..streaming.jobs import EventsBatch, parse_stream, source, start_events_stream
    history, batch = fx.split_events(spark, sf_dir)
    root = work_path(spark, "serve")
    body = EventsBatch(root)
    body.ingest(history, batch="history")
    body.ingest(fx.delivered_again(history), batch="again")
    body.compact(spark, lake.latest_partition(spark, body.events))
    _finish(start_events_stream(parse_stream(source(spark, "files", _staged(spark, batch, files=1), max_files=1)), body, root + "-ckpt"))
    return _r6(body.read_alerts(spark).select(*anomaly.ALERT_COLUMNS, "detected_at"), "baseline_mean", "baseline_std")


@register("batch_metrics")
def q_batch_metrics(spark, sf_dir):
    """Per micro-batch counters (stored readings, alerts, notifications) of the
    last day streamed as four six-hour micro-batches: every batch is scored
    against the pre-loaded history plus the earlier micro-batches, and
    notified against the outbox of the earlier ones."""
    from ..session import work_path
    from ..streaming.jobs import EventsBatch, parse_stream, source, stage_batches, start_events_stream
    history, batch = fx.split_events(spark, sf_dir)
    first = _obs(spark, sf_dir).agg((F.max("timestamp") - 86400).alias("_cut"))
    idx = F.least(F.floor((F.col("timestamp") - F.col("_cut")) / 21600), F.lit(3)).cast("int")
    staged_rows = batch.crossJoin(F.broadcast(first)).withColumn("_b", idx).drop("_cut")
    root = work_path(spark, "serve")
    body = EventsBatch(root)
    body.ingest(history, batch="history")
    glob = stage_batches(staged_rows, work_path(spark, "stage"), "_b", 4)
    _finish(start_events_stream(parse_stream(source(spark, "files", glob, max_files=1)), body, root + "-ckpt"))
    return body.read_metrics(spark).select("batch_id", "stored", "alerts", "sent")


@register("stream_cooldown")
def q_stream_cooldown(spark, sf_dir):
    """Every absolute-rule hit streamed (4 micro-batches) through the stateful
    six-hour cooldown (applyInPandasWithState)."""
    from pyspark.sql import types as T

    from ..session import work_path
    from ..streaming.cooldown import cooldown_stream
    from ..streaming.jobs import source, start_sink_stream
    hits = anomaly.alerts_absolute(_obs(spark, sf_dir)).withColumnRenamed("event_id", "seq")
    fields = ("timestamp", "seq", "city", "metric", "alert_type", "severity", "message")
    stage = _staged(spark, hits, order=("timestamp", "seq"), fields=fields)
    schema = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("seq", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in fields[2:]]])
    raw = source(spark, "files", stage, max_files=1)
    parsed = raw.select(F.from_json("value", schema).alias("a")).select("a.*")
    out = work_path(spark, "sink")
    _finish(start_sink_stream(cooldown_stream(parsed, 6 * 3600), out, out + "-ckpt"))
    return spark.read.parquet(out)


# --------------------------------------------------------------------------
# More serving views (V2, F5/F6, A2 alphabetical tail)
# --------------------------------------------------------------------------

@register("recent_windows")
def q_recent_windows(spark, sf_dir):
    """Aggregate series for a chart: the last 12 aggregate rows (rows, not windows)."""
    from ..operators.windows import window_agg
    out = clean.tail_rows(window_agg(clean.with_event_time(_obs(spark, sf_dir))), 12, ["window_start", "city"])
    return _r6(out, "avg_temperature", "avg_humidity", "avg_wind_speed")


@register("window_agg_live_city")
def q_window_agg_live_city(spark, sf_dir):
    """Live aggregates with the alphabetical tail (last 200 rows in (city, window) order)."""
    from ..operators.windows import live_window_agg
    return live_window_agg(clean.with_event_time(_obs(spark, sf_dir)), limit=200, order="city")


@register("alert_messages")
def q_alert_messages(spark, sf_dir):
    """Every candidate alert of the last day (absolute and z rules) with its message."""
    history, batch = fx.split_events(spark, sf_dir, since=anomaly.history_cutoff)
    new_p = clean.prepare_events(batch)
    cands = anomaly.candidate_alerts(new_p, anomaly.baseline_wide(history))
    return cands.select("timestamp", "event_id", "city", "alert_type", "message")


@register("backtest_holt_fixed")
def q_backtest_holt_fixed(spark, sf_dir):
    """Hold-out back-test of Holt smoothing with fixed alpha=0.5, beta=0.3."""
    from ..operators.forecast import backtest_holt
    return _r6(backtest_holt(_series(spark, sf_dir), periods=6, alpha=0.5, beta=0.3), "mae", "rmse")
