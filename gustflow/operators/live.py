"""Incremental refresh: merge freshly fetched readings into a bounded rolling
history, recompute window aggregates and score the new readings.

``live_refresh(history, current, now)`` returns ``(updated, aggregates,
alerts)``.  The fresh readings are re-stamped with ``now`` (the fetch time),
so de-duplication is per refresh.  ``history`` is the previous buffer (at
most ``live_history_rows`` rows — the bounded session buffer is the
feature), so the merge never shuffles more than one buffer;
alerts compare the fresh readings with the rest of that buffer.  An empty
``current`` leaves the history unchanged and yields no aggregates/alerts
(the caller checks emptiness once; no data goes through the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from .anomaly import detect_anomalies
from .clean import dedupe_last, tail_rows, with_event_time
from .windows import live_window_agg


def restamp(current: DataFrame, now) -> DataFrame:
    now_c = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    return (current.withColumn("event_time", now_c)
            .withColumn("timestamp", F.unix_seconds(now_c)))


def merge_history(history: DataFrame, current: DataFrame, rows: int = DEFAULT.live_history_rows) -> DataFrame:
    """Union (current after history), keep-last per (city, timestamp), newest ``rows``."""
    h = with_event_time(history).withColumn("_src", F.lit(0))
    c = current.withColumn("_src", F.lit(1))
    if "_now" not in history.columns:
        h = h.withColumn("_now", F.lit(None).cast("timestamp"))
    both = h.unionByName(c, allowMissingColumns=True)
    deduped = dedupe_last(both, ("city", "timestamp"), ("_src", "event_id"))
    return tail_rows(deduped, rows, ["timestamp", "_src", "event_id"])


def live_refresh(history: DataFrame, current: DataFrame, now, params: Params = DEFAULT):
    """``now`` is a timestamp literal, or a Column available on ``current``
    (e.g. a one-row aggregate joined to it)."""
    fresh = restamp(current, now)
    now_c = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    fresh = fresh.withColumn("_now", now_c)
    updated = merge_history(history, fresh, params.live_history_rows)
    # an empty fetch gives no aggregates; the flag is one row at most
    fetched = fresh.limit(1).select(F.lit(1).alias("_fetched"))
    aggregates = live_window_agg(updated, limit=params.live_aggregate_rows).crossJoin(F.broadcast(fetched)).drop("_fetched")
    recent = updated.where(F.col("_src") == 0)
    scored = updated.where(F.col("_src") == 1)
    stamp = scored.agg(F.max("_now").alias("detected_at"))
    alerts = detect_anomalies(scored.drop("_src", "event_time", "_now"), recent.drop("_src", "event_time", "_now"),
                              params=params)
    # one-row stamp: bounded broadcast
    return updated.drop("_src", "_now"), aggregates, alerts.crossJoin(F.broadcast(stamp))
