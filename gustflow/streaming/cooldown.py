"""Streaming notification cooldown with per-key state.

``applyInPandasWithState`` keyed by alert key; the state is one number (the
last sent time), with ``ttl_ms`` dropped once a key was silent that long.  Inside a micro-batch a key's alerts are reduced, one Arrow batch after
the other, to the first one of each second (only that one can be sent) and then
folded greedily in time order: a key takes memory for its distinct seconds,
whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT
from ..functions.scalars import alert_key

OUT_SCHEMA = "alert_key string, timestamp long, seq long, severity string, message string"
STATE_SCHEMA = "last_sent long"


def _first_of_second(held: pd.DataFrame | None, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf if held is None else pd.concat([held, pdf])
    return rows.sort_values(["timestamp", "seq"], kind="mergesort").drop_duplicates("timestamp")


def _fold(cooldown: int, ttl_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        first = None
        for pdf in pdfs:
            first = _first_of_second(first, pdf)
        if first is None or not len(first):
            return
        keep = []
        for t in first["timestamp"].to_numpy():
            t = int(t)
            ok = last is None or t - last >= cooldown
            keep.append(ok)
            if ok:
                last = t
        state.update((last,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        out = first[keep]
        if len(out):
            yield out[["alert_key", "timestamp", "seq", "severity", "message"]]
    return fn


def cooldown_stream(alerts: DataFrame, cooldown: int = DEFAULT.cooldown_seconds, seq_col: str = "seq",
                    ttl_ms: int = 0) -> DataFrame:
    """Sent alerts of a stream of alerts (columns city, metric, alert_type,
    timestamp, severity, message and a ``seq`` tie-breaker).  ``ttl_ms``: how
    long a silent key is remembered in processing time (0: for ever); take many
    cooldowns, so that a stream that stood still knows what it sent.  With it
    Spark runs a batch at every trigger, so an ``availableNow`` run ends only
    with ``spark.sql.streaming.noDataMicroBatches.enabled=false``.  Rows without
    a timestamp or key send nothing."""
    keyed = alerts.select(alert_key().alias("alert_key"), F.col("timestamp").cast("long").alias("timestamp"),
                          F.col(seq_col).cast("long").alias("seq"), "severity", "message")
    known = keyed.where(F.col("timestamp").isNotNull() & F.col("alert_key").isNotNull())
    return known.groupBy("alert_key").applyInPandasWithState(
        _fold(int(cooldown), ttl_ms), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)
