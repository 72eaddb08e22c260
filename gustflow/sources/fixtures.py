"""Observation views derived from the driver tables.

``readings`` maps the generic ``events`` table onto the observation schema
(timestamp, city, temperature, humidity, wind_speed, weather_condition) so
that every weather operator runs over the whole table.  The same mapping is
written in DuckDB SQL in :mod:`gustflow.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CITIES

# Fixed values of the mapping: base temperature per event type.
TEMPERATURE_BASE = {
    "click": 12.0,
    "view": 18.0,
    "purchase": 24.0,
    "signup": 30.0,
    "error": -1.0,
}

OBSERVATION_COLUMNS = [
    "event_id",
    "timestamp",
    "city",
    "temperature",
    "humidity",
    "wind_speed",
    "weather_condition",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base_temperature(event_type: Column) -> Column:
    expr = None
    for kind, base in TEMPERATURE_BASE.items():
        expr = (F.when(event_type == kind, F.lit(base)) if expr is None
                else expr.when(event_type == kind, F.lit(base)))
    return expr


def readings_from_events(events: DataFrame) -> DataFrame:
    """Project ``events`` onto the observation schema (narrow, no shuffle)."""
    cities = F.array(*[F.lit(c) for c in CITIES])
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.element_at(cities, (F.col("user_id") % len(CITIES)).cast("int") + 1).alias("city"),
        (_base_temperature(F.col("event_type")) + (F.col("value") - 50.0) / 10.0).alias("temperature"),
        F.nullif(k, F.lit(0)).cast("double").alias("humidity"),
        (F.col("value") / 20.0).alias("wind_speed"),
        F.col("event_type").alias("weather_condition"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(table(spark, sf_dir, "events"))


def readings_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``readings`` plus a later re-delivery of every purchase reading.

    The copies keep (city, timestamp), carry a higher event_id (arrival
    order) and a temperature raised by 0.5, so keep-last is observable.
    """
    base = readings(spark, sf_dir)
    return base.unionByName(delivered_again(base))


def delivered_again(base: DataFrame) -> DataFrame:
    """The later copies of ``base``'s purchase readings."""
    return (base.where(F.col("weather_condition") == "purchase")
            .withColumn("event_id", F.col("event_id") + F.lit(1_000_000_000))
            .withColumn("temperature", F.col("temperature") + F.lit(0.5)))


def split_history_batch(obs: DataFrame, seconds: int = 86400, time_col: str = "timestamp"):
    """Split at ``max(time) - seconds``: history is ``<`` cut, batch ``>=``.

    The cut is a one-row aggregate joined back (broadcast of a single row),
    so nothing is collected on the driver.
    """
    cut = obs.agg((F.max(time_col) - F.lit(seconds)).alias("_cut"))
    tagged = obs.crossJoin(F.broadcast(cut))
    history = tagged.where(F.col(time_col) < F.col("_cut")).drop("_cut")
    batch = tagged.where(F.col(time_col) >= F.col("_cut")).drop("_cut")
    return history, batch


def split_events(spark: SparkSession, sf_dir: str, seconds: int = 86400, since=None):
    """``split_history_batch`` over ``events`` with the cut pushed to the scan.

    The cut (newest reading - ``seconds``, in whole seconds) is computed first
    as one scalar over the ``ts`` column, then applied as literal predicates
    on the raw ``ts`` column, which Parquet uses for row-group skipping
    (``PushedFilters``): the batch side reads only the last ``seconds``.
    Same rows as the lazy split: ``timestamp >= cut`` exactly when
    ``ts >= cut`` for a whole-second cut.

    ``since`` maps the history to a lower time bound (or None): the returned
    history is then read from that bound on, again by a literal predicate on
    ``ts``.  The bound must be in whole seconds, as event times are."""
    import datetime as dt
    ev = table(spark, sf_dir, "events")
    newest = ev.agg(F.max("ts")).first()[0]
    if newest is None:
        empty = readings_from_events(ev.where(F.lit(False)))
        return empty, empty
    cut = newest.replace(microsecond=0) - dt.timedelta(seconds=int(seconds))
    # a text literal, so no Python-side time zone is involved
    bound = F.lit(cut.isoformat(sep=" ")).cast(ev.schema["ts"].dataType)
    past, batch = ev.where(F.col("ts") < bound), readings_from_events(ev.where(F.col("ts") >= bound))
    lower = since(readings_from_events(past)) if since else None
    if lower is not None:
        past = past.where(F.col("ts") >= F.lit(lower).cast(ev.schema["ts"].dataType))
    return readings_from_events(past), batch


def lineitem_readings(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """The generic run: key ``l_suppkey``, time ``l_shipdate``, three metrics;
    ``since`` (midnight of a date) is a lower bound pushed to the scan."""
    li = table(spark, sf_dir, "lineitem")
    if since is not None:
        li = li.where(F.col("l_shipdate") >= F.lit(since).cast(li.schema["l_shipdate"].dataType))
    return li.select(
        "l_suppkey",
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
    )
