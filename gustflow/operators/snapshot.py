"""Serving views over the readings: latest snapshot, enrichment, deltas, KPIs,
status and ranking.

The city dimension is a fixed 10-row table, so broadcasting it is bounded by
construction.  Everything keyed by city is an aggregation (``max_by``/
``min_by``), never a window over a whole city.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CITY_COORDINATES, METRICS
from ..functions.scalars import comfort_label, fmt, format_delta, format_utc, heat_index_celsius, round_half_up
from .clean import dedupe_last, drop_blank, latest_per_key, with_event_time


def city_dim(spark: SparkSession) -> DataFrame:
    rows = [(c, lat, lon) for c, (lat, lon) in CITY_COORDINATES.items()]
    return spark.createDataFrame(rows, "city string, lat double, lon double")


def attach_coordinates(df: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Left join to the city dimension; unknown cities get null coordinates."""
    dim = dim if dim is not None else city_dim(df.sparkSession)
    # the dimension is a fixed, 10-row table: broadcast size is bounded
    return df.join(F.broadcast(dim), "city", "left")


def with_heat_index(df: DataFrame, temp: str = "temperature", humidity: str = "humidity") -> DataFrame:
    hi = df.withColumn("heat_index", heat_index_celsius(temp, humidity))
    return hi.withColumn("comfort", comfort_label("heat_index"))


def enrich(df: DataFrame) -> DataFrame:
    """Coordinates, heat index and comfort band; without temperature and
    humidity only the coordinates."""
    out = attach_coordinates(df)
    if {"temperature", "humidity"}.issubset(df.columns):
        out = with_heat_index(out)
    return out


def previous_and_latest(df: DataFrame, key: str = "city", order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Latest and second-latest reading per key as two struct columns.

    Two aggregations instead of a window over each key: the latest row per
    key, then the latest of the rest (anti join on the order columns)."""
    cols = [c for c in df.columns if c != key]
    latest = latest_per_key(df, key, order)
    seen = latest.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    same = F.col(key) == F.col("_key")
    for i, c in enumerate(order):  # an order column may be null
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    rest = df.join(seen, same, "left_anti")
    prev = dedupe_last(rest.where(F.col(key).isNotNull()), keys=(key,), order=order)
    return (latest.select(key, F.struct(*cols).alias("now"))
            .join(prev.select(key, F.struct(*cols).alias("prev")), key, "left"))


def snapshot_delta(df: DataFrame, key: str = "city", metrics: Sequence[str] = METRICS,
                   order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Per city: previous and current value (rounded 0.1) and the signed delta
    text of every metric, the update time and the conditions; blank keys dropped."""
    clean = drop_blank(df, key)
    clean = with_event_time(clean)
    pl = previous_and_latest(clean, key, order)
    out = [F.col(key)]
    for m in metrics:
        now, prev = F.col(f"now.{m}").cast("double"), F.col(f"prev.{m}").cast("double")
        out += [round_half_up(prev, 1).alias(f"prev_{m}"), round_half_up(now, 1).alias(f"now_{m}"),
                format_delta(now - prev).alias(f"delta_{m}")]
    out += [format_utc(F.col("now.event_time"), "HH:mm:ss").alias("updated"),
            F.coalesce(F.col("now.weather_condition"), F.lit("")).alias("conditions")]
    return pl.select(*out)


def snapshot_kpis(snapshot: DataFrame, key: str = "city", value: str = "temperature") -> DataFrame:
    """Row count, mean, and the hottest / coolest key with its value (ties: smallest key)."""
    v = F.col(value)
    return snapshot.agg(
        F.count(F.lit(1)).alias("cities"),
        F.avg(v).alias("avg_temperature"),
        F.min_by(F.col(key), F.struct((-v).alias("a"), F.col(key).alias("b"))).alias("hottest_city"),
        F.max(v).alias("hottest_temperature"),
        F.min_by(F.col(key), F.struct(v.alias("a"), F.col(key).alias("b"))).alias("coolest_city"),
        F.min(v).alias("coolest_temperature"),
    )


def temperature_ranking(snapshot: DataFrame, key: str = "city", value: str = "temperature") -> DataFrame:
    """Rank of each key by value ascending (ties share a rank), computed with
    :func:`global_rank` — no single-partition window."""
    from .clean import global_rank
    return global_rank(snapshot.select(key, value), [value, key], tie=[value])


def latest_event_time(df: DataFrame, time_col: str = "event_time") -> DataFrame:
    return df.agg(F.max(time_col).alias("latest"))


def freshness_status(df: DataFrame, now, stale_after_seconds: int = 120, time_col: str = "event_time",
                     key_cols: Sequence[str] = ()) -> DataFrame:
    """Count, latest event time, age in seconds and the status text: one row,
    or one per key.  ``now`` is a literal or a one-row, one-column frame."""
    agg = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("readings"), F.max(time_col).alias("latest"))
    if isinstance(now, DataFrame):  # one row: a proven broadcast bound
        agg = agg.crossJoin(F.broadcast(now.toDF("_now")))
        now_ts = F.col("_now")
    else:
        now_ts = F.lit(now).cast("timestamp")
    age = F.unix_micros(now_ts) - F.unix_micros(F.col("latest"))
    age_s = F.floor(age / 1_000_000).cast("long")
    status = (F.when(F.col("readings") == 0, F.lit("No data"))
              .when(F.col("latest").isNull(), F.lit("Unknown"))
              .when(age > stale_after_seconds * 1_000_000,
                    F.concat(F.lit("Stale ("), age_s.cast("string"), F.lit("s old)")))
              .otherwise(F.lit("Healthy")))
    return agg.select(*key_cols, "readings", "latest", age_s.alias("age_seconds"), status.alias("status"),
                      format_utc(F.col("latest")).alias("updated"))


def shift_to_now(df: DataFrame, now, time_col: str = "event_time", epoch_col: str = "timestamp") -> DataFrame:
    """Shift all times so that the newest equals ``now``; recompute epoch seconds."""
    latest = df.agg(F.max(time_col).alias("_latest"))
    now_ts = F.lit(now).cast("timestamp")
    shifted = df.crossJoin(F.broadcast(latest)).withColumn(
        time_col, F.timestamp_micros(F.unix_micros(F.col(time_col)) + F.unix_micros(now_ts) - F.unix_micros("_latest")))
    return shifted.withColumn(epoch_col, F.unix_seconds(F.col(time_col))).drop("_latest")


def map_points(snapshot: DataFrame) -> DataFrame:
    """Rows with coordinates, hover text, and the colour range (min/max heat index)."""
    mapped = snapshot.dropna(subset=["lat", "lon"])
    hover = F.concat(
        F.lit("<b>"), F.col("city"), F.lit("</b><br>Temp: "), fmt("temperature", 1),
        F.lit("°C<br>Feels like: "), fmt(F.coalesce(F.col("heat_index"), F.col("temperature")), 1),
        F.lit("°C<br>Humidity: "), fmt("humidity", 0), F.lit("%<br>"),
        F.coalesce(F.col("weather_condition"), F.lit("")))
    stats = mapped.agg(F.min("heat_index").alias("color_min"), F.max("heat_index").alias("color_max"))
    # one-row aggregate: broadcast is bounded
    return mapped.select("city", "lat", "lon", "heat_index", hover.alias("hover")).crossJoin(F.broadcast(stats))
