"""Provider payloads (current conditions and short-range forecast) as tables.

The HTTP client itself is out of scope; payloads arrive as rows of
``(status, body)`` (current) or nested structs (forecast) and are flattened
with built-in nested-field access, ``try_element_at`` and ``posexplode``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, FORECAST_API_PATHS, Params
from ..operators.clean import global_rank

CURRENT_SCHEMA = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType()),
                                        T.StructField("humidity", T.DoubleType())])),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType())])),
    T.StructField("weather", T.ArrayType(T.StructType([T.StructField("description", T.StringType())]))),
])

FORECAST_ITEM = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType()),
                                        T.StructField("humidity", T.DoubleType())])),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType())])),
])


def current_payloads(obs: DataFrame) -> DataFrame:
    """Build ``(status, body)`` current-conditions payloads from observations
    (fixture side).  Readings of type ``error`` stand for failed fetches."""
    body = F.to_json(F.struct(
        F.col("timestamp").alias("dt"), F.col("city").alias("name"),
        F.struct(F.col("temperature").alias("temp"), F.col("humidity").alias("humidity")).alias("main"),
        F.struct(F.col("wind_speed").alias("speed")).alias("wind"),
        F.array(F.struct(F.col("weather_condition").alias("description"))).alias("weather")))
    status = F.when(F.col("weather_condition") == "error", F.lit(404)).otherwise(F.lit(200))
    return obs.select("event_id", status.alias("status"), body.alias("body"))


def parse_current(payloads: DataFrame, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """Successful payloads flattened into observations; failed fetches give no row."""
    ok = payloads.where(F.col("status") == 200)
    p = ok.select(*keep, F.from_json("body", CURRENT_SCHEMA).alias("p"))
    return p.select(
        *keep,
        F.col("p.dt").alias("timestamp"),
        F.col("p.name").alias("city"),
        F.col("p.main.temp").alias("temperature"),
        F.col("p.main.humidity").alias("humidity"),
        F.col("p.wind.speed").alias("wind_speed"),
        F.try_element_at(F.col("p.weather"), F.lit(1))["description"].alias("weather_condition"),
        F.timestamp_seconds(F.col("p.dt")).alias("event_time"),
    )


def forecast_payloads(obs: DataFrame, key: str = "city", items: int = 12) -> DataFrame:
    """Forecast payloads per (city, day): the day's readings in time order, cut
    into consecutive payloads of ``items``, so every reading lies in one
    (fixture side).  The position inside a day is the difference of two global
    ranks, so a day with a third of all readings is no single task."""
    order = [key, "issued", "timestamp", "event_id"]
    rows = obs.select(key, "timestamp", "event_id", "temperature", "humidity", "wind_speed",
                      F.to_date(F.timestamp_seconds("timestamp")).alias("issued"))
    ranked = global_rank(rows, order, name="_at")
    firsts = ranked.groupBy(key, "issued").agg(F.min("_at").alias("_first"))
    placed = ranked.join(firsts, [key, "issued"]).withColumn("payload", F.floor((F.col("_at") - F.col("_first")) / items))
    item = F.struct(F.col("_at"), F.col("timestamp").alias("dt"),
                    F.struct(F.col("temperature").alias("temp"), F.col("humidity").alias("humidity")).alias("main"),
                    F.struct(F.col("wind_speed").alias("speed")).alias("wind"))
    grouped = placed.groupBy(key, "issued", "payload").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return grouped.select(key, "issued", "payload", F.transform("_items", lambda x: x.dropFields("_at")).alias("list"))


def parse_forecast(payloads: DataFrame, metrics: Sequence[str] = ("temperature", "humidity", "wind_speed"),
                   steps: int = 12, params: Params = DEFAULT, key_cols: Sequence[str] = ("city", "issued", "payload")) -> DataFrame:
    """First ``steps`` items of every payload for every metric, with a band of
    ``max(0.3 * sample stddev, 0.5)`` (0.5 for a single item)."""
    for m in metrics:
        if m not in FORECAST_API_PATHS:
            raise ValueError(f"Unsupported forecast metric: {m}")
    items = payloads.select(*key_cols, F.posexplode("list").alias("pos", "item")).where(F.col("pos") < steps)
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"),
                 F.col(f"item.{FORECAST_API_PATHS[m][0]}.{FORECAST_API_PATHS[m][1]}").cast("double").alias("yhat"))
        for m in metrics])
    long = items.select(*key_cols, "pos", F.timestamp_seconds(F.col("item.dt")).alias("ds"), F.inline(entries))
    band = long.groupBy(*key_cols, "metric").agg(F.stddev_samp("yhat").alias("_sd"), F.count("yhat").alias("_n"))
    margin = F.when(F.col("_n") > 1, F.greatest(F.col("_sd") * params.api_band_factor, F.lit(params.band_floor))) \
        .otherwise(F.lit(params.band_floor))
    out = long.join(band.select(*key_cols, "metric", margin.alias("_m")), [*key_cols, "metric"])
    return out.select(*key_cols, "metric", "ds", "yhat",
                      (F.col("yhat") - F.col("_m")).alias("yhat_lower"), (F.col("yhat") + F.col("_m")).alias("yhat_upper"))
