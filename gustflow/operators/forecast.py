"""Short-horizon forecasts for every (key, metric) series at once.

Series come from :func:`gustflow.operators.windows.resample`: a regular grid
of ``step`` seconds with no internal gaps, so the position of a point is
``(ds - first_ds) / step`` — numbered from a per-series minimum, with no
ordering window.

* Linear trend: least squares with ``regr_slope`` / ``regr_intercept``
  (partial aggregation), future points from ``sequence(1, periods)``.
* Hold-out back-test: the last ``h = max(2, min(periods, n // 4))`` points
  are held out (only when ``n > h + min_points``), the model is refit on the
  rest, and MAE / RMSE are aggregates of the errors.
* Holt's additive-trend exponential smoothing is a scan of affine maps over
  blocks of a series (:mod:`gustflow.operators.holt`); a task holds one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, FORECAST_OK_MESSAGE, NEED_POINTS_MESSAGE, Params
from ..session import materialize
from . import holt

SERIES_KEYS = ("city", "metric")
METHODS = ("linear_trend", "exponential_smoothing", "auto", "prophet")


def _margin(std: F.Column, n: F.Column, params: Params) -> F.Column:
    sd = F.when(n > 1, std).otherwise(F.lit(1.0))
    return F.greatest(sd * params.band_factor, F.lit(params.band_floor))


def indexed(series: DataFrame, keys: Sequence[str] = SERIES_KEYS, step: int = 1800) -> DataFrame:
    """Add ``i`` (0-based position) and ``n`` (series length) to a regular series.

    Whole-partition window aggregates over one series (bounded by its grid),
    so the series is computed once and stays partitioned by its keys for
    the per-series aggregates that follow."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys)
    return (series.withColumn("_first", F.min("ds").over(w))
            .withColumn("n", F.count(F.lit(1)).over(w))
            .withColumn("i", ((F.unix_seconds("ds") - F.unix_seconds("_first")) / step).cast("long"))
            .drop("_first"))


def linear_fit(ix: DataFrame, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Per series: n, slope, intercept, population stddev of y, last ds."""
    x = F.col("i").cast("double")
    return ix.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", x).alias("slope"),
        F.regr_intercept("y", x).alias("intercept"),
        F.stddev_pop("y").alias("std"),
        F.max("ds").alias("last_ds"))


def _future(fit: DataFrame, keys: Sequence[str], periods: int, step: int, params: Params, method: str) -> DataFrame:
    k = F.explode(F.sequence(F.lit(1), F.lit(int(periods)))).alias("k")
    rows = fit.select(*keys, "n", "slope", "intercept", "std", "last_ds", k)
    yhat = F.col("slope") * (F.col("n") - 1 + F.col("k")).cast("double") + F.col("intercept")
    m = _margin(F.col("std"), F.col("n"), params)
    return rows.select(
        *keys, F.lit(method).alias("method"),
        F.timestamp_seconds(F.unix_seconds("last_ds") + F.col("k") * step).alias("ds"),
        yhat.alias("yhat"), (yhat - m).alias("yhat_lower"), (yhat + m).alias("yhat_upper"))


def forecast_linear(series: DataFrame, periods: int = 6, keys: Sequence[str] = SERIES_KEYS, step: int = 1800,
                    params: Params = DEFAULT) -> DataFrame:
    """Linear-trend forecast for every series with at least ``min_history_points``."""
    fit = linear_fit(indexed(series, keys, step), keys).where(F.col("n") >= params.min_history_points)
    return _future(fit, keys, periods, step, params, "linear_trend")


def forecast_status(series: DataFrame, method: str = "linear_trend", keys: Sequence[str] = SERIES_KEYS,
                    params: Params = DEFAULT, step: int = 1800) -> DataFrame:
    """Per series: points, the method that its fit was made with and the message.

    ``none`` when the series is too short or the method gave no finite fit;
    ``auto`` names the smoothing where it fits and else the linear trend."""
    if method not in METHODS:
        raise ValueError(f"Unknown forecast method: {method}")
    short = F.col("n") < params.min_history_points
    head, tail = NEED_POINTS_MESSAGE.split("{city}")
    need = F.concat(F.lit(head.format(n=params.min_history_points)), F.col(keys[0]).cast("string"), F.lit(tail))
    if method == "prophet":
        made = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("used", F.lit(None).cast("string"))
        reason = "No module named 'prophet'"
    else:
        reason = "no finite fit"
        if method == "linear_trend":
            made = linear_fit(indexed(series, keys, step), keys)
            made = made.withColumn("level", F.lit(None).cast("double")).withColumn("trend", F.col("level"))
        else:
            n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            fit, _ = _smoothed(series, 6, keys, step, params, None, None, False, holt.BLOCK)
            made = n.join(fit.drop("n"), list(keys), "left")
        smooth = F.when(_finite(F.col("level")) & _finite(F.col("trend")), "exponential_smoothing")
        linear = F.when(_finite(F.col("slope")) & _finite(F.col("intercept")), "linear_trend")
        made = made.withColumn("used", {"linear_trend": linear, "exponential_smoothing": smooth,
                                        "auto": F.coalesce(smooth, linear)}[method])
    failed = F.lit(f"Could not run {method.replace('_', ' ')}: {reason}")
    return made.select(*keys, "n", F.when(short | F.col("used").isNull(), "none").otherwise(F.col("used")).alias("method"),
                       F.when(short, need).when(F.col("used").isNull(), failed).otherwise(F.lit(FORECAST_OK_MESSAGE)).alias("message"))


def _holdout(ix: DataFrame, periods: int, params: Params) -> DataFrame:
    h = F.greatest(F.lit(2), F.least(F.lit(int(periods)), F.floor(F.col("n") / 4))).cast("long")
    return ix.withColumn("h", h).withColumn("eligible", F.col("n") > F.col("h") + params.min_history_points)


def backtest_linear(series: DataFrame, periods: int = 6, keys: Sequence[str] = SERIES_KEYS, step: int = 1800,
                    params: Params = DEFAULT) -> DataFrame:
    """Refit on all but the last ``h`` points, compare on them: MAE, RMSE."""
    ix = _holdout(indexed(series, keys, step), periods, params).where(F.col("n") >= params.min_history_points)
    train = ix.where(F.col("i") < F.col("n") - F.col("h"))
    x = F.col("i").cast("double")
    fit = train.groupBy(*keys).agg(F.regr_slope("y", x).alias("slope"), F.regr_intercept("y", x).alias("intercept"))
    test = ix.where(F.col("i") >= F.col("n") - F.col("h")).join(fit, list(keys))
    err = F.col("y") - (F.col("slope") * x + F.col("intercept"))
    scored = test.groupBy(*keys).agg(
        F.first("eligible").alias("eligible"), F.count(F.lit(1)).alias("_h"),
        F.avg(F.abs(err)).alias("_mae"), F.sqrt(F.avg(err * err)).alias("_rmse"))
    return scored.select(
        *keys, F.lit("linear_trend").alias("method"),
        F.when(F.col("eligible"), F.col("_h")).otherwise(F.lit(0)).cast("int").alias("n"),
        F.when(F.col("eligible"), F.col("_mae")).alias("mae"),
        F.when(F.col("eligible"), F.col("_rmse")).alias("rmse"),
        F.lit(FORECAST_OK_MESSAGE).alias("message"))


# --------------------------------------------------------------------------
# Holt's linear (additive trend) exponential smoothing
# --------------------------------------------------------------------------

FORECAST_SCHEMA = T.StructType([
    T.StructField("city", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("ds", T.TimestampType()),
    T.StructField("yhat", T.DoubleType()), T.StructField("yhat_lower", T.DoubleType()),
    T.StructField("yhat_upper", T.DoubleType()),
])


def _smoothed(series: DataFrame, periods: int, keys: Sequence[str], step: int, params: Params, alpha, beta,
              holdout: bool, block: int) -> tuple[DataFrame, DataFrame]:
    """(one row per series that is long enough, blocks).  A row has n, h, n_fit,
    last_ds, std and, where the fit is finite, level and trend."""
    blocks = materialize(holt.blocks_of(series, keys, step, block))
    h = F.greatest(F.lit(2), F.least(F.lit(int(periods)), F.floor(F.col("n") / 4))).cast("int")
    spans = holt.lengths(blocks, keys).where(F.col("n") >= params.min_history_points).withColumn("h", h)
    if holdout:
        spans = spans.where(F.col("n") > F.col("h") + params.min_history_points)
    spans = spans.withColumn("n_fit", F.col("n") - F.col("h") if holdout else F.col("n"))
    train = holt.training(blocks, spans, keys, step)
    x = (F.col("i0") + F.col("j")).cast("double")
    line = (train.select(*keys, "i0", F.posexplode("ys").alias("j", "y")).groupBy(*keys)
            .agg(F.stddev_pop("y").alias("std"), F.regr_slope("y", x).alias("slope"), F.regr_intercept("y", x).alias("intercept")))
    fitted = holt.fit(train, keys, alpha, beta).select(*keys, "level", "trend")
    last = F.timestamp_seconds(F.unix_seconds("first_ds") + (F.col("n_fit") - 1) * step).alias("last_ds")
    out = spans.join(line, list(keys)).join(fitted, list(keys), "left")
    return out.select(*keys, "n", "h", "n_fit", last, "std", "slope", "intercept", "level", "trend"), blocks


def _finite(c: F.Column) -> F.Column:
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def forecast_holt(series: DataFrame, periods: int = 6, step: int = 1800, params: Params = DEFAULT,
                  alpha: float | None = None, beta: float | None = None, holdout: bool = False,
                  fallback: bool = False, keys: Sequence[str] = SERIES_KEYS, block: int = holt.BLOCK) -> DataFrame:
    """Holt forecast of every series with at least ``min_history_points``.

    ``holdout=True`` returns the predictions for the held-out tail instead
    (used by the back-test); ``fallback=True`` is the auto cascade: the linear
    trend where the smoothing has no finite fit.  Without it such a series has
    no rows (see :func:`forecast_status`)."""
    fit, _ = _smoothed(series, periods, keys, step, params, alpha, beta, holdout, block)
    k = F.explode(F.sequence(F.lit(1), F.col("h") if holdout else F.lit(int(periods)))).alias("k")
    rows = fit.withColumn("ok", _finite(F.col("level")) & _finite(F.col("trend"))).select("*", k)
    if not fallback:
        rows = rows.where("ok")
    yhat = F.when(F.col("ok"), F.col("level") + F.col("k") * F.col("trend")).otherwise(
        F.col("slope") * (F.col("n_fit") - 1 + F.col("k")).cast("double") + F.col("intercept"))
    m = _margin(F.col("std"), F.col("n_fit"), params)
    return rows.select(
        *keys, F.when(F.col("ok"), "exponential_smoothing").otherwise("linear_trend").alias("method"),
        F.timestamp_seconds(F.unix_seconds("last_ds") + F.col("k") * step).alias("ds"),
        yhat.alias("yhat"), (yhat - m).alias("yhat_lower"), (yhat + m).alias("yhat_upper"))


def backtest_holt(series: DataFrame, periods: int = 6, step: int = 1800, params: Params = DEFAULT,
                  alpha: float | None = None, beta: float | None = None, keys: Sequence[str] = SERIES_KEYS,
                  block: int = holt.BLOCK) -> DataFrame:
    """Hold-out error of Holt smoothing.  Like the linear back-test it returns
    every series with ``min_history_points``; one too short to hold out
    ``h`` points, or without a finite fit, has n = 0 and null metrics."""
    fit, blocks = _smoothed(series, periods, keys, step, params, alpha, beta, True, block)
    spans = holt.lengths(blocks, keys).where(F.col("n") >= params.min_history_points)
    i = ((F.unix_seconds("ds0") - F.unix_seconds("first_ds")) / step).cast("int")
    tail = (blocks.join(spans, list(keys)).join(fit.select(*keys, "n_fit", "level", "trend"), list(keys))
            .where(i + F.size("ys") > F.col("n_fit"))
            .select(*keys, "n_fit", "level", "trend", i.alias("i0"), F.posexplode("ys").alias("j", "y"))
            .withColumn("k", F.col("i0") + F.col("j") - F.col("n_fit") + 1).where("k > 0"))
    err = F.col("y") - (F.col("level") + F.col("k") * F.col("trend"))
    scored = tail.where(_finite(err)).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("_n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
    return spans.join(scored, list(keys), "left").select(
        *keys, F.lit("exponential_smoothing").alias("method"), F.coalesce("_n", F.lit(0)).alias("n"),
        "mae", "rmse", F.lit(FORECAST_OK_MESSAGE).alias("message"))


def forecast(series: DataFrame, periods: int = 6, method: str = "auto", step: int = 1800,
             params: Params = DEFAULT) -> DataFrame:
    """Method dispatch: ``linear_trend``, ``exponential_smoothing``, ``auto``
    (smoothing, else linear per series) or ``prophet`` (not available: no rows,
    see :func:`forecast_status`)."""
    if method == "linear_trend":
        return forecast_linear(series, periods, step=step, params=params)
    if method == "exponential_smoothing":
        return forecast_holt(series, periods, step, params)
    if method == "auto":
        return forecast_holt(series, periods, step, params, fallback=True)
    if method == "prophet":
        return series.sparkSession.createDataFrame([], FORECAST_SCHEMA)
    raise ValueError(f"Unknown forecast method: {method}")


def next_value(fc: DataFrame, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """The first forecast row of every series."""
    return fc.groupBy(*keys).agg(F.min("ds").alias("ds"), F.min_by("yhat", "ds").alias("next_yhat"))
