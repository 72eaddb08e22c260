"""Scalar column expressions (JVM side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMFORT_BANDS, COMFORT_TOP, FREQ_BUCKETS, FREQ_TOP, HEAT_INDEX_COEFFICIENTS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmt(x, decimals: int = 1) -> Column:
    """Fixed-point text like Python's ``f"{x:.Nf}"`` (no grouping separators)."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", _c(x).cast("double"), F.lit(pattern))


def heat_index_celsius(temp_c, humidity) -> Column:
    """Heat index in deg C (Rothfusz regression with the two adjustments).

    Below 80 deg F the air temperature (rounded to 0.1) is returned; the
    result is never below the air temperature.  Null humidity above 80 deg F
    gives null.
    """
    t = _c(temp_c).cast("double")
    raw_rh = _c(humidity).cast("double")
    # greatest/least skip nulls, so the null check uses the raw column
    rh = F.greatest(F.lit(0.0), F.least(F.lit(100.0), _c(humidity).cast("double")))
    tf = t * 9.0 / 5.0 + 32.0
    c = HEAT_INDEX_COEFFICIENTS
    hi = (F.lit(c[0]) + c[1] * tf + c[2] * rh + c[3] * tf * rh + c[4] * tf * tf + c[5] * rh * rh
          + c[6] * tf * tf * rh + c[7] * tf * rh * rh + c[8] * tf * tf * rh * rh)
    dry = F.when((rh < 13.0) & (tf >= 80.0) & (tf <= 112.0),
                 ((13.0 - rh) / 4.0) * F.sqrt((17.0 - F.abs(tf - 95.0)) / 17.0)).otherwise(F.lit(0.0))
    humid = F.when((rh > 85.0) & (tf >= 80.0) & (tf <= 87.0),
                   ((rh - 85.0) / 10.0) * ((87.0 - tf) / 5.0)).otherwise(F.lit(0.0))
    hi_c = (hi - dry + humid - 32.0) * 5.0 / 9.0
    return (F.when(t.isNull(), F.lit(None).cast("double"))
            .when(tf < 80.0, round_half_up(t, 1))
            .when(raw_rh.isNull(), F.lit(None).cast("double"))
            .otherwise(round_half_up(F.greatest(hi_c, t), 1)))


def comfort_label(heat_index) -> Column:
    hi = _c(heat_index)
    expr = F.when(hi.isNull(), F.lit(None).cast("string"))
    for bound, label in COMFORT_BANDS:
        expr = expr.when(hi < bound, F.lit(label))
    return expr.otherwise(F.lit(COMFORT_TOP))


def format_delta(delta) -> Column:
    """Signed one-decimal delta text: null '—', positive '+x.x', zero '0.0'."""
    d = _c(delta)
    return (F.when(d.isNull(), F.lit("—"))
            .when(d > 0, F.concat(F.lit("+"), fmt(d, 1)))
            .when(d < 0, fmt(d, 1))
            .otherwise(F.lit("0.0")))


def format_utc(ts, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC time text with a trailing ' UTC'; null gives '—' (session zone must be UTC)."""
    t = _c(ts)
    return F.coalesce(F.concat(F.date_format(t, pattern), F.lit(" UTC")), F.lit("—"))


def alert_key(city="city", metric="metric", alert_type="alert_type") -> Column:
    return F.concat_ws(":", _c(city), _c(metric), _c(alert_type))


def notification_text(severity="severity", message="message") -> Column:
    return F.concat(F.lit("["), F.upper(F.coalesce(_c(severity), F.lit("medium"))), F.lit("] "), _c(message))


def record_key(city="city", timestamp="timestamp") -> Column:
    return F.concat_ws(":", _c(city), _c(timestamp).cast("string"))


def freq_bucket(median_seconds) -> Column:
    s = _c(median_seconds)
    expr = None
    for bound, label in FREQ_BUCKETS:
        expr = F.when(s <= bound, F.lit(label)) if expr is None else expr.when(s <= bound, F.lit(label))
    return expr.otherwise(F.lit(FREQ_TOP))


def method_label(method="method") -> Column:
    return F.initcap(F.regexp_replace(_c(method), "_", " "))


# The tie tolerances, in units of the last kept decimal.
TIE_TOLERANCE = 1e-6
TIE_TOLERANCE_6 = 1e-4  # 6-place output normalisation of aggregates


def round_half_up(x, places: int) -> Column:
    """Decimal rounding to ``places``, ties away from zero.

    A fixed sequence of IEEE operations rather than the built-in: engines'
    own ``round`` differ on doubles next to a tie (0.115 is 0.11 here and
    0.12 where the engine scales first).  The tolerance only covers the last
    bits of the double, so 0.049995 stays 0.0 at one place."""
    scale = float(10 ** int(places))
    tie = TIE_TOLERANCE_6 if int(places) >= 6 else TIE_TOLERANCE
    v = _c(x).cast("double")
    return F.signum(v) * F.floor(F.abs(v) * F.lit(scale) + F.lit(0.5 + tie)) / F.lit(scale) + F.lit(0.0)


def round6(x) -> Column:
    """Round an aggregate-derived double to 6 places (see :func:`round_half_up`)."""
    return round_half_up(x, 6)
