"""Parameters and fixed values of the weather preset.

Every operator takes its keys, time column and metric columns as arguments;
the values below are only the defaults of the weather preset.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced; do not edit)
# ---------------------------------------------------------------------------

# Tracked cities, in configuration order.
CITIES = (
    "New York",
    "London",
    "Tokyo",
    "Delhi",
    "Paris",
    "Berlin",
    "Sydney",
    "Toronto",
    "Dubai",
    "Singapore",
)

# City coordinates (lat, lon), WGS84.
CITY_COORDINATES = {
    "Berlin": (52.52, 13.405),
    "Delhi": (28.6139, 77.209),
    "Dubai": (25.2048, 55.2708),
    "London": (51.5074, -0.1278),
    "New York": (40.7128, -74.006),
    "Paris": (48.8566, 2.3522),
    "Singapore": (1.3521, 103.8198),
    "Sydney": (-33.8688, 151.2093),
    "Tokyo": (35.6762, 139.6503),
    "Toronto": (43.6532, -79.3832),
}

# Metrics scored by the detector, in scoring order.
METRICS = ("temperature", "humidity", "wind_speed")

# Absolute threshold rules, in evaluation order:
# (metric, alert_type, comparison, bound, severity)
ABSOLUTE_RULES = (
    ("temperature", "heat_wave", ">=", 40.0, "high"),
    ("temperature", "cold_snap", "<=", -5.0, "high"),
    ("humidity", "extreme_humidity", ">=", 95.0, "medium"),
    ("wind_speed", "high_wind", ">=", 15.0, "medium"),
)

# Rothfusz heat-index regression coefficients (deg F, % RH), in term order:
# c0 + c1*T + c2*R + c3*T*R + c4*T^2 + c5*R^2 + c6*T^2*R + c7*T*R^2 + c8*T^2*R^2
HEAT_INDEX_COEFFICIENTS = (
    -42.379,
    2.04901523,
    10.14333127,
    -0.22475541,
    -0.00683783,
    -0.05481717,
    0.00122874,
    0.00085282,
    -0.00000199,
)

# Comfort bands on the heat index (deg C): (upper bound exclusive, label);
# anything at or above the last bound is "Extreme heat".
COMFORT_BANDS = (
    (27.0, "Comfortable"),
    (32.0, "Warm"),
    (39.0, "Hot — caution"),
    (46.0, "Very hot — danger"),
)
COMFORT_TOP = "Extreme heat"

# Frequency buckets for median inter-arrival seconds (inclusive upper bounds).
FREQ_BUCKETS = ((90, "1min"), (600, "5min"), (2100, "30min"))
FREQ_TOP = "1H"

# Forecast metric metadata (API payload paths) for the provider forecast.
FORECAST_API_PATHS = {
    "temperature": ("main", "temp"),
    "humidity": ("main", "humidity"),
    "wind_speed": ("wind", "speed"),
}

NEED_POINTS_MESSAGE = (
    "Need at least {n} points for {city}. "
    "Keep the pipeline running to collect more history."
)
FORECAST_OK_MESSAGE = "Forecast generated successfully."


@dataclass(frozen=True)
class Params:
    """Tunable parameters of the pipeline (weather defaults)."""

    z_threshold: float = 2.5
    z_high: float = 3.0
    baseline_days: int = 7
    min_baseline_samples: int = 5
    cooldown_seconds: int = 3600
    window_duration: str = "5 minutes"
    watermark_delay: str = "10 minutes"
    trigger_interval: str = "30 seconds"
    min_history_points: int = 12
    forecast_periods: int = 6
    stale_after_seconds: int = 120
    live_history_rows: int = 2000
    live_aggregate_rows: int = 200
    load_aggregates_rows: int = 200
    load_alerts_rows: int = 100
    band_factor: float = 0.5
    api_band_factor: float = 0.3
    band_floor: float = 0.5
    metrics: tuple = field(default=METRICS)


DEFAULT = Params()
