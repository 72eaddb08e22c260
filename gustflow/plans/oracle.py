"""DuckDB oracle SQL for the registered queries (tables are pre-registered views)."""

from __future__ import annotations

from .sqlparts import (keep_last, ALERT_OUT, NOT_NULL, READINGS, READINGS_DUP, SPLIT, city_dim_sql, comfort_sql, delta_sql,
                       heat_index_sql, r6, rnd, utc_text, rolling_ctes, cooldown_ctes, resample_ctes, holt_search_ctes, linear_ctes, absolute_candidates, baseline_ctes, detect_ctes, z_candidates)

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


# --------------------------------------------------------------------------
# Detection
# --------------------------------------------------------------------------

sql("detect_anomalies", f"""
WITH {READINGS},
{SPLIT},
{detect_ctes('batch', 'hist')}
SELECT {ALERT_OUT} FROM d_alerts
""")

sql("baseline_stats", f"""
WITH {READINGS},
{SPLIT},
{baseline_ctes('hist')}
SELECT city, metric, {r6('mean')} AS mean, {r6('std')} AS std, sample_count FROM base
""")

sql("alerts_absolute", f"""
WITH {READINGS},
prep AS (SELECT * FROM readings WHERE city IS NOT NULL AND temperature IS NOT NULL
         AND humidity IS NOT NULL AND wind_speed IS NOT NULL)
SELECT "timestamp", event_id, city, metric, alert_type, severity, value, message FROM (
  {absolute_candidates('prep')})
""")

sql("alerts_zscore", f"""
WITH {READINGS},
{SPLIT},
{baseline_ctes('hist')},
newp AS (SELECT * FROM batch WHERE city IS NOT NULL AND temperature IS NOT NULL
         AND humidity IS NOT NULL AND wind_speed IS NOT NULL)
SELECT "timestamp", event_id, city, metric, alert_type, severity, value,
       {r6('baseline_mean')} AS baseline_mean, {r6('baseline_std')} AS baseline_std, z_score, message
FROM ({z_candidates('newp')})
""")

sql("score_latest", f"""
WITH {READINGS},
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY "timestamp" DESC, event_id DESC) AS rn
                          FROM readings WHERE city IS NOT NULL) WHERE rn = 1),
last10 AS (SELECT event_id FROM readings ORDER BY "timestamp" DESC, event_id DESC LIMIT 10),
older AS (SELECT * FROM readings WHERE event_id NOT IN (SELECT event_id FROM last10)),
{detect_ctes('latest', 'older')}
SELECT {ALERT_OUT} FROM d_alerts
""")

sql("baseline_stats_lineitem", f"""
WITH li AS (SELECT l_suppkey, CAST(l_shipdate AS TIMESTAMP) AS t, l_quantity, l_extendedprice, l_discount FROM lineitem),
win AS (SELECT * FROM li WHERE t >= (SELECT max(t) FROM li) - INTERVAL 365 DAY)
SELECT * FROM (
  SELECT l_suppkey, 'l_quantity' AS metric, {r6('avg(l_quantity)')} AS mean, {r6('stddev_pop(l_quantity)')} AS std,
         count(l_quantity) AS sample_count FROM win GROUP BY l_suppkey HAVING count(l_quantity) >= 5
  UNION ALL
  SELECT l_suppkey, 'l_extendedprice', {r6('avg(l_extendedprice)')}, {r6('stddev_pop(l_extendedprice)')},
         count(l_extendedprice) FROM win GROUP BY l_suppkey HAVING count(l_extendedprice) >= 5
  UNION ALL
  SELECT l_suppkey, 'l_discount', {r6('avg(l_discount)')}, {r6('stddev_pop(l_discount)')},
         count(l_discount) FROM win GROUP BY l_suppkey HAVING count(l_discount) >= 5)
""")


# --------------------------------------------------------------------------
# Projections, parsing, cleaning
# --------------------------------------------------------------------------

ET = 'make_timestamp("timestamp" * 1000000)'
OBS = 'SELECT "timestamp", city, temperature, humidity, wind_speed, weather_condition FROM readings'

sql("parse_json", f"WITH {READINGS} {OBS}")

sql("to_records", f"""WITH {READINGS}
SELECT city || ':' || CAST("timestamp" AS VARCHAR) AS key, "timestamp", city, temperature, humidity, wind_speed,
       weather_condition FROM readings""")

sql("event_time", f"""WITH {READINGS}
SELECT event_id, "timestamp", {ET} AS event_time, strftime(CAST({ET} AS DATE), '%Y-%m-%d') AS event_date
FROM readings""")

sql("prepare_events", f"""WITH {READINGS}
SELECT *, {ET} AS event_time FROM readings WHERE {NOT_NULL}""")

sql("unpivot_metrics", f"""WITH {READINGS}
SELECT event_id, "timestamp", city, 'temperature' AS metric, temperature AS value FROM readings
UNION ALL SELECT event_id, "timestamp", city, 'humidity', humidity FROM readings
UNION ALL SELECT event_id, "timestamp", city, 'wind_speed', wind_speed FROM readings""")

sql("filter_cities", f"WITH {READINGS} SELECT * FROM readings WHERE city IN ('Delhi', 'Tokyo')")

sql("dedupe_last", f"""WITH {READINGS}, {READINGS_DUP}
SELECT event_id, "timestamp", city, temperature, humidity, wind_speed, weather_condition FROM (
  SELECT *, row_number() OVER (PARTITION BY city, "timestamp" ORDER BY event_id DESC) AS rn FROM readings_dup)
WHERE rn = 1""")

sql("latest_per_city", f"""WITH {READINGS}
SELECT event_id, "timestamp", city, temperature, humidity, wind_speed, weather_condition FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY "timestamp" DESC, event_id DESC) AS rn
  FROM readings WHERE city IS NOT NULL)
WHERE rn = 1""")

sql("recent_history", f"""WITH {READINGS}
SELECT * FROM readings ORDER BY "timestamp" DESC, event_id DESC LIMIT 20""")

sql("distinct_cities", f"WITH {READINGS} SELECT DISTINCT city FROM readings WHERE city IS NOT NULL")


# --------------------------------------------------------------------------
# Windows and regular series
# --------------------------------------------------------------------------

WIN5 = f"time_bucket(INTERVAL 5 MINUTE, {ET})"

sql("window_agg_5m", f"""WITH {READINGS}
SELECT city, {WIN5} AS window_start, {WIN5} + INTERVAL 5 MINUTE AS window_end,
       {r6('avg(temperature)')} AS avg_temperature, {r6('avg(humidity)')} AS avg_humidity,
       {r6('avg(wind_speed)')} AS avg_wind_speed, count(*) AS record_count
FROM readings GROUP BY city, {WIN5}""")

sql("window_agg_live", f"""WITH {READINGS},
agg AS (
  SELECT city, {WIN5} AS window_start, {WIN5} + INTERVAL 5 MINUTE AS window_end,
         {rnd('avg(temperature)', 2)} AS avg_temperature, {rnd('avg(humidity)', 2)} AS avg_humidity,
         {rnd('avg(wind_speed)', 2)} AS avg_wind_speed, count(temperature) AS record_count
  FROM readings GROUP BY city, {WIN5})
SELECT * FROM agg ORDER BY window_start DESC, city DESC LIMIT 200""")

sql("resample_30m", f"""WITH {READINGS},
{resample_ctes()}
SELECT city, metric, ds, {r6('y')} AS y FROM series""")

sql("infer_freq", f"""WITH {READINGS},
d AS (SELECT city, "timestamp" - lag("timestamp") OVER (PARTITION BY city ORDER BY "timestamp") AS gap
      FROM readings WHERE city IS NOT NULL),
m AS (SELECT city, median(gap) AS med FROM d GROUP BY city)
SELECT city, CAST(floor(med) AS BIGINT) AS median_seconds,
  CASE WHEN med IS NULL THEN '30min' WHEN floor(med) <= 90 THEN '1min' WHEN floor(med) <= 600 THEN '5min'
       WHEN floor(med) <= 2100 THEN '30min' ELSE '1H' END AS freq
FROM m""")


# --------------------------------------------------------------------------
# Enrichment and snapshot views
# --------------------------------------------------------------------------

LATEST = f"""latest AS (
  SELECT event_id, "timestamp", city, temperature, humidity, wind_speed, weather_condition, {ET} AS event_time FROM (
    SELECT *, row_number() OVER (PARTITION BY city ORDER BY "timestamp" DESC, event_id DESC) AS rn
    FROM readings WHERE city IS NOT NULL) WHERE rn = 1)"""

sql("attach_coordinates", f"""WITH {READINGS}, {city_dim_sql()}
SELECT event_id, r.city, lat, lon FROM readings r LEFT JOIN city_dim USING (city)""")

sql("heat_index", f"""WITH {READINGS}
SELECT event_id, temperature, humidity, {heat_index_sql()} AS heat_index FROM readings""")

sql("comfort", f"""WITH {READINGS},
h AS (SELECT event_id, {heat_index_sql()} AS heat_index FROM readings)
SELECT event_id, heat_index, {comfort_sql()} AS comfort FROM h""")

ENRICHED = f"""enriched AS (
  SELECT l.*, lat, lon, {heat_index_sql()} AS heat_index FROM latest l LEFT JOIN city_dim USING (city))"""

sql("enrich", f"""WITH {READINGS}, {city_dim_sql()}, {LATEST}, {ENRICHED}
SELECT city, "timestamp", temperature, humidity, wind_speed, weather_condition, lat, lon, heat_index,
       {comfort_sql()} AS comfort FROM enriched""")

_DELTA_COLS = ",\n  ".join(
    f"{rnd('p.' + m, 1)} AS prev_{m}, {rnd('n.' + m, 1)} AS now_{m}, {delta_sql(f'(n.{m} - p.{m})')} AS delta_{m}"
    for m in ("temperature", "humidity", "wind_speed"))

sql("snapshot_delta", f"""WITH {READINGS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY "timestamp" DESC, event_id DESC) AS rn
           FROM readings WHERE city IS NOT NULL AND trim(city) <> ''),
n AS (SELECT * FROM ranked WHERE rn = 1),
p AS (SELECT * FROM ranked WHERE rn = 2)
SELECT n.city,
  {_DELTA_COLS},
  {utc_text(f'make_timestamp(n."timestamp" * 1000000)', '%H:%M:%S')} AS updated,
  coalesce(n.weather_condition, '') AS conditions
FROM n LEFT JOIN p USING (city)""")

sql("snapshot_kpis", f"""WITH {READINGS}, {LATEST}
SELECT count(*) AS cities, {r6('avg(temperature)')} AS avg_temperature,
       first(city ORDER BY temperature DESC, city) AS hottest_city, max(temperature) AS hottest_temperature,
       first(city ORDER BY temperature, city) AS coolest_city, min(temperature) AS coolest_temperature
FROM latest""")

sql("temperature_ranking", f"""WITH {READINGS}, {LATEST}
SELECT city, temperature, rank() OVER (ORDER BY temperature) AS rank FROM latest""")

sql("freshness_status", f"""WITH {READINGS},
now AS (SELECT max("timestamp") AS now_s FROM readings),
pc AS (SELECT city, count(*) AS readings, max("timestamp") AS latest_s FROM readings GROUP BY city)
SELECT city, readings, make_timestamp(latest_s * 1000000) AS latest, now_s - latest_s AS age_seconds,
       CASE WHEN now_s - latest_s > 120 THEN 'Stale (' || CAST(now_s - latest_s AS VARCHAR) || 's old)'
            ELSE 'Healthy' END AS status,
       {utc_text('make_timestamp(latest_s * 1000000)')} AS updated
FROM pc, now""")

sql("shift_to_now", f"""WITH {READINGS},
m AS (SELECT max({ET}) AS mx FROM readings),
s AS (SELECT event_id, make_timestamp(epoch_us({ET}) + epoch_us(TIMESTAMP '2026-01-01 00:00:00') - epoch_us(mx))
             AS event_time FROM readings, m)
SELECT event_id, CAST(floor(epoch_us(event_time) / 1000000) AS BIGINT) AS "timestamp", event_time FROM s""")

sql("map_points", f"""WITH {READINGS}, {city_dim_sql()}, {LATEST}, {ENRICHED},
mapped AS (SELECT * FROM enriched WHERE lat IS NOT NULL AND lon IS NOT NULL),
st AS (SELECT min(heat_index) AS color_min, max(heat_index) AS color_max FROM mapped)
SELECT city, lat, lon, heat_index,
  '<b>' || city || '</b><br>Temp: ' || printf('%.1f', temperature) || '°C<br>Feels like: '
    || printf('%.1f', coalesce(heat_index, temperature)) || '°C<br>Humidity: ' || printf('%.0f', humidity)
    || '%<br>' || coalesce(weather_condition, '') AS hover,
  color_min, color_max
FROM mapped, st""")

sql("format_times", f"""WITH {READINGS}
SELECT event_id, {utc_text(ET)} AS full, {utc_text(ET, '%H:%M:%S')} AS clock,
       {utc_text(ET, '%Y-%m-%d %H:%M')} AS minute FROM readings""")


# --------------------------------------------------------------------------
# Provider payloads
# --------------------------------------------------------------------------

sql("parse_current_payload", f"""WITH {READINGS}
SELECT event_id, "timestamp", city, temperature, humidity, wind_speed, weather_condition, {ET} AS event_time
FROM readings WHERE weather_condition IS DISTINCT FROM 'error'""")

sql("forecast_api_band", f"""WITH {READINGS},
ranked AS (SELECT *, CAST({ET} AS DATE) AS issued_d,
                  row_number() OVER (PARTITION BY city, CAST({ET} AS DATE) ORDER BY "timestamp", event_id) AS rn
           FROM readings),
items AS (SELECT *, (rn - 1) // 12 AS payload FROM ranked),
long AS (
  SELECT city, issued_d, payload, {ET} AS ds, 'temperature' AS metric, temperature AS yhat FROM items
  UNION ALL SELECT city, issued_d, payload, {ET}, 'humidity', humidity FROM items
  UNION ALL SELECT city, issued_d, payload, {ET}, 'wind_speed', wind_speed FROM items),
band AS (SELECT city, issued_d, payload, metric,
           CASE WHEN count(yhat) > 1 THEN greatest(stddev_samp(yhat) * 0.3, 0.5) ELSE 0.5 END AS m
         FROM long GROUP BY city, issued_d, payload, metric)
SELECT city, strftime(issued_d, '%Y-%m-%d') AS issued, payload, metric, ds, yhat,
       {r6('yhat - m')} AS yhat_lower, {r6('yhat + m')} AS yhat_upper
FROM long JOIN band USING (city, issued_d, payload, metric)""")


# --------------------------------------------------------------------------
# Alert history, cooldown, outbox, merge, KPIs
# --------------------------------------------------------------------------

HIST = f"{READINGS},\n{rolling_ctes()}"
HOURLY = f"{READINGS},\n{rolling_ctes(batch=3600)}"
HIST_OUT = f"""{ALERT_OUT}, batch_id, detected_at"""

sql("alert_history", f"WITH {HIST} SELECT {HIST_OUT} FROM hist_alerts")

KEYED = """keyed AS (SELECT *, city || ':' || metric || ':' || alert_type AS alert_key FROM hist_alerts)"""

sql("cooldown", f"""WITH {HOURLY}, {KEYED}, {cooldown_ctes('keyed')}
SELECT DISTINCT keyed.alert_key, keyed."timestamp", keyed.batch_id, keyed.severity
FROM keyed JOIN sent ON sent.k = keyed.alert_key AND sent.t = keyed."timestamp" AND sent.s = keyed.batch_id""")

sql("notifications", f"""WITH {HOURLY}, {KEYED}, {cooldown_ctes('keyed')}
SELECT keyed.alert_key, '[' || upper(coalesce(severity, 'medium')) || '] ' || message AS text,
       make_timestamp(keyed."timestamp" * 1000000) AS sent_at, keyed.batch_id
FROM keyed JOIN sent ON sent.k = keyed.alert_key AND sent.t = keyed."timestamp" AND sent.s = keyed.batch_id""")

sql("merge_alert_history", f"""WITH {HIST},
last AS (SELECT max(batch_id) AS lb FROM hist_alerts),
both_ AS (SELECT h.*, CASE WHEN batch_id = lb THEN 1 ELSE 0 END AS src FROM hist_alerts h, last)
SELECT {HIST_OUT} FROM (
  SELECT *, row_number() OVER (PARTITION BY city, metric, alert_type ORDER BY src DESC, detected_at DESC,
                               "timestamp" DESC) AS rn FROM both_) WHERE rn = 1""")

sql("alert_kpis", f"""WITH {HIST}
SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'high') AS high_severity,
       count(DISTINCT city) AS cities_affected FROM hist_alerts""")

sql("alert_histogram", f"""WITH {HIST}
SELECT city, severity, count(*) AS alerts FROM hist_alerts GROUP BY city, severity""")

sql("alerts_filtered", f"""WITH {HIST}
SELECT {HIST_OUT} FROM hist_alerts
WHERE severity IN ('high') AND detected_at >= (SELECT max(detected_at) FROM hist_alerts) - INTERVAL 24 HOUR""")

sql("distinct_severities", f"WITH {HIST} SELECT DISTINCT severity FROM hist_alerts WHERE severity IS NOT NULL")

sql("cooldown_hits_6h", f"""WITH {READINGS},
prep AS (SELECT * FROM readings WHERE {NOT_NULL}),
hits AS (SELECT *, city || ':' || metric || ':' || alert_type AS alert_key FROM ({absolute_candidates('prep')})),
{cooldown_ctes('hits', s='event_id', cooldown=6 * 3600)}
SELECT hits.alert_key, hits."timestamp", hits.event_id, hits.value
FROM hits JOIN sent ON sent.k = hits.alert_key AND sent.t = hits."timestamp" AND sent.s = hits.event_id""")


# --------------------------------------------------------------------------
# Forecasts
# --------------------------------------------------------------------------

FC_OUT = f"""city, metric, method, ds, {r6('yhat')} AS yhat, {r6('yhat - margin')} AS yhat_lower,
       {r6('yhat + margin')} AS yhat_upper"""

sql("forecast_linear", f"""WITH {READINGS}, {resample_ctes()}, {linear_ctes()}
SELECT {FC_OUT} FROM linear_fc""")

sql("forecast_heat_index", f"""WITH {READINGS}, {resample_ctes(metrics=[('heat_index', heat_index_sql())])},
{linear_ctes()}
SELECT {FC_OUT} FROM linear_fc""")

sql("forecast_next", f"""WITH {READINGS}, {resample_ctes()}, {linear_ctes()}
SELECT city, metric, min(ds) AS ds, {r6('arg_min(yhat, ds)')} AS next_yhat FROM linear_fc GROUP BY city, metric""")

sql("forecast_status", f"""WITH {READINGS}, {resample_ctes()}
SELECT city, metric, count(*) AS n,
       CASE WHEN count(*) < 12 THEN 'none' ELSE 'linear_trend' END AS method,
       CASE WHEN count(*) < 12 THEN 'Need at least 12 points for ' || city
                                    || '. Keep the pipeline running to collect more history.'
            ELSE 'Forecast generated successfully.' END AS message
FROM series GROUP BY city, metric""")

sql("backtest_linear", f"""WITH {READINGS}, {resample_ctes()}, {linear_ctes()},
bt AS (SELECT *, greatest(2, least(6, n // 4)) AS h FROM ix WHERE n >= 12),
tfit AS (SELECT city, metric, regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept
         FROM bt WHERE i < n - h GROUP BY city, metric),
sc AS (SELECT bt.city, bt.metric, any_value(n > h + 12) AS eligible, count(*) AS hh,
              avg(abs(y - (slope * i + intercept))) AS mae,
              sqrt(avg((y - (slope * i + intercept)) * (y - (slope * i + intercept)))) AS rmse
       FROM bt JOIN tfit USING (city, metric) WHERE i >= n - h GROUP BY bt.city, bt.metric)
SELECT city, metric, 'linear_trend' AS method, CAST(CASE WHEN eligible THEN hh ELSE 0 END AS INTEGER) AS n,
       CASE WHEN eligible THEN {r6('mae')} END AS mae, CASE WHEN eligible THEN {r6('rmse')} END AS rmse,
       'Forecast generated successfully.' AS message
FROM sc""")

sql("forecast_holt_fixed", f"""WITH RECURSIVE {READINGS}, {resample_ctes()}, {linear_ctes()},
hs AS MATERIALIZED (SELECT city, metric, i, y, n FROM ix WHERE n >= 12),
rec(city, metric, i, l, b) AS (
  SELECT h0.city, h0.metric, 0, h0.y, h1.y - h0.y
  FROM hs h0 JOIN hs h1 ON h1.city = h0.city AND h1.metric = h0.metric AND h1.i = 1 WHERE h0.i = 0
  UNION ALL
  SELECT c.city, c.metric, c.i + 1,
         0.5e0 * hs.y + (1.0e0 - 0.5e0) * (c.l + c.b),
         0.3e0 * ((0.5e0 * hs.y + (1.0e0 - 0.5e0) * (c.l + c.b)) - c.l) + (1.0e0 - 0.3e0) * c.b
  FROM rec c JOIN hs ON hs.city = c.city AND hs.metric = c.metric AND hs.i = c.i + 1),
fin AS (SELECT rec.city, rec.metric, l, b, fit.n, fit.sd, fit.last_bin FROM rec
        JOIN fit ON fit.city = rec.city AND fit.metric = rec.metric WHERE rec.i = fit.n - 1),
fc AS (SELECT city, metric, 'exponential_smoothing' AS method,
              make_timestamp((last_bin + k * 1800) * 1000000) AS ds, l + k * b AS yhat,
              greatest(0.5 * (CASE WHEN n > 1 THEN sd ELSE 1.0 END), 0.5) AS margin
       FROM fin, (SELECT unnest(range(1, 7)) AS k))
SELECT {FC_OUT} FROM fc""")


sql("forecast_holt", f"""WITH RECURSIVE {READINGS}, {resample_ctes()}, {linear_ctes()},
hs AS MATERIALIZED (SELECT city, metric, i, y, n FROM ix WHERE n >= 12),
{holt_search_ctes('hs', 'n')},
fc AS (SELECT city, metric, 'exponential_smoothing' AS method,
              make_timestamp((last_bin + k * 1800) * 1000000) AS ds, l + k * t AS yhat,
              greatest(0.5 * (CASE WHEN n > 1 THEN sd ELSE 1.0 END), 0.5) AS margin
       FROM hbest JOIN hid USING (s) JOIN fit USING (city, metric), (SELECT unnest(range(1, 7)) AS k))
SELECT {FC_OUT} FROM fc""")

sql("forecast_auto", f"""WITH RECURSIVE {READINGS}, {resample_ctes()}, {linear_ctes()},
hs AS MATERIALIZED (SELECT city, metric, i, y, n FROM ix WHERE n >= 12),
{holt_search_ctes('hs', 'n')},
fc AS (SELECT fit.city, fit.metric,
              CASE WHEN isfinite(l) AND isfinite(t) THEN 'exponential_smoothing' ELSE 'linear_trend' END AS method,
              make_timestamp((last_bin + k * 1800) * 1000000) AS ds,
              CASE WHEN isfinite(l) AND isfinite(t) THEN l + k * t ELSE slope * (n - 1 + k) + intercept END AS yhat,
              greatest(0.5 * (CASE WHEN n > 1 THEN sd ELSE 1.0 END), 0.5) AS margin
       FROM fit JOIN hid USING (city, metric) LEFT JOIN hbest USING (s), (SELECT unnest(range(1, 7)) AS k))
SELECT {FC_OUT} FROM fc""")

sql("backtest_holt", f"""WITH RECURSIVE {READINGS}, {resample_ctes()}, {linear_ctes()},
hb AS MATERIALIZED (SELECT city, metric, i, y, n, greatest(2, least(6, n // 4)) AS h FROM ix
                    WHERE n >= 12 AND n > greatest(2, least(6, n // 4)) + 12),
{holt_search_ctes('hb', 'n - h')},
err AS (SELECT hb.city, hb.metric, hb.y - (f.l + (hb.i - (hb.n - hb.h - 1)) * f.t) AS e
        FROM hb JOIN hid USING (city, metric) JOIN hbest f USING (s) WHERE hb.i >= hb.n - hb.h),
sc AS (SELECT city, metric, count(*) AS c, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM err GROUP BY city, metric)
SELECT fit.city, fit.metric, 'exponential_smoothing' AS method, CAST(coalesce(c, 0) AS INTEGER) AS n,
       {r6('mae')} AS mae, {r6('rmse')} AS rmse, 'Forecast generated successfully.' AS message
FROM fit LEFT JOIN sc USING (city, metric)""")


# --------------------------------------------------------------------------
# Lake I/O
# --------------------------------------------------------------------------

sql("lake_roundtrip", f"""WITH {READINGS}
SELECT *, {ET} AS event_time, strftime(CAST({ET} AS DATE), '%Y-%m-%d') AS event_date FROM readings""")

sql("load_events", ORACLE["dedupe_last"])

sql("lake_scan_recent", f"""WITH {READINGS},
m AS (SELECT max(CAST({ET} AS DATE)) AS md FROM readings)
SELECT readings.* FROM readings, m WHERE CAST({ET} AS DATE) >= md - INTERVAL 6 DAY""")

sql("load_aggregates", f"""WITH {READINGS},
agg AS (
  SELECT city, {WIN5} AS window_start, {WIN5} + INTERVAL 5 MINUTE AS window_end,
         {r6('avg(temperature)')} AS avg_temperature, {r6('avg(humidity)')} AS avg_humidity,
         {r6('avg(wind_speed)')} AS avg_wind_speed, count(*) AS record_count
  FROM readings GROUP BY city, {WIN5})
SELECT * FROM agg ORDER BY window_start DESC, city DESC LIMIT 200""")

sql("alerts_roundtrip", f"WITH {HIST} SELECT {ALERT_OUT}, detected_at FROM hist_alerts")

sql("load_alerts", f"""WITH {HIST}
SELECT {ALERT_OUT}, detected_at FROM hist_alerts ORDER BY "timestamp" DESC, city, metric, alert_type LIMIT 100""")


# --------------------------------------------------------------------------
# Live refresh
# --------------------------------------------------------------------------

LIVE = f"""{READINGS},
now AS (SELECT max("timestamp") + 60 AS now_s FROM readings),
cur AS (SELECT event_id, now_s AS "timestamp", city, temperature, humidity, wind_speed, weather_condition, 1 AS src
        FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY "timestamp" DESC, event_id DESC) AS rn
              FROM readings WHERE city IS NOT NULL), now WHERE rn = 1),
buf AS (SELECT * FROM readings ORDER BY "timestamp" DESC, event_id DESC LIMIT 2000),
u AS (SELECT *, 0 AS src FROM buf UNION ALL SELECT * FROM cur),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, "timestamp" ORDER BY src DESC, event_id DESC) AS rn
                     FROM u) WHERE rn = 1),
upd AS (SELECT * EXCLUDE (rn) FROM d ORDER BY "timestamp" DESC, src DESC, event_id DESC LIMIT 2000),
upd_new AS (SELECT * FROM upd WHERE src = 1),
upd_old AS (SELECT * FROM upd WHERE src = 0)"""

sql("live_history", f"""WITH {LIVE}
SELECT event_id, "timestamp", city, temperature, humidity, wind_speed, weather_condition, {ET} AS event_time
FROM upd""")

sql("live_aggregates", f"""WITH {LIVE},
agg AS (
  SELECT city, {WIN5} AS window_start, {WIN5} + INTERVAL 5 MINUTE AS window_end,
         {rnd('avg(temperature)', 2)} AS avg_temperature, {rnd('avg(humidity)', 2)} AS avg_humidity,
         {rnd('avg(wind_speed)', 2)} AS avg_wind_speed, count(temperature) AS record_count
  FROM upd GROUP BY city, {WIN5})
SELECT * FROM agg ORDER BY window_start DESC, city DESC LIMIT 200""")

sql("live_refresh", f"""WITH {LIVE},
{detect_ctes('upd_new', 'upd_old')}
SELECT {ALERT_OUT}, make_timestamp((SELECT now_s FROM now) * 1000000) AS detected_at FROM d_alerts""")


# --------------------------------------------------------------------------
# Structured Streaming (single ordered replay: first delivery wins on dedupe)
# --------------------------------------------------------------------------

FIRST = f"""first_ AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY city, "timestamp" ORDER BY event_id) AS rn
  FROM readings WHERE city IS NOT NULL AND "timestamp" IS NOT NULL) WHERE rn = 1)"""

sql("stream_window_agg", f"""WITH {READINGS}, {FIRST},
wm AS (SELECT max({ET}) - INTERVAL 10 MINUTE AS wm FROM first_),
agg AS (
  SELECT city, {WIN5} AS window_start, {WIN5} + INTERVAL 5 MINUTE AS window_end,
         {r6('avg(temperature)')} AS avg_temperature, {r6('avg(humidity)')} AS avg_humidity,
         {r6('avg(wind_speed)')} AS avg_wind_speed, count(*) AS record_count
  FROM first_ GROUP BY city, {WIN5})
SELECT agg.* FROM agg, wm WHERE window_end <= wm.wm""")

sql("stream_dedupe", f"""WITH {READINGS}, {FIRST}
SELECT *, {ET} AS event_time, strftime(CAST({ET} AS DATE), '%Y-%m-%d') AS event_date FROM first_""")

sql("stream_ingest", ORACLE["stream_dedupe"])

sql("stream_alerts", f"""WITH {READINGS},
{SPLIT},
sb AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY city, "timestamp" ORDER BY event_id) AS rn FROM batch) WHERE rn = 1),
{keep_last('last', 'SELECT * FROM hist')},
{detect_ctes('sb', 'last')}
SELECT {ALERT_OUT}, make_timestamp((SELECT max("timestamp") FROM sb) * 1000000) AS detected_at FROM d_alerts""")

sql("stream_redelivery", f"""WITH {READINGS},
{SPLIT},
sb AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY city, "timestamp" ORDER BY event_id) AS rn FROM batch) WHERE rn = 1),
{keep_last('last', """SELECT * FROM hist UNION ALL
  SELECT * REPLACE (event_id + 1000000000 AS event_id, temperature + 0.5e0 AS temperature)
  FROM hist WHERE weather_condition = 'purchase'""")},
{detect_ctes('sb', 'last')}
SELECT {ALERT_OUT}, make_timestamp((SELECT max("timestamp") FROM sb) * 1000000) AS detected_at FROM d_alerts""")

sql("stream_cooldown", f"""WITH {READINGS},
prep AS (SELECT * FROM readings WHERE {NOT_NULL}),
hits AS (SELECT *, city || ':' || metric || ':' || alert_type AS alert_key FROM ({absolute_candidates('prep')})),
{cooldown_ctes('hits', s='event_id', cooldown=6 * 3600)}
SELECT hits.alert_key, hits."timestamp", hits.event_id AS seq, hits.severity, hits.message
FROM hits JOIN sent ON sent.k = hits.alert_key AND sent.t = hits."timestamp" AND sent.s = hits.event_id""")


# --------------------------------------------------------------------------
# More serving views
# --------------------------------------------------------------------------

sql("recent_windows", f"""WITH {READINGS},
agg AS (
  SELECT city, {WIN5} AS window_start, {WIN5} + INTERVAL 5 MINUTE AS window_end,
         {r6('avg(temperature)')} AS avg_temperature, {r6('avg(humidity)')} AS avg_humidity,
         {r6('avg(wind_speed)')} AS avg_wind_speed, count(*) AS record_count
  FROM readings GROUP BY city, {WIN5})
SELECT * FROM agg ORDER BY window_start DESC, city DESC LIMIT 12""")

sql("window_agg_live_city", f"""WITH {READINGS},
agg AS (
  SELECT city, {WIN5} AS window_start, {WIN5} + INTERVAL 5 MINUTE AS window_end,
         {rnd('avg(temperature)', 2)} AS avg_temperature, {rnd('avg(humidity)', 2)} AS avg_humidity,
         {rnd('avg(wind_speed)', 2)} AS avg_wind_speed, count(temperature) AS record_count
  FROM readings GROUP BY city, {WIN5})
SELECT * FROM agg ORDER BY city DESC, window_start DESC LIMIT 200""")

sql("alert_messages", f"""WITH {READINGS},
{SPLIT},
{detect_ctes('batch', 'hist')}
SELECT "timestamp", event_id, city, alert_type, message FROM d_cand""")

sql("backtest_holt_fixed", f"""WITH RECURSIVE {READINGS}, {resample_ctes()}, {linear_ctes()},
hb AS MATERIALIZED (SELECT city, metric, i, y, n, greatest(2, least(6, n // 4)) AS h FROM ix
                    WHERE n >= 12 AND n > greatest(2, least(6, n // 4)) + 12),
rec(city, metric, i, l, b) AS (
  SELECT h0.city, h0.metric, 0, h0.y, h1.y - h0.y
  FROM hb h0 JOIN hb h1 ON h1.city = h0.city AND h1.metric = h0.metric AND h1.i = 1 WHERE h0.i = 0
  UNION ALL
  SELECT c.city, c.metric, c.i + 1,
         0.5e0 * hb.y + (1.0e0 - 0.5e0) * (c.l + c.b),
         0.3e0 * ((0.5e0 * hb.y + (1.0e0 - 0.5e0) * (c.l + c.b)) - c.l) + (1.0e0 - 0.3e0) * c.b
  FROM rec c JOIN hb ON hb.city = c.city AND hb.metric = c.metric AND hb.i = c.i + 1 AND hb.i < hb.n - hb.h),
fin AS (SELECT rec.city, rec.metric, rec.l, rec.b, hb.n, hb.h FROM rec
        JOIN hb ON hb.city = rec.city AND hb.metric = rec.metric AND hb.i = rec.i
        WHERE rec.i = hb.n - hb.h - 1),
err AS (SELECT t.city, t.metric, t.y - (f.l + (t.i - (t.n - t.h - 1)) * f.b) AS e
        FROM hb t JOIN fin f ON f.city = t.city AND f.metric = t.metric WHERE t.i >= t.n - t.h)
SELECT city, metric, 'exponential_smoothing' AS method, CAST(count(*) AS INTEGER) AS n,
       {r6('avg(abs(e))')} AS mae, {r6('sqrt(avg(e * e))')} AS rmse,
       'Forecast generated successfully.' AS message
FROM err GROUP BY city, metric""")


def _batch_metrics_sql() -> str:
    parts = [f"""{READINGS},
c AS (SELECT max("timestamp") - 86400 AS cut FROM readings),
{keep_last('hist0', 'SELECT r.* FROM readings r, c WHERE r."timestamp" < c.cut')},
sd AS (SELECT * EXCLUDE (rn) FROM (
  SELECT r.*, CAST(least(floor((r."timestamp" - c.cut) / 21600), 3) AS INTEGER) AS b,
         row_number() OVER (PARTITION BY r.city, r."timestamp" ORDER BY r.event_id) AS rn
  FROM readings r, c WHERE r."timestamp" >= c.cut AND r.city IS NOT NULL) WHERE rn = 1)"""]
    for i in range(4):
        parts.append(f"b{i} AS (SELECT * EXCLUDE (b) FROM sd WHERE b = {i})")
        prev = " UNION ALL ".join(["SELECT * FROM hist0"] + [f"SELECT * FROM b{j}" for j in range(i)])
        parts.append(f"h{i} AS ({prev})")
        parts.append(detect_ctes(f"b{i}", f"h{i}", prefix=f"d{i}"))
        earlier = " UNION ALL ".join([f"SELECT k, t FROM s{j}" for j in range(i)]) or \
            "SELECT CAST(NULL AS VARCHAR) AS k, CAST(NULL AS BIGINT) AS t WHERE false"
        parts.append(f"""s{i} AS (
  SELECT city || ':' || metric || ':' || alert_type AS k, "timestamp" AS t FROM d{i}_alerts a
  WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) e
                    WHERE e.k = a.city || ':' || a.metric || ':' || a.alert_type AND a."timestamp" - e.t < 3600))""")
    rows = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS batch_id, (SELECT count(*) FROM b{i}) AS stored, "
        f"(SELECT count(*) FROM d{i}_alerts) AS alerts, (SELECT count(*) FROM s{i}) AS sent" for i in range(4))
    return "WITH " + ",\n".join(parts) + "\n" + rows


sql("batch_metrics", _batch_metrics_sql())
