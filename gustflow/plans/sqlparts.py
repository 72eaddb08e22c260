"""DuckDB SQL building blocks for the independent oracle queries.

The oracle is written from the stated semantics, not from the Spark plans;
it shares only the fixed values (cities, rules, bases) with the library.
"""

from __future__ import annotations

from ..config import ABSOLUTE_RULES, CITIES, METRICS
from ..sources.fixtures import TEMPERATURE_BASE


def _dbl(v: float) -> str:
    """A DOUBLE literal (DuckDB reads plain decimals as DECIMAL)."""
    r = repr(float(v))
    return r if "e" in r else r + "e0"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CITY_LIST = "[" + ", ".join(_q(c) for c in CITIES) + "]"
BASE_CASE = "CASE event_type " + " ".join(
    f"WHEN {_q(k)} THEN {_dbl(v)}" for k, v in TEMPERATURE_BASE.items()) + " END"

READINGS = f"""readings AS (
  SELECT event_id,
         CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp",
         ({CITY_LIST})[user_id % 10 + 1] AS city,
         {BASE_CASE} + (value - 50.0e0) / 10.0e0 AS temperature,
         CAST(nullif(CAST(props->>'$.k' AS INTEGER), 0) AS DOUBLE) AS humidity,
         value / 20.0e0 AS wind_speed,
         event_type AS weather_condition
  FROM events)"""

READINGS_DUP = """readings_dup AS (
  SELECT * FROM readings
  UNION ALL
  SELECT event_id + 1000000000 AS event_id, "timestamp", city, temperature + 0.5e0 AS temperature,
         humidity, wind_speed, weather_condition
  FROM readings WHERE weather_condition = 'purchase')"""

NOT_NULL = "city IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL AND wind_speed IS NOT NULL"

SPLIT = f"""split AS (SELECT max("timestamp") - 86400 AS cut FROM readings),
hist AS (SELECT r.* FROM readings r, split WHERE r."timestamp" < split.cut),
batch AS (SELECT r.* FROM readings r, split WHERE r."timestamp" >= split.cut)"""


def r6(x: str) -> str:
    """Round an aggregate-derived double to 6 places (see :func:`rnd`)."""
    return rnd(x, 6)


def rnd(x: str, places: int) -> str:
    """Decimal rounding, ties away from zero: sign * floor(|x| * 10^p + 0.5 + tolerance) / 10^p."""
    scale, tie = _dbl(float(10 ** int(places))), _dbl(0.5 + (1e-4 if int(places) >= 6 else 1e-6))
    v = f"CAST({x} AS DOUBLE)"
    return f"(sign({v}) * floor(abs({v}) * {scale} + {tie}) / {scale} + {_dbl(0.0)})"


def fmt1(x: str) -> str:
    return f"printf('%.1f', {x})"


def fmt2(x: str) -> str:
    return f"printf('%.2f', {x})"


def baseline_ctes(src: str, name: str = "base", days: int = 7, min_n: int = 5, key: str = "city",
                  ts: str = '"timestamp"') -> str:
    """Long baseline over the prepared rows of ``src`` within the window."""
    parts = []
    for m in METRICS:
        parts.append(f"""SELECT {key}, {_q(m)} AS metric, avg({m}) AS mean, stddev_pop({m}) AS std,
         count({m}) AS sample_count
  FROM {name}_win GROUP BY {key} HAVING count({m}) >= {min_n}""")
    union = "\n  UNION ALL\n  ".join(parts)
    return f"""{name}_prep AS (SELECT * FROM {src} WHERE {NOT_NULL}),
{name}_win AS (SELECT * FROM {name}_prep WHERE {ts} >= (SELECT max({ts}) FROM {name}_prep) - {days} * 86400),
{name} AS (
  {union})"""


def absolute_candidates(src: str) -> str:
    parts = []
    for rank, (metric, alert_type, op, bound, severity) in enumerate(ABSOLUTE_RULES):
        words = alert_type.replace("_", " ")
        parts.append(f"""SELECT "timestamp", event_id, {rank} AS rule, city, {_q(metric)} AS metric,
         {_q(alert_type)} AS alert_type, {_q(severity)} AS severity, {metric} AS value,
         CAST(NULL AS DOUBLE) AS baseline_mean, CAST(NULL AS DOUBLE) AS baseline_std,
         CAST(NULL AS DOUBLE) AS z_score,
         city || ': {words} ({metric}=' || {fmt1(metric)} || ')' AS message
  FROM {src} WHERE {metric} {op} {_dbl(bound)}""")
    return "\n  UNION ALL\n  ".join(parts)


def z_candidates(src: str, base: str = "base", z: float = 2.5, z_high: float = 3.0) -> str:
    parts = []
    for i, m in enumerate(METRICS):
        zexpr = f"(({m} - b.mean) / b.std)"
        direction = f"(CASE WHEN {zexpr} > 0 THEN 'spike' ELSE 'drop' END)"
        parts.append(f"""SELECT r."timestamp", r.event_id, {len(ABSOLUTE_RULES) + i} AS rule, r.city, {_q(m)} AS metric,
         {_q(m)} || '_' || {direction} AS alert_type,
         CASE WHEN abs({zexpr}) >= {z_high!r} THEN 'high' ELSE 'medium' END AS severity,
         {m} AS value, b.mean AS baseline_mean, b.std AS baseline_std, {rnd(zexpr, 2)} AS z_score,
         r.city || ': {m} ' || {direction} || ' detected (' || {fmt1(m)} || ' vs baseline ' || {fmt1('b.mean')}
           || ' ± ' || {fmt1('b.std')} || ', z=' || {fmt2(zexpr)} || ')' AS message
  FROM {src} r JOIN {base} b ON b.city = r.city AND b.metric = {_q(m)}
  WHERE b.std > 0 AND abs({zexpr}) >= {z!r}""")
    return "\n  UNION ALL\n  ".join(parts)


def detect_ctes(batch: str, history: str, prefix: str = "d") -> str:
    """CTEs ending in ``{prefix}_alerts`` = detect_anomalies(batch, history)."""
    return f"""{baseline_ctes(history, name=prefix + '_base')},
{prefix}_new AS (SELECT * FROM {batch} WHERE {NOT_NULL}),
{prefix}_cand AS (
  {absolute_candidates(prefix + '_new')}
  UNION ALL
  {z_candidates(prefix + '_new', prefix + '_base')}),
{prefix}_alerts AS (
  SELECT "timestamp", city, metric, alert_type, severity, value, baseline_mean, baseline_std, z_score, message
  FROM (SELECT *, row_number() OVER (PARTITION BY city, metric, alert_type
                                     ORDER BY "timestamp", event_id, rule) AS rn
        FROM {prefix}_cand) WHERE rn = 1)"""


def keep_last(name: str, rows: str) -> str:
    """CTE: the last delivery of every (city, timestamp) of ``rows``."""
    return f"""{name} AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY city, "timestamp" ORDER BY event_id DESC) AS rn FROM ({rows})) WHERE rn = 1)"""


ALERT_OUT = f""""timestamp", city, metric, alert_type, severity, value, {r6('baseline_mean')} AS baseline_mean,
       {r6('baseline_std')} AS baseline_std, z_score, message"""


def heat_index_sql(t: str = "temperature", h: str = "humidity") -> str:
    """Heat index (deg C) in SQL, same term order as the library expression."""
    from ..config import HEAT_INDEX_COEFFICIENTS as c
    tf = f"({t} * 9.0e0 / 5.0e0 + 32.0e0)"
    rh = f"greatest(0.0e0, least(100.0e0, {h}))"
    d = [_dbl(x) for x in c]
    terms = [d[0], f"{d[1]} * {tf}", f"{d[2]} * {rh}", f"{d[3]} * {tf} * {rh}",
             f"{d[4]} * {tf} * {tf}", f"{d[5]} * {rh} * {rh}", f"{d[6]} * {tf} * {tf} * {rh}",
             f"{d[7]} * {tf} * {rh} * {rh}", f"{d[8]} * {tf} * {tf} * {rh} * {rh}"]
    hi = "(" + " + ".join(terms) + ")"
    dry = (f"(CASE WHEN {rh} < 13.0e0 AND {tf} >= 80.0e0 AND {tf} <= 112.0e0 THEN ((13.0e0 - {rh}) / 4.0e0) * "
           f"sqrt((17.0e0 - abs({tf} - 95.0e0)) / 17.0e0) ELSE 0.0e0 END)")
    humid = (f"(CASE WHEN {rh} > 85.0e0 AND {tf} >= 80.0e0 AND {tf} <= 87.0e0 THEN (({rh} - 85.0e0) / 10.0e0) * "
             f"((87.0e0 - {tf}) / 5.0e0) ELSE 0.0e0 END)")
    hic = f"(({hi} - {dry} + {humid} - 32.0e0) * 5.0e0 / 9.0e0)"
    return (f"(CASE WHEN {t} IS NULL THEN NULL WHEN {tf} < 80.0e0 THEN {rnd(t, 1)} "
            f"WHEN {h} IS NULL THEN NULL ELSE {rnd(f'greatest({hic}, {t})', 1)} END)")


def comfort_sql(hi: str = "heat_index") -> str:
    from ..config import COMFORT_BANDS, COMFORT_TOP
    whens = " ".join(f"WHEN {hi} < {_dbl(b)} THEN {_q(label)}" for b, label in COMFORT_BANDS)
    return f"(CASE WHEN {hi} IS NULL THEN NULL {whens} ELSE {_q(COMFORT_TOP)} END)"


def delta_sql(d: str) -> str:
    return (f"(CASE WHEN {d} IS NULL THEN '—' WHEN {d} > 0 THEN '+' || printf('%.1f', {d}) "
            f"WHEN {d} < 0 THEN printf('%.1f', {d}) ELSE '0.0' END)")


def city_dim_sql() -> str:
    from ..config import CITY_COORDINATES
    rows = ", ".join(f"({_q(c)}, {_dbl(lat)}, {_dbl(lon)})" for c, (lat, lon) in CITY_COORDINATES.items())
    return f"city_dim AS (SELECT * FROM (VALUES {rows}) AS t(city, lat, lon))"


def utc_text(ts: str, pattern: str = "%Y-%m-%d %H:%M:%S") -> str:
    return f"coalesce(strftime({ts}, '{pattern}') || ' UTC', '—')"


def rolling_ctes(src: str = "readings", batch: int = 86400, days: int = 7, min_n: int = 5) -> str:
    """CTEs ending in ``hist_alerts``: every batch (a day) scored against all earlier readings."""
    base_parts = []
    for m in METRICS:
        base_parts.append(f"""SELECT d, city, {_q(m)} AS metric, avg({m}) AS mean, stddev_pop({m}) AS std
  FROM contrib GROUP BY d, city HAVING count({m}) >= {min_n}""")
    union = "\n  UNION ALL\n  ".join(base_parts)
    z_parts = []
    for i, m in enumerate(METRICS):
        zexpr = f"(({m} - b.mean) / b.std)"
        direction = f"(CASE WHEN {zexpr} > 0 THEN 'spike' ELSE 'drop' END)"
        z_parts.append(f"""SELECT r.d, r."timestamp", r.event_id, {len(ABSOLUTE_RULES) + i} AS rule, r.city, {_q(m)} AS metric,
         {_q(m)} || '_' || {direction} AS alert_type,
         CASE WHEN abs({zexpr}) >= 3.0 THEN 'high' ELSE 'medium' END AS severity,
         {m} AS value, b.mean AS baseline_mean, b.std AS baseline_std, {rnd(zexpr, 2)} AS z_score,
         r.city || ': {m} ' || {direction} || ' detected (' || {fmt1(m)} || ' vs baseline ' || {fmt1('b.mean')}
           || ' ± ' || {fmt1('b.std')} || ', z=' || {fmt2(zexpr)} || ')' AS message
  FROM rprep r JOIN rbase b ON b.d = r.d AND b.city = r.city AND b.metric = {_q(m)}
  WHERE b.std > 0 AND abs({zexpr}) >= 2.5""")
    zunion = "\n  UNION ALL\n  ".join(z_parts)
    abs_parts = []
    for rank, (metric, alert_type, op, bound, severity) in enumerate(ABSOLUTE_RULES):
        words = alert_type.replace("_", " ")
        abs_parts.append(f"""SELECT d, "timestamp", event_id, {rank} AS rule, city, {_q(metric)} AS metric,
         {_q(alert_type)} AS alert_type, {_q(severity)} AS severity, {metric} AS value,
         CAST(NULL AS DOUBLE) AS baseline_mean, CAST(NULL AS DOUBLE) AS baseline_std, CAST(NULL AS DOUBLE) AS z_score,
         city || ': {words} ({metric}=' || {fmt1(metric)} || ')' AS message
  FROM rprep WHERE {metric} {op} {_dbl(bound)}""")
    aunion = "\n  UNION ALL\n  ".join(abs_parts)
    return f"""rprep AS (SELECT *, CAST(floor("timestamp" / {batch}) AS BIGINT) AS d FROM {src} WHERE {NOT_NULL}),
rdays AS (SELECT d, max("timestamp") AS bmax FROM rprep GROUP BY d),
rhist AS (SELECT d, bmax, max(bmax) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_max
          FROM rdays),
contrib AS (SELECT h.d, p.* EXCLUDE (d) FROM rprep p JOIN rhist h
            ON p."timestamp" < h.d * {batch} AND p."timestamp" >= h.hist_max - {days} * 86400),
rbase AS (
  {union}),
rcand AS (
  {aunion}
  UNION ALL
  {zunion}),
hist_alerts AS (
  SELECT c."timestamp", c.city, c.metric, c.alert_type, c.severity, c.value, c.baseline_mean, c.baseline_std,
         c.z_score, c.message, c.d AS batch_id, make_timestamp(h.bmax * 1000000) AS detected_at
  FROM (SELECT *, row_number() OVER (PARTITION BY d, city, metric, alert_type ORDER BY "timestamp", event_id, rule) AS rn
        FROM rcand) c JOIN rhist h USING (d)
  WHERE rn = 1)"""


def cooldown_ctes(src: str, key: str = "alert_key", t: str = '"timestamp"', s: str = "batch_id",
                  cooldown: int = 3600) -> str:
    """Recursive CTE ending in ``sent`` (key, t, s): greedy cooldown per key."""
    return f"""cd_a AS (SELECT DISTINCT {key} AS k, {t} AS t, {s} AS s FROM {src}),
cd_t AS (SELECT k, t, min(s) AS s FROM cd_a GROUP BY k, t),
cd_next AS MATERIALIZED (SELECT a.k, a.t, a.s, b.t AS nt, b.s AS ns
            FROM cd_a a ASOF LEFT JOIN cd_t b ON a.k = b.k AND b.t >= a.t + {cooldown}),
cd_head AS (SELECT k, t, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, s) AS rn FROM cd_a)
            WHERE rn = 1),
sent AS (
  WITH RECURSIVE chain(k, t, s) AS (
    SELECT k, t, s FROM cd_head
    UNION ALL
    SELECT n.k, n.nt, n.ns FROM chain c JOIN cd_next n ON n.k = c.k AND n.t = c.t AND n.s = c.s
    WHERE n.nt IS NOT NULL)
  SELECT * FROM chain)"""


def resample_ctes(src: str = "readings", metrics=None, step: int = 1800) -> str:
    """CTEs ending in ``series(city, metric, bin, ds, y)``: regular series with
    gap fill and time-linear interpolation (leading gaps dropped, trailing
    gaps hold the last value).  ``metrics``: list of (name, sql expression)."""
    metrics = metrics or [(m, m) for m in METRICS]
    sel = ", ".join(f"{expr} AS {name}" for name, expr in metrics)
    avgs = ", ".join(f"avg({name}) AS {name}" for name, _ in metrics)
    longs = "\n  UNION ALL ".join(f"SELECT city, bin, {_q(name)} AS metric, {name} AS v FROM rs_g"
                                  for name, _ in metrics)
    return f"""rs_b AS (SELECT city, CAST(floor("timestamp" / {step}) * {step} AS BIGINT) AS bin, {sel} FROM {src}),
rs_wide AS (SELECT city, bin, {avgs} FROM rs_b GROUP BY city, bin),
rs_span AS (SELECT city, min(bin) AS lo, max(bin) AS hi FROM rs_wide GROUP BY city),
rs_grid AS (SELECT city, unnest(range(lo, hi + 1, {step})) AS bin FROM rs_span),
rs_g AS (SELECT * FROM rs_grid LEFT JOIN rs_wide USING (city, bin)),
rs_long AS (
  {longs}),
rs_nb AS (
  SELECT *,
    last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER w1 AS pt,
    last_value(v IGNORE NULLS) OVER w1 AS pv,
    last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER w2 AS nt,
    last_value(v IGNORE NULLS) OVER w2 AS nv
  FROM rs_long
  WINDOW w1 AS (PARTITION BY city, metric ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS (PARTITION BY city, metric ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
series AS (
  SELECT * FROM (
    SELECT city, metric, bin, make_timestamp(bin * 1000000) AS ds,
      CASE WHEN v IS NOT NULL THEN v
           WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (bin - pt) / (nt - pt)
           WHEN pt IS NOT NULL THEN pv END AS y
    FROM rs_nb) WHERE y IS NOT NULL)"""


def linear_ctes(step: int = 1800, periods: int = 6, min_points: int = 12) -> str:
    """From ``series``: ``ix`` (i, n), ``fit`` and ``linear_fc`` (forecast rows)."""
    return f"""ix AS (SELECT *, (bin - min(bin) OVER (PARTITION BY city, metric)) // {step} AS i,
                count(*) OVER (PARTITION BY city, metric) AS n FROM series),
fit AS (SELECT city, metric, count(*) AS n, regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept,
               stddev_pop(y) AS sd, max(bin) AS last_bin
        FROM ix GROUP BY city, metric HAVING count(*) >= {min_points}),
linear_fc AS (
  SELECT city, metric, 'linear_trend' AS method, make_timestamp((last_bin + k * {step}) * 1000000) AS ds,
         slope * (n - 1 + k) + intercept AS yhat,
         greatest(0.5 * (CASE WHEN n > 1 THEN sd ELSE 1.0 END), 0.5) AS margin
  FROM fit, (SELECT unnest(range(1, {periods + 1})) AS k))"""


def holt_search_ctes(src: str, length: str) -> str:
    """Recursive CTEs ending in ``hbest(s, a, b, l, t)`` and ``hid(city, metric,
    s)``: Holt over the first ``length`` points of every series of ``src``
    (city, metric, i, y, ...) for every (a, b) of the coarse grid, then of the
    grid around the best of each series; ties take the least a, then b."""
    def run(name: str, grid: str) -> str:
        return f"""{name}_rec(s, a, b, i, l, t, ss) AS (
  SELECT h0.s, g.a, g.b, 0, h0.y, h1.y - h0.y, CAST(0 AS DOUBLE)
  FROM hy h0 JOIN hy h1 ON h1.s = h0.s AND h1.i = 1 JOIN {grid} g ON g.s = h0.s WHERE h0.i = 0
  UNION ALL
  SELECT r.s, r.a, r.b, r.i + 1, r.l + r.t + r.a * (hy.y - (r.l + r.t)),
         r.t + r.a * r.b * (hy.y - (r.l + r.t)), r.ss + (hy.y - (r.l + r.t)) * (hy.y - (r.l + r.t))
  FROM {name}_rec r JOIN hy ON hy.s = r.s AND hy.i = r.i + 1),
{name} AS MATERIALIZED (SELECT s, a, b, l, t FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.s ORDER BY r.ss, r.a, r.b) AS rn
  FROM {name}_rec r JOIN hid ON hid.s = r.s AND r.i = hid.m - 1 WHERE isfinite(r.ss)) WHERE rn = 1)"""
    return f"""hid AS MATERIALIZED (SELECT city, metric, CAST(row_number() OVER (ORDER BY city, metric) AS INTEGER) AS s,
                     CAST(any_value({length}) AS INTEGER) AS m FROM {src} GROUP BY city, metric),
hy AS MATERIALIZED (SELECT hid.s, CAST(i AS INTEGER) AS i, CAST(y AS DOUBLE) AS y
       FROM {src} JOIN hid USING (city, metric) WHERE i < m),
hg1 AS MATERIALIZED (SELECT hid.s, ka / 20.0e0 AS a, kb / 20.0e0 AS b
        FROM hid, (SELECT unnest(range(1, 20)) AS ka), (SELECT unnest(range(1, 20)) AS kb)),
{run('hnear', 'hg1')},
hg2 AS MATERIALIZED (SELECT hnear.s, greatest(least(hnear.a + ka / 200.0e0, 0.999e0), 0.001e0) AS a,
               greatest(least(hnear.b + kb / 200.0e0, 0.999e0), 0.001e0) AS b
        FROM hnear, (SELECT unnest(range(-9, 10)) AS ka), (SELECT unnest(range(-9, 10)) AS kb)),
{run('hbest', 'hg2')}"""
