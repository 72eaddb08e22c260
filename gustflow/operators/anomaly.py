"""Rolling-baseline anomaly detection as DataFrame operators.

``detect_anomalies(new, history)``:

1. both inputs are prepared (event time, numeric coercion, row-wise null drop);
2. the baseline is one aggregation over the history window
   ``event_time >= max(event_time) - baseline_days`` (the max is a one-row
   aggregate joined back, or a literal ``cutoff`` that also prunes
   ``event_date`` partitions);
3. every new reading yields absolute-rule and z-score candidates in one
   projection (array of structs + explode) after a left join to the
   per-key baseline — the join is left to AQE, which broadcasts the
   baseline only when its measured size is below the threshold;
4. the first candidate per (key, metric, alert_type) in reading order wins,
   computed as ``min_by`` so duplicates are folded map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ABSOLUTE_RULES, DEFAULT, METRICS, Params
from ..functions.scalars import fmt, round_half_up
from .clean import prepare_events, tail_rows

ALERT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("city", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("baseline_mean", T.DoubleType()),
    T.StructField("baseline_std", T.DoubleType()),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("message", T.StringType()),
])
ALERT_COLUMNS = [f.name for f in ALERT_SCHEMA.fields]

BASELINE_COLUMNS = ["city", "metric", "mean", "std", "sample_count"]


def _window_history(history: DataFrame, params: Params, time_col: str, cutoff) -> DataFrame:
    if cutoff is not None:
        return history.where(F.col(time_col) >= F.lit(cutoff).cast("timestamp"))
    latest = history.agg(F.max(time_col).alias("_latest"))
    span = F.expr(f"INTERVAL {int(params.baseline_days)} DAYS")
    return (history.crossJoin(F.broadcast(latest))
            .where(F.col(time_col) >= F.col("_latest") - span)
            .drop("_latest"))


def history_cutoff(history: DataFrame, key_cols: Sequence[str] = ("city",), metrics: Sequence[str] = METRICS,
                   params: Params = DEFAULT, time_col: str = "event_time", prepared: bool = False):
    """Start of the baseline window: newest prepared reading of ``history``
    less ``baseline_days`` (one scalar; None for an empty history).  A source
    that can filter on it reads only the window for the statistics."""
    h = history if prepared else prepare_events(history, key_cols, metrics)
    span = F.expr(f"INTERVAL {int(params.baseline_days)} DAYS")
    # as text, so no Python-side time zone is involved
    return h.agg((F.max(time_col) - span).cast("string")).first()[0]


def baseline_wide(history: DataFrame, key_cols: Sequence[str] = ("city",), metrics: Sequence[str] = METRICS,
                  params: Params = DEFAULT, time_col: str = "event_time", cutoff=None,
                  prepared: bool = False) -> DataFrame:
    """One row per key: ``<metric>_mean``, ``<metric>_std`` (population) and
    ``<metric>_n`` for every metric; stats below ``min_baseline_samples`` are null."""
    h = history if prepared else prepare_events(history, key_cols, metrics)
    h = _window_history(h, params, time_col, cutoff)
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"_{m}_mean"), F.stddev_pop(m).alias(f"_{m}_std"), F.count(m).alias(f"_{m}_n")]
    stats = h.groupBy(*key_cols).agg(*aggs)
    cols = list(key_cols)
    out = []
    for m in metrics:
        ok = F.col(f"_{m}_n") >= params.min_baseline_samples
        out += [F.when(ok, F.col(f"_{m}_mean")).alias(f"{m}_mean"),
                F.when(ok, F.col(f"_{m}_std")).alias(f"{m}_std"),
                F.when(ok, F.col(f"_{m}_n")).alias(f"{m}_n")]
    return stats.select(*cols, *out)


def baseline_stats(history: DataFrame, key_cols: Sequence[str] = ("city",), metrics: Sequence[str] = METRICS,
                   params: Params = DEFAULT, time_col: str = "event_time", cutoff=None,
                   prepared: bool = False) -> DataFrame:
    """Long baseline: (keys, metric, mean, std, sample_count), HAVING n >= min samples."""
    wide = baseline_wide(history, key_cols, metrics, params, time_col, cutoff, prepared)
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"),
                 F.col(f"{m}_std").alias("std"), F.col(f"{m}_n").alias("sample_count"))
        for m in metrics
    ])
    return (wide.select(*key_cols, F.inline(entries))
            .where(F.col("sample_count").isNotNull()))


def _key_text(key_cols: Sequence[str]) -> Column:
    key_cols = [k for k in key_cols if k != "batch_id"]
    if len(key_cols) == 1:
        return F.col(key_cols[0]).cast("string")
    return F.concat_ws(", ", *[F.col(k).cast("string") for k in key_cols])


def _absolute_candidates(key_cols: Sequence[str], rules) -> list[Column]:
    out = []
    for rank, (metric, alert_type, op, bound, severity) in enumerate(rules):
        v = F.col(metric).cast("double")
        hit = v >= bound if op == ">=" else v <= bound
        msg = F.concat(_key_text(key_cols), F.lit(f": {alert_type.replace('_', ' ')} ({metric}="), fmt(v, 1), F.lit(")"))
        out.append(F.when(hit, F.struct(
            F.lit(rank).alias("_rule"),
            F.lit(metric).alias("metric"), F.lit(alert_type).alias("alert_type"),
            F.lit(severity).alias("severity"), v.alias("value"),
            F.lit(None).cast("double").alias("baseline_mean"),
            F.lit(None).cast("double").alias("baseline_std"),
            F.lit(None).cast("double").alias("z_score"),
            msg.alias("message"))))
    return out


def _z_candidates(key_cols: Sequence[str], metrics: Sequence[str], params: Params, first_rank: int) -> list[Column]:
    out = []
    for i, m in enumerate(metrics):
        v = F.col(m).cast("double")
        mean, std = F.col(f"{m}_mean"), F.col(f"{m}_std")
        z = (v - mean) / std
        direction = F.when(z > 0, F.lit("spike")).otherwise(F.lit("drop"))
        hit = mean.isNotNull() & (std > 0) & (F.abs(z) >= params.z_threshold)
        msg = F.concat(_key_text(key_cols), F.lit(f": {m} "), direction, F.lit(" detected ("), fmt(v, 1),
                       F.lit(" vs baseline "), fmt(mean, 1), F.lit(" ± "), fmt(std, 1),
                       F.lit(", z="), fmt(z, 2), F.lit(")"))
        out.append(F.when(hit, F.struct(
            F.lit(first_rank + i).alias("_rule"),
            F.lit(m).alias("metric"), F.concat(F.lit(f"{m}_"), direction).alias("alert_type"),
            F.when(F.abs(z) >= params.z_high, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
            v.alias("value"), mean.alias("baseline_mean"), std.alias("baseline_std"),
            round_half_up(z, 2).alias("z_score"), msg.alias("message"))))
    return out


def candidate_alerts(new: DataFrame, baseline: DataFrame | None, key_cols: Sequence[str] = ("city",),
                     metrics: Sequence[str] = METRICS, params: Params = DEFAULT,
                     rules=ABSOLUTE_RULES, epoch_col: str = "timestamp",
                     order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Every rule hit of every prepared new reading (no first-wins yet).

    ``baseline`` is the wide baseline (see :func:`baseline_wide`) or None.
    Output: keys, timestamp, the order columns, and the alert fields.
    """
    rows = new
    cands = _absolute_candidates(key_cols, rules)
    if baseline is not None:
        rows = rows.join(baseline, list(key_cols), "left")
        cands += _z_candidates(key_cols, metrics, params, len(rules))
    order_cols = [c for c in order if c != epoch_col]
    exploded = rows.select(
        *key_cols, F.col(epoch_col).cast("long").alias("timestamp"), *order_cols,
        F.explode(F.filter(F.array(*cands), lambda c: c.isNotNull())).alias("_a"))
    return exploded.select(*key_cols, "timestamp", *order_cols, "_a.*")


def first_alert_per_key(cands: DataFrame, key_cols: Sequence[str] = ("city",),
                        order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """First candidate per (keys, metric, alert_type) in reading order (then rule order)."""
    fields = ["timestamp", "severity", "value", "baseline_mean", "baseline_std", "z_score", "message"]
    ordering = F.struct(*[F.col(c) for c in order], F.col("_rule"))
    agg = (cands.groupBy(*key_cols, "metric", "alert_type")
           .agg(F.min_by(F.struct(*[F.col(c) for c in fields]), ordering).alias("_f")))
    return agg.select("_f.timestamp", *key_cols, "metric", "alert_type", *[f"_f.{c}" for c in fields[1:]])


def detect_anomalies(new: DataFrame, history: DataFrame | None, key_cols: Sequence[str] = ("city",),
                     metrics: Sequence[str] = METRICS, params: Params = DEFAULT, rules=ABSOLUTE_RULES,
                     order: Sequence[str] = ("timestamp", "event_id"), cutoff=None) -> DataFrame:
    """Alerts for new readings against the rolling baseline of ``history``."""
    new_p = prepare_events(new, key_cols, metrics)
    base = None
    if history is not None:
        base = baseline_wide(history, key_cols, metrics, params, cutoff=cutoff)
    cands = candidate_alerts(new_p, base, key_cols, metrics, params, rules, order=order)
    return first_alert_per_key(cands, key_cols, order)


def alerts_absolute(new: DataFrame, key_cols: Sequence[str] = ("city",), metrics: Sequence[str] = METRICS,
                    rules=ABSOLUTE_RULES, order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Absolute threshold hits for every prepared reading (no first-wins)."""
    new_p = prepare_events(new, key_cols, metrics)
    return candidate_alerts(new_p, None, key_cols, metrics, rules=rules, order=order).drop("_rule")


def alerts_zscore(new: DataFrame, history: DataFrame, key_cols: Sequence[str] = ("city",),
                  metrics: Sequence[str] = METRICS, params: Params = DEFAULT,
                  order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """z-score hits for every prepared reading that has a baseline (inner semantics)."""
    new_p = prepare_events(new, key_cols, metrics)
    base = baseline_wide(history, key_cols, metrics, params)
    return (candidate_alerts(new_p, base, key_cols, metrics, params, rules=(), order=order)
            .drop("_rule"))


def score_latest(obs: DataFrame, holdout_rows: int = 10, key_cols: Sequence[str] = ("city",),
                 params: Params = DEFAULT, order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Offline scoring: the latest reading per key against all readings except
    the last ``holdout_rows`` in time order."""
    from .clean import latest_per_key

    latest = latest_per_key(obs, key_cols[0], order=order)
    last_n = tail_rows(obs.select(*order), holdout_rows, list(order)).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    same = F.lit(True)
    for i, c in enumerate(order):  # an order column may be null
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    # ``last_n`` has at most ``holdout_rows`` rows: a proven broadcast bound.
    history = obs.join(F.broadcast(last_n), same, "left_anti")
    return detect_anomalies(latest, history, key_cols, params=params, order=order)


def combine_moments(parts: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Merge partial (n, mean, M2) per metric into one per group (Chan et al.'s
    parallel update, two passes so no large squares are subtracted).  The
    inputs are per-(batch, key) summaries, so both passes are small.  Parts
    with negative n and M2 take back readings that were counted before; a
    group of which nothing is left has n = 0 and a null mean."""
    first = []
    for m in metrics:
        n, mu = F.col(f"{m}__n").cast("double"), F.col(f"{m}__mean")
        first += [F.sum(f"{m}__n").alias(f"_{m}_n"), F.try_divide(F.sum(F.when(n != 0, n * mu)), F.sum(n)).alias(f"_{m}_mean")]
    totals = parts.groupBy(*group).agg(*first)
    joined = parts.join(totals, list(group))
    second = []
    for m in metrics:
        n, mu, m2 = F.col(f"{m}__n").cast("double"), F.col(f"{m}__mean"), F.col(f"{m}__m2")
        d = mu - F.col(f"_{m}_mean")
        second += [F.first(f"_{m}_n").alias(f"_{m}_n"), F.first(f"_{m}_mean").alias(f"_{m}_mean"),
                   F.sum(F.when(n != 0, m2 + n * d * d)).alias(f"_{m}_M2")]
    return joined.groupBy(*group).agg(*second)


def moment_aggs(metrics: Sequence[str]) -> list:
    aggs = []
    for m in metrics:
        aggs += [F.count(m).alias(f"{m}__n"), F.avg(m).alias(f"{m}__mean"),
                 (F.var_pop(m) * F.count(m)).alias(f"{m}__m2")]
    return aggs


def moments(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(*moment_aggs(metrics))


def rolling_baseline(p: DataFrame, batch_seconds: int, key_cols: Sequence[str], metrics: Sequence[str],
                     params: Params, epoch_col: str = "timestamp"):
    """Per (target batch, key) baseline over all earlier prepared rows in
    ``[max(earlier) - baseline_days, start of batch)``, plus the batch table.

    One pass summarises every (batch, key) as (n, mean, M2, newest time);
    the batch table (one row per batch) is derived from those summaries.
    Whole batches inside a window contribute their summaries; only the one
    boundary batch whose window starts mid-batch is read row by row.  The
    shuffle is therefore about the size of the input, not a multiple of it,
    and the input is scanned three times in all (summaries, boundary rows,
    scoring) however many batches there are."""
    from pyspark.sql import Window
    b = int(batch_seconds)
    span = int(params.baseline_days) * 86400
    ts = F.col(epoch_col).cast("long")
    parts = p.groupBy("batch_id", *key_cols).agg(F.max(ts).alias("_max_t"), *moment_aggs(metrics))
    batches = parts.groupBy("batch_id").agg(F.max("_max_t").alias("_bmax"))
    wb = Window.orderBy("batch_id")  # one row per batch: bounded by the calendar
    batches = (batches.withColumn("_hist_max", F.max("_bmax").over(wb.rowsBetween(Window.unboundedPreceding, -1)))
               .withColumn("_cut", F.col("_hist_max") - span)
               .withColumn("_b0", F.floor(F.col("_cut") / b).cast("long")))
    targets = batches.where(F.col("_hist_max").isNotNull()).select(
        F.col("batch_id").alias("_target"), "_cut", "_b0")
    # whole batches strictly between the boundary batch and the target
    between = F.when(F.col("_b0") + 1 <= F.col("_target") - 1, F.sequence(F.col("_b0") + 1, F.col("_target") - 1))
    inner = targets.select("_target", F.explode(between).alias("batch_id"))
    whole = parts.drop("_max_t").join(inner, "batch_id").drop("batch_id")
    # the boundary batch: rows at or after the cut
    edge_rows = p.join(targets.withColumnRenamed("_b0", "batch_id"), "batch_id").where(ts >= F.col("_cut"))
    edge = moments(edge_rows, ["_target", *key_cols], metrics)
    merged = combine_moments(whole.unionByName(edge), ["_target", *key_cols], metrics)
    base = moments_baseline(merged.withColumnRenamed("_target", "batch_id"), ["batch_id", *key_cols], metrics, params)
    return base, batches


def moments_baseline(merged: DataFrame, group: Sequence[str], metrics: Sequence[str], params: Params) -> DataFrame:
    """Wide baseline (``<m>_mean``, population ``<m>_std``) from merged moments,
    null below ``min_baseline_samples``."""
    out = []
    for m in metrics:
        ok = F.col(f"_{m}_n") >= params.min_baseline_samples
        std = F.sqrt(F.greatest(F.try_divide(F.col(f"_{m}_M2"), F.col(f"_{m}_n")), F.lit(0.0)))
        out += [F.when(ok, F.col(f"_{m}_mean")).alias(f"{m}_mean"), F.when(ok, std).alias(f"{m}_std")]
    return merged.select(*group, *out)


def hourly_moments(prepared: DataFrame, key_cols: Sequence[str] = ("city",), metrics: Sequence[str] = METRICS,
                   epoch_col: str = "timestamp", grain: int = 3600) -> DataFrame:
    """Per (hour, keys): (n, mean, M2) of every metric and the newest time of
    the prepared rows — the summary a baseline needs from a stored hour."""
    ts = F.col(epoch_col).cast("long")
    return prepared.groupBy(F.floor(ts / int(grain)).cast("long").alias("hour"), *key_cols).agg(
        F.max(ts).alias("max_t"), *moment_aggs(metrics))


def detect_against(new: DataFrame, baseline: DataFrame | None, key_cols: Sequence[str] = ("city",),
                   metrics: Sequence[str] = METRICS, params: Params = DEFAULT, rules=ABSOLUTE_RULES,
                   order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """``detect_anomalies`` with a ready wide baseline (or None)."""
    new_p = prepare_events(new, key_cols, metrics)
    cands = candidate_alerts(new_p, baseline, key_cols, metrics, params, rules, order=order)
    return first_alert_per_key(cands, key_cols, order)


def rolling_detect(obs: DataFrame, batch_seconds: int = 86400, key_cols: Sequence[str] = ("city",),
                   metrics: Sequence[str] = METRICS, params: Params = DEFAULT, rules=ABSOLUTE_RULES,
                   order: Sequence[str] = ("timestamp", "event_id"), epoch_col: str = "timestamp",
                   materialize: bool = True) -> DataFrame:
    """Replay of the detector over consecutive batches of ``batch_seconds``:
    every batch is scored against all earlier readings, exactly as
    ``detect_anomalies(batch, history)`` would, in one job (see
    :func:`rolling_baseline` for how the baselines stay linear).
    Output: the alert schema plus ``batch_id`` and ``detected_at`` (the
    newest reading time of the batch).

    ``materialize`` writes the prepared, narrow projection once with a
    reliable ``checkpoint()`` (shared folder): the three passes then read
    that instead of re-deriving it from the source each time."""
    p = prepare_events(obs, key_cols, metrics, epoch_col)
    p = p.withColumn("batch_id", F.floor(F.col(epoch_col).cast("long") / int(batch_seconds)).cast("long"))
    if materialize:
        from ..session import materialize as checkpointed
        keep = [c for c in [*key_cols, epoch_col, *order, *metrics, "batch_id"] if c in p.columns]
        p = checkpointed(p.select(*dict.fromkeys(keep)))
    base, batches = rolling_baseline(p, batch_seconds, key_cols, metrics, params, epoch_col)
    detected = batches.select("batch_id", F.timestamp_seconds("_bmax").alias("detected_at"))
    cands = candidate_alerts(p, base, ["batch_id", *key_cols], metrics, params, rules, epoch_col, order)
    first = first_alert_per_key(cands, ["batch_id", *key_cols], order)
    # one row per batch (calendar-bounded) joined back
    return first.join(detected, "batch_id").select(*ALERT_COLUMNS, "batch_id", "detected_at")
