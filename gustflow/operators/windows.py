"""Time-bucketed aggregates, regular series (gap fill + interpolation) and
frequency inference.

Scale notes
-----------
* Tumbling aggregates are plain ``groupBy(window(...), key)`` with partial
  aggregation; a hot key is folded map-side.
* The regular series first aggregates to (key, bin), then works in blocks of
  bins; what a block needs of later ones is carried over a (key, block) table.
* Frequency inference folds readings to (key, second, count), computes
  inter-arrival gaps inside (key, hour) slices of those and stitches slice boundaries with a per-(key, slice) table, then finds the
  exact median from a (key, gap) histogram; no window ever spans a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS
from ..functions.scalars import freq_bucket, round_half_up
from .clean import tail_rows


def window_agg(df: DataFrame, key_cols: Sequence[str] = ("city",), metrics: Sequence[str] = METRICS,
               time_col: str = "event_time", duration: str = "5 minutes", count_col: str | None = None) -> DataFrame:
    """Tumbling-window means per key plus a row count (``count(*)`` or ``count(count_col)``)."""
    counter = F.count(F.lit(1)) if count_col is None else F.count(count_col)
    agg = (df.groupBy(F.window(time_col, duration).alias("window"), *key_cols)
           .agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics], counter.alias("record_count")))
    return agg.select(*key_cols, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      *[f"avg_{m}" for m in metrics], "record_count")


def live_window_agg(df: DataFrame, key_cols: Sequence[str] = ("city",), metrics: Sequence[str] = METRICS,
                    time_col: str = "event_time", duration: str = "5 minutes", limit: int | None = 200,
                    order: str = "time") -> DataFrame:
    """Window means rounded to 2 places, non-null ``record_count`` of the first
    metric, and the last ``limit`` rows: newest windows (``order='time'``) or
    in (key, window) order (``order='city'``)."""
    agg = window_agg(df, key_cols, metrics, time_col, duration, count_col=metrics[0])
    for m in metrics:
        agg = agg.withColumn(f"avg_{m}", round_half_up(F.col(f"avg_{m}"), 2))
    if not limit:
        return agg
    ordering = ["window_start", *key_cols] if order == "time" else [*key_cols, "window_start"]
    return tail_rows(agg, limit, ordering)


#: Bins in a block of a regular series.
BLOCK_BINS = 1024


def resample(df: DataFrame, key_cols: Sequence[str] = ("city",), metrics: Sequence[str] = METRICS,
             time_col: str = "event_time", minutes: int = 30, block_bins: int = BLOCK_BINS) -> DataFrame:
    """Regular series per (key, metric): bin means on an epoch-aligned grid,
    gaps filled by time-linear interpolation; leading gaps are dropped and
    trailing gaps repeat the last value.  Output ``(keys, metric, ds, y)``.

    Bins are gathered by (key, block of ``block_bins`` bins).  A point fills
    the grid up to the next point of its metric, which lies in its own block
    or is the first one of a later block; those first points are carried back
    over an edge table of one row per (key, block), so no task holds a key's
    bins and the input is read once."""
    step = int(minutes) * 60
    keys = list(key_cols)
    binned = df.dropna(subset=keys).select(*keys, *metrics, (F.floor(F.unix_seconds(F.col(time_col)) / step) * step).cast("long").alias("_bin"))
    wide = binned.where(F.col("_bin").isNotNull()).groupBy(*keys, "_bin").agg(
        *[F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))).alias(m) for m in metrics])  # NaN is a missing reading
    blocks = (wide.groupBy(*keys, F.expr(f"_bin div {step * int(block_bins)}").alias("_block"))
              .agg(F.sort_array(F.collect_list(F.struct("_bin", *metrics))).alias("_points")))

    def own(m: str):
        return F.transform(F.filter("_points", lambda p: p[m].isNotNull()), lambda p: F.struct(p["_bin"].alias("t"), p[m].alias("v")))

    edges = blocks.select(*keys, "_block", F.get("_points", F.size("_points") - 1)["_bin"].alias("_last"),
                          *[F.get(own(m), F.lit(0)).alias(f"_f_{m}") for m in metrics])
    later = Window.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*keys, "_block", F.max("_last").over(Window.partitionBy(*keys)).alias("_hi"),
                         *[F.last(f"_f_{m}", ignorenulls=True).over(later).alias(f"_n_{m}") for m in metrics])
    def spans(m: str):
        after = F.concat(F.slice(own(m), 2, F.lit(int(block_bins))), F.array(F.col(f"_n_{m}")))
        pairs = F.zip_with(own(m), after, lambda p, n: F.struct(F.lit(m).alias("metric"), p["t"].alias("t"), p["v"].alias("v"), n.alias("n")))
        return F.filter(pairs, lambda p: p["t"].isNotNull())  # a block without a point has none

    # null-safe, so that no filter parts the two uses of ``blocks`` and its shuffle is read twice
    named = [*keys, "_block"]
    edges = edges.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(named)], "_hi", *[f"_n_{m}" for m in metrics])
    same = F.lit(True)
    for i, c in enumerate(named):
        same = same & F.col(c).eqNullSafe(F.col(f"_e{i}"))
    rows = blocks.join(edges, same).select(*keys, "_hi", F.inline(F.concat(*[spans(m) for m in metrics])))
    end = F.when(F.col("n").isNotNull(), F.col("n.t") - step).otherwise(F.col("_hi"))
    rows = rows.select(*keys, "metric", "t", "v", "n", F.explode(F.sequence("t", end, F.lit(step).cast("long"))).alias("_bin"))
    y = F.when((F.col("_bin") == F.col("t")) | F.col("n").isNull(), F.col("v")).otherwise(
        F.col("v") + (F.col("n.v") - F.col("v")) * (F.col("_bin") - F.col("t")) / (F.col("n.t") - F.col("t")))
    return rows.select(*keys, "metric", F.timestamp_seconds("_bin").alias("ds"), y.alias("y"))


def inter_arrival(df: DataFrame, key_cols: Sequence[str] = ("city",), time_col: str = "event_time",
                  slice_seconds: int = 3600) -> DataFrame:
    """(keys, gap, n): gaps in seconds between consecutive readings of each
    key and how often each was found in a run.  Readings are folded to one row
    per (key, second) first, whose repeats are gaps of 0; the other gaps come
    from (key, slice) groups of at most ``slice_seconds`` seconds, and the
    first one of a slice is stitched to the previous non-empty slice through a
    (key, slice) table bounded by the calendar, so no window spans a whole
    key and no group grows with the readings."""
    keys = list(key_cols)
    t = df.select(*keys, F.unix_seconds(F.col(time_col)).alias("_t")).where(F.col("_t").isNotNull())
    t = t.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_c")).withColumn("_day", F.floor(F.col("_t") / int(slice_seconds)))
    w = Window.partitionBy(*keys, "_day").orderBy("_t")
    one = F.lit(1).cast("long").alias("n")
    found = F.array(F.struct(F.col("gap"), one), F.struct(F.lit(0).cast("long").alias("gap"), (F.col("_c") - 1).alias("n")))
    inner = t.withColumn("gap", F.col("_t") - F.lag("_t").over(w)).select(*keys, F.inline(found)).where("gap is not null and n > 0")
    days = t.groupBy(*keys, "_day").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    wd = Window.partitionBy(*keys).orderBy("_day")
    edges = days.select(*keys, (F.col("_first") - F.lag("_last").over(wd)).alias("gap"), one).where("gap is not null")
    return inner.unionByName(edges)


def exact_median(values: DataFrame, key_cols: Sequence[str], value_col: str, weight: str | None = None) -> DataFrame:
    """Exact median per key from a (key, value) histogram (average of the two
    middle values for an even count); ``weight``: how often a row's value
    counts.  The histogram is a partial aggregation, and the running counts
    walk distinct values only."""
    hist = values.groupBy(*key_cols, value_col).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    w = Window.partitionBy(*key_cols).orderBy(value_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wk = Window.partitionBy(*key_cols)
    ranked = (hist.withColumn("_hi", F.sum("_c").over(w))
              .withColumn("_n", F.sum("_c").over(wk))
              .withColumn("_lo", F.col("_hi") - F.col("_c")))
    # positions (0-based) of the middle elements
    lo_pos, hi_pos = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    v = F.col(value_col).cast("double")
    picked = ranked.select(
        *key_cols,
        F.when((F.col("_lo") <= lo_pos) & (lo_pos < F.col("_hi")), v).alias("_a"),
        F.when((F.col("_lo") <= hi_pos) & (hi_pos < F.col("_hi")), v).alias("_b"),
        "_n")
    return picked.groupBy(*key_cols).agg(((F.max("_a") + F.max("_b")) / 2).alias("median"),
                                         F.max("_n").alias("n"))


def infer_freq(df: DataFrame, key_cols: Sequence[str] = ("city",), time_col: str = "event_time") -> DataFrame:
    """Median inter-arrival (whole seconds, truncated) and its frequency bucket per key.

    Keys with fewer than two readings get the default 30min bucket and a
    null median."""
    gaps = inter_arrival(df, key_cols, time_col)
    med = exact_median(gaps, key_cols, "gap", "n")
    keys = df.select(*key_cols).where(F.col(key_cols[0]).isNotNull()).distinct()
    out = keys.join(med, list(key_cols), "left")
    secs = F.floor(F.col("median")).cast("long")
    return out.select(*key_cols, secs.alias("median_seconds"),
                      F.when(secs.isNull(), F.lit("30min")).otherwise(freq_bucket(secs)).alias("freq"))
