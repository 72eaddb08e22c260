"""The Parquet lake: events, window aggregates and alerts.

Layout
------
* events: ``<root>/event_date=YYYY-MM-DD/batch=<attempt>/part-*.parquet``;
  aggregates by ``window_date``, alerts by ``detected_date``.  Rows are
  range-partitioned on (date, city, time) before the write, so a hot date is
  split over several tasks and files are sorted for row-group pruning.
* ``<root>/_commits``: the log that makes a written batch visible as a whole
  and gives it its place in the arrival order (:mod:`.commits`).  Readers take
  the folders from the log, so a scan lists the dates it needs and nothing else.

Keep-last orders by (order number of the batch, source partition, source
offset, event_id): no clock takes part.  ``compact_events`` folds the visible
folders of a date into one de-duplicated folder whose rows keep their order
number; it replaces exactly what it has read.

Readers use explicit schemas; a missing root gives a typed empty frame, a
folder without a log is read whole, and real I/O errors surface.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.anomaly import ALERT_SCHEMA
from ..operators.clean import dedupe_last, head_rows, tail_rows, with_event_date, with_event_time
from .commits import CommitLog, attempt_name, log_of

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("city", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("weather_condition", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("source_partition", T.IntegerType()),
    T.StructField("source_offset", T.LongType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("batch", T.StringType()),
])
EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields]
#: Keep-last order: the batch's place in the log, the place in the source, the reading's own number.
WRITE_ORDER = ("ingest_seq", "source_partition", "source_offset", "event_id")
SOURCE_ORDER = WRITE_ORDER[1:]

AGGREGATE_SCHEMA = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("avg_temperature", T.DoubleType()),
    T.StructField("avg_humidity", T.DoubleType()),
    T.StructField("avg_wind_speed", T.DoubleType()),
    T.StructField("record_count", T.LongType()),
    T.StructField("window_date", T.DateType()),
    T.StructField("batch", T.StringType()),
])

STORED_ALERT_SCHEMA = T.StructType(list(ALERT_SCHEMA.fields) + [
    T.StructField("detected_at", T.TimestampType()),
    T.StructField("detected_date", T.DateType()),
    T.StructField("batch", T.StringType()),
])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _date(text: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return None


def partition_dates(spark: SparkSession, root: str, col: str = "event_date") -> list[dt.date]:
    """Dates of a table, newest first, from its log or, without one, from the
    folder names (metadata only: no file is opened)."""
    logged = log_of(spark, root)
    if logged:
        found = {_date(d) for d, _ in logged[0].visible(logged[1])}
    elif not exists(spark, root):
        found = set()
    else:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = {_date(st.getPath().getName()[len(col) + 1:]) for st in fs.listStatus(p)
                 if st.isDirectory() and st.getPath().getName().startswith(col + "=")}
    return sorted(found - {None}, reverse=True)


def latest_partition(spark: SparkSession, root: str, col: str = "event_date"):
    """Newest date of a table; None when there is none."""
    return next(iter(partition_dates(spark, root, col)), None)


def read_table(spark: SparkSession, root: str, schema: T.StructType, since=None, dates=None) -> DataFrame:
    """The committed rows of a table folder, read with its schema; missing or
    empty -> typed empty.  ``since`` / ``dates`` restrict the date folders
    that are listed and read.  A null ``ingest_seq`` is filled from the log."""
    col = schema.fields[-2].name  # tables end in (date, batch)
    since = None if since is None else str(since)
    dates = None if dates is None else sorted({str(d) for d in dates})
    logged = log_of(spark, root)
    if logged is None:
        if not exists(spark, root):
            return spark.createDataFrame([], schema)
        df = spark.read.schema(schema).option("basePath", root).parquet(root)
        if since is not None:
            df = df.where(F.col(col) >= F.lit(since).cast("date"))
        return df if dates is None else df.where(F.col(col).isin(dates))
    log, table = logged
    found = log.visible(table, since, dates)
    if not found:
        return spark.createDataFrame([], schema)
    root = root.rstrip("/")
    df = (spark.read.schema(schema).option("basePath", root)
          .parquet(*sorted({f"{root}/{col}={d}" for d, _ in found})))
    # on partition columns only: other folders are not opened
    df = df.where(F.concat_ws("/", F.col(col).cast("string"), "batch").isin([f"{d}/{e.attempt}" for d, e in found]))
    named = spark.createDataFrame(sorted({(e.attempt, e.batch, e.seq) for _, e in found}), "batch string, _batch string, _seq long")
    # one line a batch goes to the rows: a join that shuffles by batch would put a whole batch into one task
    df = df.join(F.broadcast(named), "batch").withColumn("batch", F.col("_batch"))
    if "ingest_seq" in df.columns:
        df = df.withColumn("ingest_seq", F.coalesce("ingest_seq", "_seq"))
    return df.select(*[f.name for f in schema.fields])


def stage(df: DataFrame, root: str, attempt: str, schema: T.StructType, sort=("city",)) -> tuple[int, list[str]]:
    """Write rows into the attempt's folders; (rows, dates), observed on the
    way.  They stay unseen until the log says otherwise."""
    col = schema.fields[-2].name
    rows = df.withColumn("batch", F.lit(attempt))
    for f in schema.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    seen = Observation()
    rows = rows.select(*[f.name for f in schema.fields]).repartitionByRange(col, *sort)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(F.col(col).cast("string")).alias("dates"))
    rows = rows.sortWithinPartitions(col, "batch", *sort)
    rows.write.mode("append").partitionBy(col, "batch").parquet(root)
    return seen.get["n"], sorted(seen.get["dates"])


def _commit(spark: SparkSession, root: str, batch: str, attempt: str, dates: list[str], info: dict | None = None) -> None:
    """Make a table's attempt visible in place of the batch's earlier one,
    whose folders then go."""
    log = CommitLog(spark, root)
    old = log.state().get(batch)
    log.commit(batch, attempt, {"": dates}, info)
    if old:
        _remove(spark, root, old.dates.get("", ()), old.attempt)


def _remove(spark: SparkSession, root: str, dates, attempt: str, col: str | None = None) -> int:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cols = [col] if col else ["event_date", "window_date", "detected_date", "sent_date"]
    return sum(bool(fs.delete(jvm.org.apache.hadoop.fs.Path(top, f"{c}={d}/batch={attempt}"), True)) for d in dates for c in cols)


def event_rows(df: DataFrame) -> DataFrame:
    """Observations in the columns of the events table."""
    return with_event_date(with_event_time(df))


def write_events(df: DataFrame, root: str, batch: str) -> None:
    """Add one writer batch of observations, visible as a whole.  ``batch``
    names the write: the same name replaces its own rows and keeps their place
    in the order, another name adds.  Rows that carry an ``ingest_seq`` keep it."""
    spark, attempt = df.sparkSession, attempt_name(str(batch))
    CommitLog(spark, root).open()
    _, dates = stage(event_rows(df), root, attempt, EVENT_SCHEMA, ("city", "timestamp"))
    _commit(spark, root, str(batch), attempt, dates)


def scan_events(spark: SparkSession, root: str, since=None, dates=None) -> DataFrame:
    """All committed rows; ``since`` (a date) and ``dates`` prune ``event_date`` folders."""
    return read_table(spark, root, EVENT_SCHEMA, since, dates)


def load_events(spark: SparkSession, root: str, since=None, limit: int | None = None,
                order=WRITE_ORDER) -> DataFrame:
    """Stored events, keep-last per (city, timestamp) in write order, optional last N."""
    def load(dates=None) -> DataFrame:
        return dedupe_last(scan_events(spark, root, since, dates), ("city", "timestamp"), order)
    if not limit:
        return load()
    return newest_rows(spark, root, load, limit, F.to_date("event_time"), "event_date",
                       lambda df: tail_rows(df, limit, ["timestamp", "event_id"]))


def newest_rows(spark: SparkSession, root: str, load, n: int, day: Column, col: str, top) -> DataFrame:
    """``top(load())`` for a top of ``n`` rows whose order starts with the day
    ``day``, which is never after a row's date folder.  Folders are read
    newest first, twice as many each time, until ``n`` rows lie after the
    newest folder that is left."""
    dates = partition_dates(spark, root, col)
    step = 1
    while step < len(dates):
        found = load([d.isoformat() for d in dates[:step]])
        if found.where(day > F.lit(dates[step].isoformat()).cast("date")).limit(n).count() >= n:
            return top(found)
        step *= 2
    return top(load())


def compact(spark: SparkSession, log: CommitLog, table: str, date, schema: T.StructType, fold, sort=("city",)) -> int:
    """Replace the visible folders of one date of a table by one that holds
    ``fold`` of their rows.  Returns the number of folders removed: exactly
    those that were read, so a batch that lands meanwhile stays."""
    day, col = str(date), schema.fields[-2].name
    root = f"{log.root}/{table}".rstrip("/")
    read = [e for _, e in log.visible(table, dates=[day])]
    if not read or len(read) == 1 and read[0].info.get("compacted"):
        return 0
    name = f"compacted-{table}-{day}"
    attempt = attempt_name(name)
    rows = read_table(spark, root, schema, dates=[day])
    held = {e.attempt for e in log.state().values() if day in e.dates.get(table, ())}
    if held != {e.attempt for e in read}:  # a batch landed between the two looks
        return compact(spark, log, table, date, schema, fold, sort)
    _, dates = stage(fold(rows), root, attempt, schema, sort)
    # a name of its own: two runs at once can't replace each other
    log.commit(attempt, attempt, {table: dates}, {"compacted": True}, [(table, day, e.attempt) for e in read])
    return sum(_remove(spark, root, [day], e.attempt, col) for e in read)


def compact_events(spark: SparkSession, root: str, event_date, order=WRITE_ORDER) -> int:
    """Fold all committed batches of one ``event_date`` into a single
    de-duplicated folder (keep-last, as the loader reads it) and remove the
    folded ones.  Returns the number of folders removed.

    Rows keep their order number, so ``load_events`` returns the same and a
    correction written later still wins; re-running is harmless.  Rows that
    are written again under the name of a folded batch come back at that
    batch's place."""
    logged = log_of(spark, root)
    if logged is None:
        return 0
    return compact(spark, *logged, event_date, EVENT_SCHEMA,
                   lambda rows: dedupe_last(rows, ("city", "timestamp"), order), ("city", "timestamp"))


def content_name(df: DataFrame) -> str:
    """A batch name that equal rows share."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return f"rows-{n}-{total}"


def write_aggregates(df: DataFrame, root: str, batch: str | None = None) -> None:
    """Add window aggregates.  The same ``batch`` (by default: the same rows)
    written again replaces itself."""
    spark, batch = df.sparkSession, batch or content_name(df)
    attempt = attempt_name(batch)
    CommitLog(spark, root).open()
    _, dates = stage(df.withColumn("window_date", F.to_date("window_start")), root, attempt, AGGREGATE_SCHEMA)
    _commit(spark, root, batch, attempt, dates)


def load_aggregates(spark: SparkSession, root: str, limit: int | None = 200) -> DataFrame:
    def load(dates=None) -> DataFrame:
        return read_table(spark, root, AGGREGATE_SCHEMA, dates=dates)
    if not limit:
        return load().drop("window_date", "batch")
    return newest_rows(spark, root, load, limit, F.to_date("window_start"), "window_date",
                       lambda df: tail_rows(df, limit, ["window_start", "city"])).drop("window_date", "batch")


def detected_date(at: str = "detected_at") -> Column:
    """The alert's folder: its detection date, or its reading's if that is
    later, so no folder holds readings of a later day."""
    return F.greatest(F.to_date(at), F.to_date(F.timestamp_seconds("timestamp")))


def persist_alerts(alerts: DataFrame, root: str, detected_at=None, batch: str | None = None) -> None:
    """Add alerts with ``detected_at`` (given column/literal, else now).  The
    same ``batch`` (by default: the same alerts) written again replaces itself."""
    if detected_at is None:
        at = F.col("detected_at") if "detected_at" in alerts.columns else F.current_timestamp()
    else:
        at = detected_at if not isinstance(detected_at, str) else F.lit(detected_at).cast("timestamp")
    spark, batch = alerts.sparkSession, batch or content_name(alerts)
    attempt = attempt_name(batch)
    CommitLog(spark, root).open()
    rows = alerts.withColumn("detected_at", at).withColumn("detected_date", detected_date())
    _, dates = stage(rows, root, attempt, STORED_ALERT_SCHEMA, ("city", "timestamp"))
    _commit(spark, root, batch, attempt, dates)


def scan_alerts(spark: SparkSession, root: str, dates=None) -> DataFrame:
    return read_table(spark, root, STORED_ALERT_SCHEMA, dates=dates).drop("detected_date", "batch")


def load_alerts(spark: SparkSession, root: str, limit: int | None = 100) -> DataFrame:
    """Newest first by reading time (total order), first ``limit``."""
    if not limit:
        return scan_alerts(spark, root)
    return newest_rows(spark, root, lambda dates=None: scan_alerts(spark, root, dates), limit,
                       F.to_date(F.timestamp_seconds("timestamp")), "detected_date",
                       lambda df: head_rows(df, limit, [F.col("timestamp").desc(), "city", "metric", "alert_type"]))
