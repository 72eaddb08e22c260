"""Reading committed batches: no task takes a whole batch."""

from pyspark.sql import types as T

from gustflow.session import work_path
from gustflow.sources import lake

T0 = 1_704_067_200
SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.LongType()),
                       T.StructField("city", T.StringType()),
                       *[T.StructField(m, T.DoubleType()) for m in ("temperature", "humidity", "wind_speed")],
                       T.StructField("weather_condition", T.StringType())])


def rows(n, first=0, temperature=1.0, step=3600):
    return [(first + i, T0 + i * step, f"c{i % 3}", temperature, 2.0, 3.0, "click") for i in range(n)]


def test_scan_is_not_shuffled_by_batch(spark):
    root = work_path(spark, "t", "scan")
    lake.write_events(spark.createDataFrame(rows(60), SCHEMA), root, batch="a")
    lake.write_events(spark.createDataFrame(rows(20, 1000, 5.0), SCHEMA), root, batch="b")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables beyond the threshold
    try:
        scan = lake.scan_events(spark, root)
        plan = scan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted((r.batch, r.ingest_seq) for r in scan.collect()) == [("a", 0)] * 60 + [("b", 1)] * 20
        got = {(r.timestamp, r.city): r.temperature for r in lake.load_events(spark, root).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {(r[1], r[2]): 5.0 if i < 20 else 1.0 for i, r in enumerate(rows(60))}


def test_written_rows_are_counted_once_and_sorted(spark):
    root = work_path(spark, "t", "stage")
    df = spark.createDataFrame(rows(500, step=600)[::-1], SCHEMA)
    n, dates = lake.stage(lake.event_rows(df), root, "x@1", lake.EVENT_SCHEMA, ("city", "timestamp"))
    assert n == 500 and dates == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    for path in spark.read.parquet(root).inputFiles():
        held = [(r.city, r.timestamp) for r in spark.read.parquet(path).collect()]
        assert held == sorted(held)
