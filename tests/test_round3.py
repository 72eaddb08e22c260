"""Commit log, arrival order, retractable moments, early-stopping reads, stop-together."""

import time

import pytest
from pyspark.sql import functions as F

from gustflow.session import work_path
from gustflow.sources import commits, lake
from gustflow.streaming import jobs
from gustflow.streaming.jobs import EventsBatch, Started, await_all

COLUMNS = ("event_id long, timestamp long, city string, temperature double, humidity double, wind_speed double, weather_condition string")
T0 = 1_700_000_000


def rows(spark, values, city="Delhi", eid=0):
    """values: (seconds after T0, temperature)."""
    return spark.createDataFrame([(eid + i, T0 + t, city, v, 50.0, 1.0, "c") for i, (t, v) in enumerate(values)], COLUMNS)


def stored(spark, root):
    return sorted((r.city, r.timestamp - T0, r.temperature) for r in lake.load_events(spark, root).collect())


def test_a_batch_that_lands_during_compaction_stays(spark, monkeypatch):
    root = work_path(spark, "t-land")
    lake.write_events(rows(spark, [(0, 1.0)]), root, "a")
    lake.write_events(rows(spark, [(0, 2.0)]), root, "b")
    real, landed = lake.stage, []

    def stage(df, path, attempt, *a):
        if attempt.startswith("compacted") and not landed:
            landed.append(True)
            lake.write_events(rows(spark, [(5, 9.0)], "Tokyo"), root, "c")
        return real(df, path, attempt, *a)

    monkeypatch.setattr(lake, "stage", stage)
    assert lake.compact_events(spark, root, lake.latest_partition(spark, root)) == 2
    assert stored(spark, root) == [("Delhi", 0, 2.0), ("Tokyo", 5, 9.0)]


def test_writing_an_older_batch_again_overturns_nothing(spark, monkeypatch):
    root = work_path(spark, "t-order")
    clock = iter(range(10**18, 0, -10**15))  # every look at a clock is earlier than the one before
    monkeypatch.setattr(time, "time_ns", lambda: next(clock))
    for batch, value in (("a", 1.0), ("b", 2.0), ("a", 1.0)):
        lake.write_events(rows(spark, [(0, value)]), root, batch)
        assert stored(spark, root) == [("Delhi", 0, 2.0 if batch == "b" or value == 1.0 and len(lake.log_of(spark, root)[0].state()) > 1 else 1.0)]
    assert lake.compact_events(spark, root, lake.latest_partition(spark, root)) == 2
    lake.write_events(rows(spark, [(0, 1.5), (60, 7.0)]), root, "a")  # after its rows were folded
    assert stored(spark, root) == [("Delhi", 0, 2.0), ("Delhi", 60, 7.0)]


def test_source_offsets_order_records_without_ids(spark):
    root = work_path(spark, "t-offset")
    df = rows(spark, [(0, 1.0), (0, 2.0), (0, 3.0)]).withColumn("event_id", F.lit(None).cast("long"))
    df = df.withColumn("source_partition", F.lit(0)).withColumn("source_offset", (100 - F.col("temperature") * 10).cast("long"))
    lake.write_events(df, root, "a")
    assert stored(spark, root) == [("Delhi", 0, 1.0)]


def test_two_writers_never_share_a_log_entry(spark, monkeypatch):
    root = work_path(spark, "t-log")
    one, two = commits.CommitLog(spark, root), commits.CommitLog(spark, root)
    real = one._load

    def behind():  # the other writer commits between this one's look and its create
        out = real()
        if "two" not in out[1]:
            two.commit("two", "two@1", {"": ["2024-01-01"]})
        return out

    monkeypatch.setattr(one, "_load", behind)
    one.commit("one", "one@1", {"": ["2024-01-02"]})
    assert {b: e.seq for b, e in two.state().items()} == {"two": 0, "one": 1}


def test_log_folds_and_passes_over_broken_entries(spark, monkeypatch):
    monkeypatch.setattr(commits, "FOLD", 4)
    log = commits.CommitLog(spark, work_path(spark, "t-fold"))
    for i in range(11):
        log.commit(f"b{i}", f"b{i}@1", {"": [f"2024-01-{i + 1:02d}"]}, replaces=[("", "2024-01-01", "b0@1")] if i == 9 else ())
        if i == 5:
            log.folder.create("00000000000000000006.json", "{\"batch\": \"half")
    state = log.state()
    assert [e.seq for e in state.values()] == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    assert state["b0"].dates[""] == [] and state["b1"].dates[""] == ["2024-01-02"]
    assert sum(n.startswith("fold-") for n in log.folder.names()) >= 2


def hot(spark, n=3):
    return rows(spark, [(90_000 + 60 * i, 60.0 + i) for i in range(n)], eid=500)


def base(spark):
    return rows(spark, [(600 * i, 20.0 + i % 5) for i in range(24)])


@pytest.mark.parametrize("dies_at", [1, 2, 3, 4])
def test_a_batch_is_seen_whole_or_not_at_all(spark, monkeypatch, dies_at):
    body = EventsBatch(work_path(spark, "t-die"))
    body.ingest(base(spark), "history")
    real, calls = lake.stage, []

    def stage(*a):
        calls.append(a)
        out = real(*a)
        if len(calls) == dies_at:
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(lake, "stage", stage)

    def seen():
        return [df.count() for df in (lake.scan_events(spark, body.events), lake.read_table(spark, body.moments, jobs.MOMENTS_SCHEMA),
                                      body.read_alerts(spark), body.read_outbox(spark), body.read_metrics(spark))]
    before = seen()
    with pytest.raises(RuntimeError):
        body(hot(spark), 0)
    assert seen() == before
    monkeypatch.setattr(lake, "stage", real)
    body(hot(spark), 0)
    after = seen()
    assert after[0] == before[0] + 3 and after[2] > 0 and after[3] > 0 and after[4] == 1
    body(hot(spark), 0)  # delivered again after the commit
    assert seen() == after
    body(rows(spark, [(95_000, 21.0)]), 0)  # other rows under the batch's number
    assert seen()[0] == after[0] + 1


def baselines(spark, body):
    from gustflow.operators import anomaly
    wide = body.baseline(spark).collect()
    scan = anomaly.baseline_wide(body.history(spark)).collect()
    pick = lambda got: {r["city"]: [None if r[f"{m}_{x}"] is None else round(r[f"{m}_{x}"], 9) for m in jobs.METRICS for x in ("mean", "std")] for r in got}
    return pick(wide), pick(scan)


def test_moments_are_those_of_deduplicated_readings(spark):
    body = EventsBatch(work_path(spark, "t-moments"))
    body.ingest(base(spark), "one")
    body.ingest(base(spark), "two")  # the same 24 readings under another name
    moments = lambda: lake.read_table(spark, body.moments, jobs.MOMENTS_SCHEMA).agg(F.sum("temperature__n")).first()[0]
    assert moments() == 24 == lake.load_events(spark, body.events).count()
    again = [(600 * i, 50.0 + i) for i in range(6)]
    body.ingest(rows(spark, again + again[:2] + [(7, 1.0)], eid=90), "three")  # corrections, repeated, and one new reading
    body.ingest(rows(spark, [(600, None), (99_000, 18.0)], eid=200), "four")  # a correction that takes a reading away
    body.ingest(rows(spark, [(t, 19.0) for t in range(0, 6000, 60)], "Tokyo", 300), "five")
    before = baselines(spark, body)
    assert before[0] == before[1] and moments() == 24 + 1 - 1 + 1 + 100
    for day in lake.partition_dates(spark, body.events):
        assert body.compact(spark, day) > 0
    after = baselines(spark, body)
    assert after[0] == after[1] == before[0]
    body.ingest(rows(spark, [(600, 30.0), (1200, 31.0)], eid=700), "six")
    last = baselines(spark, body)
    assert last[0] == last[1] != before[0]


def test_moments_on_the_edge_of_the_window(spark):
    body = EventsBatch(work_path(spark, "t-edge"))
    week = 7 * 86_400
    body.ingest(rows(spark, [(60 * i, 10.0 + i % 7) for i in range(200)]), "old")
    body.ingest(rows(spark, [(60 * i, 40.0 + i % 3) for i in range(20, 90, 2)], eid=900), "again")
    body.ingest(rows(spark, [(week + 3000, 22.0)], eid=2000), "new")
    wide, scan = baselines(spark, body)
    assert wide == scan


def test_newest_rows_open_few_dates(spark):
    root = work_path(spark, "t-alerts")
    day = 86_400
    alerts = spark.range(40).select(
        (F.lit(T0) + F.col("id") * day).alias("timestamp"), F.lit("A").alias("city"), F.lit("temperature").alias("metric"),
        F.lit("heat").alias("alert_type"), F.lit("high").alias("severity"), F.lit(1.0).alias("value"), F.lit(1.0).alias("baseline_mean"),
        F.lit(1.0).alias("baseline_std"), F.lit(1.0).alias("z_score"), F.lit("m").alias("message"),
        F.timestamp_seconds(F.lit(T0) + F.when(F.col("id") == 3, 0).otherwise(F.col("id")) * day).alias("detected_at"))
    lake.persist_alerts(alerts, root)
    lake.persist_alerts(alerts, root)  # the same alerts again replace themselves
    got = lake.load_alerts(spark, root, limit=2)
    assert [(r.timestamp - T0) // day for r in got.collect()] == [39, 38]
    assert len({f.split("detected_date=")[1][:10] for f in got.inputFiles()}) <= 4
    assert lake.load_alerts(spark, root, limit=None).count() == 40
    assert [(r.timestamp - T0) // day for r in lake.load_alerts(spark, root, limit=100).collect()] == list(range(39, -1, -1))
    lake.write_events(rows(spark, [(day * i, float(i)) for i in range(30)]), events := work_path(spark, "t-events"), "a")
    recent = lake.load_events(spark, events, limit=3)
    assert sorted(r.temperature for r in recent.collect()) == [27.0, 28.0, 29.0]
    assert len({f.split("event_date=")[1][:10] for f in recent.inputFiles()}) <= 4


def test_aggregates_written_again_are_not_doubled(spark):
    from gustflow.operators.windows import window_agg
    from gustflow.operators.clean import with_event_time
    root = work_path(spark, "t-aggs")
    aggs = window_agg(with_event_time(base(spark)))
    lake.write_aggregates(aggs, root)
    lake.write_aggregates(aggs, root)
    assert lake.load_aggregates(spark, root, limit=None).count() == aggs.count()


class Query:
    def __init__(self, turns):
        self.turns, self.isActive, self.stopped = turns, True, False

    def awaitTermination(self, timeout):
        self.turns -= 1
        self.isActive = self.turns > 0 and not self.stopped
        return not self.isActive

    def stop(self):
        self.isActive, self.stopped = False, True


def test_any_end_stops_the_others(spark):
    first, second = Query(10**6), Query(2)
    await_all(spark, [first, second])
    assert first.stopped and not second.stopped
    first, second = Query(5), Query(2)
    await_all(spark, Started((first, second), bounded=True))
    assert not first.stopped and not second.stopped


def test_regular_series_do_not_depend_on_the_block_size(spark):
    import random
    from gustflow.operators.windows import resample
    rng = random.Random(3)
    data = [(c, rng.randrange(300) * 700, *(None if rng.random() < p else rng.random() for p in (0.4, 0.8))) for c in ("A", "B", None) for _ in range(50)]
    df = spark.createDataFrame(data, "city string, s long, x double, z double").withColumn("t", F.timestamp_seconds("s"))
    one, three, whole = (sorted(map(tuple, resample(df, ["city"], ["x", "z"], "t", 30, block_bins=b).collect())) for b in (1, 3, 4096))
    assert one == three == whole and len(whole) > 300
    plan = resample(df, ["city"], ["x", "z"], "t", 30)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_repeats_of_a_second_are_counted_not_listed(spark):
    from gustflow.operators.windows import infer_freq, inter_arrival
    secs = [0] * 500 + [600, 600, 1200, 4000, 90_000]
    df = spark.createDataFrame([("A", s) for s in secs] + [("B", 5), ("C", 1), ("C", 31)], "city string, s long")
    df = df.withColumn("event_time", F.timestamp_seconds("s"))
    gaps = {(r.city, r.gap): r.n for r in inter_arrival(df).groupBy("city", "gap").agg(F.sum("n").alias("n")).collect()}
    assert gaps == {("A", 0): 500, ("A", 600): 2, ("A", 2800): 1, ("A", 86_000): 1, ("C", 30): 1}
    assert inter_arrival(df).count() == 7  # 0 twice (499 and 1 times), 600 twice, 2800, 86 000, and the one of C
    assert {r.city: r.median_seconds for r in infer_freq(df).collect()} == {"A": 0, "B": None, "C": 30}
