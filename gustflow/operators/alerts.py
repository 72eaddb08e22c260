"""Alert history operators: notification cooldown, outbox, merge, KPIs, filters.

Cooldown (greedy, per alert key): an alert is notified when no notification
of the same key was sent within the previous ``cooldown`` seconds; the
clock is the alert's event time.  Sent alerts are therefore at least
``cooldown`` apart, and the sent set is the orbit of the key's first alert
under ``nxt(a)`` = the first alert at or after ``t(a) + cooldown``.

The batch implementation is a scan over blocks of time, never a key in one
task and no rounds:

1. alerts collapse to one node per (key, second) — the earliest; the rest
   of that second can never be sent;
2. a key's time is cut into blocks.  What a block sends depends on earlier
   ones only through the second at which the key is free again, and that lies
   before the block's start + cooldown.  So the block has at most one possible
   entry per second of its first cooldown, and its paths from each of them are
   worked out in whatever task holds the block (distinct seconds of one block,
   whatever the data volume);
3. one ordered pass over the blocks' entries takes, per key, the first entry
   at which the key is free.  It streams: its state is the last sent second.
   The entries are bounded by the calendar, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..functions.scalars import alert_key, notification_text
from ..session import ship_package

#: Seconds of a block at most (unless the cooldown is longer), and cooldowns.
BLOCK_SECONDS = 1 << 18
BLOCK_COOLDOWNS = 4096


def _node(t, seq_cols: Sequence[str]):
    return F.struct(t.alias("t"), F.struct(*[F.col(c) for c in seq_cols]).alias("s"))


def _block_width(cooldown: int) -> int:
    return max(cooldown, min(BLOCK_SECONDS, cooldown * BLOCK_COOLDOWNS))


def _paths(t: np.ndarray, start: int, cooldown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, nodes, exits): for every entry of a block that starts at
    ``start``, the positions in ``t`` (its seconds, ascending) that are sent
    from there on, end to end, and the last of them."""
    nxt = np.searchsorted(t, t + cooldown)
    cur = np.arange(min(len(t), np.searchsorted(t, start + cooldown - 1) + 1))
    exits, hops = cur.copy(), []
    while (on := cur < len(t)).any():
        hops.append(np.where(on, cur, -1))
        exits = np.where(on, cur, exits)
        cur = np.where(on, nxt[np.minimum(cur, len(t) - 1)], cur)
    grid = np.stack(hops, axis=1)
    return (grid >= 0).sum(1), grid[grid >= 0], exits


def block_paths(nodes: DataFrame, key_cols: Sequence[str], cooldown: int, width: int) -> DataFrame:
    """(keys, _block, _entry, _exit, _path): the nodes sent in a block when the
    key is free again at ``_entry`` (or after the entry before it)."""

    def run(block: pa.Table) -> pa.Table:
        block = block.take(np.argsort(block.column("_t").to_numpy()))
        t, b = block.column("_t").to_numpy(), block.column("_block")[0].as_py()
        sizes, at, exits = _paths(t, b * width, cooldown)
        path = block.column("_node").combine_chunks().take(pa.array(at))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        head = block.select([*key_cols, "_block"]).slice(0, len(sizes))
        return (head.append_column("_entry", pa.array(t[:len(sizes)])).append_column("_exit", pa.array(t[exits]))
                .append_column("_path", pa.ListArray.from_arrays(ends, path)))

    long = T.LongType()
    schema = T.StructType([nodes.schema[k] for k in key_cols] + [
        T.StructField("_block", long), T.StructField("_entry", long), T.StructField("_exit", long),
        T.StructField("_path", T.ArrayType(nodes.schema["_node"].dataType))])
    return (nodes.withColumn("_t", F.col("_node.t")).withColumn("_block", F.floor(F.col("_t") / F.lit(width)))
            .groupBy(*key_cols, "_block").applyInArrow(run, schema))


def taken_paths(paths: DataFrame, key_cols: Sequence[str], cooldown: int) -> DataFrame:
    """(keys, _node) of the entries that the greedy order takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, free, taken = None, None, None, False
        for batch in batches:
            rows = []
            at = zip(*(batch.column(c).to_pylist() for c in (*key_cols, "_block", "_entry", "_exit")))
            for i, (*k, b, entry, last) in enumerate(at):
                if k != key:
                    key, block, free = k, None, None
                if b != block:
                    block, taken = b, False
                if not taken and (free is None or entry >= free):
                    rows.append(i)
                    free, taken = last + cooldown, True
            if rows:
                yield batch.take(pa.array(rows)).select([*key_cols, "_path"])

    schema = T.StructType([paths.schema[k] for k in (*key_cols, "_path")])
    ordered = (paths.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key_cols)
               .sortWithinPartitions(*key_cols, "_block", "_entry"))
    return ordered.mapInArrow(run, schema).select(*key_cols, F.explode("_path").alias("_node"))


def cooldown_sent(alerts: DataFrame, key_cols: Sequence[str] = ("alert_key",), time_col: str = "timestamp",
                  seq_cols: Sequence[str] = ("batch_id",), cooldown: int = DEFAULT.cooldown_seconds,
                  block_seconds: int | None = None) -> DataFrame:
    """Rows of ``alerts`` that are notified under the greedy cooldown.

    ``time_col`` is whole seconds; ``seq_cols`` break ties between alerts of
    the same key and second (earlier sequence is considered first).  Alerts
    without a key or a time are not notified; without a cooldown all others
    are.  The result does not depend on ``block_seconds``.
    """
    c = int(cooldown)
    t = F.col(time_col).cast("long")
    keyed = alerts.where(t.isNotNull()).dropna(subset=list(key_cols))
    if c <= 0:
        return keyed
    ship_package(alerts.sparkSession)
    # only the earliest alert of a (key, second) can be sent: one node per second
    nodes = (keyed.select(*key_cols, t.alias("_t"), F.struct(*[F.col(x) for x in seq_cols]).alias("_s"))
             .groupBy(*key_cols, "_t").agg(F.min("_s").alias("_s"))
             .select(*key_cols, F.struct(F.col("_t").alias("t"), F.col("_s").alias("s")).alias("_node")))
    paths = block_paths(nodes, key_cols, c, block_seconds or _block_width(c))
    sent = taken_paths(paths, key_cols, c)
    return keyed.withColumn("_node", _node(t, seq_cols)).join(sent, [*key_cols, "_node"], "left_semi").drop("_node")


def with_alert_key(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("alert_key", alert_key())


def notifications(alerts: DataFrame, cooldown: int = DEFAULT.cooldown_seconds,
                  seq_cols: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Outbox rows (alert_key, text, sent_at, batch_id) for the notified alerts.

    Every alert is stored regardless; only the notifications are
    suppressed by the cooldown.  ``sent_at`` is the alert's event time."""
    keyed = with_alert_key(alerts)
    sent = cooldown_sent(keyed, ("alert_key",), "timestamp", seq_cols, cooldown)
    return sent.select("alert_key", notification_text().alias("text"),
                       F.timestamp_seconds("timestamp").alias("sent_at"), *seq_cols)


def merge_history(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ("city", "metric", "alert_type"),
                  order: Sequence[str] = ("detected_at", "timestamp")) -> DataFrame:
    """Union stored and new alerts and keep the last per key (new wins over
    stored), newest reading first.

    No new alerts: the stored history unchanged."""
    s = stored.withColumn("_src", F.lit(0))
    n = new.withColumn("_src", F.lit(1))
    both = s.unionByName(n, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in keys and c != "_src"]
    agg = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("_src", *order)).alias("_r"))
    return agg.select(*keys, "_r.*").select(*[c for c in stored.columns]).orderBy(F.col(order[-1]).desc(), *keys)


def alert_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                      F.count_if(F.col("severity") == "high").alias("high_severity"),
                      F.count_distinct("city").alias("cities_affected"))


def alert_histogram(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("city", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def filter_alerts(alerts: DataFrame, severities: Sequence[str] | None = None, last_hours: int | None = None,
                  now=None) -> DataFrame:
    """Severity IN filter (empty = all) and an inclusive last-N-hours window on
    ``detected_at`` relative to ``now`` (a literal or a Column)."""
    out = alerts
    if severities:
        out = out.where(F.col("severity").isin(list(severities)))
    if last_hours is not None:
        now_c = now if now is not None and not isinstance(now, str) else F.lit(now).cast("timestamp")
        out = out.where(F.col("detected_at") >= now_c - F.expr(f"INTERVAL {int(last_hours)} HOURS"))
    return out
