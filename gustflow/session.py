"""Session helpers: a tuned local session for tests and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


_SHARED: dict[str, str] = {}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "gustflow",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**_LOCAL_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    if not conf or "spark.sql.shuffle.partitions" not in conf:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("GUSTFLOW_DRIVER_MEMORY", "4g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 192 << 20,
               state_store: str = "rocksdb") -> dict[str, str]:
    """Settings for a run over ``input_bytes`` on ``cores`` executor cores.

    * shuffle partitions: enough that a partition is about
      ``target_partition_bytes``, and at least one task per core; AQE then
      coalesces small ones and splits skewed ones at run time;
    * scan splits of 256 MB (fewer, larger tasks over Parquet);
    * streaming state in RocksDB (off-heap, spills, changelog checkpoints)
      so dedupe / window / cooldown state is not bounded by the JVM heap.
    Streaming queries freeze their shuffle partition count in the
    checkpoint, so size it for the expected peak before the first start."""
    parts = max(int(cores), -(-int(input_bytes) // int(target_partition_bytes)))
    conf = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.session.timeZone": "UTC",
    }
    if state_store == "rocksdb":
        conf["spark.sql.streaming.stateStore.providerClass"] = (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        conf["spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"] = "true"
    return conf


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings every operator relies on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gustflow`` importable in Python workers (grouped pandas and
    stateful pandas operators pickle their functions by module reference).
    The package is zipped once per SparkContext into the shared folder and
    added with ``addPyFile``, which distributes it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(shared_dir(spark), f"gustflow-{uuid.uuid4().hex[:8]}.zip")
    if "://" in target and not target.startswith("file:"):
        # remote shared folder: build locally, Spark copies it to executors
        target = os.path.join(tempfile.mkdtemp(prefix="gustflow-py-"), "gustflow.zip")
    target = target.replace("file:", "")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the
    operator of the cluster.  Only when it is unset (local tests) a
    folder is created and registered.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHARED:
        return _SHARED[key]
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        current = sc.getCheckpointDir()
    if not current and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not current:
        # Local master, nothing configured: take a private folder.
        current = tempfile.mkdtemp(prefix="gustflow-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    _SHARED[key] = current.rstrip("/")
    return _SHARED[key]


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared folder, computing
    the plan once: persisted first, so the checkpoint write reads the cached
    blocks instead of re-running the plan, then unpersisted."""
    from pyspark import StorageLevel
    shared_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint()
    cached.unpersist()
    return out


def work_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the shared folder (unique per call)."""
    return "/".join([shared_dir(spark), *parts, uuid.uuid4().hex])
