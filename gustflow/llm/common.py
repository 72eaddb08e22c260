"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gustflow.session import prepare, work_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage at a table every executor can read, so a lost executor costs
    a re-read, not a recomputation."""
    spark = df.sparkSession
    path = work_path(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``written`` with the rows in as many buckets of ``key`` as there are
    shuffle partitions: grouping or joining by ``key`` then moves only the
    other side.  The table lives in the session's catalog, its files in the
    shared folder."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", work_path(spark, "llm", name))
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table))
    return spark.table(table)


def bucket_of(col: Column, buckets: int) -> Column:
    """crc32 of the decimal text of ``col`` modulo ``buckets``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(buckets)


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Row identity: repeated identical rows share it, two texts under one
    doc_id do not."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, component) for every row of ``vertices(id)``: component = smallest
    id reachable over the undirected ``edges(a, b)``.

    Alternating large-star / small-star contraction: every round is two
    group-bys over the edge list, which never grows beyond its first size
    (each star re-hangs edges, it adds none), and the number of rounds is
    logarithmic in the component's diameter.  A hub is a hot key only as the
    group's minimum, an aggregation that combines on the map side; re-hanging
    is a join that adaptive skew splitting can cut.  Every round is written
    to the shared folder.  Rounds go on until one changes nothing; with
    ``max_rounds``, labels that have not settled by then are an error.
    """
    e = (edges.where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = written(e, "edges")
    last, rounds, settled = None, 0, e.isEmpty()
    while not settled:
        if rounds == max_rounds:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
        rounds += 1
        # large star: hang every larger neighbour on the smallest neighbour (or itself)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: hang smaller neighbours and the vertex on the smallest
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (big.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        e = written(small, "edges")
        sig = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        settled, last = sig == last, sig
    labels = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return vertices.select("id").distinct().join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def rounds_for(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n))))
