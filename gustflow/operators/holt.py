"""Holt's additive-trend smoothing as a scan of affine maps, for all series at once.

With the one-step error ``e = y - (level + trend)`` a step is
``level += trend + alpha * e; trend += alpha * beta * e``: affine in the state
(level, trend).  A block of consecutive points is therefore one affine map,
and its squared error one quadratic form of the state it starts from, so the
blocks of a series are worked out independently, in any task, and composed
afterwards.  Level starts at ``y[0]`` and trend at ``y[1] - y[0]``; the state
a series' first block starts from is known, so it runs the recursion itself.

(alpha, beta) is the least one-step SSE over 0.05, 0.10 .. 0.95 squared, then
over that pair +- 0.045 in steps of 0.005 (ties: least alpha, then beta).
The maps of a block under all pairs are numpy steps in ``mapInArrow``, one
block of ``block`` points at a time (with the built-in ``aggregate``, whose
lambdas are interpreted once a point and pair, ``forecast_holt`` at sf0.1 took
26 s instead of 8 s with the same rows); all else is built-in expressions, and the
composition holds one small map per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: points of a block
BLOCK = 2048


def _grid(lo: Column, step: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (lo + j) / step)


def _pairs(alphas: Column, betas: Column) -> Column:
    return F.flatten(F.transform(alphas, lambda a: F.transform(betas, lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _clip(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(0.999)), F.lit(0.001))


def blocks_of(series: DataFrame, keys: Sequence[str], step: int, block: int = BLOCK) -> DataFrame:
    """(keys, e, ds0, ys): the points of a regular series in blocks of clock time."""
    e = F.floor(F.unix_seconds("ds") / F.lit(step * block)).alias("e")
    point = F.struct("ds", F.col("y").cast("double").alias("y"))
    return (series.select(*keys, e, point.alias("p")).groupBy(*keys, "e")
            .agg(F.array_sort(F.collect_list("p")).alias("p"))
            .select(*keys, "e", F.col("p")[0]["ds"].alias("ds0"), F.col("p")["y"].alias("ys")))


def lengths(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: n and its first ds (one row a block is read)."""
    return blocks.groupBy(*keys).agg(F.sum(F.size("ys")).cast("long").alias("n"), F.min("ds0").alias("first_ds"))


def training(blocks: DataFrame, spans: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """The blocks of the first ``n_fit`` points of every series in ``spans``
    (keys, first_ds, n_fit), each with ``i0``, the position of its first point."""
    i0 = ((F.unix_seconds("ds0") - F.unix_seconds("first_ds")) / step).cast("int")
    return (blocks.join(spans.select(*keys, "first_ds", "n_fit"), list(keys)).withColumn("i0", i0)
            .where(F.col("i0") < F.col("n_fit"))
            .select(*keys, "e", "i0", F.slice("ys", F.lit(1), F.least(F.size("ys"), (F.col("n_fit") - F.col("i0")).cast("int"))).alias("ys")))


def starts(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: e0 (its first block) and the start (y0, y1 - y0)."""
    head = F.struct("e", F.slice("ys", 1, 2).alias("ys"))
    two = train.where(F.col("i0") < 2).groupBy(*keys).agg(F.array_sort(F.collect_list(head)).alias("h"))
    ys = F.flatten(F.col("h")["ys"])
    return two.select(*keys, F.col("h")[0]["e"].alias("e0"), F.get(ys, F.lit(0)).alias("y0"),
                      (F.get(ys, F.lit(1)) - F.get(ys, F.lit(0))).alias("d0"))


#: a block's map: where the state (ref, 0) ends (l, b), the rows (p, q) and
#: (u, w) that a departure x from it is multiplied by, and its squared error
#: ss - 2 v.x + x.W.x
_MAP = ("l", "b", "p", "q", "u", "w", "v1", "v2", "w11", "w12", "w22", "ss")


def _run(ys: np.ndarray, a: np.ndarray, ab: np.ndarray, level: float, trend: float) -> dict[str, np.ndarray]:
    """The recursion from a known state: a map that ignores the state it is given."""
    l, b, ss = np.full(a.shape, level), np.full(a.shape, trend), np.zeros(a.shape)
    for y in ys:
        e = y - (l + b)
        l, b, ss = l + b + a * e, b + ab * e, ss + e * e
    return {"l": l, "b": b, "ss": ss}


def _summarise(ys: np.ndarray, a: np.ndarray, ab: np.ndarray) -> dict[str, np.ndarray]:
    """The map of a block whose first state is not known yet."""
    zero, one = np.zeros(a.shape), np.ones(a.shape)
    l, b, p, q, u, w = one * ys[0], zero, one, zero, zero, one
    v1, v2, w11, w12, w22, ss = (zero,) * 6
    for y in ys:
        e = y - (l + b)
        x, z = p + u, q + w  # the prediction's row: level plus trend
        v1, v2, w11, w12, w22, ss = v1 + e * x, v2 + e * z, w11 + x * x, w12 + x * z, w22 + z * z, ss + e * e
        kp, ku = p * a + q * ab, u * a + w * ab
        l, b, p, q, u, w = l + b + a * e, b + ab * e, p - kp, p + q - kp, u - ku, u + w - ku
    return dict(zip(_MAP, (l, b, p, q, u, w, v1, v2, w11, w12, w22, ss)))


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to every block the maps of all its pairs, one numpy step per point."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1)
            ys = r.column("ys").flatten().to_numpy(zero_copy_only=False)
            pairs = r.column("pairs").flatten()
            a, b = (pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            e, e0, i0 = (r.column(c)[0].as_py() for c in ("e", "e0", "i0"))
            with np.errstate(all="ignore"):
                if e == e0 or i0 == 1:
                    m = _run(ys[1:] if e == e0 else ys, a, a * b, r.column("y0")[0].as_py(), r.column("d0")[0].as_py())
                else:
                    m = _summarise(ys, a, a * b)
            fields = [pa.array(m[k] if k in m else np.zeros(a.shape), pa.float64()) for k in _MAP]
            rows = pa.StructArray.from_arrays([pa.array(a), pa.array(b), *fields], ["alpha", "beta", *_MAP])
            maps_ = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            key = [r.column(c) for c in range(r.schema.get_field_index("e"))]
            yield pa.RecordBatch.from_arrays([*key, r.column("e"), pa.array([ys[0]], pa.float64()), maps_],
                                             [*r.schema.names[:len(key)], "e", "ref", "maps"])


def maps(train: DataFrame, first: DataFrame, pairs: DataFrame | Column, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b, e, ref, m): the map of every block under every pair."""
    rows = train.join(first, list(keys))
    rows = rows.withColumn("pairs", pairs) if isinstance(pairs, Column) else rows.join(pairs, list(keys))
    n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *keys, "e").select(*keys, "e", "e0", "i0", "y0", "d0", "ys", "pairs")
    schema = T.StructType([train.schema[k] for k in keys] + [
        T.StructField("e", T.LongType()), T.StructField("ref", T.DoubleType()),
        T.StructField("maps", T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("alpha", "beta", *_MAP)])))])
    return (rows.mapInArrow(_block_maps, schema).select(*keys, "e", "ref", F.explode("maps").alias("m"))
            .select(*keys, F.col("m.alpha").alias("a"), F.col("m.beta").alias("b"), "e", "ref", "m"))


def composed(mapped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b, level, trend, sse) after all blocks of a series, in order."""
    chain = F.array_sort(F.collect_list(F.struct("e", "ref", "m")))

    def step(s, x):
        m, d, t = x["m"], s["l"] - x["ref"], s["b"]
        return F.struct(
            (m["l"] + m["p"] * d + m["q"] * t).alias("l"), (m["b"] + m["u"] * d + m["w"] * t).alias("b"),
            (s["ss"] + m["ss"] - F.lit(2.0) * (m["v1"] * d + m["v2"] * t)
             + m["w11"] * d * d + F.lit(2.0) * m["w12"] * d * t + m["w22"] * t * t).alias("ss"))
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), F.lit(0.0).alias("ss"))
    return (mapped.groupBy(*keys, "a", "b").agg(chain.alias("c"))
            .withColumn("s", F.aggregate("c", zero, step))
            .select(*keys, "a", "b", F.col("s")["l"].alias("level"), F.col("s")["b"].alias("trend"), F.col("s")["ss"].alias("sse")))


def best(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pair of least finite SSE; series without one are left out."""
    finite = F.abs("sse") < F.lit(float("inf"))
    return (runs.where(finite).groupBy(*keys)
            .agg(F.min_by(F.struct("a", "b", "level", "trend"), F.struct("sse", "a", "b")).alias("f")).select(*keys, "f.*"))


def fit(train: DataFrame, keys: Sequence[str], alpha: float | None = None, beta: float | None = None) -> DataFrame:
    """(keys, a, b, level, trend) of every series with a finite fit; (alpha, beta) fixed or searched."""
    first = starts(train, keys)
    run = lambda pairs: best(composed(maps(train, first, pairs, keys), keys), keys)
    if alpha is not None and beta is not None:
        return run(F.array(F.struct(F.lit(float(alpha)).alias("a"), F.lit(float(beta)).alias("b"))))
    coarse = _grid(F.lit(1), F.lit(20.0), 19)
    near = run(_pairs(coarse, coarse))
    fine = _grid(F.lit(-9), F.lit(200.0), 19)
    around = lambda c: F.transform(fine, lambda f: _clip(F.col(c) + f))
    return run(near.select(*keys, _pairs(around("a"), around("b")).alias("pairs")))
