"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by ``3`` rounds of random signs and a fast Hadamard
transform; the nearest signed axis is one hash.  A table concatenates
``width`` such hashes; each vector is put into its ``PROBES`` best buckets of
every table (the runner-up axes give the further probes).  Vectors sharing a
bucket are candidates, and every candidate pair is verified by its exact
cosine in double precision.

Identical vectors are one class with a weight.  A bucket is worked through in
blocks of ``BLOCK`` classes: a large bucket is many independent (block,
block) tasks, so no task holds an unbounded group.  A pair meeting in several
buckets is counted only in the first of them, found from both vectors'
bucket lists, so counts need no pairs to be written: a task emits one count
per class and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gustflow.llm.common import components, digest, written
from gustflow.llm.text import ragged

TABLES = 16  # at least; more for wide hashes, see tables_for
PROBES = 3
THRESHOLD = 0.95
RECALL = 0.9999
BLOCK = 1024
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def buckets(x: np.ndarray, width: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) bucket numbers of unit vectors."""
    n, d = x.shape
    size = 1 << max(1, math.ceil(math.log2(d)))
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        code = np.zeros((n, probes), np.int64)
        lost = np.full((n, width), np.inf)
        second = np.zeros((n, width), np.int64)
        first = np.zeros((n, width), np.int64)
        for w in range(width):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            a = np.abs(y)
            two = np.argpartition(-a, 1, axis=1)[:, :2]
            swap = a[rows, two[:, 0]] < a[rows, two[:, 1]]
            two[swap] = two[swap][:, ::-1]
            first[:, w], second[:, w] = (2 * two[:, k] + (y[rows, two[:, k]] < 0) for k in (0, 1))
            lost[:, w] = a[rows, two[:, 0]] - a[rows, two[:, 1]]
        base = (2 * size) ** np.arange(width, dtype=np.int64)
        code[:, 0] = first @ base
        cheapest = np.argsort(lost, axis=1)  # probe p > 0: the p-th cheapest axis change
        for p in range(1, probes):
            k = cheapest[:, min(p, width) - 1]
            code[:, p] = code[:, 0] + (second[rows, k] - first[rows, k]) * base[k]
        out[:, t] = code
    return out


def width_for(n: int, d: int) -> int:
    """Hashes per table so unrelated vectors rarely share a bucket."""
    axes = 2 << max(1, math.ceil(math.log2(max(2, d))))
    return max(1, min(62 // int(math.log2(axes)), math.ceil(math.log(max(2, n)) / math.log(axes))))


def table_chance(width: int, d: int, threshold: float = THRESHOLD, probes: int = PROBES, pairs: int = 256, tables: int = 4) -> float:
    """Estimated chance that two vectors with a cosine of ``threshold`` share
    a bucket of one table: random pairs, hashed."""
    rng = np.random.default_rng(SEED + 1)
    x, y = rng.normal(size=(2, pairs, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    a, b = (buckets(v, width, tables, probes, SEED + 1) for v in (x, threshold * x + math.sqrt(max(0.0, 1 - threshold ** 2)) * y))
    return float((a[:, :, :, None] == b[:, :, None, :]).any((2, 3)).mean())


def tables_for(width: int, d: int, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL) -> int:
    """Tables that find a pair at the threshold with a chance of ``recall``:
    a wider hash parts it more often.  A power of two, so a bucket's name
    modulo the tables is its table even where the name wraps."""
    chance = min(max(table_chance(width, d, threshold, probes), 1e-3), 1 - 1e-9)
    need = math.log(1 - recall) / math.log(1 - chance)
    return max(TABLES, 1 << math.ceil(math.log2(max(1.0, need))))


def unit(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, offsets, values): unit vectors in double precision and the rows
    that have one: not null, no null or non-finite component, not zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.diff(col.offsets.to_numpy()).astype(np.int64)
    if col.null_count:
        size[col.is_null().to_numpy(zero_copy_only=False)] = 0
    start = col.offsets.to_numpy()[:-1].astype(np.int64)
    has = np.flatnonzero(size)
    x = col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[ragged(start[has], size[has])]  # null: nan
    first = np.cumsum(size[has]) - size[has]
    top = np.maximum.reduceat(np.abs(x), first) if len(has) else np.zeros(0)  # nan and inf come through
    good = np.isfinite(top) & (top > 0)
    x, has, top = x[np.repeat(good, size[has])], has[good], top[good]
    first = np.cumsum(size[has]) - size[has]
    x = x / np.repeat(top, size[has])  # before squaring: no overflow or underflow
    norm = np.sqrt(np.add.reduceat(x * x, first)) if len(has) else np.zeros(0)
    return has, np.append(first, len(x)), x / np.repeat(norm, size[has])


def classes(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, key, unit) for every row: key names identical unit vectors and
    is null, as is unit, for a row without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has, offsets, x = unit(b.column("v"))
            keys = [digest(x[s:e].tobytes()) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            vectors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x))
            place = np.full(b.num_rows, -1)
            place[has] = np.arange(len(has))
            place = pa.array(place, mask=place < 0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()).take(place), vectors.take(place)], ["vec_id", "key", "unit"])

    return table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(
        run, "vec_id long, key binary, unit array<double>")


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                    tables: int | None = None, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table``.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest vec_id reachable.  Every row's vector is compared: rows that share
    a vec_id are joined in one component, whether or not their vectors link,
    and repeated rows link with each other.  A null vec_id names nothing: such
    a row takes part by its vector, its component_id is the smallest vec_id it
    reaches (null if none), and it is kept if it reaches none.  Vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing and are components of their own, and vectors of different length
    don't link.  An empty table gives an empty result; other columns are
    ignored.
    """
    named = written(classes(table, vec_id, embedding), "vectors")
    reps = named.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("unit")).alias("d")).first()
    width = width_for(size["n"], size["d"] or 2)
    tables = tables or tables_for(width, size["d"] or 2, threshold, probes)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("unit")
            d = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            starts = np.cumsum(d) - d
            for one in np.unique(d):
                own = np.flatnonzero(d == one)
                x = flat[starts[own][:, None] + np.arange(one)]
                code = buckets(x, width, tables, probes)
                # one bucket name per table, probe target and dimension
                name = (code * tables + np.arange(tables)[None, :, None]).reshape(len(own), -1)
                yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(own)), pa.array(name.tolist(), pa.list_(pa.int64()))], ["rep", "buckets"])

    hashed = written(reps.select("rep", "unit").mapInArrow(hashes, "rep long, buckets array<long>").join(reps, "rep"), "hashed")
    member = hashed.select("rep", F.size("unit").alias("dim"), F.explode(F.array_distinct("buckets")).alias("bucket"))
    filled = (member.groupBy("bucket", "dim").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
              .withColumn("blocks", F.ceil(F.col("held") / block).cast("int")))
    placed = member.join(filled, ["bucket", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # each block meets every block once: pair (i, j), i <= j, holds the rows of both
    placed = placed.select("rep", "dim", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = placed.select("rep", "bucket", "dim", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    loaded = cells.join(hashed, "rep").repartition("bucket", "dim", "i", "j").sortWithinPartitions("bucket", "dim", "i", "j", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, n, x, names, own, cell in _groups(batches, tables):
            got = _links(x, names, own, cell, threshold)
            if got is None:
                continue
            a, b = got
            count = np.bincount(a, n[b], minlength=len(rep)) + np.bincount(b, n[a], minlength=len(rep))
            forest = _forest(len(rep), a, b)
            has = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[has], rep[forest[:, 0]]])), pa.array(np.concatenate([count[has].astype(np.int64), np.zeros(len(forest), np.int64)])),
                 pa.array(np.concatenate([rep[has], rep[forest[:, 1]]]))], ["a", "links", "b"])

    found = written(loaded.select("rep", "n", "unit", "buckets", "bucket", "dim", "i", "j", "own").mapInArrow(verify, "a long, links long, b long"), "links")
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    # one vec_id on several classes joins them
    held = named.where("vec_id is not null and key is not null").select("vec_id", "key").distinct().join(reps.select("key", "rep"), "key")
    several = held.groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").select("vec_id", "b")
    edges = found.where("a <> b").select("a", "b").union(held.join(several, "vec_id").select(F.col("rep").alias("a"), "b"))
    parts = components(reps.select(F.col("rep").alias("id")), edges).withColumnRenamed("id", "rep")
    low = parts.join(reps.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("smallest"))
    per_class = reps.select("key", "rep", "n").join(links, "rep", "left").join(parts.join(low, "component").select("rep", "smallest"), "rep")
    out = named.select("vec_id", "key").join(per_class, "key", "left")
    component = F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"))


def _groups(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[tuple]:
    """Runs of equal (bucket, dim, i, j) in sorted input, as arrays."""
    held: list[pa.RecordBatch] = []

    def emit():
        t = pa.Table.from_batches(held).combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        d = int(col("dim")[0])
        x = t.column("unit").combine_chunks().flatten().to_numpy().reshape(-1, d)
        names = t.column("buckets").combine_chunks().flatten().to_numpy().reshape(t.num_rows, tables, -1)
        return col("rep"), col("n"), x, names, col("own"), (int(col("bucket")[0]), int(col("i")[0]), int(col("j")[0]))

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("bucket", "dim", "i", "j")], 1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = tuple(keys[s].tolist())
            if held and key != last:
                if sum(h.num_rows for h in held) > 1:
                    yield emit()
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held and sum(h.num_rows for h in held) > 1:
        yield emit()


def _links(x: np.ndarray, names: np.ndarray, own: np.ndarray, cell: tuple[int, int, int], threshold: float):
    """Index pairs of the cell's links that meet in no earlier bucket."""
    bucket, i, j = cell
    left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
    if not len(left) or not len(right):
        return None
    a, b = np.nonzero(x[left] @ x[right].T >= threshold - 1e-9)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    exact = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
    a, b = a[exact], b[exact]
    if not len(a):
        return None
    # names are (row, table, probe); a bucket's table is its name modulo the tables
    table = bucket % names.shape[1]
    for t in range(table):  # a pair that meets in an earlier table is counted there
        apart = ~(names[a, t][:, :, None] == names[b, t][:, None, :]).any((1, 2))
        a, b = a[apart], b[apart]
        if not len(a):
            return None
    na, nb = names[a, table], names[b, table]
    least = np.where((na[:, :, None] == nb[:, None, :]).any(2), na, np.iinfo(np.int64).max).min(1)
    mine = least == bucket
    return (a[mine], b[mine]) if mine.any() else None


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges that keep the links' components, at most n - 1."""
    root = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((max(x, y), min(x, y)))
    return np.array(out, np.int64).reshape(-1, 2)
