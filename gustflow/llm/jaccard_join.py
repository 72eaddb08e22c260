"""Exact Jaccard join of word-shingle sets with set-relation skipping.

Two documents link when their sets of distinct ``K``-word shingles have a
Jaccard similarity of at least ``PERCENT`` / 100.  Equal sets are one class.

1. Sharing test.  A set of n shingles and any partner differ in at most
   m = n - ceil(0.8 n) of them, so among any m + l of its shingles at least l
   lie in the partner.  The m + l least-hashed shingles of every set are
   looked up in a distributed table; a set with fewer than l of them in any
   other set has no partner and leaves the join.  Texts that merely share a
   passage leave here.
2. Prefix index.  The rest order their shingles by corpus frequency (a fixed
   size sketch, only an order) and index the first m + 1: linked sets share
   an indexed shingle.
3. Answers by set relation.  Every set is compared with one leader it shares
   most indexed shingles with; a set linked to its leader joins the leader's
   cluster.  In each index list the entries of a cluster form a block with
   its best size and position, and two blocks are skipped unless these allow
   a link.  Clusters that meet are compared by their leaders, once; since
   |x & y| <= |X & Y| + |x - X| + |y - Y| for members x, y of leaders X, Y,
   the members' answers follow from the leaders' overlap except for the pairs
   the bound leaves open, and only those are compared.
4. The components of the links.  Members of one cluster are connected through
   the leader, so no cluster is ever expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gustflow.llm.common import components, digest, written
from gustflow.llm.text import Words, chunks, gram_hash, mix

K = 5
PERCENT = 80
SKETCH_BITS = 20
SLICE_BITS = 16
BUCKET_BITS = 10
CHUNK = 8 << 20
#: Times the sets without a leader elect one; a later round only saves comparisons.
STAR_ROUNDS = 2
NO_ID = -(1 << 63)


def shingles(col: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every text's distinct shingles, by row, then hash.
    Hashing takes some 50 bytes a byte of text, so it goes slice by slice."""
    at, rows, values = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for piece in chunks([pa.RecordBatch.from_arrays([col], ["text"])]):
        row, value = _shingles(piece.column("text"), k)
        rows.append(row + at)
        values.append(value)
        at += piece.num_rows
    return np.concatenate(rows), np.concatenate(values)


def _shingles(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = Words(col, lower=True)
    h = w.hash
    grams = gram_hash(h, k)
    start = np.flatnonzero(w.doc[:len(grams)] == w.doc[k - 1:]) if len(grams) else np.zeros(0, np.int64)
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < k))
    extra = np.array([gram_hash(h[w.first[i]:w.first[i + 1]], int(size[i]))[0] for i in short], np.uint64)
    row, value = np.concatenate([w.doc[start], short]), np.concatenate([grams[start], extra])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def allowance(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def spare(n: np.ndarray) -> np.ndarray:
    """l of the sharing test."""
    return 1 + n // 16


def needed(na: Column, nb: Column, percent: int = PERCENT) -> Column:
    """Least overlap of linked sets: o * (100 + p) >= p * (na + nb)."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def _base(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, value = shingles(b.column("text"), k)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            names = [digest(value[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("d"), b.column("k"), pa.array(np.diff(cut), pa.int64()), pa.array(names, pa.binary())], ["doc_id", "d", "k", "n", "fp"])
    return run


def sharing(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(fp) of the sets that pass the sharing test (a superset of the linked
    ones).

    A task packs the shingles of a chunk of texts by hash bucket, eight bytes
    each; equal shingles of a chunk are one entry, so a shingle in a third of
    all texts costs one entry a chunk.  Buckets report shared entries back to
    their chunk, where each text's count is completed.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        for big in chunks(batches, max_bytes=CHUNK):
            for at in range(0, big.num_rows, 1 << 16):
                b = big.slice(at, 1 << 16)
                row, value = shingles(b.column("text"), k)
                cut = np.searchsorted(row, np.arange(b.num_rows + 1))
                n = np.diff(cut)
                names = [digest(value[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
                first = {}
                for i, name in enumerate(names):
                    first.setdefault(name, i)
                lone = np.zeros(b.num_rows, bool)  # one of equal sets stands for all
                lone[list(first.values())] = True
                least = np.arange(len(row)) - cut[row] < (allowance(n, percent) + spare(n))[row]
                use = least & lone[row]
                row, value = row[use], value[use]
                order = np.argsort(value, kind="stable")
                row, value = row[order], value[order]
                new = np.ones(len(value), bool)
                new[1:] = value[1:] != value[:-1]
                group = np.cumsum(new) - 1
                many = np.bincount(group, minlength=int(new.sum()))[group] > 1 if len(group) else new
                here = np.bincount(row[many], minlength=b.num_rows)
                chunk, seq = (part << 32) | seq, seq + 1
                own = np.flatnonzero(lone & (n > 0))
                meta = b"".join(names[i] for i in own.tolist()) + own.astype("<u4").tobytes() + (spare(n)[own] - here[own]).astype("<i4").tobytes()
                # one entry a distinct shingle; the row of a shared one is settled here already
                entry = ((value[new] << np.uint64(BUCKET_BITS)) & ~np.uint64(0xFFFF)) | row[new].astype(np.uint64)
                bucket = (value[new] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                done = many[new]
                ids, starts = np.unique(bucket, return_index=True)
                ends = np.append(starts[1:], len(bucket))
                blobs = [entry[s:e].tobytes() + np.packbits(done[s:e]).tobytes() for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * (len(ids) + 1), pa.int64()), pa.array([*ids.tolist(), -1 - chunk % 4093], pa.int32()),
                     pa.array([*(ends - starts).tolist(), len(own)], pa.int32()), pa.array([*blobs, meta], pa.binary())], ["chunk", "bucket", "n", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        last = None

        def emit():
            entries = [np.frombuffer(d, "<u8", n) for _, n, d in held]
            done = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8, -1, 8 * n), count=n) for _, n, d in held]).astype(bool)
            flat = np.concatenate(entries)
            name = flat >> np.uint64(16)
            order = np.argsort(name, kind="stable")
            same = name[order][1:] == name[order][:-1]
            shared = np.zeros(len(flat), bool)
            shared[order[1:][same]] = True
            shared[order[:-1][same]] = True
            shared &= ~done
            out, at = [], 0
            for (chunk, n, _), e in zip(held, entries):
                hit = (e[shared[at:at + n]] & np.uint64(0xFFFF)).astype("<u2")
                at += n
                if len(hit):
                    out.append((chunk, len(hit), hit.tobytes()))
            return out

        for b in batches:
            out = []
            for chunk, bucket, n, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "bucket", "n", "data"))):
                if bucket < 0:
                    out.append((chunk, -n, data))
                    continue
                if bucket != last and held:
                    out += emit()
                    held = []
                last = bucket
                held.append((chunk, n, data))
            if out:
                yield _triples(out)
        if held:
            out = emit()
            if out:
                yield _triples(out)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, meta, hits = None, None, np.zeros(0, np.int64)

        def emit():
            names, own, need = meta
            return [names[16 * i:16 * i + 16] for i in np.flatnonzero(hits[own] >= need).tolist()]

        for b in batches:
            out = []
            for chunk, n, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "n", "data"))):
                if chunk != last:
                    if meta is not None:
                        out += emit()
                    last, meta, hits = chunk, None, np.zeros(1 << 16, np.int64)
                if n <= 0:
                    n = -n
                    meta = data[:16 * n], np.frombuffer(data, "<u4", n, 16 * n).astype(np.int64), np.frombuffer(data, "<i4", n, 20 * n)
                else:
                    np.add.at(hits, np.frombuffer(data, "<u2").astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["fp"])
        if meta is not None:
            yield pa.RecordBatch.from_arrays([pa.array(emit(), pa.binary())], ["fp"])

    packed = rows.select("text").mapInArrow(pack, "chunk long, bucket int, n int, data binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "chunk long, n int, data binary")
    return met.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(settle, "fp binary").distinct()


def _triples(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], ["chunk", "n", "data"])


def sketch(sets: DataFrame) -> np.ndarray:
    """Counts of shingles by hash prefix: 2**SKETCH_BITS numbers, whatever
    the corpus; summed by slice on the executors."""
    per = 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for data in b.column("shingles").to_pylist():
                np.add.at(total, (np.frombuffer(data, "<u8") >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        yield _slices(total, per)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, data in zip(b.column("slice").to_pylist(), b.column("data").to_pylist()):
                total[s] = total.get(s, 0) + np.frombuffer(data, "<i8")
        for s, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["slice", "data"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in sets.select("shingles").mapInArrow(count, "slice int, data binary").repartition("slice").mapInArrow(add, "slice int, data binary").collect():
        out[r["slice"] * per:(r["slice"] + 1) * per] = np.frombuffer(bytes(r["data"]), "<i8")
    return out


def _slices(total: np.ndarray, per: int) -> pa.RecordBatch:
    parts = [(i, p.tobytes()) for i, p in enumerate(total.reshape(-1, per)) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["slice", "data"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, o) for pairs (a, b) of set names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(o, pa.int64())], ["a", "b", "na", "nb", "o"])

    x = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a binary, b binary, na long, nb long, o long")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) whose components are those of all linked pairs."""
    order = sets.sparkSession.sparkContext.broadcast(sketch(sets))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, copies, n, data in zip(*(b.column(c).to_pylist() for c in ("fp", "copies", "n", "shingles"))):
                value = np.frombuffer(data, "<u8")
                often = order.value[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                m = int(allowance(np.array(n), percent)) + 1
                own = value[np.lexsort((mix(value), often))[:m]].view(np.int64)
                usual = int(np.log2(1 + often).sum() * 1000 / n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fp] * m, pa.binary()), pa.array(np.full(m, copies)), pa.array(np.full(m, n)), pa.array(own), pa.array(np.arange(m)), pa.array(np.full(m, usual))],
                    ["fp", "copies", "n", "h", "pos", "usual"])

    entries = written(sets.mapInArrow(index, "fp binary, copies long, n long, h long, pos long, usual long"), "index")
    entries = entries.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent))))
    good = F.col("o") >= needed(F.col("na"), F.col("nb"), percent)
    star, waiting = None, entries
    for _ in range(STAR_ROUNDS):
        # the set with most copies and the most usual shingles leads: a group's original rather than an edit of it
        leaders = waiting.groupBy("h", "band").agg(F.max(F.struct("copies", "usual", "fp")).alias("lead"), F.count(F.lit(1)).alias("held")).where("held > 1")
        votes = (waiting.join(leaders, ["h", "band"]).where(F.col("fp") != F.col("lead.fp"))
                 .groupBy("fp", "lead").agg(F.count(F.lit(1)).alias("votes")))
        first = votes.groupBy("fp").agg(F.max_by("lead.fp", F.struct("votes", "lead")).alias("b")).select(F.col("fp").alias("a"), "b")
        found = written(overlaps(first, sets).where(good), "stars")
        star = found if star is None else star.unionByName(found)
        settled = found.select(F.col("a").alias("fp")).union(found.select("b")).distinct()
        waiting = waiting.join(settled, "fp", "left_anti")
    # a set belongs to its leader's cluster, or to its own; slack = |x - X|
    member = written(sets.select("fp", "n").join(star.select(F.col("a").alias("fp"), F.col("b").alias("leader"), "o"), "fp", "left").select(
        "fp", "n", F.coalesce("leader", "fp").alias("c"), F.when(F.col("leader").isNull(), 0).otherwise(F.col("n") - F.col("o")).alias("slack")), "members")
    blocks = (entries.select("fp", "n", "h", "pos").join(member.select("fp", "c"), "fp").groupBy("h", "c")
              .agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest")))
    p, q = blocks.select("h", *[F.col(x).alias(x + "1") for x in ("c", "lo", "hi", "rest")]), blocks.select("h", *[F.col(x).alias(x + "2") for x in ("c", "lo", "hi", "rest")])
    open_ = ((F.col("c1") < F.col("c2")) & (100 * F.col("hi1") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo1"))
             & (F.least("rest1", "rest2") >= needed(F.col("lo1"), F.col("lo2"), percent)))
    meets = p.join(q, "h").where(open_).select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()
    meets = written(overlaps(meets, sets), "meetings")
    linked = star.select("a", "b").union(meets.where(good).select("a", "b"))
    early = written(components(sets.select(F.col("fp").alias("id")), linked), "early")  # clusters already connected need no more links
    widest = member.groupBy("c").agg(F.max("slack").alias("slack"), F.min("n").alias("least"))
    near = (meets.join(widest.select(F.col("c").alias("a"), F.col("slack").alias("s1"), F.col("least").alias("l1")), "a")
            .join(widest.select(F.col("c").alias("b"), F.col("slack").alias("s2"), F.col("least").alias("l2")), "b")
            .where((F.col("o") + F.col("s1") + F.col("s2") >= needed(F.col("l1"), F.col("l2"), percent)) & ~good)
            .join(early.select(F.col("id").alias("a"), F.col("component").alias("p1")), "a").join(early.select(F.col("id").alias("b"), F.col("component").alias("p2")), "b")
            .where("p1 <> p2").select("a", "b", "o"))
    one = member.select(F.col("fp").alias("x"), F.col("n").alias("nx"), F.col("c").alias("a"), F.col("slack").alias("sx"))
    two = member.select(F.col("fp").alias("y"), F.col("n").alias("ny"), F.col("c").alias("b"), F.col("slack").alias("sy"))
    left = (near.join(one, "a").join(two, "b").where(
        (F.col("o") + F.col("sx") + F.col("sy") >= needed(F.col("nx"), F.col("ny"), percent)) & (100 * F.col("nx") >= percent * F.col("ny")) & (100 * F.col("ny") >= percent * F.col("nx")))
        .select(F.col("x").alias("a"), F.col("y").alias("b")))
    rest = written(overlaps(left, sets).where(good), "rest")
    return linked.union(rest.select("a", "b"))


def classes(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, d, k, n_shingles, component_id, part) per row; part names the
    component by a set of it, as two components may share a doc_id.

    Null, empty and wordless texts have an empty set and link with nothing;
    so does a row with a null doc_id (component_id null); their part is null.  Rows with equal
    sets are linked, repeated ones included.  An empty table gives an empty
    result; other columns are ignored.
    """
    rows = _rows(docs)
    base = written(rows.mapInArrow(_base(k), "doc_id long, d long, k long, n long, fp binary"), "sets_base")
    named = base.where("n > 0 and doc_id is not null")
    kinds = named.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("d", "k")).alias("rep"), F.count(F.lit(1)).alias("copies"))
    kinds = written(kinds, "kinds")
    chosen = kinds.join(sharing(rows.where("doc_id is not null"), k, percent), "fp").select("fp", "copies", "rep.d", "rep.k")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, value = shingles(b.column("text"), k)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("fp"), b.column("copies"), pa.array(np.diff(cut), pa.int64()), pa.array([value[i:j].astype("<u8").tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["fp", "copies", "n", "shingles"])

    texts = rows.select("d", "k", "text").join(written(chosen, "chosen"), ["d", "k"]).dropDuplicates(["fp"])
    sets = written(texts.select("fp", "copies", "text").mapInArrow(build, "fp binary, copies long, n long, shingles binary"), "sets")
    part = components(sets.select(F.col("fp").alias("id")), links(sets, percent))
    least = part.withColumnRenamed("id", "fp").join(kinds.select("fp", "least"), "fp")
    label = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component", "component_id")
    final = kinds.select("fp", "least").join(label, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("of"), F.coalesce("component", "fp").alias("set"))
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return base.join(final, "fp", "left").select(
        "doc_id", "d", "k", F.col("n").alias("n_shingles"),
        F.when(linkable, F.col("of")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linkable, F.col("set")).alias("part"))


def join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    return classes(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row, with all columns, of every component: the smallest doc_id's
    and, of its different texts there, the one with the least text hash.
    Unlinked texts under one doc_id all stay, as do rows without a doc_id."""
    named = written(classes(docs, k, percent).select("d", "k", "part"), "named")
    kept = (named.where("part is not null").groupBy("part").agg(F.min(F.struct("d", "k")).alias("x")).select("x.*")
            .union(named.where("part is null").select("d", "k")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("k"))
    null_id = F.col("d") == NO_ID
    named = rows.join(kept, ["d", "k"], "left_semi").where(~null_id).dropDuplicates(["d", "k"])
    return named.unionByName(rows.where(null_id)).select("_row.*")
