"""Best-fit sequence packing with exact-complement hashing.

Only the multiset of piece lengths matters to the plan, so the plan is made
on the driver from a histogram of at most ``capacity`` counts, whatever the
corpus size.  For every length, longest first, the gap it leaves is looked up
in the tables of available single lengths, pair sums and triple sums; a
combination that fills the gap exactly is consumed as often as the counts
allow.  What has no exact complement is placed best-fit, longest first, again
in bulk by counts.  The plan is a list of runs "the pieces of length L with
ranks r..r+n go to sequences s..s+n at offset o"; Spark ranks the pieces of
each length (offset per written partition + rank inside it) and looks the
run up.  No piece or text passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gustflow.llm.bpe import default_vocab, encoder
from gustflow.llm.common import written
from gustflow.llm.text import chunks

CAPACITY = 2048
END_ID = 0

Run = tuple[int, int, int, int, int]  # length, first rank, count, first sequence, offset


def _single(avail: np.ndarray, gap: int) -> list[int] | None:
    return [gap] if avail[gap] > 0 else None


def _pair(avail: np.ndarray, gap: int) -> list[int] | None:
    """Two available lengths adding to ``gap``, the longest first half."""
    a = np.arange(1, gap // 2 + 1)
    ok = (avail[a] > 0) & (avail[gap - a] > 0)
    if gap % 2 == 0 and len(a):
        ok[-1] = avail[gap // 2] > 1
    hit = np.flatnonzero(ok)
    return [gap - int(a[hit[0]]), int(a[hit[0]])] if len(hit) else None


def _triple(avail: np.ndarray, gap: int) -> list[int] | None:
    for a in np.flatnonzero(avail[:gap - 1])[::-1]:
        a = int(a)
        avail[a] -= 1
        rest = _pair(avail, gap - a)
        avail[a] += 1
        if rest:
            return [a, *rest]
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs covering every piece once, and the number of sequences.  Where
    exact fills use up the short pieces that best fit alone would place
    better, the plan without them is taken."""
    exact, plain = (_plan(histogram, capacity, fill) for fill in (True, False))
    return exact if exact[1] <= plain[1] else plain


def _plan(histogram: dict[int, int], capacity: int, fill: bool) -> tuple[list[Run], int]:
    avail = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        avail[length] = n
    ranks = np.zeros(capacity + 1, np.int64)
    runs: list[Run] = []
    bins = 0

    def put(length: int, n: int, first_bin: int, offset: int) -> None:
        runs.append((length, int(ranks[length]), n, first_bin, offset))
        ranks[length] += n
        avail[length] -= n

    rest: list[int] = []
    for length in range(capacity, 0, -1):
        while avail[length] > 0:
            gap = capacity - length
            if gap == 0:
                n = int(avail[length])
                put(length, n, bins, 0)
                bins += n
                continue
            if not fill:
                break
            avail[length] -= 1
            combo = _single(avail, gap) or _pair(avail, gap) or _triple(avail, gap)
            avail[length] += 1
            if combo is None:
                break
            parts = [length, *combo]
            n = min(int(avail[p]) // parts.count(p) for p in parts)
            offset = 0
            for p in parts:
                put(p, n, bins, offset)
                offset += p
            bins += n
        if avail[length] > 0:
            rest.append(length)

    # Best fit of the residual, by groups of sequences with one fill level:
    # a group is a list of (first sequence, count) ranges.
    open_bins: dict[int, list[list[int]]] = {}  # gap -> ranges
    gaps = np.zeros(capacity + 1, np.int64)  # sequences per gap
    for length in rest:
        while avail[length] > 0:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                n = int(avail[length])
                per = capacity // length
                n = -(-n // per)  # new sequences for all of this length
                first, bins = bins, bins + n
                put(length, n, first, 0)
                gap = capacity - length
                open_bins.setdefault(gap, []).append([first, n])
                gaps[gap] += n
                continue
            gap = length + int(fits[0])
            first, have = open_bins[gap][-1]
            n = min(have, int(avail[length]))
            put(length, n, first, capacity - gap)
            if n == have:
                open_bins[gap].pop()
            else:
                open_bins[gap][-1] = [first + n, have - n]
            gaps[gap] -= n
            left = gap - length
            if left:
                open_bins.setdefault(left, []).append([first, n])
                gaps[left] += n
    return runs, bins


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenised pieces of every text: ids, then ``end_id``; only longer
    documents are cut, every ``capacity`` tokens.  ``part``/``rank_in_part``
    number the pieces of one length inside a written partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc, seen = encoder(vocab), np.zeros(capacity + 1, np.int64)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in chunks(batches):
            out: list[list[int]] = [[] for _ in range(7)]
            for doc, data in zip(b.column("doc_id").to_pylist(), enc.ids_bytes(b.column("text").to_pylist())):
                data += end
                for i in range(0, len(data), step):
                    own = data[i:i + step]
                    length = len(own) // 4
                    for column, v in zip(out, (doc, i // step, i // 4, length, zlib.crc32(own), part, int(seen[length]))):
                        column.append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with length/part/rank_in_part."""
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = written(by_part, "pack_counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    # runs of one length are contiguous and cover ranks 0..n-1: (length, rank) order finds the run
    begins = {int(length): (int(i), int(j)) for length, i, j in _spans(table[:, 0])}
    sent = cut.sparkSession.sparkContext.broadcast((table, begins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begins = sent.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank_in_part").to_numpy() + b.column("base").to_numpy()
            at = np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                i, j = begins[int(one)]
                own = length == one
                at[own] = i + np.searchsorted(table[i:j, 1], rank[own], side="right") - 1
            hit = table[at]
            arrays = [b.column(c) for c in OUT[:5]] + [pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])]
            yield pa.RecordBatch.from_arrays(arrays, OUT)

    # skewed lengths are no hot key here: a (length, part) key holds one written partition's pieces at most
    joined = cut.join(base, ["length", "part"]).select(*OUT[:5], "rank_in_part", "base")
    return joined.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def _spans(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    values, first = np.unique(sorted_values, return_index=True)
    for v, i, j in zip(values, first, [*first[1:], len(sorted_values)]):
        yield v, i, j


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Null text counts as empty (one piece holding ``end_id``); a null doc_id
    stays null; repeated rows are separate pieces; an empty table gives an
    empty result; other columns are ignored.
    """
    return assign(written(pieces(docs, vocab or default_vocab(), capacity, end_id), "pieces"), capacity)
