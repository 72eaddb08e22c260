"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the 10-word windows of the benchmark items (a shorter
item is one window).  They are cut into shards of bounded size; a shard's
tables are broadcast and all documents pass by them.  For each length m of
window there is a table of shifts over blocks of B = 3 words (fewer for
shorter windows): a block that stands in no window lets the search jump
m - B + 1 words, one that ends d words before a window's end lets it jump d.
Where the shift is 0 the block's bucket of windows with that suffix is looked
up, the window's hash narrows the bucket, and the words themselves are
compared.  Words are A-Z lower-cased runs of ASCII letters, digits and
non-ASCII characters.  The search runs over many stretches of texts at once
(numpy), so one very long text is no slower a word than many short ones.

Shards grow with the benchmark, not with the documents; every shard reads all
documents, and what shards find for a document is merged by a digest of the
row.  Null, empty and wordless texts have no words and no hits; a null or
wordless item has no window; a null item_id counts under the name ``-``;
repeated item_ids are one item; repeated documents each get their row.  With
an empty benchmark no document is hit; without documents there are no rows.
Columns besides doc_id and text, item_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gustflow.llm.common import written
from gustflow.llm.text import Words, chunks, gram_hash, mix, ragged

WINDOW = 10
BLOCK = 3
#: Bounds of a shard: (window, item) pairs and their bytes.
SHARD_PAIRS = 1 << 17
SHARD_BYTES = 16 << 20
#: Window starts in a stretch.
STRETCH = 128

# separators: all but digits, letters and bytes of non-ASCII characters
_SEPARATES = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _SEPARATES[_lo:_hi] = False


def _words(col: pa.Array) -> Words:
    return Words(col, lower=True, space=_SEPARATES)


def _item_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(iter([batch])):
            w = _words(part.column("text"))
            items = part.column("item").to_pylist()
            names, texts = [], []
            for row, item in enumerate(items):
                lo, hi = int(w.first[row]), int(w.first[row + 1])
                words = [w.data[w.start[i]:w.end[i]].tobytes().decode() for i in range(lo, hi)]
                for i in range(max(1, len(words) - length + 1) if words else 0):
                    names.append(item)
                    texts.append(" ".join(words[i:i + length]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], ["window", "item"])


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Distinct (window, item): an item's windows, words joined by one space."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("-")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _item_windows(b, length), "window string, item string").distinct()


@dataclass
class Machine:
    """Wu-Manber tables of the windows of ``m`` words."""

    m: int
    block: int
    shift: np.ndarray  # by block hash modulo its size
    suffixes: np.ndarray  # distinct hashes of last blocks, ascending
    bucket: np.ndarray  # first window of each suffix, plus the total
    full: np.ndarray  # window hashes, ascending inside a bucket
    ids: np.ndarray  # window of each bucket place


def machine(hashes: np.ndarray, ids: np.ndarray) -> Machine:
    """``hashes``: word hashes, one row for each window."""
    n, m = hashes.shape
    b = min(BLOCK, m)
    blocks = [_hash_at(hashes.ravel(), np.arange(n) * m + j, b) for j in range(m - b + 1)]
    size = 1 << max(10, math.ceil(math.log2(8 * n * len(blocks))))
    shift = np.full(size, m - b + 1, np.uint8)
    for j, h in enumerate(blocks):  # ascending j: the smallest shift is written last
        shift[h & np.uint64(size - 1)] = m - b - j
    full = _hash_at(hashes.ravel(), np.arange(n) * m, m)
    order = np.lexsort((full, blocks[-1]))
    suffixes, bucket = np.unique(blocks[-1][order], return_index=True)
    return Machine(m, b, shift, suffixes, np.append(bucket, n), full[order], ids[order])


def _hash_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = (out ^ h[at + j]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(k))


@dataclass
class Shard:
    machines: list[Machine]
    data: np.ndarray  # the windows' bytes
    start: np.ndarray  # of every word of every window
    end: np.ndarray
    first: np.ndarray  # first word of each window
    items: pa.Array  # item names by window
    item_first: np.ndarray


def shard(pairs: pa.Table) -> Shard:
    pairs = pairs.sort_by([("window", "ascending"), ("item", "ascending")]).combine_chunks()
    texts = pairs["window"].combine_chunks()
    encoded = texts.dictionary_encode()
    which = encoded.indices.to_numpy(zero_copy_only=False)
    w = Words(encoded.dictionary, space=_SEPARATES)
    lengths = np.diff(w.first)
    hashes = w.hash
    machines = []
    for m in np.unique(lengths[lengths > 0]):
        ids = np.flatnonzero(lengths == m)
        machines.append(machine(hashes[w.first[ids][:, None] + np.arange(m)], ids))
    return Shard(machines, w.data, w.start, w.end, w.first, pairs["item"].combine_chunks(),
                 np.searchsorted(which, np.arange(len(lengths) + 1)))


def places(mac: Machine, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Window starts whose last block has shift 0, skipping by shifts.
    ``first``: first word of each text, plus the total."""
    starts = np.maximum(np.diff(first) - mac.m + 1, 0)  # window starts a text has
    stretches = -(-starts // STRETCH)
    lo = np.repeat(first[:-1], stretches) + ragged(np.zeros(len(starts), np.int64), stretches) * STRETCH
    hi = np.minimum(lo + STRETCH, np.repeat(first[:-1] + starts, stretches))
    found, mask, tail = [], np.uint64(len(mac.shift) - 1), mac.m - mac.block
    while len(lo):
        jump = mac.shift[_hash_at(h, lo + tail, mac.block) & mask]
        found.append(lo[jump == 0])
        lo = lo + np.maximum(jump, 1)
        alive = lo < hi
        lo, hi = lo[alive], hi[alive]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def occurrences(mac: Machine, sh: Shard, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in a chunk of texts."""
    at = places(mac, h, w.first)
    suffix = _hash_at(h, at + mac.m - mac.block, mac.block)
    b = np.minimum(np.searchsorted(mac.suffixes, suffix), len(mac.suffixes) - 1)
    hit = mac.suffixes[b] == suffix
    at, b = at[hit], b[hit]
    full = _hash_at(h, at, mac.m)
    lo, end = mac.bucket[b], mac.bucket[b + 1]
    hi = end.copy()
    while len(open_ := np.flatnonzero(lo < hi)):  # binary search of each place's bucket
        mid = (lo[open_] + hi[open_]) >> 1
        less = mac.full[mid] < full[open_]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    out_at, out_id = [], []
    while len(at):  # once, but for windows that share a hash
        ok = lo < end
        at, lo, end, full = at[ok], lo[ok], end[ok], full[ok]
        ok = mac.full[lo] == full
        at, lo, end, full = at[ok], lo[ok], end[ok], full[ok]
        same = equal(sh, mac.ids[lo], w, at, mac.m)
        out_at.append(at[same])
        out_id.append(mac.ids[lo[same]])
        at, lo, end, full = at[~same], lo[~same] + 1, end[~same], full[~same]
    return (np.concatenate(out_at), np.concatenate(out_id)) if out_at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def equal(sh: Shard, ids: np.ndarray, w: Words, at: np.ndarray, m: int, step: int = 1 << 14) -> np.ndarray:
    """Whether the ``m`` words from each ``at`` are those of window ``ids``."""
    out = np.zeros(len(at), bool)
    for i in range(0, len(at), step):
        k = np.arange(m)
        mine, theirs = at[i:i + step, None] + k, sh.first[ids[i:i + step], None] + k
        size = w.end[mine] - w.start[mine]
        fits = (size == sh.end[theirs] - sh.start[theirs]).all(axis=1)
        mine, theirs, size = mine[fits], theirs[fits], size[fits].ravel()
        differs = w.data[ragged(w.start[mine].ravel(), size)] != sh.data[ragged(sh.start[theirs].ravel(), size)]
        row = np.repeat(np.arange(len(mine)).repeat(m), size)
        bad = np.zeros(len(mine), bool)
        bad[row[differs]] = True
        out[i + np.flatnonzero(fits)] = ~bad
    return out


_FOUND = "key string, doc_id long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"
_SPAN = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch], sh: Shard) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        w = _words(part.column("text"))
        h = w.hash
        got = [(m.m, *occurrences(m, sh, w, h)) for m in sh.machines]
        cover = np.zeros(len(w) + 1, np.int32)
        for m, at, _ in got:
            np.add.at(cover, at, 1)
            np.add.at(cover, at + m, -1)
        inside = np.zeros(len(w) + 2, bool)
        inside[1:-1] = np.cumsum(cover)[:-1] > 0
        # covered stretches, which a text's end also ends
        edge = np.zeros(len(w) + 1, bool)
        edge[w.first] = True
        lo = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        hi = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        row = w.doc[lo]
        span_first = np.searchsorted(row, np.arange(part.num_rows + 1))
        spans = pa.StructArray.from_arrays([pa.array(lo - w.first[row]), pa.array(hi - w.first[row])], ["lo", "hi"])
        at, ids = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (1, 2))
        pairs = np.unique(np.stack([w.doc[at], ids]), axis=1)
        count = sh.item_first[pairs[1] + 1] - sh.item_first[pairs[1]]
        named = np.stack([np.repeat(pairs[0], count), ragged(sh.item_first[pairs[1]], count)])
        names = sh.items.take(pa.array(named[1])).dictionary_encode()
        owner = np.unique(np.stack([named[0], names.indices.to_numpy(zero_copy_only=False)]), axis=1) if len(named[0]) else named
        item_first = np.searchsorted(owner[0], np.arange(part.num_rows + 1))
        items = names.dictionary.take(pa.array(owner[1]))
        yield pa.RecordBatch.from_arrays([
            part.column("key"), part.column("doc_id"), pa.array(np.diff(w.first), pa.int64()),
            pa.ListArray.from_arrays(pa.array(span_first, pa.int32()), spans.cast(_SPAN)),
            pa.ListArray.from_arrays(pa.array(item_first, pa.int32()), items)], ["key", "doc_id", "n_words", "spans", "items"])


def search(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, shard_pairs: int = SHARD_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(every row's key, doc_id and n_words; for each key with a hit the
    covered ``spans`` of word numbers, ascending, and the ``items``)."""
    spark = docs.sparkSession
    pairs = written(windows(benchmark, length), "decontam_windows")
    n, size = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    shards = max(1, -(-n // shard_pairs), -(-size // SHARD_BYTES))
    pairs = pairs.withColumn("shard", F.pmod(F.xxhash64("window", "item"), F.lit(shards)))
    rows = docs.select(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))), 256).alias("key"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes = []
    for s in range(shards):
        tables = spark.sparkContext.broadcast(shard(pairs.where(F.col("shard") == s).select("window", "item").toArrow()))
        passes.append(written(rows.mapInArrow(lambda b, t=tables: _search(b, t.value), _FOUND), "decontam_pass"))
        tables.unpersist()
    hits = [p.where(F.size("spans") > 0).select("key", "spans", "items").dropDuplicates(["key"]) for p in passes]
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    found = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return passes[0].select("key", "doc_id", "n_words"), found


def covered(spans):
    """Numbers in the union of ascending [lo, hi) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(s["lo"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["hi"]).alias("end")), lambda acc: acc["n"])


def contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """One row per document: its words, the words inside a benchmark window,
    and the benchmark items found."""
    rows, found = search(docs, benchmark, length, shard_pairs)
    found = found.select("key", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    none = F.lit(0).cast("long")
    return (rows.join(found, "key", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
                    F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                    (F.coalesce("n_hit", none) > 0).alias("contaminated")))
