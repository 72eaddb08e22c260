"""Removal of word passages that occur more than once, by suffix automata.

A window is ``WINDOW`` consecutive words.  Every window is named by its
anchor, the least-hashed ``GRAM``-word run inside it (the leftmost on ties),
so equal windows have equal anchors at equal places.  Windows that share an
anchor position form a segment.

1. Anchors (about one word in fifteen) are counted over the corpus; only an
   anchor seen in two different texts, or twice in one, can name a repeated
   window.  Texts with such an anchor keep their segments there.
2. Equal segments are one reference row with a weight.  The reference is
   sharded by anchor, and a shard goes to the only texts that can match it:
   those holding its anchors (a broadcast of all shards to all texts would
   grow with the square of the corpus).  Each shard's segments are built into
   a suffix automaton with occurrence counts; streaming a segment through it
   gives, at every word, the longest passage ending there that occurs twice.
3. Where that length reaches ``WINDOW``, the window is removed from every
   text that holds the segment.

An anchor with more than ``HOT`` different segments is not one shard: its
windows are counted one by one by a 128-bit digest, which combines on the map
side and spreads over all tasks.  Word-for-word copies of a whole text are
settled by the digest of the text, one of them standing for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gustflow.llm.common import digest, written
from gustflow.llm.text import Words, chunks, gram_hash

WINDOW = 35
GRAM = 8
HOT = 4096
NO_ID = -(1 << 63)


class Segments:
    """Segments of a chunk's texts: runs of windows with one anchor."""

    def __init__(self, col: pa.Array, window: int, gram: int):
        w = Words(col)
        self.words, span = w, window - gram + 1
        n = len(w) - window + 1
        if n <= 0:
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.int64)
            return
        grams = gram_hash(w.hash, gram)
        start = np.flatnonzero(w.doc[:n] == w.doc[window - 1:])
        view = np.lib.stride_tricks.sliding_window_view(grams, span)
        anchor = np.concatenate([start[i:i + 65536] + view[start[i:i + 65536]].argmin(1) for i in range(0, len(start), 65536)]) if len(start) else start
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(new)
        self.first, self.anchor = start[at], anchor[at]
        self.last = start[np.append(at[1:], len(start)) - 1] if len(at) else at
        self.doc, self.hash = w.doc[self.first], grams[self.anchor].view(np.int64)


class Automaton:
    """Suffix automaton of word sequences, with weighted occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state of p's strings followed by ``word``, cut off q if longer strings end there."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, weight: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
            else:
                cur, p = self._state(self.length[last] + 1), last
                while p != -1 and word not in self.next[p]:
                    self.next[p][word] = cur
                    p = self.link[p]
                self.link[cur] = 0 if p == -1 else self._split(p, self.next[p][word], word)
                last = cur
            self.count[last] += weight

    def close(self) -> None:
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def statistics(self, words: list) -> list[int]:
        """Per word, the longest passage ending there that occurs at least twice."""
        out, state, size = [], 0, 0
        for word in words:
            while True:
                q = self.next[state].get(word)
                if q is not None and self.count[q] >= 2:
                    state, size = q, size + 1
                    break
                if state == 0:
                    size = 0
                    break
                state = self.link[state]
                size = self.length[state]
            out.append(size)
        return out


def repeated_windows(segments: list[tuple[str, int]], window: int) -> list[list[int]]:
    """For (segment, weight) pairs of one shard: offsets of the windows that
    occur at least twice."""
    if len(segments) == 1:
        text, weight = segments[0]
        return [list(range(text.count(" ") + 2 - window)) if weight > 1 else []]
    automaton, split = Automaton(), [s.split(" ") for s, _ in segments]
    for words, (_, weight) in zip(split, segments):
        automaton.add(words, weight)
    automaton.close()
    return [[e - window + 1 for e, size in enumerate(automaton.statistics(words)) if size >= window] for words in split]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        w = Words(b.column("text"))
        blank = w.data.copy()  # separators become spaces; words already joined by one space need no rebuilding
        out = []
        for i in range(b.num_rows):
            out.append(_joined(blank, w, w.first[i], w.first[i + 1]))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("d"), b.column("k"), pa.array(np.diff(w.first), pa.int64()), pa.array([hashlib.sha256(x).digest() for x in out], pa.binary())],
            ["doc_id", "d", "k", "n_words", "sha"])


def _joined(data: np.ndarray, w: Words, i: int, j: int, keep: np.ndarray | None = None) -> bytes:
    """Words i..j-1 (those with ``keep``) joined by one space."""
    if j <= i:
        return b""
    start, end = w.start[i:j], w.end[i:j]
    if keep is not None:
        start, end = start[keep], end[keep]
        if not len(start):
            return b""
    size = end - start + 1
    at = np.cumsum(size) - size
    index = np.arange(int(size.sum())) + np.repeat(start - at, size)
    out = data[np.minimum(index, len(data) - 1)]
    out[at + size - 1] = 32
    return out[:-1].tobytes()


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(base rows, removals): base has doc_id, d, k, n_words, sha (of all
    words) and ``copied``; removals have d, k, text and ``starts``, the
    removed windows' first words, for texts not copied as a whole."""
    rows = _rows(docs)
    base = written(rows.mapInArrow(_base, "doc_id long, d long, k long, n_words long, sha binary"), "base")
    copies = base.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("d", "k")).alias("rep"))
    copies = written(copies, "copies")
    reps = copies.select("rep.d", "rep.k", (F.col("copies") > 1).alias("copied"), F.col("copies").alias("weight"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, max_bytes=8 << 20):
            s = Segments(b.column("text"), window, gram)
            k = b.column("k").to_numpy()[s.doc]
            order = np.lexsort((k, s.hash))
            h, k, doc = s.hash[order], k[order], s.doc[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(new)
            twice = np.zeros(len(h), np.int64)
            twice[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            ends = np.append(at[1:], len(h)) - 1 if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(k[at]), pa.array(k[ends]), pa.array(np.maximum.reduceat(twice, at) if len(at) else twice)], ["h", "lo", "hi", "twice"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = Segments(b.column("text"), window, gram)
            own = pa.array(s.doc)
            yield pa.RecordBatch.from_arrays([pa.array(s.hash), b.column("d").take(own), b.column("k").take(own), pa.array((s.first - s.words.first[s.doc]).astype(np.int32))], ["h", "d", "k", "pos"])

    repeated = (rows.select("k", "text").mapInArrow(anchors, "h long, lo long, hi long, twice long")
                .groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("twice").alias("twice"))
                .where("lo <> hi or twice > 0").select("h"))
    marked = (rows.select("d", "k", "text").mapInArrow(places, "h long, d long, k long, pos int").join(repeated, "h")
              .groupBy("d", "k").agg(F.collect_set("pos").alias("places")))
    texts = written(rows.select("d", "k", "text").join(marked, ["d", "k"]).join(reps, ["d", "k"]), "marked")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = Segments(b.column("text"), window, gram)
            pos = s.first - s.words.first[s.doc]
            wanted = [np.array(p, np.int64) for p in b.column("places").to_pylist()]
            lo = np.searchsorted(s.doc, np.arange(b.num_rows + 1))
            use = np.concatenate([lo[i] + np.flatnonzero(np.isin(pos[lo[i]:lo[i + 1]], wanted[i])) for i in range(b.num_rows)])
            text = [_joined(s.words.data, s.words, int(s.first[u]), int(s.last[u]) + window) for u in use]
            own = pa.array(s.doc[use])
            yield pa.RecordBatch.from_arrays(
                [b.column("d").take(own), b.column("k").take(own), b.column("weight").take(own), pa.array(pos[use].astype(np.int32)), pa.array(s.hash[use]),
                 pa.array([digest(t) for t in text], pa.binary()), pa.array([t.decode("utf-8", "replace") for t in text], pa.string())],
                ["d", "k", "weight", "pos", "h", "key", "segment"])

    held = texts.mapInArrow(segments, "d long, k long, weight long, pos int, h long, key binary, segment string")
    reference = written(held.groupBy("h", "key").agg(F.sum("weight").alias("n"), F.first("segment").alias("segment")), "reference")
    crowd = reference.groupBy("h").agg(F.count(F.lit(1)).alias("different"))
    reference = reference.join(crowd, "h")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, keys, group in _by_anchor(batches):
            for key, hits in zip(keys, repeated_windows(group, window)):
                if hits:
                    yield pa.RecordBatch.from_pydict({"h": pa.array([h], pa.int64()), "key": pa.array([key], pa.binary()), "hits": pa.array([hits], pa.list_(pa.int32()))})

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for h, key, n, text in zip(*(b.column(c).to_pylist() for c in ("h", "key", "n", "segment"))):
                words = text.split(" ")
                for o in range(len(words) - window + 1):
                    for column, v in zip(out, (h, key, o, n, digest(" ".join(words[o:o + window]).encode()))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()))], ["h", "key", "o", "n", "name"])

    shards = reference.where(F.col("different") <= hot).select("h", "key", "n", "segment").repartition("h").sortWithinPartitions("h", "key")
    small = shards.mapInArrow(_packed(stream), "h long, key binary, hits array<int>")
    windows = reference.where(F.col("different") > hot).select("h", "key", "n", "segment").mapInArrow(single, "h long, key binary, o int, n long, name binary")
    twice = windows.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")
    large = windows.join(twice, "name").groupBy("h", "key").agg(F.collect_set("o").alias("hits"))
    hits = written(small.unionByName(large), "hits")
    # texts copied as a whole are settled: their places only served as reference
    again = texts.where(~F.col("copied")).mapInArrow(segments, "d long, k long, weight long, pos int, h long, key binary, segment string").drop("segment", "weight")
    found = again.join(hits, ["h", "key"]).groupBy("d", "k").agg(F.flatten(F.collect_list(F.transform("hits", lambda o: o + F.col("pos")))).alias("starts"))
    out = texts.select("d", "k", "text").join(found, ["d", "k"])
    flags = copies.where("copies > 1").select("sha", F.lit(True).alias("copied"))
    whole = base.join(flags, "sha", "left").withColumn("copied", F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= window))
    return whole, out


def _packed(run):
    """Join a generator's one-row batches into larger ones."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if len(held) >= 5000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return packed


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[tuple[str, int]]]]:
    """Runs of one anchor in sorted input; at most ``hot`` rows each."""
    last, keys, group = None, [], []
    for b in batches:
        for h, key, n, segment in zip(*(b.column(c).to_pylist() for c in ("h", "key", "n", "segment"))):
            if h != last and group:
                yield last, keys, group
                keys, group = [], []
            last = h
            keys.append(key)
            group.append((segment, n))
    if group:
        yield last, keys, group


def _cut(window: int, sha: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"))
            removed, kept = [], []
            for i, starts in enumerate(b.column("starts").to_pylist()):
                first, n = int(w.first[i]), int(w.first[i + 1] - w.first[i])
                edge = np.zeros(n + 1, np.int64)
                s = np.unique(np.array(starts, np.int64))
                edge[s] += 1
                edge[s + window] -= 1
                gone = np.cumsum(edge)[:n] > 0
                removed.append(int(gone.sum()))
                if sha:
                    kept.append(hashlib.sha256(_joined(w.data, w, first, first + n, ~gone)).hexdigest())
                else:
                    kept.append(_rest(w, first, n, int(w.offsets[i]), int(w.offsets[i + 1]), gone))
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("k"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["d", "k", "n_removed", "kept"])
    return run


def _rest(w: Words, first: int, n: int, begin: int, end: int, gone: np.ndarray) -> str:
    """The text without the removed words and the white space after each."""
    keep = np.ones(end - begin, bool)
    for j in np.flatnonzero(gone).tolist():
        stop = int(w.start[first + j + 1]) if j + 1 < n else end
        keep[int(w.start[first + j]) - begin:stop - begin] = False
    return w.data[begin:end][keep].tobytes().decode("utf-8", "replace")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row.

    Null text has no words; texts shorter than a window keep all words; rows
    repeated with one doc_id are occurrences like any other, so long ones are
    removed whole; an empty table gives an empty result; other columns are
    ignored.
    """
    base, found = removals(docs, window, gram, hot)
    cut = found.mapInArrow(_cut(window, True), "d long, k long, n_removed long, kept string")
    out = base.join(cut, ["d", "k"], "left")
    return out.select("doc_id", "n_words", F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(F.col("copied"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"))


def strip(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """All rows and columns, ``text`` without the removed words.

    Null and short texts stay as they are; rows repeated word for word lose
    the words of their windows like any other occurrences; an empty table gives
    an empty result; any further columns, whatever their names, are carried
    along."""
    from gustflow.llm.line_quality import ROW, row_of, with_text
    base, found = removals(docs, window, gram, hot)
    cut = found.mapInArrow(_cut(window, False), "d long, k long, n_removed long, kept string").select("d", "k", F.col("kept").alias("_kept"))
    copied = base.where("copied").select("d", "k", F.lit("").alias("_kept")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row_of(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("k"))
    return with_text(rows.join(cut.unionByName(copied), ["d", "k"], "left"), F.coalesce(F.col("_kept"), F.col(ROW)["text"]), docs)
