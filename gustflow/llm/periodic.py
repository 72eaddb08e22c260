"""Periodic runs of words by difference-cover longest common extensions.

A run is a maximal stretch of words with smallest period q and at least
max(6, 4 q) words.  Every run of period q holds a place i of the grid 0, s,
2s, ... (s = max(6, 4 q) - q) with equal words at i and i + q, so the grids of
all periods, about n log n places, are enough: each place's common extension
forward and backward gives the whole stretch.  Extensions compare a few words
until both places stand in a difference cover modulo 64; only suffixes that
start at covered places are sorted, and from there on the answer is a range
minimum over the neighbours' common prefixes (sparse table).

Texts are handled a chunk at a time (a single longer text is a chunk of its
own) as one sequence of word numbers with a separator of its own after every
text; the sorted samples are made only for the texts whose places get that
far.  A text needs a few hundred bytes a word and nothing is kept between
chunks.  Null, empty and wordless texts have no words and no runs; a null
doc_id has no crc32 and is taken as it is; repeated rows each get a row; an
empty table gives none.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gustflow.llm.text import Words, chunks, ragged, text_buffers, _SPACE

MIN_WORDS = 6
EXPONENT = 4
#: Cover modulus: a square, so that 0..r-1 and the multiples of r cover all differences.
ROOT = 8
MODULUS = ROOT * ROOT
#: Grid places handled at once.
SLICE = 1 << 20


def _cover() -> tuple[np.ndarray, np.ndarray]:
    """(cover, sync): ``sync[x, d]`` words after places that are x modulo the
    modulus and d apart, both places are in the cover."""
    member = np.zeros(MODULUS, bool)
    member[:ROOT] = member[::ROOT] = True
    sync = np.full((MODULUS, MODULUS), MODULUS, np.int64)
    x, d = np.indices(sync.shape)
    for t in range(MODULUS - 1, -1, -1):
        sync[member[(x + t) % MODULUS] & member[(x + d + t) % MODULUS]] = t
    return np.flatnonzero(member), sync


COVER, SYNC = _cover()


class Extensions:
    """Longest common extensions of a sequence in which no two suffixes are equal."""

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        # words of their own past the end
        self.seq = np.concatenate([seq, seq.max(initial=0) + 1 + np.arange(2 * MODULUS)]).astype(np.int64)

    def walk(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(equal words, whether all words up to the synchronised places are)."""
        need = SYNC[i % MODULUS, (j - i) % MODULUS]
        got, alive, t = np.zeros(len(i), np.int64), np.flatnonzero(need > 0), 0
        while len(alive):
            alive = alive[self.seq[i[alive] + t] == self.seq[j[alive] + t]]
            t += 1
            got[alive] = t
            alive = alive[need[alive] > t]
        return got, got == need

    def sort_samples(self) -> None:
        """Rank the suffixes at covered places: by their first 64 words, then
        by doubling along the places of the same residue."""
        blocks = self.n // MODULUS + 1
        self.slot = np.full(MODULUS, -1, np.int64)
        self.slot[COVER] = np.arange(len(COVER)) * blocks
        at = (COVER[:, None] + np.arange(blocks) * MODULUS).ravel()
        self.blocks, self.at = blocks, at
        small = len(self.seq) < 1 << 31 and self.seq.max() < 1 << 31
        view = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([self.seq, np.full(MODULUS, self.seq.max() + 1)]).astype(">u4" if small else ">u8"), MODULUS)
        keys = np.ascontiguousarray(view[np.minimum(at, len(view) - 1)])
        _, rank = np.unique(keys.view(f"V{keys.shape[1] * keys.itemsize}").ravel(), return_inverse=True)
        self.levels = [rank.astype(np.int64)]
        inner = np.arange(len(at)) % blocks
        step = 1
        while (rank := self.levels[-1]).max(initial=0) + 1 < len(at) and step < blocks:
            # past the end of a residue's places every suffix is already told apart
            after = np.where(inner + step < blocks, rank[np.minimum(np.arange(len(at)) + step, len(at) - 1)] + 1, 0)
            _, rank = np.unique(rank * (len(at) + 1) + after, return_inverse=True)
            self.levels.append(rank.astype(np.int64))
            step *= 2
        order = np.argsort(self.levels[-1], kind="stable")
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = (a % blocks + (1 << k) <= blocks) & (b % blocks + (1 << k) <= blocks)
            same = inside & (self.levels[k][a] == self.levels[k][b])
            # a whole last block ends at the padding, where no two places agree
            same &= (a % blocks + (1 << k) < blocks) & (b % blocks + (1 << k) < blocks)
            common[same] += MODULUS << k
            a[same] += 1 << k
            b[same] += 1 << k
        x, y, alive = at[a], at[b], np.arange(len(a))
        last = len(self.seq) - 1
        for t in range(2 * MODULUS):
            alive = alive[(np.maximum(x[alive], y[alive]) + t <= last)]
            alive = alive[self.seq[x[alive] + t] == self.seq[y[alive] + t]]
            if not len(alive):
                break
            common[alive] += 1
        self.table = [common]
        while (1 << len(self.table)) <= len(common):
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def sampled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of covered places."""
        ra, rb = (self.rank[self.slot[p % MODULUS] + p // MODULUS] for p in (a, b))
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            m = k == level
            row = self.table[level]
            out[m] = np.minimum(row[lo[m]], row[hi[m] - (1 << level)])
        return out


def grid(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of every grid place, in slices."""
    periods = np.where(lengths >= MIN_WORDS, lengths // EXPONENT, 0)
    text = np.repeat(np.arange(len(lengths)), periods)
    q = ragged(np.ones(len(lengths), np.int64), periods)
    step = np.maximum(MIN_WORDS, EXPONENT * q) - q
    places = -(-(lengths[text] - q) // step)
    total = np.cumsum(places)
    first = 0
    while first < len(q):
        done = total[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(total, done + SLICE, side="right")))
        n = places[first:stop]
        at = ragged(np.zeros(stop - first, np.int64), n) * np.repeat(step[first:stop], n)
        yield np.repeat(text[first:stop], n), at, np.repeat(q[first:stop], n)
        first = stop


def find_runs(seq: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of every run, by text, start and
    period.  ``seq``: word numbers of all texts; ``first``: each text's first
    word, plus the total."""
    lengths = np.diff(first)
    # every text is followed by a separator of its own
    base = first[:-1] + np.arange(len(lengths))
    apart = np.empty(len(seq) + len(lengths), np.int64)
    apart[np.arange(len(seq)) + np.repeat(np.arange(len(lengths)), lengths)] = seq
    apart[base + lengths] = seq.max(initial=-1) + 1 + np.arange(len(lengths))
    front, back = Extensions(apart), Extensions(apart[::-1])
    n = len(apart)
    short, deep = [], []
    for text, at, q in grid(lengths):
        i = base[text] + at
        hit = front.seq[i] == front.seq[i + q]
        text, i, q = text[hit], i[hit], q[hit]
        ahead, more = front.walk(i, i + q)
        behind, less = back.walk(n - i, n - i - q)
        done = ~(more | less)
        short.append(np.stack([text[done], i[done] - behind[done], ahead[done] + behind[done] + q[done], q[done]]))
        deep.append(np.stack([text[~done], i[~done], q[~done]]))
    if not short:
        return np.zeros((0, 4), np.int64)
    found = [_runs_of(np.concatenate(short, axis=1))]
    text, i, q = np.concatenate(deep, axis=1)
    if len(text):
        found.append(_deep(apart, base, lengths, text, i, q))
    rows = _runs_of(np.concatenate(found, axis=1))
    rows[1] -= base[rows[0]]
    return rows[:, np.lexsort((rows[3], rows[1], rows[0]))].T


def _deep(apart: np.ndarray, base: np.ndarray, lengths: np.ndarray, text: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Stretches around places whose comparison reached the samples, over
    the texts that have such places."""
    texts = np.unique(text)
    size = lengths[texts] + 1
    moved = np.zeros(len(base), np.int64)
    moved[texts] = np.cumsum(size) - size - base[texts]
    seq = apart[ragged(base[texts], size)]
    front, back = Extensions(seq), Extensions(seq[::-1])
    n, i = len(seq), i + moved[text]
    far = []
    for lce, a, b in ((front, i, i + q), (back, n - i, n - i - q)):
        got, reached = lce.walk(a, b)
        reached = np.flatnonzero(reached)
        if len(reached):
            lce.sort_samples()
            got[reached] += lce.sampled(a[reached] + got[reached], b[reached] + got[reached])
        far.append(got)
    ahead, behind = far
    return _runs_of(np.stack([text, i - behind - moved[text], ahead + behind + q, q]))


def _runs_of(rows: np.ndarray) -> np.ndarray:
    """The stretches that are long enough, each once with its smallest period."""
    rows = rows[:, rows[2] >= np.maximum(MIN_WORDS, EXPONENT * rows[3])]
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[1, 1:] != rows[1, :-1]) | (rows[2, 1:] != rows[2, :-1])
    return rows[:, new]


def word_array(col: pa.Array, w: Words) -> pa.Array:
    """The words of a chunk as a string array."""
    _, data = text_buffers(col)
    offsets = np.zeros(len(w) + 1, np.int64)
    np.cumsum(w.end - w.start, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(w), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~_SPACE[data]].tobytes()))


def repeated_tail(n: int, h: int) -> np.ndarray | None:
    """Word numbers of a text of ``n`` words with its tail made periodic, as
    the crc32 ``h`` says; None where it says nothing."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def _analyse(batches: Iterator[pa.RecordBatch], tails: bool) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        w = Words(part.column("text"))
        words = word_array(part.column("text"), w)
        source = np.arange(len(w))
        for row, h in enumerate(part.column("h").to_pylist() if tails else ()):
            lo, n = int(w.first[row]), int(w.first[row + 1] - w.first[row])
            if h is not None and (moved := repeated_tail(n, h)) is not None:
                source[lo:lo + n] = lo + moved
        numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        runs = find_runs(numbers[source], w.first)
        text, start, length, period = runs.T
        lost = np.zeros(len(w) + 1, np.int64)
        np.add.at(lost, w.first[text] + start + period, 1)
        np.add.at(lost, w.first[text] + start + length, -1)
        kept = np.flatnonzero(np.cumsum(lost)[:-1] == 0)
        kept_first = np.searchsorted(kept, w.first)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_first, pa.int32()), words.take(pa.array(source[kept]))), pa.scalar(" ", pa.large_string()))
        offsets, data = text_buffers(joined)
        data = memoryview(data)
        collapsed = [hashlib.sha256(data[offsets[k]:offsets[k + 1]]).hexdigest() for k in range(part.num_rows)]
        n_runs = np.bincount(text, minlength=part.num_rows)
        digest, best = [hashlib.sha256(b"").hexdigest()] * part.num_rows, [None] * part.num_rows
        run_first = np.searchsorted(text, np.arange(part.num_rows + 1))
        for k in np.flatnonzero(n_runs):
            own = runs[run_first[k]:run_first[k + 1], 1:]
            digest[k] = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own.tolist()).encode()).hexdigest()
            best[k] = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
        top = [pa.array([b and b[x] for b in best], pa.int64()) for x in range(3)]
        exponent = pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_runs, pa.int64()), *top, exponent, pa.array(digest), pa.array(collapsed)],
                                         ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def analyse(docs: DataFrame, tails: bool = False) -> DataFrame:
    """One row per document: its runs, the longest one, and the hash of its
    words with every run cut to its first period.  ``tails`` first repeats the
    tail of a tenth of the texts, chosen by crc32 of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return rows.mapInArrow(lambda b: _analyse(b, tails),
                           "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        w = Words(part.column("text"))
        numbers = word_array(part.column("text"), w).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text, start, length, period = find_runs(numbers, w.first).T
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(start), pa.array(length), pa.array(period)],
                                         ["doc_id", "start", "length", "period"])


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text as it is."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _listed, "doc_id long, start long, length long, period long")
