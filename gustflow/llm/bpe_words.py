"""BPE through a distinct-word table.

1. Every text is split into words once.  A task gathers texts into chunks of
   about ``CHUNK_CHARS`` and writes for each its table of distinct words and,
   packed, every text's words as numbers into that table.
2. The chunks' tables (chunk, number, word) are dealt out and sorted by word,
   so that all rows of a distinct word lie together; it is encoded once.
3. The ids go back to their chunk by number, where each text's ids are put
   together by position.  What is shuffled are a chunk's distinct words, never
   single occurrences.
4. Decoding gathers the id-to-piece table (dense on id, so the join is an
   array lookup) and joins pieces by one space, which is what this
   vocabulary's decoder does.

The packed texts are written in buckets of their chunk, so they are not
shuffled to meet their ids.  A task holds one chunk: its packed texts and the ids of its distinct words.  A
longer text is a chunk of its own.  Nothing passes through the driver and
nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gustflow.llm.bpe import default_vocab, encoder
from gustflow.llm.common import bucketed
from gustflow.llm.text import chunks, ragged

CHUNK_CHARS = 32 << 20
#: Words put together at once inside a chunk.
STEP_WORDS = 1 << 18

_CHUNK = "chunk long, docs binary, codes binary, words array<string>"
_DOC = [("known", "u1"), ("id", "<i8"), ("words", "<i8")]


class Chunk:
    """Texts as numbers into the table of their distinct words."""

    def __init__(self) -> None:
        self.table: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []
        self.chars = 0

    def add(self, doc_id: int | None, words: list[str], chars: int) -> None:
        table = self.table
        for w in words:
            if w not in table:
                table[w] = len(table)
        self.codes.append(np.fromiter(map(table.__getitem__, words), "<u4", len(words)))
        self.docs.append((doc_id is not None, doc_id or 0, len(words)))
        self.chars += chars

    def pack(self, z, name: int) -> pa.RecordBatch:
        """Frequent words get low numbers; the numbers are packed as byte
        planes, of which the high ones are almost all zero."""
        code = np.concatenate(self.codes)
        order = np.argsort(-np.bincount(code, minlength=len(self.table)), kind="stable")
        number = np.empty(len(order), "<u4")
        number[order] = np.arange(len(order))
        planes = number[code].view(np.uint8).reshape(-1, 4).T.tobytes()
        words = pa.array(self.table, pa.string()).take(pa.array(order))
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([z.compress(np.array(self.docs, _DOC).tobytes())], pa.binary()), pa.array([z.compress(planes)], pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], ["chunk", "docs", "codes", "words"])


def word_chunks(docs: DataFrame, vocab: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk, docs, codes, words), each text split once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext
        enc, z = encoder(vocab), zstandard.ZstdCompressor(level=6)
        name, held = TaskContext.get().partitionId() << 32, Chunk()  # a name no other task gives
        for b in chunks(batches, max_bytes=1 << 20):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                if held.docs and held.chars + len(text) > chunk_chars:
                    yield held.pack(z, name)
                    name, held = name + 1, Chunk()
                held.add(doc_id, enc.words(text) if text else [], len(text))
        if held.docs:
            yield held.pack(z, name)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _CHUNK)


def encode_words(slots: DataFrame, vocab: str) -> DataFrame:
    """(of, number, ids) for (of, number, word) sorted by word inside every
    partition, with all rows of a word in one: each distinct word goes through
    the library once.  ids are little-endian bytes, two or four an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(vocab), {}
        kind = id_kind(enc)
        for b in batches:
            coded = b.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = [w for w in words if w not in last]  # a word may go on from the batch before
            ids = {**last, **{w: np.array(i, kind).tobytes() for w, i in zip(new, enc.encode_words(new))}}
            table = pa.array([ids[w] for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("of"), b.column("number"), table.take(coded.indices)], ["of", "number", "ids"])
            if words:
                last = {words[-1]: ids[words[-1]]}

    return slots.mapInArrow(run, "of long, number int, ids binary")


def id_kind(enc) -> str:
    return "<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4"


def encode(docs: DataFrame, vocab: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; see
    ``encoded`` for the row handling."""
    return encoded(docs, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", vocab, chunk_chars)


def encode_ids(docs: DataFrame, vocab: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, ids, decoded): the ids and the decoded text themselves."""
    return encoded(docs, _ids, "ids array<int>, decoded string", vocab, chunk_chars)


def encoded(docs: DataFrame, finish, columns: str, vocab: str | None, chunk_chars: int) -> DataFrame:
    """Null and empty texts have no ids; repeated rows give repeated results;
    null doc_id stays null; an empty table gives an empty result; other
    columns are ignored."""
    vocab = vocab or default_vocab()
    packed = bucketed(word_chunks(docs, vocab, chunk_chars), "chunk", "bpe_chunks")
    slots = packed.select(F.col("chunk").alias("of"), F.posexplode("words").alias("number", "word"))
    filled = encode_words(slots.repartition("word").sortWithinPartitions("word"), vocab)

    def put_together(texts: pa.Table, words: pa.Table) -> pa.Table:
        import zstandard
        z, enc = zstandard.ZstdDecompressor(), encoder(vocab)
        names = pa.array([f"{i} " for i in range(enc.tok.get_vocab_size())])
        pieces = pa.array([p + " " for p in enc.pieces()])
        words = words.sort_by("number").combine_chunks()
        blobs = words["ids"].to_pylist()
        ids = np.frombuffer(b"".join(blobs), id_kind(enc))
        sizes = np.array([len(b) // ids.itemsize for b in blobs], np.int64)
        ids, starts = ids.astype(np.int32), np.cumsum(sizes) - sizes
        rows = np.frombuffer(z.decompress(texts["docs"][0].as_py()), _DOC)
        codes = np.ascontiguousarray(np.frombuffer(z.decompress(texts["codes"][0].as_py()), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
        ends, out, first = np.cumsum(rows["words"]), [], 0
        while first < len(rows):
            before = int(ends[first - 1]) if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, before + STEP_WORDS, side="right")))
            parts, lo = [], before
            for end in ends[first:stop].tolist():
                code = codes[lo:end]
                parts.append(ids[ragged(starts[code], sizes[code])])
                lo = end
            doc_id = pa.array(rows["id"][first:stop], pa.int64(), mask=rows["known"][first:stop] == 0)
            out.append(finish(doc_id, parts, names, pieces))
            first = stop
        return pa.Table.from_batches(out)

    return (packed.select("chunk", "docs", "codes").groupBy("chunk").cogroup(filled.groupBy("of"))
            .applyInArrow(put_together, f"doc_id long, {columns}"))


def _joined(ids: list[np.ndarray], table: pa.Array) -> Iterator[memoryview]:
    """Each document's table entries, joined by one space."""
    text = table.take(pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
    if not len(text):
        yield from (memoryview(b"") for _ in ids)
        return
    at = np.frombuffer(text.buffers()[1], np.int32)
    data, start = memoryview(text.buffers()[2]), 0
    for own in ids:
        end = start + len(own)
        yield data[int(at[start]):int(at[end]) - 1] if end > start else memoryview(b"")
        start = end


def _digests(doc_id: pa.Array, ids: list[np.ndarray], names: pa.Array, pieces: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array([len(i) for i in ids], pa.int64()),
         pa.array([hashlib.sha256(t).hexdigest() for t in _joined(ids, names)], pa.string()),
         pa.array([hashlib.sha256(t).hexdigest() for t in _joined(ids, pieces)], pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(doc_id: pa.Array, ids: list[np.ndarray], names: pa.Array, pieces: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array([i.tolist() for i in ids], pa.list_(pa.int32())), pa.array([bytes(t).decode() for t in _joined(ids, pieces)], pa.string())],
        ["doc_id", "ids", "decoded"])
