"""Token-id files of independent zstandard frames with a trailing seek table.

File layout (all integers little-endian):
  magic ``GTOK0002`` | frame* | seek table | footer
  frame       one zstandard frame with its content checksum, holding the ids
              of one document, or of several as long as they have ``frame_ids``
              ids at most, as uint16 (vocabularies up to 65536) or uint32
  seek table  per frame:  offset u64, bytes u32, raw bytes u64, documents u32, crc32 of the raw ids u32
              per document: doc_id i64, ids u64, 1 if its doc_id is null else 0 (u8)
  footer      frames u64, documents u64, table crc32 u32, id width u32, magic
A reader opens the tail, finds the frames of the documents it wants and reads
only those byte ranges: a request decompresses a document's own frame, at most
``frame_ids`` ids or the document itself.  Documents lie in ascending doc_id
order inside and across files; a file's manifest row has the first and last
doc_id and the number of rows without one, so a request opens only files that
can hold its documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gustflow.llm.bpe import default_vocab, encoder
from gustflow.llm.common import written
from gustflow.llm.text import chunks
from gustflow.session import work_path

MAGIC = b"GTOK0002"
FRAME = struct.Struct("<QIQII")
DOC = struct.Struct("<qQB")
FOOT = struct.Struct("<QQII8s")
FRAME_IDS = 1 << 13
#: Neighbouring wanted frames are read together up to this size.
READ_BYTES = 1 << 22
END_ID = 1


class Writer:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, out, wide: bool, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard
        self.out, self.width, self.frame_ids = out, 4 if wide else 2, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.at, self.frames, self.docs, self.held, self.held_ids, self.held_docs = len(MAGIC), [], [], [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held_ids and self.held_ids + len(ids) > self.frame_ids:
            self._flush()
        self.held.append(ids.astype("<u4" if self.width == 4 else "<u2").tobytes())
        self.held_ids += len(ids)
        self.held_docs += 1
        self.docs.append(DOC.pack(doc_id or 0, len(ids), doc_id is None))

    def _flush(self) -> None:
        raw = b"".join(self.held)
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.frames.append(FRAME.pack(self.at, len(frame), len(raw), self.held_docs, zlib.crc32(raw)))
        self.at += len(frame)
        self.held, self.held_ids, self.held_docs = [], 0, 0

    def close(self) -> None:
        if self.held_docs:
            self._flush()
        table = b"".join(self.frames) + b"".join(self.docs)
        self.out.write(table)
        self.out.write(FOOT.pack(len(self.frames), len(self.docs), zlib.crc32(table), self.width, MAGIC))


class Reader:
    """Random access to one file's documents; ``source`` needs seek/read/size."""

    def __init__(self, source, size: int):
        import zstandard
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(size - FOOT.size)
        n_frames, n_docs, crc, self.width, magic = FOOT.unpack(source.read(FOOT.size))
        length = n_frames * FRAME.size + n_docs * DOC.size
        source.seek(size - FOOT.size - length)
        table = source.read(length)
        if magic != MAGIC or zlib.crc32(table) != crc:
            raise ValueError("damaged token file: bad seek table")
        self.frames = list(FRAME.iter_unpack(table[:n_frames * FRAME.size]))
        self.docs = np.frombuffer(table[n_frames * FRAME.size:], [("doc_id", "<i8"), ("n", "<u8"), ("null", "u1")])
        self.start = np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])
        self.first_doc = np.concatenate([[0], np.cumsum([f[3] for f in self.frames], dtype=np.int64)])

    def unpacked(self, k: int, data: bytes) -> np.ndarray:
        _, _, raw_size, _, crc = self.frames[k]
        raw = self.zstd.decompress(data, max_output_size=raw_size)
        if len(raw) != raw_size or zlib.crc32(raw) != crc:
            raise ValueError(f"damaged token file: frame {k}")
        return np.frombuffer(raw, "<u4" if self.width == 4 else "<u2").astype("<u4")

    def frame(self, k: int) -> np.ndarray:
        at, size = self.frames[k][:2]
        self.source.seek(at)
        return self.unpacked(k, self.source.read(size))

    def _wanted(self, need: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(frame, its ids); neighbours come in one read."""
        i = 0
        while i < len(need):
            j, at = i + 1, self.frames[need[i]][0]
            end = at + self.frames[need[i]][1]
            while j < len(need) and need[j] == need[j - 1] + 1 and end + self.frames[need[j]][1] - at <= READ_BYTES:
                end += self.frames[need[j]][1]
                j += 1
            self.source.seek(at)
            data = memoryview(self.source.read(end - at))
            for k in need[i:j]:
                o = self.frames[k][0] - at
                yield k, self.unpacked(k, data[o:o + self.frames[k][1]])
            i = j

    def places(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, ids) of the wanted documents
        (None: all); other frames stay unread."""
        null = self.docs["null"] == 1
        if doc_ids is None:
            want = np.arange(len(self.docs))
        else:
            want = np.flatnonzero(~null & np.isin(self.docs["doc_id"], np.fromiter(doc_ids, np.int64)))
        in_frame = np.searchsorted(self.first_doc, want, "right") - 1
        for k, ids in self._wanted(np.unique(in_frame).tolist()):
            base = self.start[self.first_doc[k]]
            for i in want[np.searchsorted(in_frame, k):np.searchsorted(in_frame, k, "right")].tolist():
                s, e = int(self.start[i]), int(self.start[i + 1])
                yield None if null[i] else int(self.docs["doc_id"][i]), s, ids[s - base:e - base]

    def read(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the wanted documents."""
        return ((d, ids) for d, _, ids in self.places(doc_ids))


def _open(path: str):
    """pyarrow's file system of a path; Hadoop's names of S3 are known to it as ``s3``."""
    from pyarrow import fs
    if path.startswith(("s3a://", "s3n://")):
        path = f"s3://{path.partition('://')[2]}"
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


MANIFEST = "file string, part int, n_docs long, n_ids long, first_doc long, last_doc long, n_null long"
MANIFEST_ARROW = pa.schema([("file", pa.string()), ("part", pa.int32()), *((c, pa.int64()) for c in ("n_docs", "n_ids", "first_doc", "last_doc", "n_null"))])


def write_files(docs: DataFrame, folder: str, vocab: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write ``docs`` in doc_id order, one file per range partition; returns
    the manifest (file, part, n_docs, n_ids, first_doc, last_doc, n_null),
    read from the shared folder.

    A task writes under a name of its own and hands it on only when the file
    is complete, so a retried or speculative attempt never shows up in the
    manifest half written or twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, part = encoder(vocab), TaskContext.get().partitionId()
        wide = enc.tok.get_vocab_size() > 65536
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.gtok"
        fs, path = _open(name)
        end, writer, out, n_ids, n_null, first, last = np.array([end_id], "<u4").tobytes(), None, None, 0, 0, None, None
        for b in chunks(batches):
            if writer is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path)
                writer = Writer(out, wide, frame_ids)
            for doc, data in zip(b.column("doc_id").to_pylist(), enc.ids_bytes(b.column("text").to_pylist())):
                ids = np.frombuffer(data + end, "<u4")
                writer.add(doc, ids)
                n_ids += len(ids)
                n_null += doc is None
                first, last = doc if first is None else first, doc
        if writer is not None:
            writer.close()
            out.close()
            row = {"file": name, "part": part, "n_docs": len(writer.docs), "n_ids": n_ids, "first_doc": first, "last_doc": last, "n_null": n_null}
            yield pa.RecordBatch.from_pylist([row], MANIFEST_ARROW)

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def files_of(manifest: DataFrame, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(file, part, base) of the files that can hold the wanted documents
    (None: all); ``base`` counts the ids of all earlier files, by a running
    sum over one row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    if doc_ids is not None:
        wanted = np.unique(np.fromiter(doc_ids, np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                has = b.column("first_doc").is_valid().to_numpy(zero_copy_only=False)
                first, last = (b.column(c).fill_null(0).to_numpy() for c in ("first_doc", "last_doc"))
                yield b.filter(pa.array(has & (np.searchsorted(wanted, last, "right") > np.searchsorted(wanted, first))))

        files = files.mapInArrow(run, files.schema)
    return files.select("file", "part", "base")


def read_files(manifest: DataFrame, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decompressed
    and checked frame by frame from the files; ``start`` counts all ids of
    earlier files and documents.

    With ``doc_ids`` (a request, sent to every task) only the rows of these
    documents: only files whose range holds one of them are opened, and only
    their frames are read and decompressed.
    """
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    files = files_of(manifest, wanted)
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                fs, path = _open(name)
                with fs.open_input_file(path) as f:
                    rows: list[tuple] = []
                    for doc, at, ids in Reader(f, f.size()).places(wanted):
                        rows.append((doc, base + at, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return files.repartitionByRange(n, "part").select("file", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def roundtrip(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Encode, write and read back all documents.

    Null text counts as empty (only the end id); a null doc_id sorts first
    and comes back null; repeated rows are written as often as they occur,
    ties ordered by their text's hash; an empty table writes no file.
    """
    spark = docs.sparkSession
    return read_files(write_files(docs, work_path(spark, "llm", "tokens"), vocab or default_vocab()))
