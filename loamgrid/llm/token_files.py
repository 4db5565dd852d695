"""Token files with bit or byte planes.

File format (all integers little-endian)::

    chunk   := plane*                      one after another, each a zstandard frame
    plane   := bytes of one bit (or byte) position of every id of the chunk
    index   := per chunk: u64 offset, u64 first id, u32 ids, u32 planes, u32 x planes sizes
    docs    := zstandard frame of i64 doc_id and u64 tokens per document, as two runs
    footer  := u64 index offset, u64 docs offset, u64 ids, u64 documents, u32 chunks,
               u32 mode (0 bits, 1 bytes), 8 bytes magic

A chunk holds a fixed number of ids (the last one of a file fewer).  Their
bits are transposed: plane ``b`` has bit ``b`` of each id, eight ids to a
byte; planes above the largest id of the chunk are left out.  High planes are
nearly constant and shrink to nothing.  Byte planes are the default: they take
a tenth of the time and, on ids of words, an eighth less space.

Documents are dealt by ranges of ``doc_id``, as many as their bytes ask for
(``FILE_BYTES`` each), and sorted, and each partition writes one file to shared storage under a name of its own per attempt.  Only
the manifest, a table made of what successful tasks return, makes a file part
of the result, so repeated or lost tasks leave no trace in it.

Defined cases: a null or empty text is just its end id; rows of equal id are
ordered by text; null ids come first; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, scratch, slim, stored
from .tokens import encoded

MAGIC = b"LGPLANE1"
FOOTER = struct.Struct("<QQQQII8s")
CHUNK_IDS = 1 << 16
#: Bytes of text that go into one file.
FILE_BYTES = 16 << 20
LEVEL = 1
MANIFEST = "part int, file string, documents bigint, ids bigint"
#: Stands for a null doc_id inside a file.
NO_ID = -(1 << 63)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a chunk of ids, the lowest first."""
    width = max(1, int(ids.max()).bit_length())
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(-(-width // 8))]
    planes = []
    for k in range(-(-width // 8)):
        spread = np.unpackbits(np.ascontiguousarray(raw[:, k])[:, None], axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")
        planes += [p.tobytes() for p in packed[: min(8, width - 8 * k)]]
    return planes


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a chunk."""
    raw = np.zeros((n, 4), np.uint8)
    if not bits:
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        for k in range(-(-len(planes) // 8)):
            own = np.stack([np.frombuffer(p, np.uint8) for p in planes[8 * k : 8 * k + 8]])
            spread = np.zeros((8, n), np.uint8)
            spread[: len(own)] = np.unpackbits(own, axis=1, count=n, bitorder="little")
            raw[:, k] = np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")[:, 0]
    return raw.reshape(-1).view("<u4")


class Writer:
    """Streams ids into one file; holds one chunk and the index in memory."""

    def __init__(self, out, chunk_ids: int = CHUNK_IDS, bits: bool = False):
        self.out, self.chunk_ids, self.bits = out, chunk_ids, bits
        self.zip, self.at, self.ids = zstandard.ZstdCompressor(level=LEVEL), 0, 0
        self.waiting: list[bytes] = []
        self.held = 0
        self.index: list[bytes] = []
        self.docs: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(NO_ID if doc is None else doc)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.chunk_ids:
            self._chunks(False)

    def _chunks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // self.chunk_ids * self.chunk_ids
        for lo in range(0, whole, self.chunk_ids):
            part = ids[lo : min(lo + self.chunk_ids, whole)]
            frames = [self.zip.compress(p) for p in to_planes(part, self.bits)]
            self.index.append(struct.pack(f"<QQII{len(frames)}I", self.at, self.ids, len(part), len(frames), *map(len, frames)))
            for f in frames:
                self.out.write(f)
                self.at += len(f)
            self.ids += len(part)
        self.waiting, self.held = ([] if whole == len(ids) else [ids[whole:].tobytes()]), len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._chunks(True)
        index = b"".join(self.index)
        docs = self.zip.compress(np.asarray(self.docs, "<i8").tobytes() + np.asarray(self.sizes, "<u8").tobytes())
        self.out.write(index)
        self.out.write(docs)
        self.out.write(FOOTER.pack(self.at, self.at + len(index), self.ids, len(self.docs), len(self.index), int(not self.bits), MAGIC))


def read_file(source) -> Iterator[tuple[int | None, bytes]]:
    """``(doc_id, ids)`` of each document of an open random-access file, a chunk in memory at a time."""
    size = source.size()
    source.seek(size - FOOTER.size)
    index_at, docs_at, _, n_docs, n_chunks, mode, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    source.seek(index_at)
    index = source.read(docs_at - index_at)
    unzip = zstandard.ZstdDecompressor()
    docs = unzip.decompress(source.read(size - FOOTER.size - docs_at))
    keys, sizes = np.frombuffer(docs[: 8 * n_docs], "<i8"), np.frombuffer(docs[8 * n_docs :], "<u8")
    held, waiting, at = 0, [], 0

    def chunk() -> bytes:
        nonlocal at
        offset, _, n, planes = struct.unpack_from("<QQII", index, at)
        lengths = struct.unpack_from(f"<{planes}I", index, at + 24)
        at += 24 + 4 * planes
        source.seek(offset)
        raw = source.read(sum(lengths))
        frames, lo = [], 0
        for x in lengths:
            frames.append(unzip.decompress(raw[lo : lo + x]))
            lo += x
        return from_planes(frames, n, mode == 0).tobytes()

    buffer, lo = b"", 0
    for key, n in zip(keys.tolist(), sizes.tolist()):
        need = n * 4
        if len(buffer) - lo < need:
            waiting, held = [buffer[lo:]], len(buffer) - lo
            while held < need:
                waiting.append(chunk())
                held += len(waiting[-1])
            buffer, lo = b"".join(waiting), 0
        yield (None if key == NO_ID else key), buffer[lo : lo + need]
        lo += need


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, files: int | None = None,
    chunk_ids: int = CHUNK_IDS, bits: bool = False,
) -> DataFrame:
    """Encode all documents, write files in ascending ``doc_id`` order, return the stored manifest."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    end = np.asarray([end_id], "<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, out, name = TaskContext.get().partitionId(), None, None, ""
        for doc, ids in encoded(batches, tokenizer, end):
            if writer is None:
                where, base = pafs.FileSystem.from_uri(path)
                where.create_dir(base, recursive=True)
                name = f"tokens-{part:06d}-{uuid.uuid4().hex}.bin"
                out = where.open_output_stream(f"{base}/{name}")
                writer = Writer(out, chunk_ids, bits)
            writer.add(doc, ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.ids], pa.int64())], names=["part", "file", "documents", "ids"])

    rows = slim(docs)
    n = files or max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.transform(map_arrow, write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files of a manifest.

    The manifest has a row per file; its running totals place each file's first id.
    """
    spark, total, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("part").collect():  # a row per file
        rows.append((r["file"], total))
        total += r["ids"]
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.createDataFrame(rows, "file string, first bigint").repartition(len(rows), "file")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for b in batches:
            for file, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, name = pafs.FileSystem.from_uri(file)
                out = []
                with where.open_input_file(name) as source:
                    for doc, ids in read_file(source):
                        n = len(ids) // 4
                        out.append((doc, at, n, zlib.crc32(ids)))
                        at += n
                        if len(out) >= 20_000:
                            yield batch(out)
                            out = []
                if out:
                    yield batch(out)

    return files.transform(map_arrow, read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
