"""Token ids in seekable files of independent zstandard frames.

A file holds frames that each decompress on their own, then a skippable frame
with the document index (with a mark for rows without an id), then the published seek table of the zstandard
seekable format: compressed size, decompressed size and XXH64 checksum of each
frame, the number of frames, and the magic number. A frame's content is the
ids of whole documents, little-endian, two bytes wide where the vocabulary
allows. The index gives each document's id, frame, place in it and number of
ids. So a reader takes the tail of a file, then only the frames of the
documents it wants, and checks each.

Documents are range-partitioned by id, and each task writes the file of its
range: under a name of its own attempt first, then renamed, so a task that runs
again after a lost executor replaces its file with the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, partitions
from .encoding import encoder

END_ID = 0
#: Bytes of ids at which a frame closes; a longer document has a frame to itself.
FRAME_BYTES = 1 << 20
LEVEL = 3
#: Bytes of text that are encoded together; a longer text is alone.
RUN_BYTES = 8 << 20
# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


#: Spark's names of stores and the names that pyarrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


class Store:
    """Files under one folder: a path, or a URI of a store that pyarrow reaches; others are refused by name."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        folder = "file://" + folder if folder.startswith("/") else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
        scheme, _, rest = folder.partition(":")
        if scheme not in SCHEMES and scheme not in SCHEMES.values():
            raise ValueError(f"token files can't be written to {scheme}: name a folder in one of {sorted(SCHEMES)}")
        self.fs, self.base = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
        self.fs.create_dir(self.base, recursive=True)

    def write(self, name: str):
        return self.fs.open_output_stream(f"{self.base}/{name}", compression=None)

    def read(self, name: str):
        return self.fs.open_input_file(f"{self.base}/{name}")

    def rename(self, old: str, new: str) -> None:
        self.fs.move(f"{self.base}/{old}", f"{self.base}/{new}")


class Writer:
    """Writes documents in order to one open file; holds one frame and the index in memory."""

    def __init__(self, out: BinaryIO, width: int, frame_bytes: int = FRAME_BYTES) -> None:
        import zstandard

        self.out, self.width, self.limit = out, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.limit:
            self._close_frame()
        self.index.append((doc_id or 0, len(self.frames), self.size, len(ids) // self.width, doc_id is None))
        self.held.append(ids)
        self.size += len(ids)

    def _close_frame(self) -> None:
        import xxhash

        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        index = struct.pack("<BQ", self.width, len(self.index)) + np.array(self.index, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = np.array(self.frames, "<u4").tobytes()
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(foot)) + entries + foot)


class Reader:
    """Reads the tail of a file, then only the frames that hold the documents asked for."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        tail = 12 * n + 9
        file.seek(size - tail)
        self.frames = np.frombuffer(file.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        at = int(self.starts[-1])
        file.seek(at)
        magic, length = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        raw = file.read(length)
        self.width, count = struct.unpack("<BQ", raw[:9])
        self.index = np.frombuffer(raw[9:], "<i8").reshape(count, 5)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        self.file.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames[k, 0])))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: frozenset[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(place in the file, doc_id, ids) in file order; all, or those wanted."""
        held, raw = -1, b""
        for i, (doc, k, at, n, none) in enumerate(self.index.tolist()):
            if wanted is None or (doc in wanted and not none):
                if k != held:
                    held, raw = k, self.frame(k)
                yield i, None if none else doc, np.frombuffer(raw, f"<u{self.width}", n, at)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write ``docs(doc_id, text)`` as token files and return the manifest ``shard, file, first_id, n_docs, n_ids``.

    Each document's ids are those of its whole text (null: empty) and END_ID.
    Files hold ascending ranges of doc_id. Rows that share an id stand next to
    each other, each as a document, by the hash of their text, and may be dealt to more files
    than one; so do rows without an id, after all others. Other columns are ignored; an empty
    table gives an empty manifest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, store, shard = encoder(tokenizer), Store(folder), TaskContext.get().partitionId()
        name, width = f"part-{shard:06d}.tok.zst", np.dtype(enc.width).itemsize
        own = f"_{name}.{uuid.uuid4().hex}"
        out = writer = None
        total = 0
        for b in batches:
            docs = b.column(0).to_pylist()
            for first, ids, starts in enc.documents(b.column(1), END_ID, RUN_BYTES):
                if writer is None:
                    out = store.write(own)
                    writer = Writer(out, width, frame_bytes)
                total += len(ids)
                raw, cuts = ids.astype(f"<u{width}").tobytes(), (starts * width).tolist()
                for doc, s, e in zip(docs[first:], cuts, cuts[1:], strict=False):
                    writer.add(doc, raw[s:e])
        if writer is not None:
            writer.close()
            out.close()
            store.rename(own, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "first_id": [None if writer.index[0][4] else writer.index[0][0]], "n_docs": [len(writer.index)], "n_ids": [total]}, schema=manifest)

    manifest = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    return materialize(rows.mapInArrow(run, "shard int, file string, first_id long, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents, and ``ids``; ``start`` is the number of ids before it in all files.

    ``ids`` and the checksum are over 32-bit little-endian ids. ``wanted`` is one request's list of ids; files outside it aren't opened and
    only its frames are decompressed. None: all documents, those without an id too. The manifest has a
    row per file, so its running sum is small.
    """
    order = Window.orderBy("shard")
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if wanted is not None:
        files = files.withColumn("next_id", F.lead("first_id").over(order))
        ids = F.array(*[F.lit(int(x)) for x in wanted]) if wanted else F.expr("cast(array() as array<long>)")
        files = files.where(F.exists(ids, lambda x: (x >= F.col("first_id")) & (F.col("next_id").isNull() | (x <= F.col("next_id")))))
    asked = None if wanted is None else frozenset(map(int, wanted))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        store = Store(folder)
        for b in batches:
            for r in b.to_pylist():
                with store.read(r["file"]) as f:
                    reader = Reader(f)
                    starts = (r["base"] + np.cumsum(reader.index[:, 3]) - reader.index[:, 3]).tolist()
                    out: list[tuple] = []
                    for i, doc, ids in reader.documents(asked):
                        raw = ids.astype("<u4").tobytes()
                        out.append((doc, starts[i], len(ids), zlib.crc32(raw), *[raw] * with_ids))
                        if len(out) >= 256:
                            yield batch(out)
                            out = []
                    if out:
                        yield batch(out)

    files = files.select("shard", "file", "base").repartition(partitions(files), "shard")
    return files.select("file", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_folder(spark: SparkSession) -> str:
    return new_path(spark, "tokens")
