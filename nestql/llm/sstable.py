"""Token ids in sorted-string-table shards, keyed by document.

A shard: data blocks, a Bloom filter, a sparse index with the first key of each block, and a footer of fixed size. In a
block each key is stored as what differs from the key before; the block is compressed. A reader takes the footer, index
and filter, then one block for a key: it asks the filter, searches the index by bisection and walks the block.

Keys order as doc_id does: a byte (0 for null, so null is first), then eight bytes. Repeated ids are kept, in the order
of their texts. A null text counts as empty. Shards are ranges of doc_id, in order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .store import Scratch, small_batches
from .tokens import encoder

MAGIC = b"NQSST1\0\0"
FOOTER = struct.Struct("<6Q8s")  # index place and size, filter place and size, entries, ids, magic
BLOCK = 1 << 16
BITS, HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(keys: list[bytes], size: int) -> np.ndarray:
    h = np.array([(zlib.crc32(k), zlib.crc32(k, 0x9E3779B9) | 1) for k in keys], np.uint64).reshape(-1, 2)
    return (h[:, :1] + h[:, 1:] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)


class Writer:
    """Entries must come in the order of their keys."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.at, self.zip = sink, 0, zstandard.ZstdCompressor(1)
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.first, self.last = bytearray(), b"", b""
        self.entries = self.ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        value = (b"\1" if wide else b"\0") + ids.astype("<u4" if wide else "<u2").tobytes()
        if not self.block:
            self.first, self.last = key, b""
        same = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK:
            self.flush()

    def _put(self, raw: bytes) -> tuple[int, int]:
        self.sink.write(raw)
        self.at += len(raw)
        return self.at - len(raw), len(raw)

    def flush(self) -> None:
        if self.block:
            self.index.append((self.first, *self._put(self.zip.compress(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        size = max(64, -(-BITS * len(self.keys) // 8) * 8)
        bits = np.zeros(size, bool)
        if self.keys:
            bits[_bits(self.keys, size).astype(np.int64).ravel()] = True
        bloom = self._put(np.packbits(bits).tobytes())
        index = self._put(b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index))
        self.sink.write(FOOTER.pack(*index, *bloom, self.entries, self.ids, MAGIC))


class Reader:
    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        end = source.size()
        ia, n, ba, m, self.entries, self.ids, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, at = self._at(ia, n), 0
        self.index: list[tuple[bytes, int, int]] = []
        while at < n:
            k, at = _read_varint(raw, at)
            key, at = raw[at : at + k], at + k
            place, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            self.index.append((key, place, size))
        self.bits = np.unpackbits(np.frombuffer(self._at(ba, m), np.uint8))

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw, at, key = self.unzip.decompress(self._at(*self.index[i][1:])), 0, b""
        while at < len(raw):
            same, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key, at = key[:same] + raw[at : at + n], at + n
            yield key, np.frombuffer(raw[at + 1 : at + size], "<u4" if raw[at] else "<u2").astype("<u4")
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this id, none if there is none."""
        key = key_of(doc_id)
        if not self.bits[_bits([key], len(self.bits)).astype(np.int64).ravel()].all():
            return []
        i = max(0, bisect_right(self.index, key, key=lambda x: x[0]) - 1)
        while i > 0 and self.index[i][0] == key:  # repeated ids may begin in the block before
            i -= 1
        found = []
        for j in range(i, len(self.index)):
            if self.index[j][0] > key:
                break
            found += [v for k, v in self.block(j) if k == key]
        return found


def opened(path: str) -> Reader:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return Reader(store.open_input_file(inner))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """Encode and write; returns the manifest: part, path, n_docs, n_ids, a row for each shard, in the order of doc_id.

    A task that runs twice writes two files; only the one in the manifest counts.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, writer = encoder(tokenizer, kind), None
        part = TaskContext.get().partitionId()
        path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
        store, inner = fs.FileSystem.from_uri(path)
        for batch in batches:
            if writer is None:
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                writer = Writer(store.open_output_stream(inner))
            ids, at = enc.encode(batch.column(1), end_id)
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                writer.add(key_of(doc), ids[a:b])
        if writer is not None:
            writer.close()
            writer.sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [writer.entries], "n_ids": [writer.ids]})

    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return docs.mapInArrow(run, "part int, path string, n_docs long, n_ids long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files of a manifest."""
    spark, start, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row for each shard
        rows.append((r["path"], start))
        start += r["n_ids"]

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = opened(path)
                for i in range(len(reader.index)):  # a block at a time
                    out = []
                    for key, ids in reader.block(i):
                        out.append((doc_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    shards = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, kind: str = "spaceless", end_id: int = 2) -> DataFrame:
    """Write docs as shards in the shared folder, and return what the files hold."""
    scratch = Scratch(docs.sparkSession, "sst")
    manifest = write_shards(docs, scratch.path("shards"), tokenizer, kind, end_id)
    return read_shards(scratch.write(manifest, "manifest"))
