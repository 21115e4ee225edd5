"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order. It is a sequence of sections, each ended by a line feed so that Spark's
own writer (with its commit protocol, on any file system) can produce it row by row:

* blocks: zstandard of entries, ``varint shared, varint unshared, varint value length, key suffix, value``; the key shares its
  first bytes with the entry before, a block's first entry shares none; then crc32 of the compressed bytes;
* index: for each block its last key's length and bytes, offset and length (sparse: one entry a block);
* Bloom filter over keys: 10 bits a key, 7 probes from two xxHash values;
* footer of fixed size: where index and filter are, counts of entries and ids, shard number, id width, magic.

``TableReader.get`` asks the filter, bisects the index and scans one block. Keys: one byte 0 for a null id, else 1 and
the id in big-endian order with its sign bit flipped. Values: ids of 2 or 4 bytes. Repeated ids keep all their entries,
ordered by text. Null text counts as empty and still gets the end id. An empty table gives empty shards. Extra columns
are not read. A text of any length is one entry; a shard holds whole entries. Ids wider than the shard's width are refused, never cut.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded
from loomgraph.llm.tokens import encoder, vocabulary
from loomgraph.plans.storage import discard, fresh_path, materialize

BLOCK_BYTES = 1 << 16
BITS_A_KEY, PROBES = 10, 7
#: Input bytes (as stored) a shard holds about; the reader takes a shard at a time.
SHARD_BYTES = 32 << 20
MAGIC = b"LGSSTAB1"
_FOOTER = struct.Struct("<QIQIQQIB8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % (1 << 64) % bits for i in range(PROBES)]


class TableWriter:
    """Sections of one shard, in order: ``add`` gives the blocks that became full, ``finish`` the rest."""

    def __init__(self, shard: int, width: int, checked: bool = True):
        self.shard, self.width, self.checked = shard, width, checked
        self.block, self.last, self.size = [], b"", 0
        self.offset = self.entries = self.ids = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def _section(self, data: bytes) -> bytes:
        self.offset += len(data) + 1
        return data

    def _close(self) -> bytes:
        packed = zstandard.ZstdCompressor(level=1).compress(b"".join(self.block))
        data = packed + struct.pack("<I", zlib.crc32(packed))
        self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QI", self.offset, len(data)))
        self.block, self.size, self.last = [], 0, b""
        return self._section(data)

    def add(self, key: bytes, ids: np.ndarray) -> Iterator[bytes]:
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        if self.checked and len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} doesn't fit {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids)
        if self.size >= BLOCK_BYTES:
            yield self._close()

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._close()
        index_at, index = self.offset, b"".join(self.index)
        yield self._section(index)
        bits = max(64, len(self.keys) * BITS_A_KEY + 7 & ~7)
        marks = np.zeros(bits, bool)
        for key in self.keys:
            marks[_probes(key, bits)] = True
        bloom_at, bloom = self.offset, np.packbits(marks).tobytes()
        yield self._section(bloom)
        yield self._section(_FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.entries, self.ids, self.shard, self.width, MAGIC))


class TableReader:
    """Looks keys up in, or walks through, the bytes of a shard."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        index_at, index_len, bloom_at, bloom_len, self.entries, self.ids, self.shard, self.width, magic = _FOOTER.unpack(self.data[-1 - _FOOTER.size : -1])
        if magic != MAGIC:
            raise ValueError("not a table shard")
        self.bloom = np.frombuffer(self.data[bloom_at : bloom_at + bloom_len], np.uint8)
        index, at = bytes(self.data[index_at : index_at + index_len]), 0
        self.last_keys, self.blocks = [], []
        while at < len(index):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QI", index, at + n))
            at += n + 12

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.blocks[block]
        packed = self.data[offset : offset + length - 4]
        if zlib.crc32(packed) != struct.unpack("<I", self.data[offset + length - 4 : offset + length])[0]:
            raise ValueError(f"block {block} of shard {self.shard} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(bytes(packed)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, len(self.bloom) * 8))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry under ``key``."""
        if not self.may_hold(key):
            return []
        found = []
        for block in range(bisect_left(self.last_keys, key), len(self.blocks)):
            found += [ids for k, ids in self._entries(block) if k == key]
            if self.last_keys[block] > key:
                break
        return found


def write_tables(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 0, width: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts, appends ``end_id`` and writes shards in ascending id order below ``path``.

    ``width``: bytes of an id, 2 or 4; by default as many as the vocabulary and ``end_id`` need. An id that doesn't fit is an error. Memory: one Arrow batch and one open block a task.
    """
    needed = 2 if max(encoder(vocabulary_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    width = width or needed
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, int(str(stored)) // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        table, encode = TableWriter(context.partitionId() if context else 0, width, width < needed), encoder(vocabulary_path)
        end = np.array([end_id], "<u4").tobytes()
        out: list[bytes] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist()), strict=True):
                    out += table.add(key_of(doc_id), np.frombuffer(ids + end, "<u4"))
                if out:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["section"])
                    out = []
        yield pa.record_batch([pa.array(list(table.finish()), pa.binary())], ["section"])

    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, "section binary").select(F.col("section").cast("string").alias("value")).write.option("compression", "none").text(path)


def read_tables(spark, path: str) -> DataFrame:
    """``(shard, place, doc_id, offset, n_tokens, ids_crc32)`` of every entry; ``offset`` counts the shard's ids before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                table, rows, offset = TableReader(content.as_buffer()), [], 0
                for place, (key, ids) in enumerate(table):
                    rows.append((table.shard, place, id_of(key), offset, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    offset += len(ids)
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["shard", "place", "doc_id", "offset", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, "shard long, place long, doc_id long, offset long, n_tokens long, ids_crc32 long")


def op2_sstable(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = fresh_path(spark, "sstable")
    write_tables(docs, path, vocabulary("byte_bpe_50k.json"))
    entries, _ = materialize(read_tables(spark, path), "sstable-entries")
    discard(spark, path)  # the query's result has been read back; write_tables leaves its files to callers
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return entries.join(sums, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
