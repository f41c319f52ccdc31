"""Token ids in sorted-string-table shards.

Documents are ordered by id over all shards, and inside each. A shard holds data blocks, one block index entry per block,
a Bloom filter of its keys, and a footer:

    block    zstd of entries; entry: varint shared, varint rest, varint ids, rest of the key, ids (2 or 4 bytes each)
    index    per block: varint rest of key etc. as in a block, with varint offset, stored length, entries, ids
    bloom    bits of `BLOOM_HASHES` probes, 10 bits a key
    footer   40 bytes: index offset and length, bloom offset and length (u64 each), id width u16, version u16, magic u32

A key is the document's id as 8 bytes whose order is the numeric order, or no bytes for a null id, which comes first. Keys share
prefixes with the one before, anew in each block. Ids are little-endian; the width is 2 where all ids fit.

Every attempt of a task writes files of its own names; the manifest names those of the attempt that Spark took, so a lost
executor or a repeated task leaves no wrong file in use.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import byte_tokens
from loomwell.llm.columns import slices, text_or_empty
from loomwell.llm.scratch import saved, shared_path
from loomwell.llm.workers import lean

BLOCK_BYTES = 64 << 10
#: A shard is closed at this size of its data blocks.
SHARD_BYTES = 128 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER, MAGIC, VERSION = struct.Struct("<QQQQHHI"), 0x5353544C, 2
MANIFEST = "shard long, part int, path string, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def shared_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def probes(key: bytes, bits: int) -> list[int]:
    """Double hashing by the two halves of a 128-bit hash."""
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard; keys must come in order. Memory: one block, the index and the keys' Bloom probes."""

    def __init__(self, fs: pafs.FileSystem, path: str, width: int = 4):
        self.fs, self.path, self.width = fs, path, width
        self.out = fs.open_output_stream(path)
        self.zip = zstandard.ZstdCompressor(level=3)
        self.at = self.docs = self.tokens = 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.first, self.last, self.n, self.ids, self.size = [], None, b"", 0, 0, 0

    def add(self, key: bytes, ids: bytes, n: int) -> None:
        """ids: n little-endian ids of the shard's width."""
        shared = shared_prefix(self.last, key) if self.n else 0
        self.block += [varint(shared) + varint(len(key) - shared) + varint(n) + key[shared:], ids]
        self.first, self.last = key if self.first is None else self.first, key
        self.n, self.ids, self.size = self.n + 1, self.ids + n, self.size + len(ids) + 12
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.n:
            data = self.zip.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), self.n, self.ids))
            self.at, self.docs, self.tokens = self.at + len(data), self.docs + self.n, self.tokens + self.ids
            self._fresh()

    def close(self) -> dict:
        self.flush()
        index, last = bytearray(), b""
        for key, *numbers in self.index:
            shared = shared_prefix(last, key)
            index += varint(shared) + varint(len(key) - shared) + key[shared:] + b"".join(map(varint, numbers))
            last = key
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_data = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(bytes(index) + bloom_data + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom_data), self.width, VERSION, MAGIC))
        self.out.close()
        return {"n_docs": self.docs, "n_tokens": self.tokens, "n_bytes": self.at + len(index) + len(bloom_data) + FOOTER.size}


class ShardReader:
    """Reads a shard block by block, or one document by Bloom filter and binary search in the block index."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        i, i_n, self.bloom_at, self.bloom_n, self.width, version, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{path} is no shard of version {VERSION}")
        data, at, last = self.file.read_at(i_n, i), 0, b""
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        while at < i_n:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            last = last[:shared] + data[at : at + rest]
            at += rest
            numbers = []
            for _ in range(4):
                x, at = read_varint(data, at)
                numbers.append(x)
            self.first.append(last)
            self.blocks.append(tuple(numbers))
        self.unzip = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length, *_ = self.blocks[k]
        data, at, last = self.unzip.decompress(self.file.read_at(length, offset)), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            last = last[:shared] + data[at : at + rest]
            at += rest
            yield last, np.frombuffer(data, f"<u{self.width}", n, at)
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with that id; [] if there is none."""
        from bisect import bisect_left

        key = key_of(doc_id)
        bloom = self.file.read_at(self.bloom_n, self.bloom_at)
        bits = struct.unpack_from("<Q", bloom)[0]
        if not all(bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in probes(key, bits)):
            return []
        out = []
        for k in range(max(0, bisect_left(self.first, key) - 1), len(self.blocks)):
            if self.first[k] > key:
                break
            out += [ids.astype("<u4") for found, ids in self.block(k) if found == key]
        return out


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_shards(df: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes all whole texts, appends end_id to each, and writes shards into the folder; gives the saved manifest.

    Null texts count as empty and hold the end id alone. Ids are ordered as long; a null id comes first; rows that repeat an
    id are all kept, in any order among them; an id that is no whole number is an error. An empty table gives an empty manifest. The folder must be reachable from
    all executors under the same URI.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        coder, shard, part, writer, done = byte_tokens.coder(tokenizer_path), TaskContext.get().partitionId(), 0, None, []
        small = coder.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        width, last = (2 if small else 4), np.array([end_id], "<u4").tobytes()

        def close() -> None:
            done.append({"shard": shard, "part": part, "path": f"{folder}/{name}", **writer.close()})

        for batch in batches:
            for some in slices(batch, "t", byte_tokens.SLICE_BYTES):
                for key, raw in zip(some.column(0).to_pylist(), coder.texts(some.column(1).to_pylist())):
                    if writer is None:
                        name = f"shard-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.sst"
                        writer = ShardWriter(fs, f"{base}/{name}", width)
                    raw += last
                    writer.add(key_of(key), np.frombuffer(raw, "<u4").astype("<u2").tobytes() if small else raw, len(raw) // 4)
                    if writer.at >= SHARD_BYTES:
                        close()
                        part, writer = part + 1, None
        if writer:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    rows = df.select(df[doc_id].cast("long").alias("id"), text_or_empty(df, text).alias("t"))
    return saved(rows.repartitionByRange(n, "id").sortWithinPartitions("id").mapInArrow(lean(run, uses_kept=True), MANIFEST), "shard-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids, read from the files.

    The manifest has a row a file, which bounds what comes to the driver: at 128 MB a file, some 80 bytes for each.
    """
    files = manifest.orderBy("shard", "part").toPandas()
    files["start"] = files["n_tokens"].cumsum() - files["n_tokens"]
    plan = [(p, int(s)) for p, s in zip(files["path"], files["start"])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                fs, at = open_fs(path)
                rows, size = [], 0
                for key, ids in ShardReader(fs, at):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((id_of(key), start, len(ids), zlib.crc32(raw), raw))
                    start, size = start + len(ids), size + len(raw)
                    if size > 8 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
        return out.astype({"doc_id": "Int64"})

    at = spark.createDataFrame(plan, "path string, start long")
    return at.repartition(max(1, len(plan)), F.col("start")).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def shards_round_trip(df: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes df's documents into a new shared folder and reads them back, without the ids."""
    spark = df.sparkSession
    manifest = write_shards(df, tokenizer_path, shared_path(spark, "shards"), end_id)
    return read_shards(spark, manifest).drop("ids")
