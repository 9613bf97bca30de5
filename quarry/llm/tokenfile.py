"""Token files: concatenated ids of documents, with Elias-Fano coded boundaries.

Documents are range-partitioned by id (ties by a hash of the text, so that one id may hold any share of the rows),
encoded in ascending order, and cut into shards of about SHARD_IDS ids. A shard is one binary value: a header, the
Elias-Fano code of the ends of its documents, the code of their ids, and the ids as 16-bit integers (32 where the
vocabulary needs them). Shards travel in Parquet files, so any store that Spark writes to will do and a lost task
leaves no half file. Bounds and ids need about 2 + log2(range / documents) bits a document; every 256th one of the
upper bits is sampled in 32 bits, select() starts there, and the offsets that are read come from it.

Every document ends with END_ID, so empty and null texts have one id; texts are encoded whole, whatever their length.
Null ids come first. Repeated rows are kept. Extra columns are not read. An empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import bpe
from quarry.llm.common import documents, materialize, partitions

END_ID = 1
SHARD_IDS = 4_000_000
#: Ones between samples, and bytes that select() looks at together.
_MAGIC, _SAMPLE, _LOOK = b"QTF2", 256, 96


class EliasFano:
    """A non-decreasing sequence of integers from 0, in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        x = np.asarray(values, np.uint64)
        n, top = len(x), int(x[-1]) if len(x) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((x[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        upper[ones] = 1
        return cls(n, bits, low, np.packbits(upper, bitorder="little"), ones[::_SAMPLE].astype(np.uint64))

    @staticmethod
    def _kind(high_bytes: int) -> str:
        """Samples are 32-bit, unless there are so many upper bits that they can't be."""
        return "<u4" if high_bytes < 1 << 29 else "<u8"

    def dump(self) -> bytes:
        samples = self.samples.astype(self._kind(len(self.high)))
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + samples.tobytes()

    @classmethod
    def load(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b = struct.unpack_from("<QBQQ", raw, at)
        at += struct.calcsize("<QBQQ")
        low, at = np.frombuffer(raw, np.uint8, a, at), at + a
        high, at = np.frombuffer(raw, np.uint8, b, at), at + b
        kind = np.dtype(cls._kind(b))
        samples = np.frombuffer(raw, kind, -(-n // _SAMPLE), at)
        return cls(n, bits, low, high, samples), at + samples.nbytes

    def select(self, i: int) -> int:
        """Position of the i-th one of the upper bits, from the sample before it."""
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte, skip = at >> 3, at & 7
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + _LOOK], bitorder="little")[skip:])
            if left < len(ones):
                return (byte << 3) + skip + int(ones[left])
            left, byte, skip = left - len(ones), byte + _LOOK, 0

    def __getitem__(self, i: int) -> int:
        at = i * self.low_bits
        low = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little") >> (at & 7) & (1 << self.low_bits) - 1
        return ((self.select(i) - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits).astype(np.int64)
        return (high.astype(np.int64) << self.low_bits) | (bits << np.arange(self.low_bits)).sum(axis=1)


def dump_shard(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """Ids: little-endian 32-bit ids of each document, in ascending order of its doc_id, nulls first."""
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    ends = np.cumsum([len(b) // 4 for b in ids])
    body = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    return _MAGIC + struct.pack("<BQq", width, len(doc_ids) - len(known), least) + EliasFano.of(ends).dump() + EliasFano.of(np.array([x - least for x in known], np.uint64)).dump() + body


def load_shard(blob: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """doc_ids, ends of the documents, ids."""
    if blob[:4] != _MAGIC:
        raise ValueError("not a token file")
    width, nulls, least = struct.unpack_from("<BQq", blob, 4)
    ends, at = EliasFano.load(memoryview(blob), 4 + struct.calcsize("<BQq"))
    keys, at = EliasFano.load(memoryview(blob), at)
    return [None] * nulls + (keys.all() + least).tolist(), ends, np.frombuffer(blob, f"<u{width}", -1, at)


def token_shards(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """part int, shard int, start long (ids before it in the part), n_ids long, blob binary. docs: doc_id, text."""
    end = END_ID.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start, keys, held, n = TaskContext.get().partitionId(), 0, 0, [], [], 0
        width = 2 if len(bpe.encoder(path).v.tokens) <= 1 << 16 else 4

        def out():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([n], pa.int64()), "blob": pa.array([dump_shard(keys, held, width)], pa.binary())})

        for rows, ids in bpe.encoded_batches(batches, path):
            for k, b in zip(rows.column("doc_id").to_pylist(), ids):
                keys.append(k)
                held.append(b + end)
                n += len(b) // 4 + 1
                if n >= shard_ids:
                    yield out()
                    shard, start, keys, held, n = shard + 1, start + n, [], [], 0
        if keys:
            yield out()

    key = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), key)
    return ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key).mapInArrow(work, "part int, shard int, start long, n_ids long, blob binary")


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files. Only one sum a part goes to the driver."""
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(sums):
        before[part] = at
        at += sums[part]
    bases = shards.sparkSession.sparkContext.broadcast(before)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, coded, ids = load_shard(row["blob"])
                ends = np.array([coded[i] for i in range(coded.n)], np.int64)  # each by select()
                starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts + row["start"] + bases.value[row["part"]], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "start", "blob").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(materialize(token_shards(documents(spark, sf_dir)), "tokens"))
