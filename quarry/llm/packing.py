"""Best-fit packing planned on the histogram of lengths.

Documents are encoded once, where they lie; longer ones than a sequence are cut. What is written is one small row a
piece: its length, and its rank among the pieces of that length in its task. The histogram (at most one count a
length) goes to the driver, which runs best fit decreasing over counts: bins of equal room are handled as ranges. The
plan says, for a length and a range of ranks, the first sequence and the offset. Ranks over all tasks are sums of
counts by task; pieces then look up their slots by length and rank. The plan's size depends on the sequence length
alone, not on the number of documents.

Null and empty texts have the end id alone. Repeated rows are packed as often as they occur. Equal lengths are ranked
by task and order within it. Other columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.llm import bpe
from quarry.llm.common import documents, materialize

SEQUENCE, END_ID = 4096, 1


def plan_best_fit(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset), sorted: rank r of the length from first rank on goes to first sequence + r - first rank."""
    plan, bins = [], 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges of sequences
    rooms: list[int] = []

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if not free[left]:
                bisect.insort(rooms, left)
            free[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, n = free[left].pop()
                if not free[left]:
                    del rooms[k]
            else:
                left, first, n = room, bins, -(-count // (room // length))
                bins += n
            each = left // length
            full = min(n, count // each)
            # full bins take `each` pieces; one more bin takes what is left, if that is less
            for m, at, q in ((full, first, each), (1, first + full, count - full * each)) if full < n and count - full * each < each else ((full, first, each),):
                for j in range(q if m else 0):
                    plan.append((length, rank, at, room - left + j * length))
                    rank += m
                    count -= m
                if m and q:
                    put(left - q * length, at, m)
            used = full + (1 if full < n and count == 0 and rank and plan[-1][2] == first + full else 0)
            put(left, first + used, n - used)
    return sorted(plan)


def pieces(docs: DataFrame, path: str | None = None, room: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, rank: one row a piece."""
    end = END_ID.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64).tolist()
        for rows, ids in bpe.encoded_batches(batches, path):
            found = []
            for key, b in zip(rows.column("doc_id").to_pylist(), ids):
                b += end
                for k, at in enumerate(range(0, len(b), 4 * room)):
                    cut = b[at : at + 4 * room]
                    n = len(cut) // 4
                    found.append((key, k, at // 4, n, zlib.crc32(cut), task, seen[n]))
                    seen[n] += 1
            columns = list(zip(*found)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (rows.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def assign(found: DataFrame, room: int = SEQUENCE) -> DataFrame:
    """found (length, task, rank and other columns) with sequence_id and offset instead of task and rank."""
    counts = found.groupBy("task", "length").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # room rows at most
    plan = np.array(plan_best_fit(histogram, room), np.int64).reshape(-1, 4)
    held = found.sparkSession.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan[:, 1:]))
    names = [c for c in found.columns if c not in ("task", "rank")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots = held.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(rank) else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(slot[:, 1] + rank - slot[:, 0]), pa.array(slot[:, 2])], [*names, "sequence_id", "offset"])

    ranked = found.join(bases, ["task", "length"]).select(*names, (F.col("rank") + F.col("_base")).alias("rank"))
    return ranked.mapInArrow(work, ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, room: int = SEQUENCE) -> DataFrame:
    return assign(materialize(pieces(docs, path, room), "pieces"), room)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents packed into sequences."""
    return pack(docs)
