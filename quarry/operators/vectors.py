"""Dense vectors: centroids, nearest centroid, k nearest neighbours, retrieval metrics, singular vectors.

A vector is an array; products are unrolled over its known dimension, so they stay in generated code. Centroids and
queries are broadcast in blocks of at most BROADCAST_ROWS: one block where there are few, and one after the other where
there are more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from importlib.util import find_spec

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.sources.shared import materialize

#: Rows of a block that is broadcast (at some kilobytes each).
BROADCAST_ROWS = 5_000
#: Distances that a task holds at once.
_HELD = 1_000_000
#: Columns of a matrix up to which all products of two columns are summed at once (8 MB a task), and tasks that sum them.
GRAM_COLUMNS, GRAM_TASKS = 1_000, 64


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    row = vectors.select(F.size(column).alias("n")).where("n > 0").first()
    return row["n"] if row else 0


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """df in parts of about BROADCAST_ROWS rows at most, each with a broadcast hint, dealt by a hash of key."""
    n = -(-df.count() // BROADCAST_ROWS)
    return [F.broadcast(df)] if n <= 1 else [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(2 * n)) == k)) for k in range(2 * n)]


def dot(a: Column, b: Column, dim: int) -> Column:
    return reduce(lambda x, y: x + y, [F.get(a, k).cast("double") * F.get(b, k).cast("double") for k in range(dim)], F.lit(0.0))


def squared_distance(a: Column, b: Column, dim: int) -> Column:
    diff = [F.get(a, k).cast("double") - F.get(b, k).cast("double") for k in range(dim)]
    return reduce(lambda x, y: x + y, [d * d for d in diff], F.lit(0.0))


def centroids(vectors: DataFrame, group: str, column: str = "embedding", dim: int | None = None) -> DataFrame:
    """group, centroid: mean of each dimension, one pass with map-side sums."""
    dim = dimension(vectors, column) if dim is None else dim
    sums = vectors.groupBy(group).agg(*[F.avg(F.get(F.col(column), k).cast("double")).alias(f"_m{k}") for k in range(dim)])
    return sums.select(group, F.array(*[F.col(f"_m{k}") for k in range(dim)]).alias("centroid"))


def nearest(vectors: DataFrame, centers: DataFrame, label: str, dim: int, column: str = "embedding") -> DataFrame:
    """vectors but for column, with label (of the nearest center, ties to the smallest) and distance; repeated rows stay.

    Rows are compared where they lie, with blocks of centers (one row a cluster) that the driver hands out; nothing is
    exchanged. Without centers both are null.
    """
    spark, kind = vectors.sparkSession, centers.schema[label].dataType
    held = sorted((r[0], r[1]) for r in centers.select(label, "centroid").toLocalIterator())
    kept, dim = [c for c in vectors.columns if c != column], len(held[0][1]) if held else dim
    parts = [(spark.sparkContext.broadcast(np.array([c for _, c in b], float).reshape(len(b), dim)), k) for k in range(0, len(held), BROADCAST_ROWS) for b in (held[k : k + BROADCAST_ROWS],)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(column).to_pylist(), float).reshape(batch.num_rows, dim)
            best, at = np.full(len(x), np.inf), np.full(len(x), -1)
            for block, first in parts:
                step = max(1, _HELD // (len(block.value) * dim))
                for i in range(0, len(x), step):
                    d = ((x[i : i + step, None, :] - block.value[None]) ** 2).sum(axis=2)
                    k = d.argmin(axis=1)
                    d = d[np.arange(len(d)), k]
                    new = d < best[i : i + step]
                    best[i : i + step][new], at[i : i + step][new] = d[new], first + k[new]
            none = at < 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(at, mask=none), pa.array(np.sqrt(best), mask=none)], [*kept, "_at", "distance"])

    schema = vectors.select(*kept).schema.add("_at", "long").add("distance", "double")
    found = vectors.mapInArrow(work, schema)
    return found.select(*kept, F.get(F.lit([k for k, _ in held]).cast(f"array<{kind.simpleString()}>"), F.col("_at").cast("int")).alias(label), "distance")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, dim: int, q_id: str, c_id: str) -> DataFrame:
    """q_id, rank, c_id, score (cosine) of the k nearest of each query; ties by id. queries: q_id, vector; a stated set, compared with all rows in blocks that are broadcast; of each task k rows a query are exchanged."""
    a, b = F.col("vector"), F.col("embedding")
    order = Window.partitionBy(q_id).orderBy(F.round("score", 9).desc(), F.col(c_id))

    def best(block: DataFrame) -> DataFrame:
        scored = corpus.crossJoin(block).withColumn("score", dot(a, b, dim) / F.sqrt(dot(a, a, dim) * dot(b, b, dim))).drop("vector", "embedding")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    return reduce(DataFrame.union, map(best, blocks(queries.select(q_id, "vector"), q_id)))


def backend(wanted: str = "exact") -> str:
    """The index to use: a wanted library if it is installed, else the exact comparison of top_k()."""
    return wanted if wanted == "exact" or find_spec(wanted) else "exact"


def retrieval_metrics(hits: DataFrame, support: DataFrame, n_queries: int, query: str = "label", found: str = "found", ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """k, mrr, hit_rate weighted by the support of each query. hits: query, rank, found; support: query, weight."""
    first = hits.groupBy(query).agg(F.min(F.when(F.col(found) == F.col(query), F.col("rank"))).alias("first"))
    ks_df = hits.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    w = first.join(support, query).join(F.broadcast(ks_df), F.lit(True))
    inside = F.col("first").isNotNull() & (F.col("first") <= F.col("k"))
    return w.groupBy("k").agg(
        (F.sum(F.when(inside, F.col("weight") / F.col("first")).otherwise(0.0)) / F.sum("weight")).alias("mrr"), (F.sum(F.when(inside, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("hit_rate"),
        F.lit(n_queries).cast("long").alias("query_classes"), F.sum("weight").alias("weighted_docs"),
    )


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, rows, and each entry's row (from 0), column and weight, of blocks of so many rows that they have _HELD entries over GRAM_COLUMNS columns."""
    sizes = np.diff(batch.column("column").offsets.to_numpy())
    columns, weights, ends = batch.column("column").flatten().to_numpy(), batch.column("weight").flatten().to_numpy(), np.append(0, np.cumsum(sizes))
    for i in range(0, len(sizes), _HELD // GRAM_COLUMNS):
        n = min(_HELD // GRAM_COLUMNS, len(sizes) - i)
        at = slice(ends[i], ends[i + n])
        yield i, n, np.repeat(np.arange(n), sizes[i : i + n]), columns[at], weights[at]


def _gram(rows: DataFrame, n: int) -> np.ndarray:
    """Sums of the products of all pairs of n columns: a matrix a task, added up row by row in a second step."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((n, n))
        for batch in batches:
            for _, k, row, column, weight in _entries(batch):
                x = np.zeros((k, n))
                x[row, column] = weight
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["i", "g"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, g in zip(batch.column("i").to_pylist(), batch.column("g").flatten().to_numpy().reshape(-1, n)):
                held[i] = held[i] + g if i in held else g.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "g"])

    out = np.zeros((n, n))
    for r in rows.coalesce(GRAM_TASKS).mapInArrow(products, "i int, g array<double>").repartition(8, "i").mapInArrow(added, "i int, g array<double>").toLocalIterator():
        out[r["i"]] = r["g"]
    return out


def singular_vectors(long_form: DataFrame, components: int) -> DataFrame:
    """id, embedding: projection on the right singular vectors of the uncentred matrix given as id, column, weight (column: index from 0).

    The matrix is written once. Up to GRAM_COLUMNS columns its vectors are those of the matrix of products, which takes
    one pass; MLlib's iteration, for more, takes a pass a step.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    entry = F.struct(F.col("column").cast("int").alias("column"), F.col("weight").cast("double").alias("weight"))
    rows = materialize(long_form.groupBy("id").agg(F.collect_list(entry).alias("x")).select("id", "x.column", "x.weight"), "matrix")
    n = int(rows.agg(F.max(F.array_max("column"))).first()[0] or 0) + 1
    if n <= GRAM_COLUMNS:
        values, right = np.linalg.eigh(_gram(rows, n))
        kept = [k for k in range(n - 1, -1, -1)[: min(components, n)] if values[k] > 0 and values[k] >= 1e-18 * values[-1]]
        v = right[:, kept]
    else:
        matrix = IndexedRowMatrix(rows.rdd.map(lambda r: IndexedRow(int(r["id"]), Vectors.sparse(n, sorted(zip(r["column"], r["weight"]))))))
        v = matrix.computeSVD(min(components, n), computeU=False).V.toArray()
    held = rows.sparkSession.sparkContext.broadcast(v)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k, row, column, weight in _entries(batch):
                y = np.zeros((k, held.value.shape[1]))
                for c in range(y.shape[1]):
                    y[:, c] = np.bincount(row, weight * held.value[column, c], k)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, k), pa.array(list(y), pa.list_(pa.float64()))], ["id", "embedding"])

    return rows.mapInArrow(projected, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>")
