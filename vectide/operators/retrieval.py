"""Exact nearest vectors of a query set, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles

#: Bytes of query vectors sent to every task at once; more queries are taken in several passes over the rows.
BLOCK_BYTES = 32 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products summed from left to right, as SQL does, so that ties are ties."""
    out = np.zeros((len(rows), len(queries)))
    for j in range(rows.shape[1]):
        out += rows[:, j : j + 1] * queries[:, j]
    return out


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score, rank): the ``k`` rows of the highest inner product for each query, ties by row_id.

    ``queries`` and ``rows``: (id, vector), of one length. Each task keeps k candidates a query, so what is shuffled
    grows with tasks and queries and not with rows times queries.
    """
    spark = rows.sparkSession
    queries = queries.select(F.col("id").cast("long"), doubles(F.col("vector")).alias("vector")).dropna()
    rows = rows.select(F.col("id").cast("long"), doubles(F.col("vector")).alias("vector")).dropna()
    first = queries.select(F.size("vector")).first()
    count = queries.count()
    schema = "query_id long, row_id long, score double"
    if first is None:
        return spark.createDataFrame([], schema + ", rank int")
    blocks = max(1, -(-count * first[0] * 8 // BLOCK_BYTES))
    parts = None
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        got = block.toArrow()
        shared = spark.sparkContext.broadcast((np.array(got.column(0).to_pylist(), np.int64), _matrix(got.column(1))))

        def nearest(batches, shared=shared):
            ids, q = shared.value
            best = np.zeros((0, len(ids)))
            best_id = np.zeros((0, len(ids)), np.int64)
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    if not part.num_rows or not len(ids):
                        continue
                    s = np.vstack([best, scores(_matrix(part.column(1)), q)])
                    r = np.vstack([best_id, np.repeat(np.array(part.column(0).to_pylist(), np.int64)[:, None], len(ids), axis=1)])
                    order = np.lexsort((r, -s), axis=0)[:k]
                    best, best_id = np.take_along_axis(s, order, 0), np.take_along_axis(r, order, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(best))), pa.array(best_id.ravel()), pa.array(best.ravel())], ["query_id", "row_id", "score"])

        found = rows.mapInArrow(nearest, schema)
        parts = found if parts is None else parts.union(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def max_sim(queries: DataFrame, rows: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, row_id, score), with rank too where ``k`` is given: late interaction, the mean over a query's vectors of the best inner product with the row's.

    ``queries`` and ``rows``: (id, pos, vector), several vectors an id. Rows are dealt out by id, so a task has all of
    an id's vectors and finishes its scores; with ``k`` it keeps k rows a query, by score to 9 places and then by id.
    Queries are sent in blocks, a query's vectors in one.
    """
    spark = rows.sparkSession
    queries = queries.select(F.col("id").cast("long"), doubles(F.col("vector")).alias("vector")).dropna()
    rows = rows.select(F.col("id").cast("long"), doubles(F.col("vector")).alias("vector")).dropna()
    schema = "query_id long, row_id long, score double"
    first = queries.select(F.size("vector")).first()
    if first is None:
        return spark.createDataFrame([], schema + (", rank int" if k else ""))
    blocks = max(1, -(-queries.count() * first[0] * 8 // BLOCK_BYTES))
    dealt = rows.repartition("id").sortWithinPartitions("id")
    parts = None
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        got = block.orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((np.array(got.column(0).to_pylist(), np.int64), _matrix(got.column(1))))

        def finish(batches, shared=shared):
            """Whole ids at a time: the last one of a batch waits for the next batch."""
            owner, q = shared.value
            names, start, sizes = np.unique(owner, return_index=True, return_counts=True)
            best, best_id = np.zeros((0, len(names))), np.zeros((0, len(names)), np.int64)

            def scored(ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                own, at = np.unique(ids, return_index=True)
                most = np.maximum.reduceat(scores(matrix, q), at, axis=0)
                return own, np.add.reduceat(most, start, axis=1) / sizes

            held = None
            for ids, matrix in _with_end(_chunks(batches)):
                if ids is None:
                    if held is None:
                        break
                    ids, matrix, whole = *held, len(held[0])
                else:
                    if held is not None:
                        ids, matrix = np.concatenate([held[0], ids]), np.vstack([held[1], matrix])
                    whole = int(np.searchsorted(ids, ids[-1]))
                    held = ids[whole:], matrix[whole:]
                if not whole:
                    continue
                own, s = scored(ids[:whole], matrix[:whole])
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(own))), pa.array(np.repeat(own, len(names))), pa.array(s.ravel())], ["query_id", "row_id", "score"])
                    continue
                s = np.vstack([best, s])
                r = np.vstack([best_id, np.repeat(own[:, None], len(names), axis=1)])
                order = np.lexsort((r, -np.round(s, 9)), axis=0)[:k]
                best, best_id = np.take_along_axis(s, order, 0), np.take_along_axis(r, order, 0)
            if k is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(best))), pa.array(best_id.ravel()), pa.array(best.ravel())], ["query_id", "row_id", "score"])

        found = dealt.mapInArrow(finish, schema)
        parts = found if parts is None else parts.union(found)
    if k is None:
        return parts
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def _chunks(batches):
    """(ids, vectors) of some rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            yield np.array(part.column(0).to_pylist(), np.int64), _matrix(part.column(1))


def _with_end(chunks):
    yield from chunks
    yield None, None
