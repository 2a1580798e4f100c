"""Connected components of an edge table: stars of what each partition has, then alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_A_PART, forget, map_arrow, saved

ROUNDS = 60
#: Edges that a task joins at once: at least those of a partition of a saved table that has one only.
AT_ONCE = 5 * ROWS_A_PART


def smallest_reached(edges: list[tuple[int, int]]) -> dict[int, int]:
    """For each node of ``edges`` the smallest that they lead to, itself left out."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: y for x in list(up) if (y := top(x)) != x}


def joined(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components as ``edges``: for each partition, AT_ONCE edges at a time, a star around the smallest node of each component."""

    def run(batches):
        def stars(held):
            found = smallest_reached(held)
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["u", "v"])

        held = []
        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            if len(held) >= AT_ONCE:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return map_arrow(edges, run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that can be reached. Nulls and loops are left out.

    First each partition's edges are joined by themselves: where there is one partition that is all. Otherwise each
    round joins every node's larger neighbours to the smallest of its neighbours and then its smaller neighbours
    to the smallest; minima are aggregated where the rows are, and no neighbourhood is gathered. Rounds grow with the
    logarithm of a component's size; the edges are written to the shared folder after each, and those of the round before are deleted.
    """
    first = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    now = saved(joined(first).distinct())
    forget(first)
    before = None
    for _ in range(ROUNDS if first.n_rows > ROWS_A_PART else 0):
        parts = now.rdd.getNumPartitions()
        # large star: a node's larger neighbours go to the smallest of it and its neighbours
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        found = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, saved(found, all=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).cast("string"))
        forget(last)
        if now.seen == before:
            break
        before = now.seen
    else:
        if first.n_rows > ROWS_A_PART:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
