"""Greedy batches of texts under a budget of padded tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .integrity import running_sums

BATCH_SIZE, BATCH_TOKENS = 12, 16_384
#: Fixed value: texts of one calibration chunk.
CHUNK = 8


def calibration_chunks(items: DataFrame, size: int = CHUNK) -> DataFrame:
    """(idx, n, chunk, place) of all items (idx, n), n being a text's tokens within the encoder's limit: longest first, ties by idx, ``size`` to a chunk.

    A text's rank is the number of longer ones, from a table of a row a length, and of those before it of its own
    length, counted by blocks; nothing is sorted as a whole.
    """
    if size < 1:
        raise ValueError("size must be positive")
    lengths = items.groupBy("n").agg(F.count(F.lit(1)).alias("of"))
    longer = F.coalesce(F.sum("of").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = running_sums(items.select("idx", "n"), "n", "idx", F.lit(1).cast("long")).join(F.broadcast(lengths.select("n", longer.alias("longer"))), "n")
    rank = F.col("longer") + F.col("offset")
    return ranked.select("idx", "n", F.floor(rank / size).alias("chunk"), (rank % size).cast("int").alias("place"))


def batch_plan(items: DataFrame, call: str, batch_size: int = BATCH_SIZE, budget: int = BATCH_TOKENS) -> DataFrame:
    """(call, idx, n, batch, place, width) for items (call, idx, n), n being a text's tokens.

    A call's texts are taken longest first, ties by idx. A batch is as wide as its first text; a text begins a new one
    where the batch has ``batch_size`` texts or would, with it, exceed the budget of padded tokens. A text longer than
    the budget is alone. The fold runs over each call's own list, so calls should be bounded.
    """
    if batch_size < 1 or budget < 1:
        raise ValueError("batch_size and budget must be positive")
    listed = items.groupBy(call).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("idx").alias("idx")))).alias("xs"))
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("count"), F.lit(0).cast("long").alias("width"), F.array().cast("array<struct<idx:bigint,n:bigint,batch:int,place:int,width:bigint>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        n = (-x["m"]).cast("long")
        new = (state["batch"] < 0) | (state["count"] >= batch_size) | ((state["count"] + 1) * state["width"] > budget)
        batch = F.when(new, state["batch"] + 1).otherwise(state["batch"])
        place = F.when(new, F.lit(0)).otherwise(state["count"])
        width = F.when(new, n).otherwise(state["width"])
        row = F.struct(x["idx"].cast("long").alias("idx"), n.alias("n"), batch.alias("batch"), place.alias("place"), width.alias("width"))
        return F.struct(batch.alias("batch"), (place + 1).alias("count"), width.alias("width"), F.concat(state["out"], F.array(row)).alias("out"))

    return listed.select(call, F.inline(F.aggregate("xs", start, step)["out"]))
