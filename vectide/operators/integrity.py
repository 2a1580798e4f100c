"""Content digests, shared contents, aligned offsets and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: alignment of stored tensors in bytes.
ALIGNMENT = 64
#: Ids of one block of a running sum.
BLOCK = 1024


def aligned(n: Column) -> Column:
    return (F.ceil(n / ALIGNMENT) * ALIGNMENT).cast("long")


def running_offsets(rows: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """``rows`` with ``offset``: the sum of the aligned sizes of the key's rows before, by ``order`` (a whole number, no ties)."""
    return running_sums(rows, key, order, aligned(size))


def running_sums(rows: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """``rows`` with ``offset``: the sum of ``size`` over the key's rows before, by ``order`` (a whole number, no ties).

    In two steps, so that no key is one task's: sums of blocks of the order, and then rows within their block.
    """
    own = rows.withColumn("_size", size).withColumn("_block", F.floor(F.col(order) / BLOCK))
    blocks = own.groupBy(key, "_block").agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(key, "_block", before.alias("_before"))
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_inside", inside).join(blocks, [key, "_block"]).withColumn("offset", F.col("_before") + F.col("_inside")).drop("_size", "_block", "_before", "_inside")


def shared_contents(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """(digest, first_id, copies, bytes, saved) for each distinct content."""
    own = rows.select(F.col(key).alias("_id"), F.sha1(content).alias("digest"), F.octet_length(content).cast("long").alias("bytes"))
    got = own.groupBy("digest", "bytes").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return got.withColumn("saved", (F.col("copies") - 1) * F.col("bytes"))


def require_disjoint(held_out: DataFrame, seen: DataFrame, text: str = "text") -> None:
    """An error if a text of ``held_out`` that isn't blank stands in ``seen`` too."""
    both = held_out.where(F.trim(text) != "").select(text).distinct().join(seen.select(text), text, "left_semi").count()
    if both:
        raise ValueError(f"{both} held-out texts have been seen")
