"""Sparse token weights: pooling, matching and retrieval on long form (id, tid, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BEGIN, END, PAD, UNKNOWN


def max_pool(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, tid, w): the largest weight of each token of a text; begin, pad, end and unknown are left out (the mask token is not), and so are weights that are not positive."""
    kept = tokens.where(~F.col("tid").isin(BEGIN, PAD, END, UNKNOWN) & (F.col("w") > 0))
    return kept.groupBy(*keys, "tid").agg(F.max("w").alias("w"))


def match(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score) for each pair: the sum over common tokens of the products of weights, 0 without any."""
    a = pairs.join(left.select(F.col("id").alias("a"), "tid", F.col("w").alias("wa")), "a")
    both = a.join(right.select(F.col("id").alias("b"), "tid", F.col("w").alias("wb")), ["b", "tid"])
    sums = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))
    return pairs.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_tokens(weights: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest tokens of each text, ties by token."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "tid"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score, rank): the ``k`` best matches of each query; an equi-join on tokens, whose frequent ones adaptive execution splits. Scores are rounded to 9 places before ranking, ties go by row_id."""
    q = queries.select(F.col("id").alias("query_id"), "tid", F.col("w").alias("wq"))
    sums = rows.join(q, "tid").groupBy("query_id", F.col("id").alias("row_id")).agg(F.round(F.sum(F.col("w") * F.col("wq")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)


def as_map(id_: str, weights: DataFrame, value: Column) -> DataFrame:
    """(id, weights): a map from the token's decimal string to ``value``, in order of tokens."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("tid", value.alias("v")))), lambda e: F.struct(e["tid"].cast("string"), e["v"]))
    return weights.groupBy(id_).agg(F.map_from_entries(entries).alias("weights"))
