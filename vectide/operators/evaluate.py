"""Accuracy and latency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins that a span of values is cut into, and how often a bin that holds a position is cut again.
BINS, LEVELS = 4096, 3


def spearman(both: DataFrame, key: str = "id") -> DataFrame:
    """(key, rho) for rows (key, tid, w1, w2), a missing weight null and counted as 0: ordinal ranks by weight descending, ties by token, then Pearson's correlation; 1 with up to two tokens."""
    filled = both.select(key, "tid", F.coalesce("w1", F.lit(0.0)).alias("w1"), F.coalesce("w2", F.lit(0.0)).alias("w2"))
    ranks = [F.row_number().over(Window.partitionBy(key).orderBy(F.desc(w), "tid")).cast("double").alias(r) for w, r in (("w1", "r1"), ("w2", "r2"))]
    ranked = filled.select(key, *ranks)
    return ranked.groupBy(key).agg(F.when(F.count(F.lit(1)) <= 2, F.lit(1.0)).otherwise(F.corr("r1", "r2")).alias("rho"))


def places(rows: DataFrame, key: str, scores: tuple[str, ...], k: int) -> DataFrame:
    """(key, a place for each score) of the rows among the ``k`` highest by any of the scores, ties by key.

    Only rows that some score puts among its first k are ranked against each other; a row's place by another score is
    one more than the rows above it, which are counted where they are.
    """
    top = None
    for s in scores:
        best = rows.orderBy(F.desc(s), key).limit(k).select(key, *scores)
        top = best if top is None else top.union(best)
    top = top.distinct()  # k rows a score at most
    named = top.select(F.col(key).alias("_key"), *[F.col(s).alias(f"_{s}") for s in scores])
    above = [F.count_if((F.col(s) > F.col(f"_{s}")) | ((F.col(s) == F.col(f"_{s}")) & (F.col(key) <= F.col("_key")))).alias(f"place_{s}") for s in scores]
    return rows.join(F.broadcast(named)).groupBy("_key").agg(*above).withColumnRenamed("_key", key)


def quantiles(rows: DataFrame, key: str, value: str, points: tuple[float, ...], inclusive: bool = False) -> DataFrame:
    """(key, n, p...): quantiles of the ordered values at position p * (n + 1), or p * (n - 1) + 1 where ``inclusive``, interpolated and within the ends; one value is itself.

    A group is not sorted in one task. The span of a group's values is cut into BINS equal bins, running counts find
    those that hold the two values next to each position, and these are cut again between their own ends; after LEVELS
    cuts the distinct values of what is left are ranked, each with its count. An outlier costs one cut.
    """
    base = rows.select(key, F.col(value).cast("double").alias("x")).dropna()
    ends = base.groupBy(key).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    place = F.col("p") * (F.col("n") - 1) + 1 if inclusive else F.col("p") * (F.col("n") + 1)
    asked = ends.select("*", F.explode(F.array(*[F.lit(p) for p in points])).alias("p"))
    asked = asked.withColumn("at", F.least(F.greatest(place, F.lit(1.0)), F.col("n").cast("double")))
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.least(F.floor("at") + 1, F.col("n"))))).alias("r"))
    # a span is known by its key and by how many values stand before it
    spans = asked.select(key, "r", "low", "high", F.lit(0).cast("long").alias("before")).distinct()

    def inside() -> DataFrame:
        return base.join(spans.select(key, "low", "high", "before").distinct(), key).where(F.col("x").between(F.col("low"), F.col("high")))

    def holding(counts: DataFrame, by: str) -> DataFrame:
        """Each wanted rank beside the part of its span that holds it; ``rank`` values stand before that part."""
        run = F.sum("c").over(Window.partitionBy(key, "before").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
        ranked = counts.withColumn("rank", F.col("before") + F.coalesce(run, F.lit(0)))
        return spans.select(key, "r", "before").join(ranked, [key, "before"]).where((F.col("r") > F.col("rank")) & (F.col("r") <= F.col("rank") + F.col("c")))

    width = F.col("high") - F.col("low")
    for _ in range(LEVELS):
        cut = inside().withColumn("bin", F.when(width > 0, F.floor((F.col("x") - F.col("low")) / width * (BINS - 1))).otherwise(0).cast("int"))
        parts = cut.groupBy(key, "before", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        spans = holding(parts, "bin").select(key, "r", "low", "high", F.col("rank").alias("before"))
    found = holding(inside().groupBy(key, "before", "x").agg(F.count(F.lit(1)).alias("c")), "x").select(key, "r", "x")
    got = asked.select(key, "n", "p", "at", "r").join(found, [key, "r"])
    share = F.when(F.col("r") == F.floor("at"), 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    values = got.groupBy(key, "n", "p").agg(F.sum(share * F.col("x")).alias("q"), F.count(F.lit(1)).alias("m"), F.max("x").alias("one"))
    # at the upper end there is one value only, and it stands alone
    values = values.withColumn("q", F.when(F.col("m") == 1, F.col("one")).otherwise(F.col("q")))
    return values.groupBy(key, "n").pivot("p", list(points)).agg(F.first("q"))
