"""Scores of (query, passage) pairs by all three representations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import MAX_LENGTH, QUERY_MAX_LENGTH
from ..sources.model_files import Vocabulary
from .encoding import Backbone, Heads, encode
from .tokenizer import token_ids


def compute_score(pairs: DataFrame, vocabulary: Vocabulary, backbone: Backbone, heads: Heads, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), query_length: int = QUERY_MAX_LENGTH, passage_length: int = MAX_LENGTH, wide: bool = False) -> DataFrame:
    """(pair_id, dense, sparse, colbert, sparse_dense, colbert_sparse_dense) of (pair_id, query, passage).

    Each distinct text is encoded once for each of the two limits. Tokens that two texts don't share add nothing; a
    pair without common tokens scores 0 there. ``wide``: in double.
    """
    if len(weights) != 3:
        raise ValueError("three weights are needed: dense, sparse, colbert")
    sides = {}
    for side, limit in (("query", query_length), ("passage", passage_length)):
        texts = pairs.select(F.coalesce(side, F.lit("")).alias("text")).distinct().withColumn("key", F.col("text"))
        ids = token_ids(texts, "key", "text", vocabulary, limit)
        sides[side] = encode(ids, backbone, heads, key="key", dense=True, sparse=True, colbert=True, wide=wide)
    q = sides["query"].toDF("query", "qd", "qs", "qc")
    p = sides["passage"].toDF("passage", "pd", "ps", "pc")
    own = pairs.select("pair_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("query", "passage")]).join(q, "query").join(p, "passage")
    shared = F.aggregate(F.map_entries("qs"), F.lit(0.0), lambda a, e: a + e["value"].cast("double") * F.coalesce(F.try_element_at("ps", e["key"]).cast("double"), F.lit(0.0)))
    best = F.transform("qc", lambda x: F.array_max(F.transform("pc", lambda y: V.dot(x, y))))
    colbert = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size("qc")
    scored = own.select("pair_id", V.dot(F.col("qd"), F.col("pd")).alias("dense"), shared.alias("sparse"), colbert.alias("colbert"))
    two, three = V.hybrid(F.col("dense"), F.col("sparse"), F.col("colbert"), weights)
    return scored.select("*", two.alias("sparse_dense"), three.alias("colbert_sparse_dense"))
