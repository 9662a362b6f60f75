"""Fusing lexical and semantic hits: reciprocal ranks, or weighted min-max scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import top

RRF_K = 60
LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.3, 0.7
LEXICAL_K, SEMANTIC_K, FINAL_K = 50, 50, 10


def normalize_scores(hits: DataFrame, method: str = "minmax") -> DataFrame:
    """Scores of each query on [0, 1]; where all are equal, or there is one, they become 0."""
    if method != "minmax":
        raise ValueError(f"unknown normalisation: {method!r}")
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", (F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low))


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score): the sum of 1 / (k + rank) over the lanes that have the document."""
    both = lexical.select("query_id", "doc_id", "rank").unionByName(semantic.select("query_id", "doc_id", "rank"))
    return both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def weighted(lexical: DataFrame, semantic: DataFrame, lexical_weight: float = LEXICAL_WEIGHT, semantic_weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """Weighted sum of the min-max scores; a lane without the document counts as 0."""
    parts = [normalize_scores(h.select("query_id", "doc_id", "score")).withColumn("score", F.col("score") * w) for h, w in ((lexical, lexical_weight), (semantic, semantic_weight))]
    return parts[0].unionByName(parts[1]).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def fuse(lexical: DataFrame, semantic: DataFrame, strategy: str = "rrf", **options) -> DataFrame:
    if strategy == "rrf":
        return rrf(lexical, semantic, **options)
    if strategy == "weighted":
        return weighted(lexical, semantic, **options)
    raise ValueError(f"unknown strategy: {strategy!r}")


def rank_results(hits: DataFrame, k: int = FINAL_K) -> DataFrame:
    return top(hits, k or FINAL_K)
