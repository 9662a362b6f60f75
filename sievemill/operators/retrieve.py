"""Hybrid retrieval: the engine's public interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import settled
from ..sources import tables
from . import bm25, fusion, gate, vector


def is_blank(raw: Column) -> Column:
    return tx.clean(raw) == ""


def preprocess(queries: DataFrame, blank: str = "skip") -> DataFrame:
    """queries (query_id, raw) with ``tokens`` and ``semantic_text``.  Blank ones have no results: they
    are left out (and ``respond`` tells them), or with ``blank`` "error" fail the search."""
    if blank not in ("skip", "error"):
        raise ValueError(f"unknown way with blank queries: {blank!r}")
    if blank == "error":
        wrong = F.raise_error(F.format_string("query %s is empty", F.col("query_id").cast("string"))).cast("string")
        out = queries.withColumn("raw", F.when(is_blank(F.col("raw")), wrong).otherwise(F.col("raw")))
    else:
        out = queries.filter(~is_blank(F.col("raw")))
    return out.withColumns({"tokens": tx.lexical(F.col("raw")), "semantic_text": tx.semantic(F.col("raw"))})


def enrich(hits: DataFrame, docs: DataFrame, snippet: int = 300, always: bool = False) -> DataFrame:
    """rank, doc_id, score (6 digits), title, snippet, source and url; unknown documents get defaults."""
    d = docs.select(F.col("id").alias("doc_id"), "title", "content", "source", "url")
    out = hits.join(d, "doc_id", "left")
    return out.select(
        "query_id", "rank", "doc_id", F.round("score", 6).alias("score"), F.coalesce("title", F.lit("Unknown")).alias("title"), tx.snippet(F.col("content"), snippet, always).alias("snippet"),
        F.coalesce("source", F.lit("Unknown")).alias("source"), F.coalesce("url", F.lit("")).alias("url"),
    )


def get_texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, content) of the ids (doc_id) that are known."""
    return docs.select(F.col("id").alias("doc_id"), "content").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def needs_fallback(hits: DataFrame, queries: DataFrame, few: int = 2, low: float = 0.3) -> DataFrame:
    """(query_id, web_fallback): fewer than ``few`` results, or the best below ``low``."""
    best = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    out = queries.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", ((F.coalesce("n", F.lit(0)) < few) | (F.coalesce("best", F.lit(0.0)) < low)).alias("web_fallback"))


def respond(results: DataFrame, fallback: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row a query: its results as an array of structs, and whether it fell back; with the queries
    (query_id, raw), ``error`` says which of them are empty."""
    if queries is not None:
        error = F.when(is_blank(F.col("raw")), F.lit("query is empty"))
        fallback = fallback.join(queries.select("query_id", error.alias("error")), "query_id", "left")
    one = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "score", "snippet", "url", "doc_id"))).alias("results"))
    return fallback.join(one, "query_id", "left")


class Engine:
    """Indexes documents (id, title, content, source, url) and answers batches of queries.

    The encoder turns a text column into vectors; without one, queries bring an ``embedding``.
    """

    def __init__(self, docs: DataFrame, index: bm25.Index, vectors: DataFrame, encoder: vector.Encoder | None = None) -> None:
        self.docs, self.index, self.vectors, self.encoder = docs, index, vectors, encoder

    @classmethod
    def build(cls, docs: DataFrame, encoder: vector.Encoder | None = None, vectors: DataFrame | None = None) -> Engine:
        ready = settled(gate.indexable(docs), "indexable")
        if ready.isEmpty():
            raise ValueError("no document can be indexed")
        index = bm25.build(ready.select(F.col("id").alias("doc_id"), "tokens"))
        if vectors is None:
            if encoder is None:
                raise ValueError("give vectors or an encoder")
            vectors = ready.select(F.col("id").alias("doc_id"), encoder.encode(F.col("semantic")).alias("embedding"))
        elif encoder is not None:
            vectors = vector.check_dimension(vectors, encoder.dimension)
        return cls(ready.drop("tokens", "semantic"), index, vectors, encoder)

    def add(self, docs: DataFrame, vectors: DataFrame | None = None) -> Engine:
        """The engine with more documents; ids that it has are left out."""
        new = gate.appendable(docs).join(self.docs.select("id"), "id", "left_anti").dropDuplicates(["id"])
        index = bm25.append(self.index, new.select(F.col("id").alias("doc_id"), "tokens"))
        if vectors is None:
            if self.encoder is None:
                raise ValueError("give vectors or an encoder")
            vectors = new.select(F.col("id").alias("doc_id"), self.encoder.encode(F.col("semantic")).alias("embedding"))
        vectors = vector.check_dimension(vectors, self.dimension())
        docs = self.docs.unionByName(new.drop("tokens", "semantic"), allowMissingColumns=True)
        return Engine(docs, index, self.vectors.unionByName(vectors, allowMissingColumns=True), self.encoder)

    def dimension(self) -> int:
        """Components of the vectors that the engine holds."""
        if self.encoder is not None:
            return self.encoder.dimension
        found = self.vectors.select(F.size("embedding")).first()
        if found is None:
            raise ValueError("an engine without vectors has no dimension")
        return found[0]

    def save(self, path: str) -> None:
        tables.save_index(self.index, self.vectors, self.docs, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: vector.Encoder | None = None) -> Engine:
        """RuntimeError where a table is missing."""
        index, vectors, docs = tables.load_index(spark, path)
        return cls(docs, index, vectors, encoder)

    def lexical(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return bm25.search(queries, self.index, k or fusion.FINAL_K)

    def semantic(self, queries: DataFrame, k: int = 10) -> DataFrame:
        if "embedding" not in queries.columns:
            if self.encoder is None:
                raise ValueError("queries need an embedding, or the engine an encoder")
            queries = queries.withColumn("embedding", self.encoder.encode(F.col("semantic_text")))
        elif not self.vectors.isEmpty():
            queries = vector.check_dimension(queries, self.dimension())
        return vector.search(queries.filter("embedding IS NOT NULL"), self.vectors, k or fusion.FINAL_K)

    def retrieve(self, queries: DataFrame, k: int = fusion.FINAL_K, strategy: str = "rrf", blank: str = "skip") -> DataFrame:
        """Enriched results of queries (query_id, raw[, embedding])."""
        ready = preprocess(queries, blank)
        fused = fusion.fuse(self.lexical(ready, fusion.LEXICAL_K), self.semantic(ready, fusion.SEMANTIC_K), strategy)
        return enrich(fusion.rank_results(fused, k), self.docs)

    def similar(self, ids: DataFrame, k: int = 10) -> DataFrame:
        """The k documents nearest to each of ids (doc_id), itself left out."""
        q = self.vectors.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "embedding")
        found = vector.search(q, self.vectors, k + 1).filter("query_id <> doc_id").drop("rank")
        return bm25.top(found, k)


def evaluate(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at k of each query; relevant: (query_id, doc_id)."""
    rel = relevant.distinct().withColumn("rel", F.lit(1))
    got = hits.filter(F.col("rank") <= k).join(rel, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    per = got.groupBy("query_id").agg(F.sum("rel").alias("found"), F.max(F.col("rel") / F.col("rank")).alias("mrr"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    n = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = n.withColumn("ideal", F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0)))
    out = ideal.join(per, "query_id", "left").fillna(0)
    return out.select("query_id", (F.col("found") / k).alias("precision"), (F.col("found") / F.col("n")).alias("recall"), F.col("mrr").cast("double").alias("mrr"), (F.col("dcg") / F.col("ideal")).alias("ndcg"))
