"""BM25-Okapi over Parquet tables: build, append, search."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settled

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Distinct terms of queries that are broadcast (some 20 MB).
BROADCAST_TERMS = 200_000


class Index(NamedTuple):
    postings: DataFrame  # term, doc_id, tf, dl
    doc_stats: DataFrame  # doc_id, dl
    term_stats: DataFrame  # term, n, idf
    corpus_stats: DataFrame  # nd, avgdl, avg_idf: one row


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of docs (doc_id, tokens)."""
    return docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def _idf(n: Column, nd: Column) -> Column:
    return F.ln(nd - n + 0.5) - F.ln(n + 0.5)


def from_postings(tf: DataFrame, lengths: DataFrame) -> Index:
    """All statistics; documents without tokens count in nd and avgdl.  Terms in more than half of
    the documents get a quarter of the mean idf instead of their negative one."""
    sizes = settled(lengths.agg(F.count("*").alias("nd"), F.avg("dl").alias("avgdl")), "size")
    terms = tf.groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(sizes.select("nd")))  # one row
    raw = settled(terms.select("term", "n", _idf(F.col("n"), F.col("nd")).alias("idf")), "terms")
    mean = raw.agg(F.avg("idf").alias("avg_idf"))
    stats = raw.crossJoin(F.broadcast(mean)).select("term", "n", F.when(F.col("idf") < 0, FLOOR * F.col("avg_idf")).otherwise(F.col("idf")).alias("idf"))
    return Index(tf, lengths, stats, settled(sizes.crossJoin(mean), "corpus"))


def _held(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of docs (doc_id, tokens), whose text is tokenized once for both: a document
    without tokens has a row with a null term."""
    rows = docs.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term"))
    held = settled(rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")), "postings")
    return held.filter("term IS NOT NULL").select("term", "doc_id", "tf", "dl"), held.groupBy("doc_id").agg(F.max("dl").alias("dl"))


def build(docs: DataFrame) -> Index:
    """Index of docs (doc_id, tokens)."""
    return from_postings(*_held(docs))


def append(index: Index, docs: DataFrame) -> Index:
    """The index with more documents: postings are added, statistics are computed anew from them.
    Documents whose id the index has already are left out."""
    new = docs.join(index.doc_stats.select("doc_id"), "doc_id", "left_anti")
    held, sizes = _held(new)
    return from_postings(index.postings.unionByName(held), index.doc_stats.unionByName(sizes))


def scores(queries: DataFrame, index: Index, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) for queries (query_id, tokens); repeated query terms count each.

    The queries' terms get their idf first; up to BROADCAST_TERMS of them are broadcast, so that postings
    of other terms go where they are read, and more are joined by term.  Postings know their document's
    length, so hits are only moved to be added up.
    """
    terms = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    asked = settled(terms.join(index.term_stats.select("term", "idf"), "term"), "asked")
    if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    hit = index.postings.join(asked, "term").crossJoin(F.broadcast(index.corpus_stats.select("avgdl")))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top(hits: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query with 1-based ranks; scores are compared to nine digits, ties go to
    the smaller doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 9)), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int = 50) -> DataFrame:
    """(query_id, doc_id, score, rank), positive scores only."""
    return top(scores(queries, index).filter("score > 0"), k)
