"""From pages to a corpus: crawl, parse, language, gate, quota; and growing it for weak queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions import language as lang
from ..scratch import settled
from . import corpus, gate, retrieve

#: Accepted documents that each language is to have.
LANGUAGE_TARGETS = {"en": 1200, "es": 800}


def parse_pages(crawled: DataFrame) -> DataFrame:
    """Documents without ids of crawled pages (url, html and hints)."""
    d = crawled.withColumn("p", html.parse(F.col("html"), urls.host(F.col("url"))))
    content = F.col("p.content")
    return d.select(
        "depth", "url", F.col("p.title").alias("title"), content.alias("content"), F.col("source_name").alias("source"), F.coalesce("category_hint", gate.category(urls.host(F.col("url")), content)).alias("category"),
        lang.detect(content, F.col("language_hint")).alias("language"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("fetched_at"),
    )


def build_corpus(
    pages: DataFrame, seeds: DataFrame, existing: DataFrame | None = None, max_depth: int = 2, max_pages: int | None = None, min_chars: int = gate.MIN_CHARS, targets: dict[str, int] = LANGUAGE_TARGETS
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons) of the pages that seeds reach, in breadth-first order; seeds
    are rows of ``schema.SEED``.

    A document over its language's quota has passed the gate, so its url and content count as seen.
    """
    parsed = parse_pages(corpus.crawl(pages, seeds, max_depth, max_pages))
    last, have = 0, {}
    if existing is not None:
        last = existing.agg(F.max("id")).first()[0] or 0
        have = {r[0]: r[1] for r in existing.groupBy(corpus.document_language().alias("l")).count().collect()}
        existing = gate.with_keys(existing)
    parsed = settled(parsed.withColumn("place", F.struct("depth", "url")))
    numbered = settled(corpus.next_ids(parsed, "place", last).drop("place", "depth"))
    gated = settled(gate.gate(numbered, existing, "id", min_chars).drop("url_key", "fp"))
    passed = gate.language_quota(gated.filter("reason IS NULL"), targets, "id", have)
    accepted = passed.filter("NOT over_quota").drop("over_quota", "reason")
    over = passed.filter("over_quota").drop("over_quota").withColumn("reason", F.lit("language_over_target"))
    return accepted, gated.filter("reason IS NOT NULL").unionByName(over)


def query_seeds(queries: DataFrame) -> DataFrame:
    """Search addresses of queries (raw) as seeds, with what is known of each search."""
    searches = list(zip(urls.SEARCHES, ("en", "es"), (["pubmed.ncbi.nlm.nih.gov"], ["scielo.org"])))
    rows = F.array(*[F.struct(F.concat(F.lit(s), urls.quote_plus(F.lower("raw"))).alias("url"), F.lit(hint).alias("language_hint"), F.array(*map(F.lit, d)).alias("allowed_domains")) for s, hint, d in searches])
    return queries.select(F.inline(rows)).select("url", "language_hint", F.lit("dynamic").alias("source_name"), F.lit("research_article").alias("category_hint"), "allowed_domains")


def expand(engine: retrieve.Engine, queries: DataFrame, pages: DataFrame, max_depth: int = 1, max_pages: int | None = 10, k: int = 5, few: int = 2, low: float = 0.3) -> tuple[retrieve.Engine, DataFrame, DataFrame]:
    """Answer queries (query_id, raw); where results are weak, crawl from the queries' own seeds, add
    what passes the gate, and answer again.  (engine, results, fallback flags)"""
    results = engine.retrieve(queries, k)
    flags = retrieve.needs_fallback(results, queries, few, low)
    weak = queries.join(flags.filter("web_fallback"), "query_id", "left_semi")
    accepted, _ = build_corpus(pages, query_seeds(weak), engine.docs, max_depth, max_pages)
    if accepted.isEmpty():
        return engine, results, flags
    grown = engine.add(accepted)
    return grown, grown.retrieve(queries, k), flags
