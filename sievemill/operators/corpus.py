"""Corpora: metrics, ids, early stop, and breadth-first traversal of a pages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions import language as lang
from ..scratch import settled


def document_language() -> Column:
    return F.coalesce(F.col("language"), lang.from_url(F.col("url")))


def distributions(docs: DataFrame) -> DataFrame:
    """(dimension, value, n) for language, source and category, in one pass over grouping sets."""
    d = docs.select(document_language().alias("language"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("category", F.lit("unknown")).alias("category"))
    sets = d.groupingSets([[F.col("language")], [F.col("source")], [F.col("category")]], "language", "source", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "language").when(F.col("g") == 5, "source").otherwise("category")
    return sets.select(name.alias("dimension"), F.coalesce("language", "source", "category").alias("value"), "n")


def metrics(docs: DataFrame, rejected: int | Column, seconds: float | None = None) -> DataFrame:
    """One row of totals, ratio, average length, distributions as maps, rate and five examples."""
    return judged_metrics(docs.withColumn("valid", F.lit(True)), seconds, F.lit(rejected) if isinstance(rejected, int) else rejected)


def judged_metrics(docs: DataFrame, seconds: float | None = None, more_rejected: Column | None = None) -> DataFrame:
    """``metrics`` of documents that a column ``valid`` tells from rejected ones.

    One pass counts by language, source and category together and keeps the five smallest ids of each
    count; what is left is a row for each combination, from which the maps and totals are made.
    """
    few = F.slice(F.array_sort(F.collect_list(F.struct("id", "title", "url"))), 1, 5)
    lost = F.lit(0) if more_rejected is None else more_rejected
    names = {"language": document_language(), "source": F.coalesce("source", F.lit("unknown")), "category": F.coalesce("category", F.lit("unknown"))}
    counted = docs.groupBy("valid", *[v.alias(k) for k, v in names.items()]).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.count("content").alias("filled"))
    counted = settled(counted, "counts")
    good = F.col("valid")
    n = F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0))
    bad = F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)) + lost
    mean = F.sum(F.when(good, F.col("chars"))) / F.sum(F.when(good, F.col("filled")))
    total = [n.alias("total_valid_documents"), bad.cast("long").alias("total_rejected_documents"), F.round(n / F.greatest(F.lit(1), n + bad), 4).alias("validity_ratio"), F.coalesce(F.round(mean, 2), F.lit(0.0)).alias("average_content_length_chars")]
    if seconds is not None:
        total += [F.round(F.lit(float(seconds)), 2).alias("crawl_duration_seconds"), F.round(n / max(1e-6, seconds) * 60, 2).alias("docs_per_minute")]
    out = counted.agg(*total)
    for k in names:
        by = counted.filter("valid").groupBy(k).agg(F.sum("n").alias("n"))
        out = out.crossJoin(by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k), F.col("n"))))).alias(f"distribution_by_{k}")))
    first = docs.filter("valid").orderBy("id").limit(5).agg(few.alias("examples"))
    return out.crossJoin(first)  # one row each


def next_ids(docs: DataFrame, order: str, last: int = 0) -> DataFrame:
    """Ids after ``last`` in order.  Positions come from counts of ranges, not from one sorted task;
    the ranges are written once, so that counts and positions are of the same ones."""
    ranged = settled(docs.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("part").count()
    before = counts.withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ranged.withColumn("turn", within).join(F.broadcast(before), "part").withColumn("id", F.lit(last) + F.col("base") + F.col("turn")).drop("part", "turn", "base")


def early_stop(docs: DataFrame, order: str, min_valid: int, targets: dict[str, int]) -> DataFrame:
    """Rows before the first place where enough are valid and every language has its target.

    Each condition first holds after its n-th row in order, which a top-n finds; rows after the last
    of these places go.  A condition that never holds keeps all.
    """
    conditions = [(min_valid, docs)] + [(t, docs.filter(F.col("language") == k)) for k, t in targets.items()]
    last = None
    for n, rows in conditions:
        if n <= 0:
            continue
        few = rows.select(order).orderBy(order).limit(n).agg(F.count("*"), F.max(order)).first()
        if few[0] < n:
            return docs
        last = few[1] if last is None else max(last, few[1])
    return docs.limit(0) if last is None else docs.filter(F.col(order) <= F.lit(last))


def links(pages: DataFrame) -> DataFrame:
    """(url, target), both normalised, for every link of pages (url, html)."""
    own = pages.select("url", F.explode(html.links(F.col("url"), F.col("html"))).alias("target"))
    own = own.filter(urls.is_http(F.col("target")))
    return own.select(urls.normalize(F.col("url")).alias("url"), urls.normalize(F.col("target")).alias("target")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of all that seeds (url) reach over edges (url, target) in so many steps."""
    frontier = seeds.select("url").distinct().withColumn("depth", F.lit(0).cast("long"))
    found = frontier
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.select("url"), "url").select(F.col("target").alias("url")).distinct()
        frontier = step.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        frontier = settled(frontier)
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """Pages of a table reached breadth first, with depth and the seed's hints; seeds: url,
    language_hint, source_name, category_hint, allowed_domains.  A page takes the hints of the
    smallest domain set that reaches it first."""
    keyed = pages.withColumn("page_url", urls.normalize(F.col("url")))
    edges = settled(links(pages))
    hints = ("language_hint", "source_name", "category_hint", "allowed_domains")
    frontier = seeds.withColumn("url", urls.normalize(F.col("url"))).dropDuplicates(["url"]).withColumn("depth", F.lit(0).cast("long"))
    found = frontier
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier, "url").filter(urls.is_allowed(F.col("target"), F.col("allowed_domains")))
        step = step.groupBy(F.col("target").alias("url")).agg(F.min(F.struct(*hints)).alias("h")).select("url", "h.*")
        frontier = step.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        frontier = settled(frontier)
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    out = found.join(keyed.withColumnRenamed("url", "raw_url"), F.col("url") == F.col("page_url")).drop("page_url")
    return out.orderBy("depth", "url").limit(max_pages) if max_pages else out
