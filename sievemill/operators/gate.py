"""The quality gate: ordered reasons, duplicates against the corpus and inside a batch, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions import text as tx
from ..scratch import dropped, settled

# The fields that a document must have, in the order of their checks.
FIELDS = ("title", "content", "source", "url", "category", "language")
MIN_CHARS = 600
#: Documents over its target that a language may still get before it is closed.
SLACK = 100

# Categories by a part of the source's name, then by words in the content, in order.
DOMAIN_CATEGORIES = (("medlineplus.gov", "health_topic"), ("pubmed.ncbi.nlm.nih.gov", "research_article"), ("who.int", "health_guideline"), ("ncbi.nlm.nih.gov", "research"))
KEYWORD_CATEGORIES = (
    ("health_topic", ("symptom", "síntoma", "treatment", "tratamiento", "cause", "causa")),
    ("research_article", ("abstract", "resumen", "author", "autor", "study", "estudio")),
    ("health_guideline", ("recommendation", "recomendación", "guideline", "guía", "standard", "estándar")),
    ("news", ("news", "noticia", "update", "actualización", "report", "reporte")),
)
# Categories that the older sink has a folder for.
STORED_CATEGORIES = ("health_topic", "research_article", "health_guideline", "news", "generic_content")


def reason(min_chars: int = MIN_CHARS) -> Column:
    """Why a row's own fields fail, the first cause only; null if they pass."""
    out = None
    for f in FIELDS:
        bad = F.col(f).isNull() | ~F.rlike(F.col(f), F.lit(r"[^\s\p{Z}]"))
        out = (F.when if out is None else out.when)(bad, f"missing_or_empty_{f}")
    return out.when(~F.col("language").isin(*lang.SUPPORTED), "invalid_language").when(F.length("content") < min_chars, "content_too_short")


def category(source: Column, content: Column) -> Column:
    low, text = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    out = None
    for part, name in DOMAIN_CATEGORIES:
        out = (F.when if out is None else out.when)(F.contains(low, F.lit(part)), name)
    for name, words in KEYWORD_CATEGORIES:
        out = out.when(F.rlike(text, F.lit("|".join(words))), name)
    return out.otherwise("generic_content")


def legacy_error(min_chars: int = 100) -> Column:
    """The older schema's validation message, null if valid; the source may be blank."""
    out = None
    for f in ("title", "content", "source", "url"):
        out = (F.when if out is None else out.when)(F.col(f).isNull(), f"Missing required field: '{f}'")
    for f in ("title", "content", "url"):
        out = out.when(tx.clean(F.col(f)) == "", f"Field '{f}' cannot be empty")
    n = F.length("content")
    return out.when(n < min_chars, F.format_string(f"Content too short (%d chars, min {min_chars})", n))


def legacy_enrich(docs: DataFrame) -> DataFrame:
    """is_valid, validation_error and category (null if invalid) added."""
    error = legacy_error()
    return docs.withColumns({"validation_error": error, "is_valid": error.isNull(), "category": F.when(error.isNull(), category(F.col("source"), F.col("content")))})


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"url_key": F.lower(F.trim("url")), "fp": tx.fingerprint(F.col("content"))})


def against_existing(keyed: DataFrame, existing: DataFrame) -> DataFrame:
    """``reason`` for rows whose url, or else content, the corpus has already (both with keys)."""
    urls = existing.select("url_key", F.lit(True).alias("old_url")).distinct()
    contents = existing.select("fp", F.lit(True).alias("old_fp")).distinct()
    out = keyed.join(urls, "url_key", "left").join(contents, "fp", "left")
    return out.withColumn("reason", F.when(F.col("old_url"), "duplicate_url").when(F.col("old_fp"), "duplicate_content")).drop("old_url", "old_fp")


def first_wins(docs: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order."""
    first = docs.groupBy(key).agg(F.min(order).alias(order))
    return docs.join(first, [key, order], "left_semi")


def two_keys(docs: DataFrame, seq: str = "seq", url: str = "url_key", fp: str = "fp") -> DataFrame:
    """Exact sequential de-duplication by url and content, in the order of a unique ``seq``.

    A rejected row registers neither key.  Each round accepts the rows that come first among the
    undecided of both their keys, and rejects those that share a key with an accepted row; the
    smallest undecided row is always decided, and chains are short.  Adds ``reason``.
    """
    keys = settled(docs.select(F.col(seq).alias("s"), F.col(url).alias("u"), F.col(fp).alias("f")), "keys")
    todo, accepted = keys, None
    while True:
        by_u, by_f = todo.groupBy("u").agg(F.min("s").alias("su")), todo.groupBy("f").agg(F.min("s").alias("sf"))
        new = todo.join(by_u, "u").join(by_f, "f").filter("s = su AND s = sf").select("s", "u", "f")
        new = settled(new)
        accepted = new if accepted is None else accepted.unionByName(new)
        left = settled(todo.join(new.select("u"), "u", "left_anti").join(new.select("f"), "f", "left_anti"), "undecided")
        if todo is not keys:
            dropped(todo)
        todo = left
        if todo.isEmpty():
            break
    urls = accepted.select("u", F.col("s").alias("kept_url"))
    judged = keys.join(urls, "u", "left").join(accepted.select("s", F.lit(True).alias("kept")), "s", "left")
    verdict = F.when(F.col("kept"), F.lit(None).cast("string")).when(F.col("kept_url") < F.col("s"), "duplicate_url").otherwise("duplicate_content")
    judged = judged.filter(F.coalesce("kept", F.lit(False)) == F.lit(False)).select(F.col("s").alias(seq), verdict.alias("reason"))
    return docs.join(settled(judged, "verdicts"), seq, "left")  # documents are joined once, by their place alone


def language_quota(docs: DataFrame, targets: dict[str, int], order: str, existing: dict[str, int] | None = None, slack: int = SLACK) -> DataFrame:
    """``over_quota`` for accepted rows beyond target + slack + 1 of their language, existing counted;
    ``order`` is unique.  The last place that a language still gets is found by a top-n, so that no task
    sorts a language."""
    existing = existing or {}
    over = F.lit(False)
    for k, t in targets.items():
        n = t + slack + 1 - existing.get(k, 0)
        own = F.col("language") == k
        if n <= 0:
            over = F.when(own, F.lit(True)).otherwise(over)
            continue
        few = docs.filter(own).select(order).orderBy(order).limit(n).agg(F.count("*"), F.max(order)).first()
        if few[0] == n:
            over = F.when(own, F.col(order) > F.lit(few[1])).otherwise(over)
    return docs.withColumn("over_quota", F.coalesce(over, F.lit(False)))


def gate(docs: DataFrame, existing: DataFrame | None = None, seq: str = "id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``reason`` for every row: its own fields, then the corpus, then the batch."""
    checked = settled(with_keys(docs.withColumn("reason", reason(min_chars))), "checked")
    failed, good = checked.filter("reason IS NOT NULL"), checked.filter("reason IS NULL").drop("reason")
    parts = [failed]
    if existing is not None:
        known = against_existing(good, existing)
        parts.append(known.filter("reason IS NOT NULL"))
        good = known.filter("reason IS NULL").drop("reason")
    parts.append(two_keys(good, seq))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def indexable(docs: DataFrame) -> DataFrame:
    """Batch rule: an id, string fields (absent counts as ''), some text; then the first of each id."""
    text = tx.indexed_text(F.col("title"), F.col("content"))
    good = docs.filter(F.col("id").isNotNull()).withColumns({"tokens": tx.lexical(text), "semantic": tx.semantic(text)})
    good = good.filter((F.size("tokens") > 0) | (F.col("semantic") != ""))
    w = Window.partitionBy("id").orderBy("url", "content")
    return good.withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def appendable(docs: DataFrame) -> DataFrame:
    """Append rule: an id, title and content not empty, and both kinds of text."""
    text = tx.indexed_text(F.col("title"), F.col("content"))
    good = docs.filter("id IS NOT NULL AND coalesce(title, '') <> '' AND coalesce(content, '') <> ''").withColumns({"tokens": tx.lexical(text), "semantic": tx.semantic(text)})
    return good.filter((F.size("tokens") > 0) & (F.col("semantic") != ""))
