"""The queries of this subpackage, each over its whole tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled ones whose id's CRC-32 is no multiple of 5."""
    from .toxicity import fit, held_out, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs.filter(~held_out(F.col("doc_id"), 5, 0)), _table(spark, sf_dir, "labels"), "toxic")
    out = score(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labelled ones whose id's CRC-32 mod 4 is not 2."""
    from .quality import fit, score
    from .toxicity import held_out

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, docs.filter(~held_out(F.col("doc_id"), 4, 2)), _table(spark, sf_dir, "labels"), "quality")
    out = score(docs, scorer)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens with their BM25 neighbours."""
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents, learned from those whose id's CRC-32 mod 7 is not 2."""
    import public_tokenizers

    from .lattice_lm import score
    from .toxicity import held_out

    held = held_out(F.col("doc_id"), 7, 2)
    out = score(_table(spark, sf_dir, "documents"), ~held, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every vector whose id is divisible by 20."""
    from .ads_ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors (cosine of 0.95 or more) of all embeddings."""
    from .imi import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to seekable WARC bundles in the shared folder, and read back."""
    from .warc import read_archives, write_archives

    return read_archives(write_archives(_table(spark, sf_dir, "pages")))


def op6_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from .host_html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their near-duplicate components (radius 4)."""
    from .simhash import hex16, near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), radius=4, words=4, seed=42)
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: Shares of the token total that each language is to have.
LANGUAGE_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language posteriors, learned from the documents of the labelled table, and fitted rates."""
    from .mixing import copies, fit_domains, rates

    docs = _table(spark, sf_dir, "documents")
    labelled = docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    domains = fit_domains(docs, labelled.select("doc_id", F.col("lang").alias("domain")))
    weights = {k: v for k, v in LANGUAGE_WEIGHTS.items() if k in domains.names}
    out = rates(docs, domains, weights)
    posteriors = [F.col(f"p_{k}").alias(f"p_{name}") for k, name in enumerate(domains.names)]
    return out.select("doc_id", "n_tokens", *posteriors, "rate", copies(F.col("rate"), F.col("row_hash")).alias("copies"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_bigru": op1_toxicity_bigru,
    "op8_quality_random_indexing": op8_quality_random_indexing,
    "op2_bm25_packing": op2_bm25_packing,
    "op9_soft_mixing": op9_soft_mixing,
    "op3_lattice_likelihood": op3_lattice_likelihood,
    "op4_adaptive_scan": op4_adaptive_scan,
    "op10_inverted_multi_index": op10_inverted_multi_index,
    "op5_seekable_warc": op5_seekable_warc,
    "op6_host_suffix_array": op6_host_suffix_array,
    "op7_simhash_bktree": op7_simhash_bktree,
}

ORACLES: dict[str, str] = {
    "op5_seekable_warc": """
        WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        sized AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM own),
        last AS (SELECT payload_digest AS digest, max(page_id) AS last_id FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last_id THEN last_id END AS refers_to
        FROM sized LEFT JOIN last ON payload_digest = digest""",
}
