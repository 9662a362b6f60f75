"""A corpus pipeline: toxicity, quality, near-duplicates, mixing by language, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last returns the pieces of packed sequences.  ``run`` writes every stage's rows
to the shared folder and reads them back as the next stage's documents.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import mixing, packing, quality, simhash, toxicity
from sievemill.llm.base import persist
from sievemill.llm.queries import LANGUAGE_WEIGHTS


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; learned from labelled ids whose CRC-32 is no multiple of 5."""
    net = toxicity.fit(docs.filter(~toxicity.held_out(F.col("doc_id"), 5, 0)), _labels(spark, sf_dir), "toxic")
    return persist(toxicity.keep_clean(docs, net, 0.5), "clean")  # in small batches


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; learned from labelled ids whose CRC-32 mod 4 is not 2."""
    train = docs.filter(~toxicity.held_out(F.col("doc_id"), 4, 2))
    return persist(quality.keep_good(docs, quality.fit(docs, train, _labels(spark, sf_dir), "quality"), 0.7), "good")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, fingerprints within
    twenty bits, and an estimate of 0.745 or more from min-hashes, which a similarity of 0.8 passes."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs, radius=20, words=5, similar=0.745))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned so that languages have their target shares of the tokens; none repeats."""
    labelled = docs.join(_labels(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    domains = mixing.fit_domains(docs, labelled.select("doc_id", F.col("lang").alias("domain")))
    weights = {k: v for k, v in LANGUAGE_WEIGHTS.items() if k in domains.names}
    if len(weights) < len(LANGUAGE_WEIGHTS):
        warnings.warn(f"no labelled documents of {sorted(set(LANGUAGE_WEIGHTS) - set(weights))}: the other languages share the whole", stacklevel=2)
    return persist(mixing.mix(docs, domains, mixing.fit_rates(docs, domains, weights, most=1.0)[1]), "mixed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_copies),
    ("mixing", mix_languages),
    ("packing", pack),
]

#: Trained classifiers can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
