"""Sources and sinks: JSON documents, rejects, raw pages, metrics, and indexes as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import language as lang
from ..operators import bm25, gate, vector
from ..schema import DOCUMENT, RAW_PAGE, REJECTED


def read_json(spark: SparkSession, path: str, schema: StructType = DOCUMENT) -> DataFrame:
    """One JSON document a file, in folders of any depth; unreadable ones have only ``_corrupt``."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    reader = spark.read.schema(full).option("recursiveFileLookup", True).option("multiLine", True)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Readable documents; the older generation's missing language comes from the url."""
    docs = read_json(spark, path).filter("_corrupt IS NULL").drop("_corrupt")
    return docs.withColumn("language", F.coalesce("language", lang.from_url(F.col("url"))))


def document_store(spark: SparkSession, path: str) -> DataFrame:
    """One document of each id: the latest fetched, then the largest url; null ids are dropped."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("fetched_at"), F.desc("url"), "content")
    return documents(spark, path).filter("id IS NOT NULL").withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def to_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents with id and content, and one row that counts unreadable files (and those with ids)."""
    raw = read_json(spark, path)
    return raw.filter("_corrupt IS NULL AND id IS NOT NULL AND content IS NOT NULL").drop("_corrupt"), raw.agg(F.count("_corrupt").alias("read_errors"), F.count("id").alias("with_id"))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rejects of all shapes in one table."""
    return read_json(spark, path, REJECTED).filter("_corrupt IS NULL").drop("_corrupt").withColumn("reason", F.coalesce("reason", "rejection_reason"))


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RAW_PAGE).filter("_corrupt IS NULL").drop("_corrupt")


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Partitioned by language and category."""
    docs.write.mode(mode).partitionBy("language", "category").format(fmt).save(path)


def write_rejected(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Partitioned by reason; runs append and never overwrite."""
    rows.write.mode("append").partitionBy("reason").format(fmt).save(path)


def write_batch(rows: DataFrame, path: str, number: int, by: list[str]) -> None:
    """Rows of one micro-batch, partitioned by its number and then as given; written again they replace
    that batch's alone."""
    out = rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("batch", *by).parquet(path)


def write_by_category(docs: DataFrame, valid: str, invalid: str, fmt: str = "json") -> None:
    """The older sink: valid rows by category (unknown ones under 'unknown'), others with their error
    as rejection_reason."""
    known = F.when(F.col("category").isin(*gate.STORED_CATEGORIES), F.col("category")).otherwise("unknown")
    docs.filter("is_valid").withColumn("category", known).write.mode("append").partitionBy("category").format(fmt).save(valid)
    docs.filter("NOT is_valid").withColumn("rejection_reason", F.col("validation_error")).write.mode("append").format(fmt).save(invalid)


def write_raw(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").parquet(path)


def write_metrics(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


_INDEX = ("postings", "doc_stats", "term_stats", "corpus_stats")


def save_index(index: bm25.Index, vectors: DataFrame, docs: DataFrame, path: str) -> None:
    """Postings are ranged and sorted by term, so that a search skips row groups without its terms."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    for name in _INDEX[1:]:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    vectors.withColumn("unit", vector.unit(F.col("embedding"))).write.mode("overwrite").parquet(f"{path}/vectors")
    docs.write.mode("overwrite").parquet(f"{path}/documents")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_index(spark: SparkSession, path: str) -> tuple[bm25.Index, DataFrame, DataFrame]:
    """The index, vectors and documents; RuntimeError names what is missing."""
    missing = [n for n in (*_INDEX, "vectors", "documents") if not exists(spark, f"{path}/{n}")]
    if missing:
        raise RuntimeError(f"no index under {path}: {', '.join(missing)} missing")
    parts = [spark.read.parquet(f"{path}/{n}") for n in (*_INDEX, "vectors", "documents")]
    return bm25.Index(*parts[:4]), parts[4], parts[5]
