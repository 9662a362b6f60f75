"""Incremental ingestion: new documents of a streaming source pass the gate and join the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gate
from ..scratch import dropped, settled
from ..sources import tables


def ingest(stream: DataFrame, corpus: str, rejects: str, checkpoint: str, min_chars: int = gate.MIN_CHARS) -> StreamingQuery:
    """Each micro-batch of documents is gated against the corpus so far and appended to it, or to
    the rejects.

    The keys of the corpus stand beside it (``<corpus>_keys``), so that a batch reads no texts but its
    own.  A batch writes its verdicts first, under its number; documents, rejects and keys are made of
    these, each in a folder of the batch that a rerun overwrites, so that nothing is stored twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = f"{corpus}_keys"
        known = spark.read.parquet(keys) if tables.exists(spark, keys) else None
        own = f"{keys}/batch={number}"
        if known is not None:  # a rerun does not meet the keys that it wrote itself
            known = known.filter(F.col("batch") != number).select("url_key", "fp")
        out = settled(gate.gate(batch, known, "id", min_chars), "gated")
        good = out.filter("reason IS NULL")
        tables.write_batch(out.filter("reason IS NOT NULL").drop("url_key", "fp"), rejects, number, ["reason"])
        tables.write_batch(good.drop("reason", "url_key", "fp"), corpus, number, ["language", "category"])
        good.select("url_key", "fp").write.mode("overwrite").parquet(own)
        dropped(out)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
