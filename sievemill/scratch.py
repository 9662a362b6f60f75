"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine that names none gets a temporary folder, on a
    cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="sievemill-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sievemill/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df computed once, written and read back: later uses read files, and a lost executor costs a
    reread and not the lineage."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Remove the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sievemill/" in at:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, and of under 64 MB a core, dealt to all cores: the little
    that moves is less than what one core would have to compute alone.  Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores << 26 else df
