"""Sessions with the settings that the engine's plans are made for."""

from pyspark.sql import SparkSession


def build(app: str = "sievemill", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew splitting, Arrow, UTC; ``conf`` overrides (dots as '__')."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
