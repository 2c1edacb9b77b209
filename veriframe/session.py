"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on (time zone), and those that let plans adapt at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; partitions sets spark.sql.shuffle.partitions."""
    builder = SparkSession.builder.config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
