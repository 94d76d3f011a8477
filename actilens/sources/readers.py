"""Batch and streaming sources of log, traffic and metric records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """A stored table; a fixed schema avoids inference passes over the data."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A relational table by URL. Give ``partitionColumn``, bounds and ``numPartitions`` for large ones."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).load()


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """New files of a folder as a stream; the trigger size bounds what a micro-batch holds."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType | str, **options: str) -> DataFrame:
    """JSON records of a topic (needs the Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .options(**options).load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain scan of few large splits enough tasks for heavy work per row.

    Tables with as many splits as there are cores, the normal case on a cluster, pass unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
