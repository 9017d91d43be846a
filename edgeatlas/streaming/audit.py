"""An extension: the audit log as a stream, summed by time window with a watermark for late lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.sources.audit import SCHEMA


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def windowed(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, tool, n_calls, n_errors: the same plan for a stream and a table."""
    g = log.withWatermark("ts", late) if log.isStreaming else log
    g = g.groupBy(F.window("ts", window), "tool").agg(F.count("*").alias("n_calls"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    return g.select(F.col("window.start").alias("start"), "tool", "n_calls", "n_errors")
