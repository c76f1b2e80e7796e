"""Streaming reads of run journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.sources.journal import EVENT


def journal_status(spark: SparkSession, path: str) -> DataFrame:
    """Latest round and move total per job and stage of a growing journal."""
    rows = spark.readStream.schema(EVENT).json(path).where("stage is not null")
    return rows.groupBy("job", "stage").agg(
        F.max("round").alias("round"), F.sum("moves").alias("moves"), F.max("elapsed_seconds").alias("elapsed_seconds"))
