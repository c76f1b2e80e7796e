"""Ordered locus manifests: lengths in, half-open site intervals out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.ordering import running_total


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(position, alignment_length) from JSON lines, in file order."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("position", "line")).where("trim(line) <> ''")
    return lines.select(F.col("position").cast("long").alias("position"),
                        F.get_json_object("line", "$.alignment_length").cast("long").alias("alignment_length"))


def boundaries(lengths: DataFrame) -> DataFrame:
    """(locus, start, end) by a running sum of positive lengths."""
    bad = F.raise_error(F.lit("locus lengths must be positive")).cast("long")
    length = F.when(F.col("alignment_length") > 0, F.col("alignment_length")).otherwise(bad)
    ends = running_total(lengths, "position", length, "end")
    return ends.select(F.col("position").alias("locus"), (F.col("end") - F.col("alignment_length")).alias("start"), "end")


def check_tiling(loci: DataFrame, length: int) -> None:
    """Raise unless the intervals cover 0..length exactly once."""
    row = loci.agg(F.min("start").alias("first"), F.max("end").alias("last"),
                   F.sum(F.col("end") - F.col("start")).alias("covered")).first()
    if (row["first"], row["last"], row["covered"]) != (0, length, length):
        raise ValueError("locus manifest must tile the alignment exactly")
