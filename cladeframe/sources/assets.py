"""Parameter tables of scorers, read only if their files are the expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json"}


def digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every file under ``path``, by file name; the bytes stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return {r["name"]: r["digest"] for r in rows.collect()}


def load_parameters(spark: SparkSession, path: str, expected: str | dict[str, str], schema: str) -> DataFrame:
    """A parameter table of the given schema.

    ``expected`` is the SHA-256 of a single file, or one for each file name.
    A missing, additional or changed file is an error, and nothing is read.
    """
    found = digests(spark, path)
    if isinstance(expected, str):
        expected = dict.fromkeys(found, expected) if len(found) == 1 else {}
    if found != expected:
        odd = sorted({*found, *expected} - {n for n in found if found[n] == expected.get(n)})
        raise ValueError(f"parameter files differ from the expected ones: {', '.join(odd) or 'none found'}")
    kinds = {READERS.get(name.rsplit(".", 1)[-1]) for name in found}
    if len(kinds) != 1 or None in kinds:
        raise ValueError("parameter files must all be parquet, csv or json")
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    return (reader.option("header", True) if kinds == {"csv"} else reader).format(kinds.pop()).load(path)
