"""Append-only event journals and measurement ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "job string, stage string, round int, moves int, elapsed_seconds double, detail string, _corrupt string"
LEDGER = ("task string, method string, id string, taxa int, family string, status string, nrf double, seconds double")
TAIL = 300


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Events of a journal; lines that are no JSON are left out."""
    rows = spark.read.schema(EVENT).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def tail(events: DataFrame, order: str, count: int = TAIL) -> DataFrame:
    return events.orderBy(F.desc(order)).limit(count)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV rows; (task, method, id) must be unique."""
    rows = spark.read.schema(LEDGER).option("header", True).csv(path)
    if rows.groupBy("task", "method", "id").count().where("count > 1").limit(1).count():
        raise ValueError("ledger key (task, method, id) repeats")
    return rows


def compact(events: DataFrame) -> DataFrame:
    """Events with finite scalars only and the mean of the selected gains.

    ``scalars`` is map<string, double>, ``gains`` array<double>; the lists
    that a search carries never reach the journal.
    """
    finite = F.map_filter("scalars", lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    mean = F.aggregate("gains", F.lit(0.0), lambda a, g: a + g) / F.size("gains")
    return events.withColumn("scalars", finite).withColumn(
        "mean_gain", F.when(F.size("gains") > 0, mean)).drop("gains")


def plateaus(steps: DataFrame, tolerance: float, window: int = 8) -> DataFrame:
    """Adds ``plateau``: the last ``window`` steps moved the objective by at most
    ``tolerance`` in total and every state in them occurred at least twice.

    ``steps`` is (job, step, state, before, after).
    """
    recent = Window.partitionBy("job").orderBy("step").rowsBetween(-(window - 1), 0)
    rows = steps.select(
        "job", "step", F.count("*").over(recent).alias("_n"), F.collect_list("state").over(recent).alias("_states"),
        (F.max("after").over(recent) - F.min("before").over(recent)).alias("_span"),
        F.max(F.col("after") - F.col("before")).over(recent).alias("_gain"))
    twice = F.expr("forall(_states, s -> size(filter(_states, t -> t = s)) >= 2)")
    return rows.select("job", "step", ((F.col("_n") == window) & twice & (F.col("_span") <= tolerance)
                                       & (F.col("_gain") <= tolerance)).alias("plateau"))
