"""Total orders and running sums that never sort a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.session import cut_apart as cut

BLOCK = 1 << 16


def global_rank(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """0-based rank by ``order`` inside each ``group``.

    ``group + order`` must be unique per row. Rows are range partitioned on the
    whole key, so equal leading values still spread over partitions; only one
    count per partition is combined.
    """
    keys = [*group, *order]
    placed = cut(
        df.repartitionByRange(*[F.col(c) for c in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", *group,
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        placed.join(starts, ["_part", *group])
        .withColumn(out, (F.col("_at") + F.col("_shift")).cast("long"))
        .drop("_part", "_at", "_shift")
    )


def running_totals(df: DataFrame, order: str, values: dict[str, str | Column], block: int = BLOCK) -> DataFrame:
    """Inclusive running sums by the non-negative integer ``order``, one per output name.

    Two levels of blocks: rows inside a block, blocks inside a block of
    blocks, so no window sees more than ``block`` rows below 2^48 positions.
    """
    names = list(values)
    rows = df.withColumns({f"_v_{k}": (F.col(v) if isinstance(v, str) else v).cast("long") for k, v in values.items()})
    rows = rows.withColumn("_b1", F.floor(F.col(order) / block)).withColumn("_b2", F.floor(F.col("_b1") / block))
    inner = Window.partitionBy("_b1").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    small = rows.groupBy("_b2", "_b1").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in names])
    large = small.groupBy("_b2").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in names])
    before1 = Window.partitionBy("_b2").orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)
    before2 = Window.partitionBy(F.lit(0)).orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tops = large.select("_b2", *[F.coalesce(F.sum(f"_t_{k}").over(before2), zero).alias(f"_o_{k}") for k in names])
    offsets = small.select(
        "_b1", "_b2", *[F.coalesce(F.sum(f"_s_{k}").over(before1), zero).alias(f"_i_{k}") for k in names]
    ).join(tops, "_b2").select("_b1", *[(F.col(f"_i_{k}") + F.col(f"_o_{k}")).alias(f"_f_{k}") for k in names])
    summed = rows.select(*df.columns, "_b1", *[F.sum(f"_v_{k}").over(inner).alias(f"_r_{k}") for k in names])
    return summed.join(offsets, "_b1").select(
        *df.columns, *[(F.col(f"_r_{k}") + F.col(f"_f_{k}")).alias(k) for k in names])


def running_total(df: DataFrame, order: str, value: str | Column, out: str, block: int = BLOCK) -> DataFrame:
    """One inclusive running sum, see :func:`running_totals`."""
    return running_totals(df, order, {out: value}, block)
