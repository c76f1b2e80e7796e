"""Pieces shared by the text operators: table access, ranks without a single task, rolling hashes over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW = "__cladeframe_row__"  # helper column beside columns of any other name
SLICE_BYTES = 1 << 20  # documents are taken together up to this size; a longer one is taken whole, alone
BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Give Python workers this package, and batches of fewer rows than Spark's default, as texts are long."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def row_key(*columns: str) -> Column:
    """64-bit identity of a row's content; nulls take part."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def spread_rank(df: DataFrame, group: list[str], order: list[str], out: str, per_bucket: int = 512) -> DataFrame:
    """0-based gapless rank inside each ``group``, in no particular order of the rows.

    Rows of a group are dealt by hash of ``order`` into buckets of about
    ``per_bucket`` rows, so a group that holds a third of all rows is ranked by
    many tasks. ``order`` must tell apart all rows that differ in any column.
    For groups of a bounded number only: their sizes are broadcast.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.count("*") / per_bucket).alias("_buckets"))
    dealt = df.join(F.broadcast(sizes), group).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets"))).drop("_buckets")
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (dealt.withColumn("_inside", F.row_number().over(inside) - 1).join(starts, keys)
            .withColumn(out, (F.col("_start") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_start"))


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of one column of a batch."""
    return slices_of(batch.column(batch.schema.get_field_index(column)))


def slices_of(values: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in the bytes) of strings; null is empty."""
    if values.null_count:
        values = values.fill_null("")
    values = values.cast(pa.large_string())
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + n + 1] if n else np.zeros(1, np.int64)
    data = values.buffers()[2] if n else None
    octets = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, octets[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, step in enumerate((BASE, inverse)):
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any substring of a byte array from prefix sums modulo 2**64."""

    def __init__(self, octets: np.ndarray):
        power, self.inverse = _powers(len(octets) + 1)
        self.sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[octets] * power[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes from every position on."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_bounds(octets: np.ndarray, is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of maximal runs of word bytes; a run ends where its row ends."""
    inside = is_word[octets]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(octets)]
    starts_here[edges] = inside[edges]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends_here[tails] = inside[tails]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_array(octets: np.ndarray, is_word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words between ``starts`` and ``ends``, as ``word_bounds`` finds them with ``is_word``."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(octets[is_word[octets]])])
