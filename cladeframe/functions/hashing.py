"""Deterministic integer mixing in plain BIGINT arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Multipliers of the 32-bit mix and of the column salt, and the default seed.
MIX_FIRST = 0x7FEB352D
MIX_SECOND = 0x846CA68B
SALT_STEP = 0x9E3779B9
SEED = 20260934

MASK = 0xFFFFFFFF


def _times(x: str, factor: int) -> str:
    """x * factor mod 2^32 from two 16-bit halves, which cannot overflow."""
    return f"(((shiftright({x}, 16) * {factor}L) & 65535L) * 65536L + ({x} & 65535L) * {factor}L) & {MASK}L"


def add_mix32(df: DataFrame, x: str, out: str) -> DataFrame:
    """Add the 32-bit avalanche of the SQL expression ``x``, mod 2^32, as ``out``.

    Each step is its own projection, so no step is repeated inside the next.
    """
    steps = [f"cast({x} as bigint) & {MASK}L", f"{out} ^ shiftright({out}, 16)", _times(out, MIX_FIRST),
             f"{out} ^ shiftright({out}, 15)", _times(out, MIX_SECOND), f"{out} ^ shiftright({out}, 16)"]
    for step in steps:
        df = df.withColumn(out, F.expr(step))
    return df


def mix32_value(x: int) -> int:
    """The same mix for one Python integer."""
    x &= MASK
    x ^= x >> 16
    x = x * MIX_FIRST & MASK
    x ^= x >> 15
    x = x * MIX_SECOND & MASK
    return x ^ (x >> 16)


def column_salt(projection: int, seed: int = SEED) -> int:
    return mix32_value(seed + projection * SALT_STEP)
