"""Support weights, margins and pooled opinions as row expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE_ULPS = 64 * 2.0 ** -52


def local_weights(scores: list[Column]) -> list[Column]:
    """Normalised exponentials of log scores, shifted by the largest."""
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def margin_index(margin: Column) -> Column:
    """Monotone 0..100 display of a signed margin; 50 at zero."""
    distance = F.lit(50.0) / (F.abs(margin) + 1)
    return F.when(margin >= 0, F.lit(100.0) - distance).otherwise(distance)


def tie_tolerance(scores: list[Column]) -> Column:
    return F.lit(TIE_ULPS) * F.greatest(F.lit(1.0), *[F.abs(s) for s in scores])


def winners(scores: list[Column]) -> list[Column]:
    """1 for each score equal to the best within rounding."""
    top, tolerance = F.greatest(*scores), tie_tolerance(scores)
    return [F.when(top - s <= tolerance, 1).otherwise(0) for s in scores]


def safe_log(p: Column) -> Column:
    """Logarithm used by pooled opinions."""
    return F.ln(F.least(F.greatest(p, F.lit(1e-8)), F.lit(1.0)))
