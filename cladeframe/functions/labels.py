"""Newick label quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that force quotes, and labels the strict rule leaves plain.
RESERVED = r"[\s(),:;\[\]']"
STRICT_PLAIN = r"^[A-Za-z0-9_.+\-]+$"


def in_quotes(name: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))


def quoted(name: Column) -> Column:
    """Quote only labels with reserved characters."""
    return F.when(name.rlike(RESERVED), in_quotes(name)).otherwise(name)


def strictly_quoted(name: Column) -> Column:
    """Quote every label outside the plain alphabet."""
    return F.when(name.rlike(STRICT_PLAIN), name).otherwise(in_quotes(name))
