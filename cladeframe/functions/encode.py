"""Base characters, state codes and bit planes.

States: A, C, G, T = 0..3, anything else (gaps, N, ?, ambiguity codes) = 4 =
missing. A word holds ``width`` consecutive sites as three integers: low bit,
high bit and observed mask. The first site of a word is its most significant
bit, the order in which a base-2 string is read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = 4
WORD = 60  # sites per word; fits a signed 64-bit integer


def state_of(base: Column) -> Column:
    """State code of one character, case-insensitive."""
    return F.coalesce(
        F.when(base.isin("A", "a"), 0).when(base.isin("C", "c"), 1)
        .when(base.isin("G", "g"), 2).when(base.isin("T", "t", "U", "u"), 3),
        F.lit(MISSING),
    ).cast("int")


def base_of(state: Column) -> Column:
    return F.lit("ACGT-").substr(state + F.lit(1), F.lit(1))


def clean(sequence: Column) -> Column:
    """Sequence over A, C, G, T and N, one character per input character."""
    known = F.translate(sequence, "acgtuU", "ACGTTT")
    return F.regexp_replace(known, "(?s)[^ACGT]", "N")


def plane(word: Column, bits: str) -> Column:
    """Integer whose bits are ``bits`` of A, C, G, T, N for each site of a word."""
    return F.conv(F.translate(word, "ACGTN", bits), 2, 10).cast("long")


def low_plane(word: Column) -> Column:
    return plane(word, "01010")


def high_plane(word: Column) -> Column:
    return plane(word, "00110")


def observed_plane(word: Column) -> Column:
    return plane(word, "11110")


def site_bit(site: Column, width: int = WORD) -> Column:
    """Bit of a site inside its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (width - 1 - site % width).cast("int"))


def pack_pair(low: Column, high: Column) -> Column:
    """Two 4-bit states in a byte, the even site in the low nibble."""
    return F.call_function("shiftleft", high.cast("int"), F.lit(4)).bitwiseOR(low.cast("int"))


def nibble(byte: Column, odd: Column) -> Column:
    shift = F.when(odd == 1, 4).otherwise(0)
    return F.call_function("shiftright", byte.cast("int"), shift).bitwiseAND(F.lit(15))
