"""Quartet site patterns, symmetric orbits and topology classes.

The three topologies of taxa (0, 1, 2, 3) are 01|23, 02|13 and 03|12.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _partitions(items: tuple[int, ...]) -> list[frozenset]:
    """All ways to put items into unordered blocks."""
    if not items:
        return [frozenset()]
    *head, last = items
    found = []
    for blocks in _partitions(tuple(head)):
        found.append(blocks | {frozenset([last])})
        found.extend(blocks - {block} | {block | {last}} for block in blocks)
    return found


def _text(blocks: frozenset) -> str:
    """A partition of the four taxa as text: the number of each taxon's block, blocks numbered by their first taxon."""
    ranked = sorted(blocks, key=min)
    return "".join(str(next(i for i, block in enumerate(ranked) if taxon in block)) for taxon in range(4))


# A site pattern is a partition of the taxa into those of equal state.
_BLOCKS = {_text(blocks): blocks for blocks in _partitions((0, 1, 2, 3))}
ORBITS = sorted(_BLOCKS)
ORDERS = {0: (0, 1, 2, 3), 1: (0, 2, 1, 3), 2: (0, 3, 1, 2)}


def reordered(order: tuple[int, ...]) -> list[int]:
    """Source position of each orbit after reading the taxa in ``order``.

    Reading puts taxon ``order[k]`` at place k; the orbit seen there is the
    image of the source partition under the inverse renaming.
    """
    seen_at = {_text(frozenset(frozenset(order.index(t) for t in block) for block in _BLOCKS[orbit])): i
               for i, orbit in enumerate(ORBITS)}
    return [seen_at[orbit] for orbit in ORBITS]


def within_split_orders() -> list[tuple[int, ...]]:
    """The eight orders that keep the split 01|23."""
    sides = [((0, 1), (2, 3)), ((2, 3), (0, 1))]
    flips = [(a, b) for a in (1, -1) for b in (1, -1)]
    return [(*left[::a], *right[::b]) for left, right in sides for a, b in flips]


def orbit_of(s0: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """Orbit text of four observed states."""
    d1 = F.when(s1 == s0, 0).otherwise(1)
    d2 = F.when(s2 == s0, 0).when(s2 == s1, d1).otherwise(d1 + 1)
    top = F.greatest(d1, d2)
    d3 = F.when(s3 == s0, 0).when(s3 == s1, d1).when(s3 == s2, d2).otherwise(top + 1)
    return F.concat(F.lit("0"), d1.cast("string"), d2.cast("string"), d3.cast("string"))


def orbit_masks(low: list[Column], high: list[Column], observed: list[Column]) -> dict[str, Column]:
    """Bit mask of the jointly observed sites of a word in each orbit."""
    every = observed[0].bitwiseAND(observed[1]).bitwiseAND(observed[2]).bitwiseAND(observed[3])

    def differ(i: int, j: int) -> Column:
        return low[i].bitwiseXOR(low[j]).bitwiseOR(high[i].bitwiseXOR(high[j]))

    unequal = {(i, j): differ(i, j) for i in range(4) for j in range(i + 1, 4)}
    masks = {}
    for orbit in ORBITS:
        mask = every
        for j in range(1, 4):
            # Earlier taxa of the same class are represented by the first one.
            for i in range(j):
                if orbit.index(orbit[i]) != i:
                    continue
                part = unequal[i, j]
                mask = mask.bitwiseAND(F.bitwise_not(part) if orbit[i] == orbit[j] else part)
        masks[orbit] = mask
    return masks


def pair_class(x: Column, y: Column, others: list[Column]) -> Column:
    """Class of the split that pairs taxa x and y, by their sorted ranks.

    Ranks {0,1} and {2,3} give class 0, {0,2} and {1,3} class 1, {0,3} and
    {1,2} class 2.
    """
    def rank(t: Column) -> Column:
        return sum(((t > o).cast("int") for o in others), F.lit(0))

    low, high = F.least(rank(x), rank(y)), F.greatest(rank(x), rank(y))
    return F.when(low == 0, high - 1).when((low == 1) & (high == 2), 2) \
        .when((low == 1) & (high == 3), 1).otherwise(0)


def group_order_scores(a: Column, b: Column, c: Column, d: Column, scores: Column) -> list[Column]:
    """Scores of ab|cd, ac|bd, ad|bc from an array in sorted-taxon order."""
    taxa = [a, b, c, d]
    return [F.element_at(scores, pair_class(a, other, taxa) + 1) for other in (b, c, d)]


def topology_class(d01: Column, d23: Column, d02: Column, d13: Column, d03: Column, d12: Column) -> Column:
    """Class with the smallest paired path sum (four-point condition)."""
    first, second, third = d01 + d23, d02 + d13, d03 + d12
    return F.when((first <= second) & (first <= third), 0).when(second <= third, 1).otherwise(2)
