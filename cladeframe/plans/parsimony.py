"""One least-change reconstruction of ancestral states, and the changes it makes.

Seen from leaf 0, every node takes, given the state of its parent, the first
state of least cost. So a node is a map from its parent's state to its own.
Maps of the nodes along a path compose to one map, which is how a part of the
contracted tree (:mod:`cladeframe.plans.contraction`) hands a state through
to what hangs below it: the number of stages does not follow the depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.plans import contraction
from cladeframe.plans.likelihood import CHANGE_COSTS
from cladeframe.session import cut_apart as cut

ROWS = "cluster long, block int, item long, kind int, value binary"
NAMES = ["cluster", "block", "item", "kind", "value"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
MAP, OPEN, STATE, WEIGHT = range(4)
COUNTS = "node long, before int, after int, n double"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.table([pa.array(c, k) for c, k in zip(columns, TYPES)], names=NAMES)


class Path:
    """Items of one part on one block; a map leads from the state above an item to the one its children hang from."""

    def __init__(self, structure: pa.Table, rows: pa.Table, width: int):
        s = structure.sort_by("item")
        self.items, self.nodes = s.column("item").to_pylist(), s.column("node").to_pylist()
        self.above = s.column("above")[0].as_py()
        self.up = dict(zip(self.items, s.column("up").to_pylist()))
        self.slots = np.arange(width)
        self.maps, self.open, self.state, self.weight = {}, None, None, None
        for row in rows.to_pylist():
            if row["kind"] == MAP:
                self.maps[row["item"]] = np.frombuffer(row["value"], np.uint8).reshape(4, width)
            elif row["kind"] == OPEN:
                self.open = row["item"]
            elif row["kind"] == STATE:
                self.state = np.frombuffer(row["value"], np.uint8)
            else:
                self.weight = np.frombuffer(row["value"]).reshape(-1, width)[0]

    def walk(self, state: np.ndarray) -> dict[int, np.ndarray]:
        """State above every item, from that above the part."""
        found = {self.items[0]: state}
        for item in self.items[1:]:
            up = self.up[item]
            found[item] = self.maps[up][found[up], self.slots]
        return found


def replacements(nodes: DataFrame, leaf_cells: DataFrame, weight: DataFrame) -> DataFrame:
    """(node, before, after, n): sites on which the edge above ``node`` leads from one state to another, or keeps it.

    ``leaf_cells`` is (pattern, taxon, state) and ``weight`` (pattern, weight).
    A missing state is filled in. Where the states differ, n adds up to the
    least number of changes.
    """
    plan = contraction.schedule(contraction.with_tour(nodes))
    matrices = plan.items.select("node", F.array(*[F.lit(c) for c in CHANGE_COSTS]).alias("p"))
    blocks = contraction.Blocks.of(leaf_cells)
    tree = contraction.Contraction(plan, matrices, blocks, contraction.MinPlus())
    tree.rise()
    width = blocks.width

    def choices(block, part):
        rows = []
        for item in part.items:
            cost = part.value[item][0][0][None] + (1 - np.eye(4))[:, :, None]  # state above, own state, slot
            rows.append((part.cluster, block, item, MAP, cost.argmin(1).astype(np.uint8).tobytes()))
        return _table(rows)

    def compose(key, structure, rows):
        path = Path(structure, rows, width)
        if path.open is None:
            return _table([])
        every = np.broadcast_to(np.arange(4, dtype=np.uint8)[:, None], (4, width))
        through = path.maps[path.open][path.walk(every)[path.open], path.slots]
        return _table([(path.above, key[1].as_py(), key[0].as_py(), MAP, through.tobytes())])

    def hand_down(key, structure, rows):
        path = Path(structure, rows, width)
        return _table([(item, key[1].as_py(), 0, STATE, state.tobytes()) for item, state in path.walk(path.state).items()])

    def count(key, structure, rows):
        path = Path(structure, rows, width)
        found = []
        for (item, before), node in zip(path.walk(path.state).items(), path.nodes):
            after = path.maps[item][before, path.slots]
            sums = np.bincount(before.astype(np.int64) * 4 + after, path.weight, 16)
            found += [(node, k // 4, k % 4, float(sums[k])) for k in np.flatnonzero(sums)]
        columns = list(zip(*found)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["node", "before", "after", "n"])

    def open_items(level: int) -> DataFrame:
        """The item of each part of a level that other parts hang from."""
        below = plan.items.where(F.col(f"s{level}") & (F.col(f"u{level}") > 0)).select(F.col(f"u{level}").alias("cluster"), F.col(f"u{level - 1}").alias("item")).distinct()
        return below.select("cluster", F.explode(F.sequence(F.lit(0), F.lit(blocks.count - 1))).alias("block"), "item", F.lit(OPEN).alias("kind"), F.lit(None).cast("binary").alias("value"))

    maps = [cut(tree.descend(None, choices, ROWS))]
    for level in range(1, plan.levels):
        maps.append(cut(tree.parts(level, maps[-1].unionByName(open_items(level)), compose, ROWS)))
    state = _root_states(tree)
    for level in range(plan.levels, 1, -1):
        state = cut(tree.parts(level, maps[level - 1].unionByName(state), hand_down, ROWS))
    weights = tree._weights(weight.select("pattern", "weight")).select("cluster", "block", "item", F.lit(WEIGHT).alias("kind"), "value")
    counted = tree.parts(1, maps[0].unionByName(state).unionByName(weights), count, COUNTS)
    return counted.groupBy("node", "before", "after").agg(F.sum("n").cast("long").alias("n"))


def _root_states(tree: contraction.Contraction) -> DataFrame:
    """State of the root leaf on every block: what is observed, else the first of least cost."""
    width = tree.width
    top = tree.level[-1].select("block", F.col("value").alias("cost")).join(tree.root, "block", "left")

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                cost = np.frombuffer(row["cost"]).reshape(4, width)
                state = np.minimum(cost, cost.min(0) + 1).argmin(0).astype(np.uint8)
                slot, seen = np.divmod(np.array(row["codes"] or [], np.int64), 8)
                state[slot[seen < 4]] = seen[seen < 4]
                rows.append((1, row["block"], 0, STATE, state.tobytes()))
            yield from _table(rows).to_batches()

    return top.mapInArrow(run, ROWS)
