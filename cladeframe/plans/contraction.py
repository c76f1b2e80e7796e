"""Messages on trees of any depth by contraction of parts of the tree.

The tree hangs from its root leaf. A preorder that visits the smaller child
first cuts it into parts of bounded weight, each a contiguous interval: whole
subtrees, and stretches of the paths between them with all that hangs from
their sides. A part has at most one edge below it, so seen from above it is
four values a pattern, or a 4 x 4 transfer matrix a pattern where that edge is
open. A node that joins two heavy subtrees is a part of its own. The parts are
the nodes of a smaller tree that is cut by the same rule at a coarser weight,
and a logarithmic number of levels contracts the tree to one part; going back
down, each part learns what lies outside. The number of Spark stages follows
the number of levels, log(n) / log(``WEIGHT``), whether the tree is balanced
or a ladder.

Patterns are dealt into rows of ``WIDTH``; one task handles one part on one
such row, so neither long trees nor long alignments meet in one group.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import models
from cladeframe.operators import trees
from cladeframe.operators.ordering import global_rank, running_totals
from cladeframe.session import cut_apart as cut, ship_package

WEIGHT, WIDTH = 64, 256
LEAF, VECTOR, LINEAR, GIVEN, WEIGHTS = range(5)
DATA = "cluster long, block int, item long, kind int, codes array<int>, value binary, log binary, other binary, otherlog binary"
FIELDS = ["cluster", "block", "item", "kind", "codes", "value", "log", "other", "otherlog"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 4]


class SumProduct:
    """Likelihoods: products at nodes, sums over states along edges, rescaled as they go."""

    neutral, impossible = 1.0, 0.0

    def __init__(self, pi):
        self.pi = np.asarray(pi, float)

    def push(self, p, x):
        return np.matmul(p, x.reshape(*x.shape[:2], -1)).reshape(x.shape)

    def fold(self, f, x):
        return (f * x[:, None]).sum(2) if x.ndim == 3 else np.einsum("kijw,kjbw->kibw", f, x)

    def both(self, x, y):
        if x.ndim < y.ndim:
            x, y = y, x
        return x * (y[:, :, None] if x.ndim > y.ndim else y)

    def adjoint(self, f, above):
        return (f * (self.pi[:, None] * above)[:, :, None]).sum(1) / self.pi[:, None]

    def scaled(self, x):
        top = x.sum(1) if x.ndim == 3 else x.sum((1, 2))
        top = np.where(top > 0, top, 1.0)
        return x / (top[:, None] if x.ndim == 3 else top[:, None, None]), np.log(top)


class MinPlus:
    """Least costs: sums at nodes, minima over states along edges; costs are symmetric."""

    neutral, impossible = 0.0, float(1 << 30)

    def push(self, p, x):
        flat = x.reshape(*x.shape[:2], -1)
        return (p[:, :, :, None] + flat[:, None]).min(2).reshape(x.shape)

    def fold(self, f, x):
        return (f + x[:, None]).min(2) if x.ndim == 3 else (f[:, :, :, None] + x[:, None]).min(2)

    def both(self, x, y):
        if x.ndim < y.ndim:
            x, y = y, x
        return x + (y[:, :, None] if x.ndim > y.ndim else y)

    def adjoint(self, f, above):
        return (f + above[:, :, None]).min(1)

    def scaled(self, x):
        return x, 0.0


@dataclass
class Schedule:
    """Nodes with their part at every level: c0 is the place in the preorder, c1 .. the parts, u0 .. those of the parent, s1 .. first nodes."""

    items: DataFrame
    levels: int


def schedule(nodes: DataFrame, weight: int = WEIGHT) -> Schedule:
    """Parts of the tree at every level.

    ``nodes`` is (node, parent, enter, leave, tips) as :func:`trees.rooted`
    gives it; the root leaf has a null parent or no row.
    """
    below = cut(nodes.where("parent IS NOT NULL").select("node", "parent", "enter", "leave", (2 * F.col("tips") - 1).alias("size")))
    total, levels = below.count(), 1
    while weight ** levels <= total:
        levels += 1
    kids = below.groupBy("parent").agg(F.max(F.struct("size", "node"))["node"].alias("_last"), F.sum("size").alias("_both"),
                                       F.max("size").alias("hi"), F.when(F.count("*") > 1, F.min("size")).alias("lo"))
    step = 1 + F.when(F.col("node") == F.col("_last"), F.col("_both") - F.col("size")).otherwise(0)
    placed = below.join(kids, "parent").withColumn("_step", step)
    events = placed.select("node", F.inline(F.array(
        F.struct(F.col("enter").alias("at"), F.col("_step").alias("v")), F.struct(F.col("leave").alias("at"), (-F.col("_step")).alias("v")))))
    place = running_totals(events, "at", {"c0": "v"}).where("v > 0").select("node", "c0")
    own = kids.select(F.col("parent").alias("node"), "lo", "hi")
    parent = below.select(F.col("node").alias("parent"), F.col("size").alias("p_size")).join(
        own.select(F.col("node").alias("parent"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi")), "parent")
    rows = below.select("node", "parent", "size").join(place, "node").join(own, "node", "left").join(parent, "parent", "left")

    def on_path(size: str, lo: str, hi: str, least: int):
        return F.coalesce((F.col(size) >= least) & (F.col(hi) >= least) & (F.col(lo) < least), F.lit(False))

    starts, first = {}, F.col("p_size").isNull()
    for level in range(levels, 0, -1):
        least = weight ** level
        inner, outer = on_path("size", "lo", "hi", least), on_path("p_size", "p_lo", "p_hi", least)
        same = outer & (F.floor(F.col("size") / least) == F.floor(F.col("p_size") / least))
        # A part of a coarser level begins at every finer level, too.
        first = first | (F.col("size") >= least) & ~(inner & F.coalesce(same, F.lit(False)))
        starts[f"s{level}"] = first
    marked = cut(rows.select("node", "parent", "c0", (F.col("size") == 1).alias("leaf"), *[s.alias(name) for name, s in starts.items()]))
    parts = cut(running_totals(marked, "c0", {f"c{level}": F.col(f"s{level}").cast("int") for level in range(1, levels + 1)}))
    above = parts.select(F.col("node").alias("parent"), *[F.col(f"c{level}").alias(f"u{level}") for level in range(levels)])
    return Schedule(cut(parts.join(above, "parent", "left").na.fill(0, [f"u{level}" for level in range(levels)])), levels)


def edge_matrices(lengths: DataFrame, variants: list[tuple[np.ndarray, np.ndarray, list[float]]], step: float = 0.0) -> DataFrame:
    """(node, p, more): matrices of every category of the edge above each node, in order.

    ``variants`` lists (rate matrix, frequencies, rates of the categories), the
    model itself first. With ``step``, ``more`` has the derivative by the
    logarithm of the length, then by each parameter, whose two neighbours at
    ``step`` on either side follow in ``variants``.
    """
    ship_package(lengths.sparkSession)
    names = ["node", "p", "more"] if step else ["node", "p"]

    def run(batches):
        for batch in batches:
            t = batch.column(1).to_numpy(zero_copy_only=False)

            def of(q, pi, rates):
                return models.transitions(q, pi, np.multiply.outer(t, rates).reshape(-1)).reshape(len(t), -1)

            columns = [of(*variants[0])]
            if step:
                q, _, rates = variants[0]
                p = columns[0].reshape(len(t), -1, 4, 4)
                slope = (p @ q) * np.multiply.outer(t, rates)[:, :, None, None]
                both = [of(*v) for v in variants[1:]]
                more = [slope.reshape(len(t), -1), *[(b - a) / (2 * step) for a, b in zip(both[::2], both[1::2])]]
                columns.append(np.concatenate(more, 1))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * c.shape[1], pa.int32()), pa.array(c.reshape(-1))) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=names)

    return lengths.select("node", "length").mapInArrow(run, "node long, p array<double>" + (", more array<double>" if step else ""))


class Part:
    """One part of the tree on one row of patterns: its items, their payloads and edges."""

    def __init__(self, structure: pa.Table, data: pa.Table, algebra, width: int):
        self.algebra, self.width = algebra, width
        s = structure.sort_by("item")
        self.items = s.column("item").to_pylist()
        self.nodes = s.column("node").to_pylist()
        self.above = s.column("above")[0].as_py() if len(s) else 0
        edges = s.column("p").combine_chunks()
        flat = edges.flatten().to_numpy().reshape(len(s), -1, 4, 4)
        self.cats = flat.shape[1]
        self.edge = dict(zip(self.items, flat))
        if "more" in s.column_names:  # derivatives of the matrices
            self.more = dict(zip(self.items, s.column("more").combine_chunks().flatten().to_numpy().reshape(len(s), -1, self.cats, 4, 4)))
        known = set(self.items)
        self.kids: dict[int, list[int]] = {i: [] for i in self.items}
        for item, up in zip(self.items, s.column("up").to_pylist()):
            if up in known and up != item:
                self.kids[up].append(item)
        none = (np.full((self.cats, 4, width), algebra.neutral), np.zeros((self.cats, width)))
        self.payload = {i: (VECTOR, *none) for i, leaf in zip(self.items, s.column("leaf").to_pylist()) if leaf}
        self.given = self.other = self.weights = None
        for row in data.to_pylist():
            if row["kind"] == LEAF:
                self.payload[row["item"]] = (VECTOR, self.states(row["codes"]), none[1])
            elif row["kind"] == WEIGHTS:
                self.weights = np.frombuffer(row["value"]).reshape(-1, width)
            elif row["kind"] == GIVEN:
                self.given = (self.array(row["value"], 4), self.array(row["log"]))
                self.other = (self.array(row["other"], 4), self.array(row["otherlog"])) if row["other"] is not None else None
            else:
                shape = (4,) if row["kind"] == VECTOR else (4, 4)
                self.payload[row["item"]] = (row["kind"], self.array(row["value"], *shape), self.array(row["log"]))

    def array(self, octets: bytes, *shape: int) -> np.ndarray:
        return np.frombuffer(octets).reshape(self.cats, *shape, self.width)

    def states(self, codes: list[int]) -> np.ndarray:
        """Values of a leaf; codes are slot * 8 + state, 4 for missing."""
        slot, state = np.divmod(np.array(codes, np.int64), 8)
        slot, state = slot[state < 4], state[state < 4]
        value = np.full((4, self.width), self.algebra.neutral)
        value[:, slot] = self.algebra.impossible
        value[state, slot] = self.algebra.neutral
        return np.broadcast_to(value, (self.cats, 4, self.width))

    def rise(self, below=None) -> None:
        """Values of all items and their messages over the edges above them; ``below`` comes in over the open edge."""
        a = self.algebra
        self.value, self.message = {}, {}
        one = np.where(np.eye(4, dtype=bool), a.neutral, a.impossible)[None, :, :, None]
        for item in reversed(self.items):
            sent = [self.message[k] for k in self.kids[item]]
            kind, x, log = self.payload.get(item, (None, None, 0.0))
            if kind == LINEAR and (sent or below):
                y, ylog = (sent or [below])[0]
                x, log = a.fold(x, y), log + ylog
            elif kind is None:
                if len(sent) < 2:
                    if not sent:
                        self.value[item] = None  # both edges below are open
                        continue
                    sent = [*sent, below or (np.broadcast_to(one, (self.cats, 4, 4, self.width)), 0.0)]
                x, log = a.both(sent[0][0], sent[1][0]), sent[0][1] + sent[1][1]
            x, more = a.scaled(x)
            self.value[item] = (x, log + more)
            self.message[item] = (a.push(self.edge[item], x), log + more)

    def descend(self) -> None:
        """What the rest of the tree says at the upper end of the edge above every item."""
        a = self.algebra
        self.rise(self.other)
        self.outside = {self.items[0]: self.given}
        if self.value[self.items[0]] is None:
            self.value[self.items[0]] = self.other
        for item in self.items:
            d, log = self.outside[item]
            down = a.push(self.edge[item], d)
            kids = self.kids[item]
            for k in kids:
                if self.payload.get(item, (None,))[0] == LINEAR:
                    _, f, flog = self.payload[item]
                    x, xlog = a.adjoint(f, down), log + flog
                else:
                    mate = next((self.message[m] for m in kids if m != k), self.other)
                    x, xlog = a.both(down, mate[0]), log + mate[1]
                x, more = a.scaled(x)
                self.outside[k] = (x, xlog + more)


def _bytes(x) -> bytes:
    return np.ascontiguousarray(x, float).tobytes()


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.table([pa.array(c, k) for c, k in zip(columns, KINDS)], names=FIELDS)


@dataclass
class Blocks:
    """Patterns dealt into rows of ``width``, and the states of every leaf on each row; the tree does not matter yet."""

    patterns: DataFrame
    codes: DataFrame
    count: int
    width: int

    @staticmethod
    def of(cells: DataFrame, patterns: DataFrame | None = None, width: int = WIDTH) -> Blocks:
        """``cells`` is (pattern, taxon, state), a null or absent state is missing; ``patterns`` lists all where some have no cell."""
        ship_package(cells.sparkSession)
        ranked = global_rank(cells.select("pattern").distinct() if patterns is None else patterns.select("pattern"), [], ["pattern"])
        placed = cut(ranked.select("pattern", F.floor(F.col("rank") / width).cast("int").alias("block"), (F.col("rank") % width).cast("int").alias("slot")))
        state = F.least(F.coalesce(F.col("state"), F.lit(4)), F.lit(4)).cast("int")
        codes = cut(cells.join(placed, "pattern").groupBy(F.col("taxon").alias("node"), "block").agg(
            F.collect_list(F.col("slot") * 8 + state).alias("codes")))  # ``width`` at most
        return Blocks(placed, codes, (placed.agg(F.max("block")).first()[0] or 0) + 1, width)


class Contraction:
    """Messages of one tree on blocks of patterns under one algebra.

    ``matrices`` is (node, p) for the edge above every node but the root leaf;
    a column ``more`` of derivatives goes along to the finest level.
    """

    def __init__(self, plan: Schedule, matrices: DataFrame, blocks: Blocks, algebra):
        self.plan, self.algebra, self.width = plan, algebra, blocks.width
        self.edges = cut(plan.items.join(matrices, "node"))
        self.patterns, self.blocks = blocks.patterns, blocks.count
        self.root = blocks.codes.where("node = 0").select("block", "codes")
        self.level = [cut(self._data(blocks.codes.where("node <> 0").join(plan.items, "node").select(
            F.col("c1").alias("cluster"), "block", F.col("c0").alias("item"), F.lit(LEAF).alias("kind"), "codes")))]

    def with_edges(self, matrices: DataFrame) -> Contraction:
        """The same tree and patterns with other matrices."""
        other = copy(self)
        other.edges, other.level = cut(self.plan.items.join(matrices, "node")), self.level[:1]
        return other

    @staticmethod
    def _data(rows: DataFrame) -> DataFrame:
        missing = {"codes": "array<int>", **dict.fromkeys(("value", "log", "other", "otherlog"), "binary")}
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(missing[c]).alias(c) for c in FIELDS])

    def _structure(self, level: int) -> DataFrame:
        """Items of the parts of a level, for every block of patterns."""
        firsts = self.edges if level == 1 else self.edges.where(f"s{level - 1}")
        more = [c for c in ("more",) if level == 1 and c in self.edges.columns]
        above = F.col(f"c{level + 1}") if level < self.plan.levels else F.lit(0).cast("long")
        return firsts.select(
            F.col(f"c{level}").alias("cluster"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"), F.col(f"c{level - 1}").alias("item"),
            F.col(f"u{level - 1}").alias("up"), "node", above.alias("above"), (F.col("leaf") if level == 1 else F.lit(False)).alias("leaf"), "p", *more)

    def _each(self, level: int, data: DataFrame, work: Callable, kind: str) -> DataFrame:
        algebra, width = self.algebra, self.width

        def run(key, structure, rows):
            return work(key[0].as_py(), key[1].as_py(), Part(structure, rows, algebra, width))

        return self.parts(level, data, run, kind)

    def parts(self, level: int, data: DataFrame, run: Callable, kind: str) -> DataFrame:
        """``run(key, structure, rows)`` on every part of a level and block, with the rows of ``data`` that name it."""
        left = self._structure(level).groupBy("cluster", "block")
        return left.cogroup(data.groupBy("cluster", "block")).applyInArrow(run, kind)

    def rise(self, to_root: bool = True) -> None:
        """Contract level by level; what each part sends up is kept for the way down, which needs all but the last."""
        def work(cluster, block, part):
            part.rise()
            found = part.value[part.items[0]]
            if found is None:
                return _table([])
            x, log = found
            kind = VECTOR if x.ndim == 3 else LINEAR
            return _table([(part.above, block, cluster, kind, None, _bytes(x), _bytes(np.broadcast_to(log, (part.cats, part.width))), None, None)])

        for level in range(1, self.plan.levels + to_root):
            self.level.append(cut(self._each(level, self.level[-1], work, DATA)))

    def arrived(self) -> DataFrame:
        """(pattern, cat, m0 .. m3, log): what the tree says to its root leaf."""
        algebra, width = self.algebra, self.width
        top = self.level[-1].select("block", "value", "log").join(self.edges.where("c0 = 1").select("p"))  # one edge hangs from the root leaf

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    p = np.array(row["p"]).reshape(-1, 4, 4)
                    sent = algebra.push(p, np.frombuffer(row["value"]).reshape(len(p), 4, width))
                    yield _rows(row["block"], {"m": sent, "log": np.frombuffer(row["log"]).reshape(len(p), width)})

        found = top.mapInArrow(run, "block int, slot int, cat int, m0 double, m1 double, m2 double, m3 double, log double")
        return found.join(self.patterns, ["block", "slot"]).drop("block", "slot")

    def descend(self, weights: DataFrame | None, emit: Callable, kind: str) -> DataFrame:
        """What ``emit`` makes of each part at the finest level, where all items are nodes.

        ``emit(block, part)`` returns an Arrow table of schema ``kind``;
        ``part.value`` and ``part.outside`` hold what lies below and above each
        edge, ``part.weights`` a row for every column of ``weights`` but pattern.
        """
        algebra, width = self.algebra, self.width
        cats = F.size("p") / 16

        def root(batches):
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    part = Part.__new__(Part)
                    part.algebra, part.width, part.cats = algebra, width, int(row["cats"])
                    rows.append((1, row["block"], 0, GIVEN, None, _bytes(part.states(row["codes"] or [])), _bytes(np.zeros((part.cats, width))), None, None))
                yield from _table(rows).to_batches()

        every = self.patterns.select("block").distinct().join(self.root, "block", "left").join(self.edges.where("c0 = 1").select(cats.alias("cats")))
        given = every.mapInArrow(root, DATA)

        def work(cluster, block, part):
            part.descend()
            rows = []
            for item in part.items:
                kind = part.payload.get(item, (None,))[0]
                other = None
                if kind == LINEAR:
                    other = part.message[part.kids[item][0]] if part.kids[item] else part.other
                elif kind is None:
                    other = part.value[item]
                more = [_bytes(other[0]), _bytes(np.broadcast_to(other[1], (part.cats, part.width)))] if other else [None, None]
                d, log = part.outside[item]
                rows.append((item, block, 0, GIVEN, None, _bytes(d), _bytes(np.broadcast_to(log, (part.cats, part.width))), *more))
            return _table(rows)

        def last(cluster, block, part):
            part.descend()
            part.cluster = cluster
            return emit(block, part)

        for level in range(self.plan.levels, 1, -1):
            given = cut(self._each(level, self.level[level - 1].unionByName(given), work, DATA))
        data = self.level[0].unionByName(given)
        if weights is not None:
            data = data.unionByName(self._weights(weights))
        return self._each(1, data, last, kind)

    def _weights(self, weights: DataFrame) -> DataFrame:
        """The weights of each block of patterns, a row for every column, for every part of the finest level."""
        width, names = self.width, [c for c in weights.columns if c != "pattern"]

        def run(batches):
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    w = np.zeros((len(names), width))
                    for slot, *values in row["all"]:
                        w[:, int(slot)] = values
                    rows.append((row["cluster"], row["block"], 0, WEIGHTS, None, _bytes(w), None, None, None))
                yield from _table(rows).to_batches()

        each = weights.join(self.patterns, "pattern").groupBy("block").agg(F.collect_list(F.array(F.col("slot").cast("double"), *[F.col(c).cast("double") for c in names])).alias("all"))
        parts = self.plan.items.where("s1").select(F.col("c1").alias("cluster"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"))
        return parts.join(each, "block").mapInArrow(run, DATA)

    def messages(self) -> DataFrame:
        """(node, pattern, cat, m0 .. m3, log, d0 .. d3, dlog) of every edge, by its lower node."""
        def emit(block, part):
            batches = []
            for item, node in zip(part.items, part.nodes):
                (v, log), (d, dlog) = part.value[item], part.outside[item]
                batches.append(_rows(block, {"m": v, "log": log, "d": d, "dlog": dlog}, node, part.cats))
            return pa.Table.from_batches(batches)

        kind = "node long, block int, slot int, cat int, m0 double, m1 double, m2 double, m3 double, log double, d0 double, d1 double, d2 double, d3 double, dlog double"
        return self.descend(None, emit, kind).join(self.patterns, ["block", "slot"]).drop("block", "slot")


def _rows(block: int, values: dict[str, np.ndarray], node: int | None = None, cats: int | None = None) -> pa.RecordBatch:
    """A row for each category and slot."""
    cats, _, width = next(v.shape for v in values.values() if np.ndim(v) == 3)
    names, columns = ["block", "slot", "cat"], [np.full(cats * width, block, np.int32), np.tile(np.arange(width, dtype=np.int32), cats), np.repeat(np.arange(cats, dtype=np.int32), width)]
    for name, x in values.items():
        if np.ndim(x) == 3:
            names += [f"{name}{i}" for i in range(4)]
            columns += [np.ascontiguousarray(x[:, i]).reshape(-1) for i in range(4)]
        else:
            names.append(name)
            columns.append(np.ascontiguousarray(np.broadcast_to(x, (cats, width))).reshape(-1))
    if node is not None:
        names, columns = ["node", *names], [np.full(cats * width, node, np.int64), *columns]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def with_tour(nodes: DataFrame) -> DataFrame:
    """Nodes with tour steps and tip counts, found anew where ``nodes`` is (node, parent) alone."""
    if {"enter", "leave", "tips"} <= set(nodes.columns):
        return nodes
    links = cut(nodes.where("parent IS NOT NULL").select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v")))
    return cut(trees.rooted(links, (links.count() + 3) // 2))
