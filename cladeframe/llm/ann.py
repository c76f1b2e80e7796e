"""Nearest neighbours by cosine with a hierarchical k-means tree.

The tree is grown on a bounded sample of unit vectors and is as small as its
sample, so it can be broadcast; every vector is then placed in a leaf. A query
walks the tree best bin first: a priority queue always opens the node whose
centre is nearest, and leaves come out in that order. How many leaves a query
visits is calibrated: for a sample of queries the true neighbours are found by
a scan of all vectors, and the visit count is the smallest with which the
sample reaches the recall asked for. A query whose leaves hold fewer others
than asked for walks on until they do. Leaves that lie together form cells of
bounded size, and a leaf beyond that size several, so a leaf with a third of all
vectors is searched by many tasks. A query goes once to each cell that holds
leaves of its own, with the list of these; a task keeps the vectors of one cell
and lets the queries pass by, so its memory does not grow with them.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. A query is never its own neighbour; rows
that repeat a query's id count as the query itself. Equal scores are ordered by
id. With fewer vectors than asked for, all others are returned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.session import cut, ship_package

SAMPLE_BYTES = 32 << 20
SAMPLE_ROWS = 20_000
PIECE = 2048  # vectors that a scan compares at once
CELL_ROWS, CELL_BYTES = 1 << 17, 32 << 20  # vectors that a task keeps: rows, and bytes in single precision
CELLS = 32  # fewer vectors go in a cell where there would be fewer cells than these
TOGETHER = 512  # queries that meet a cell at once
WALKS = 512  # queries whose leaves one task finds
BRANCHES = 16
MOST_LEAVES = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles or, where they are given so, floats."""
    given = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast("array<float>" if given == "array<float>" else "array<double>")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0))
    top = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return some.where(F.size("v") == (top["d"] if top else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so equal rows give equal numbers wherever they stand."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class Tree:
    """Nodes in breadth-first numbers; a node's children are an interval with a centre each."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []  # by inner node
        self.children: list[list[int]] = [[]]
        waiting = [(0, np.arange(len(sample)))]
        n_leaves = 1
        while waiting:
            # The fullest node is split next, so leaves hold about as many vectors each.
            waiting.sort(key=lambda w: len(w[1]))
            node, rows = waiting.pop()
            k = min(BRANCHES, len(rows) // 2, leaves - n_leaves + 1)
            if k < 2:
                continue
            centres, label = self._split(sample[rows], k, rng)
            if len(centres) < 2:
                continue
            first = len(self.children)
            self.children[node] = list(range(first, first + len(centres)))
            self.children.extend([] for _ in centres)
            self.centres.append((node, centres))
            n_leaves += len(centres) - 1
            waiting.extend((first + i, rows[label == i]) for i in range(len(centres)))
        by_node = dict(self.centres)
        self.centres = [by_node.get(i) for i in range(len(self.children))]
        self.leaves = sum(not c for c in self.children)

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
        centres = np.unique(rows[rng.choice(len(rows), k, replace=False)], axis=0)
        label = np.zeros(len(rows), int)
        for _ in range(8):
            label = (rows @ centres.T).argmax(1)
            kept = np.unique(label)
            centres = np.array([rows[label == i].mean(0) for i in kept])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        return centres, (rows @ centres.T).argmax(1)

    def place(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of every row, by the nearest centre on each level."""
        node = np.zeros(len(unit), int)
        waiting = [(0, np.arange(len(unit)))]
        while waiting:
            at, rows = waiting.pop()
            if not self.children[at]:
                node[rows] = at
                continue
            label = (unit[rows] @ self.centres[at].T).argmax(1)
            waiting.extend((c, rows[label == i]) for i, c in enumerate(self.children[at]) if (label == i).any())
        return node

    def visit(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, enough: int = 0) -> list[int]:
        """The first ``most`` leaves in best-bin-first order, and further ones until they hold ``enough`` by ``sizes``."""
        queue, out, held = [(-1.0, 0)], [], 0
        while queue and (len(out) < most or held < enough):
            _, at = heapq.heappop(queue)
            if not self.children[at]:
                out.append(at)
                held += sizes.get(at, 0) if sizes else 0
                continue
            near = self.centres[at] @ query
            for c, s in zip(self.children[at], near.tolist()):
                heapq.heappush(queue, (-s, c))
        return out


def grow(vectors: DataFrame, n: int) -> Tree:
    width = vectors.select(F.size("v")).first()
    rows = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width[0])) if width else 0
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, rows / max(n, 1)) * (1 << 30)))
    sample = [r[1] for r in sorted((r[0], r[1]) for r in vectors.where(share).collect())]
    leaves = int(min(MOST_LEAVES, max(1, n // 256)))
    return Tree(_unit(np.array(sample)) if sample else np.zeros((0, 1)), leaves)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def placed(vectors: DataFrame, tree) -> DataFrame:
    """(vec_id, v, leaf) of every vector."""
    def run(batches):
        for batch in batches:
            leaf = tree.value.place(_unit(_matrix(batch.column(1)))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id long, v {_kind(vectors, 'v')}, leaf int")


def cells_of(rows: dict[int, int], width: int) -> dict[int, tuple[int, int]]:
    """(first cell, cells) of every leaf by its number of vectors: neighbours share a cell, a large leaf has several."""
    size = min(CELL_ROWS, max(1, CELL_BYTES // (4 * max(width, 1))), max(PIECE, -(-sum(rows.values()) // CELLS)))
    out, cell, held = {}, 0, 0
    for leaf in sorted(rows):
        if held and held + rows[leaf] > size:
            cell, held = cell + 1, 0
        n = -(-rows[leaf] // size)
        out[leaf] = cell, n
        held += rows[leaf]
        if n > 1:
            cell, held = cell + n, 0
    return out


def visits(queries: DataFrame, n_queries: int, tree, most: int, sizes: dict[int, int], cells: dict[int, tuple[int, int]], k: int) -> DataFrame:
    """(cell, id, v, leaves): the first ``most`` leaves of every query by cell, and further ones until they hold ``k`` others.

    ``sizes`` are the ids in each leaf, MOST_LEAVES numbers at most.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((sizes, cells))
    # Rows that repeat a query's id are no candidates of it.
    own = queries.groupBy("vec_id").agg(F.count("*").alias("own"))

    def run(batches):
        sizes, cells = shared.value
        for batch in batches:
            unit = _unit(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, 1))
            for a in range(0, max(batch.num_rows, 1), 64):
                which, where, leaves = [], [], []
                for i, n in enumerate(batch.column(2).slice(a, 64).to_pylist(), a):
                    by_cell: dict[int, list[int]] = {}
                    for leaf in tree.value.visit(unit[i], most, sizes, k + n):
                        first, count = cells.get(leaf, (0, 0))  # a leaf without vectors has no cell
                        for cell in range(first, first + count):
                            by_cell.setdefault(cell, []).append(leaf)
                    which.extend([i] * len(by_cell))
                    where.extend(by_cell)
                    leaves.extend(by_cell.values())
                w = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(where, pa.int32()), batch.column(0).take(w), batch.column(1).take(w), pa.array(leaves, pa.list_(pa.int32()))],
                    names=["cell", "id", "v", "leaves"])

    # By rows, as a walk takes long for the few bytes of a query.
    spread = queries.join(own, "vec_id").select("vec_id", "v", "own").repartition(max(1, -(-n_queries // WALKS)), F.xxhash64("vec_id", "v"))
    return spread.mapInArrow(
        run, f"cell int, id long, v {_kind(queries, 'v')}, leaves array<int>")


def _best(ids, vectors, query_ids, queries, k):
    """(query_id, vec_id, score) of the k nearest of one block for each query, ties to the smaller id."""
    if not len(ids) or not len(query_ids):
        return [], [], []
    near = _unit(queries) @ _unit(vectors).T
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    out_q, out_v, out_s = [], [], []
    limit = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1])]
    for i, row in enumerate(near):
        # All that may tie with the last place are scored exactly.
        some = np.flatnonzero((row >= limit[i] - 1e-9) & np.isfinite(row))
        exact = cosines(vectors[some], np.broadcast_to(queries[i], (len(some), queries.shape[1])))
        order = np.lexsort((ids[some], -exact))[:k]
        out_q.extend([query_ids[i]] * len(order))
        out_v.extend(ids[some][order].tolist())
        out_s.extend(exact[order].tolist())
    return out_q, out_v, out_s


class Cell:
    """Vectors of some leaves, met by queries of which each names its leaves."""

    def __init__(self, ids: np.ndarray, leaf: np.ndarray, vectors: np.ndarray, k: int):
        # Repeated rows count once. Of equal vectors no query takes others than the first k by id, its own id apart.
        raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, 8 * vectors.shape[1]))).ravel()
        same = np.unique(raw, return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        order = order[_place(same[order], ids[order]) == 0]
        order = order[_place(same[order]) <= k]
        order = order[np.lexsort((ids[order], leaf[order]))]
        self.k, self.ids, self.vectors = k, ids[order], vectors[order]
        self.leaves, self.starts = np.unique(leaf[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.unit = _unit(self.vectors).astype(np.float32)
        self.by_id = np.argsort(self.ids, kind="stable")
        # Two sums of rounded products in single precision, each off by at most this share of one.
        self.slack = np.float32(4 * (vectors.shape[1] + 4) * 2.0 ** -24)

    def best(self, ids: np.ndarray, vectors: np.ndarray, leaves: list) -> tuple[list, list, list]:
        """(query_id, vec_id, score) of the k nearest for each query, ties to the smaller id."""
        k, unit, n = self.k, _unit(vectors).astype(np.float32), len(ids)
        asked = np.zeros((n, len(self.leaves)), bool)
        asked[np.repeat(np.arange(n), [len(x) for x in leaves]), np.searchsorted(self.leaves, np.concatenate(leaves))] = True
        sorted_ids = self.ids[self.by_id]
        low, high = np.searchsorted(sorted_ids, ids, "left"), np.searchsorted(sorted_ids, ids, "right")
        own_rows = np.repeat(np.arange(n), high - low)
        own = self.by_id[np.arange(len(own_rows)) - np.repeat(np.cumsum(high - low) - high, high - low)]
        order = np.argsort(own, kind="stable")
        own_rows, own = own_rows[order], own[order]
        top = np.full((n, k), -np.inf, np.float32)  # best k so far, the least of them first
        some = []
        for at, (a, b) in enumerate(zip(self.starts, self.ends)):
            rows = np.flatnonzero(asked[:, at])
            if not len(rows):
                continue
            near = unit[rows] @ self.unit[a:b].T
            first, last = np.searchsorted(own, [a, b])
            for i, c in zip(own_rows[first:last], own[first:last]):
                if asked[i, at]:
                    near[np.searchsorted(rows, i), c - a] = -np.inf
            better = np.flatnonzero(near.max(1) >= top[rows, 0] - self.slack)
            rows, near = rows[better], near[better]
            most = min(k, b - a)
            added = np.partition(near, (b - a) - most, axis=1)[:, (b - a) - most:] if most < b - a else near
            top[rows] = np.partition(np.concatenate([top[rows], added], 1), most, axis=1)[:, most:]
            x, y = np.nonzero(near >= np.maximum(top[rows, :1] - self.slack, np.float32(-2)))
            some.append((rows[x], y + a, near[x, y]))
        if not some:
            return [], [], []
        rows, columns, near = (np.concatenate(c) for c in zip(*some))
        kept = near >= top[rows, 0] - self.slack
        rows, columns = rows[kept], columns[kept]
        exact = np.concatenate([np.zeros(0)] + [cosines(self.vectors[columns[i:i + 65536]], vectors[rows[i:i + 65536]]) for i in range(0, len(rows), 65536)])
        order = np.lexsort((self.ids[columns], -exact, rows))
        order = order[_place(rows[order]) < k]
        return ids[rows[order]].tolist(), self.ids[columns[order]].tolist(), exact[order].tolist()


def _place(*sorted_keys: np.ndarray) -> np.ndarray:
    """Place of every row among those of its key, from 0."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([key[1:] != key[:-1] for key in sorted_keys], axis=0)
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))


def meet(rows: DataFrame, n_cells: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest in a cell for each of its queries.

    ``rows`` has (cell, asks, id, v, leaf, leaves): vectors with their leaf, and queries, where ``asks`` is 1, with their leaves.
    """
    def run(batches):
        cell, held, block = None, [], None
        for batch in batches:
            cells, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)]):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, held, block = cells[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((part.column(2).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(3))))
                    continue
                if block is None:
                    block = Cell(*(np.concatenate(c) for c in zip(*held)), k) if held else None
                    held = []
                if block is None:
                    continue
                for i in range(0, b - a, TOGETHER):
                    some = part.slice(i, TOGETHER)
                    q, v, s = block.best(some.column(2).to_numpy(), _matrix(some.column(3)), some.column(5).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return rows.repartitionById(max(1, n_cells), F.col("cell")).sortWithinPartitions("cell", "asks").mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scan_all(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """Exact neighbours of a few given (id, vector) queries, by one pass over all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        ids = np.array([q[0] for q in shared.value], np.int64)
        asked = np.array([q[1] for q in shared.value])
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                part = batch.slice(a, PIECE)
                q, v, s = _best(part.column(0).to_numpy(), _matrix(part.column(1)), ids, asked, k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return _top(vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def calibrate(vectors: DataFrame, in_leaves: DataFrame, queries: DataFrame, n_queries: int, tree, k: int, recall: float, tried: int = 200) -> int:
    """Smallest number of leaves with which ``tried`` queries reach ``recall``."""
    share = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < F.lit(int(min(1.0, tried / max(n_queries, 1)) * (1 << 30)))
    some = [(r[0], list(r[1])) for r in queries.where(share).collect()]
    if not some:
        return tree.value.leaves
    truth = scan_all(vectors, some, k).join(in_leaves.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf")
    orders = dict(zip([q[0] for q in some], (tree.value.visit(u, tree.value.leaves) for u in _unit(np.array([q[1] for q in some])))))
    where = {q: {leaf: i for i, leaf in enumerate(o)} for q, o in orders.items()}
    places = sorted(where[r[0]][r[1]] for r in truth.collect())  # k rows for each tried query
    if not places:
        return tree.value.leaves
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)] + 1


def search(table: DataFrame, every: int = 50, k: int = 5, recall: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): the neighbours of all vectors whose id is a multiple of ``every``."""
    spark = table.sparkSession
    ship_package(spark)
    vectors = cut(usable(table))
    queries = vectors.where(F.col("vec_id") % every == 0)
    n, n_queries = vectors.count(), queries.count()
    tree = spark.sparkContext.broadcast(grow(vectors, n))
    in_leaves = cut(placed(vectors, tree))
    most = calibrate(vectors, in_leaves, queries, n_queries, tree, k, recall)
    sizes = {r[0]: r[1] for r in in_leaves.groupBy("leaf").agg(F.count_distinct("vec_id")).collect()}
    # One row for each leaf, MOST_LEAVES at most.
    rows = {r[0]: r[1] for r in in_leaves.groupBy("leaf").count().collect()}
    width = vectors.select(F.size("v")).first()
    cells = cells_of(rows, width[0] if width else 0)
    dealt = F.broadcast(spark.createDataFrame([(leaf, *c) for leaf, c in cells.items()], "leaf int, first int, n int"))
    held = in_leaves.join(dealt, "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), "n")).cast("int").alias("cell"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v", "leaf",
        F.lit(None).cast("array<int>").alias("leaves"))
    asked = visits(queries, n_queries, tree, most, sizes, cells, k).select("cell", F.lit(1).alias("asks"), "id", "v", F.lit(None).cast("int").alias("leaf"), "leaves")
    return _top(meet(held.unionByName(asked), max((c + n for c, n in cells.values()), default=0), k), k).select("query_id", "rank", "vec_id", "score")
