"""Neighbours whose leaves are dealt into cells: rows sent, small cells, equal vectors."""

import collections

import numpy as np

from cladeframe.llm import ann


def _exact(ids, m, q, k=5):
    s = ann.cosines(m, np.broadcast_to(m[q], m.shape))
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_a_query_goes_once_to_each_cell(spark):
    m = np.random.default_rng(1).normal(size=(4000, 16)).astype(np.float32)
    vectors = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>"))
    tree = ann.Tree(ann._unit(m.astype(float)), 200)
    shared = spark.sparkContext.broadcast(tree)
    rows = {r["leaf"]: r["count"] for r in ann.placed(vectors, shared).groupBy("leaf").count().collect()}
    cells = ann.cells_of(rows, 16)
    n_cells = max(c + n for c, n in cells.values())
    assert len(rows) > 100 and n_cells <= 3 and sum(rows.values()) == 4000
    got = ann.visits(vectors.where("vec_id < 40"), 40, shared, 150, rows, cells, 5).collect()
    assert len(got) <= 40 * n_cells
    asked = collections.defaultdict(set)
    for r in got:
        asked[r["id"]] |= set(r["leaves"])
    unit = ann._unit(m.astype(float))
    assert all(asked[q] == set(tree.visit(unit[q], 150)) & set(rows) for q in range(40))


def test_small_cells_and_large_leaves_find_what_one_scan_finds(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    monkeypatch.setattr(ann, "PIECE", 8)
    monkeypatch.setattr(ann, "calibrate", lambda *a, **b: a[4].value.leaves)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(1200, 12))
    m[300:600] = m[50]
    m[600:650] = 2 * m[50]
    ids = np.arange(1200)
    found = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 1200, 50):
        want = _exact(ids, m, q)
        assert [v for v, _ in got[q]] == [v for v, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want], rtol=0, atol=1e-12)


def test_repeated_rows_take_no_place_of_others():
    rng = np.random.default_rng(4)
    m = np.repeat(rng.normal(size=(30, 4)), 2, axis=0)
    ids = np.repeat(np.arange(30), 2)
    m[20:40] = m[20]
    cell = ann.Cell(ids, np.repeat([0, 1], 30), m, 3)
    q, v, s = cell.best(np.array([4, 99, 11]), m[[8, 20, 22]], [np.array([0, 1])] * 3)
    assert q == [4] * 3 + [99] * 3 + [11] * 3
    for i, (own, at) in enumerate(((4, 8), (99, 20), (11, 22))):
        score = ann.cosines(m[::2], np.broadcast_to(m[at], m[::2].shape))
        order = [j for j in np.lexsort((ids[::2], -score)) if j != own][:3]
        assert v[3 * i:3 * i + 3] == order and np.allclose(s[3 * i:3 * i + 3], score[order], rtol=0, atol=1e-12)
