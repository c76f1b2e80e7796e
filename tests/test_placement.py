"""Placement by blocks of queries against the scores of single quartets."""

import random

import pytest

from cladeframe.functions import scorers
from cladeframe.operators import quartets, sites
from cladeframe.plans import placement, refine

LEAVES, SITES = 9, 130
TREE = [(0, 9), (1, 9), (9, 10), (2, 10), (10, 11), (3, 11), (11, 12), (12, 13), (4, 13), (5, 13), (12, 14), (6, 14), (14, 15), (7, 15), (8, 15)]


def _predictor(spark, taxa, layers):
    draw = random.Random(3)
    rows = [(t, s, draw.randrange(5)) for t in taxa for s in range(SITES) if draw.random() < 0.8]
    words = sites.words_of_cells(spark.createDataFrame(rows, "taxon int, site int, state int")).selectExpr("cast(taxon AS long) AS taxon", "word", "low", "high", "observed")
    return refine.network_predictor(words, -(-SITES // sites.WORD), layers)


def _deep(spark):
    draw = random.Random(4)
    rows = [(0, i, j, draw.uniform(-1, 1)) for i in range(-1, 256) for j in range(5)] + [(1, i, j, draw.uniform(-1, 1)) for i in range(-1, 5) for j in range(3)]
    return spark.createDataFrame(rows, "layer int, i int, j int, w double")


@pytest.mark.parametrize("net, aggregation", [("default", "log"), ("deep", "probability")])
def test_blocks_score_edges_as_single_quartets_do(spark, monkeypatch, net, aggregation):
    monkeypatch.setattr(placement, "BLOCK", 3)
    monkeypatch.setattr(placement, "STRETCH", 5)
    layers = scorers.default_layers(spark) if net == "default" else _deep(spark)
    edges = spark.createDataFrame([(min(e), max(e)) for e in TREE], "u long, v long")
    # Taxon 40 has no cells; -3 stands before all leaves and the others behind them.
    asked = [-3, 20, 21, 25, 40, 30]
    queries = spark.createDataFrame([(q,) for q in asked], "query long")
    predict = _predictor(spark, [*range(LEAVES), *(q for q in asked if q != 40)], layers)
    got = {(r["query"], r.u, r.v): r.score for r in placement.edge_scores(edges, LEAVES, queries, predict, aggregation=aggregation).collect()}
    two = sorted((tuple(r) for r in placement.best_edges(placement.edge_scores(edges, LEAVES, queries, predict, aggregation=aggregation, most=2), 2).collect()), key=lambda r: (r[0], r[4]))
    del predict.by_site
    single = placement.edge_scores(edges, LEAVES, queries.where("query IN (-3, 21, 40)"), predict, aggregation=aggregation).collect()
    want = {(r["query"], r.u, r.v): r.score for r in single}
    assert len(got) == len(asked) * len(TREE) and set(want) <= set(got)
    assert all(got[k] == pytest.approx(s, abs=1e-7) for k, s in want.items())
    best = []
    for q in sorted(asked):
        rows = sorted((-s, u, v) for (p, u, v), s in got.items() if p == q)[:2]
        best += [(q, u, v, -s, k + 1) for k, (s, u, v) in enumerate(rows)]
    assert two == best


def test_no_row_of_a_query_and_a_node_is_shuffled(spark, monkeypatch):
    def listed(*_):
        raise AssertionError("quartets were listed one by one")

    monkeypatch.setattr(quartets, "score_in_groups", listed)
    edges = spark.createDataFrame([(min(e), max(e)) for e in TREE], "u long, v long")
    queries = spark.createDataFrame([(q,) for q in range(20, 30)], "query long")
    predict = _predictor(spark, [*range(LEAVES), *range(20, 30)], scorers.default_layers(spark))
    assert placement.best_edges(placement.edge_scores(edges, LEAVES, queries, predict, most=2), 2).count() == 20
    assert placement.edge_scores(edges, LEAVES, queries.where("false"), predict, most=2).count() == 0
