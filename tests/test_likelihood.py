"""Likelihood search on small simulated alignments."""

import json
import math
from itertools import product

import numpy as np
import pytest

from cladeframe import config
from cladeframe.functions import models
from cladeframe.plans import engine, likelihood_search
from cladeframe.sources.newick import parse_newick

TREE = [(0, 5, 0.1), (1, 5, 0.2), (5, 6, 0.15), (2, 6, 0.1), (6, 7, 0.2), (3, 7, 0.1), (4, 7, 0.3)]


def simulate(sites, seed=3):
    """States of leaves 0..4 on TREE under JC69, 4 for missing."""
    rng = np.random.default_rng(seed)
    at = {5: rng.integers(0, 4, sites)}
    for child, parent, t in ((0, 5, 0.1), (1, 5, 0.2), (6, 5, 0.15), (2, 6, 0.1), (7, 6, 0.2), (3, 7, 0.1), (4, 7, 0.3)):
        moved = rng.random(sites) < 0.75 * (1 - math.exp(-4 * t / 3))
        at[child] = np.where(moved, (at[parent] + rng.integers(1, 4, sites)) % 4, at[parent])
    data = np.array([at[k] for k in range(5)])
    data[rng.random(data.shape) < 0.05] = 4
    return data


def brute(edges, data, model):
    """Log likelihood by summing over all states of the inner nodes."""
    q, pi = models.rate_matrix(np.array(model.pi), np.array(model.rates)), np.array(model.pi)
    out = 0.0
    p = {rate: {(u, v): models.transitions(q, pi, np.array([t * rate]))[0] for u, v, t in edges} for rate in model.site_rates()}
    for column in data.T:
        moving = 0.0
        for table in p.values():
            for inner in product(range(4), repeat=3):
                state, value = dict(zip((5, 6, 7), inner)), pi[inner[0]]
                for (u, v), m in table.items():
                    if u < 5:
                        value *= m[state[v], column[u]] if column[u] < 4 else 1.0
                    else:
                        value *= m[state[u], state[v]]
                moving += value / model.categories
        seen = set(column[column < 4])
        still = 1.0 if not seen else pi[next(iter(seen))] if len(seen) == 1 else 0.0
        out += math.log((1 - model.invariant) * moving + model.invariant * still)
    return out


@pytest.fixture(scope="module")
def data():
    return simulate(80)


@pytest.fixture(scope="module")
def patterns(spark, data):
    rows = [(t, s, int(x)) for t, row in enumerate(data) for s, x in enumerate(row) if x < 4]
    return likelihood_search.Patterns.of(spark.createDataFrame(rows, "taxon long, site long, state int"), 5)


def test_scan_and_total_match_enumeration(spark, data, patterns):
    edges = spark.createDataFrame(TREE, "u long, v long, length double")
    model = likelihood_search.Mixture([0.3, 0.2, 0.2, 0.3], [1.0, 2.0, 0.5, 0.7, 3.0, 1.0], alpha=0.6, categories=2, invariant=0.15)
    kept = data[:, (data < 4).any(0)]
    want = brute(TREE, kept, model)
    assert likelihood_search.total(edges, 5, patterns, model) == pytest.approx(want, abs=1e-6)
    found = {(r.u, r.v): r for r in likelihood_search.scan(edges, 5, patterns, model).collect()}
    assert set(found) == {(5, 6), (6, 7)}
    assert all(r.ll0 == pytest.approx(want, abs=1e-6) for r in found.values())
    # Interchange 1 of (5, 6; 0, 1 | 2, 7) puts 2 beside 0.
    swapped = [(0, 5, 0.1), (2, 5, 0.1), (5, 6, 0.15), (1, 6, 0.2), *TREE[4:]]
    assert found[5, 6].ll1 == pytest.approx(brute(swapped, kept, model), abs=1e-6)


def test_search_finds_the_tree(spark, patterns):
    wrong = [(0, 5, 0.1), (2, 5, 0.1), (5, 6, 0.1), (1, 6, 0.1), (6, 7, 0.1), (3, 7, 0.1), (4, 7, 0.1)]
    edges, history = likelihood_search.likelihood_nni(
        spark.createDataFrame(wrong, "u long, v long, length double"), 5, patterns, likelihood_search.Mixture([0.25] * 4), max_rounds=1, fit_rounds=1)
    rows = edges.collect()
    near = {r.u: r.v for r in rows if r.u < 5}
    assert near[0] == near[1] and near[3] == near[4] and len(rows) == 7
    assert history[0]["moves"] == 1 and all(h["after"] >= h["before"] for h in history)


def test_gene_run_ends_with_lengths_and_support(spark, data, tmp_path):
    text = f"5 {data.shape[1]}\n" + "".join(f"t{k} {''.join('ACGT-'[x] for x in row)}\n" for k, row in enumerate(data))
    (tmp_path / "in.phy").write_text(text)
    settings = config.defaults("gene")
    for stage in settings["stages"]:
        stage["enabled"] = stage["id"] == "likelihood"
        if stage["id"] == "likelihood":
            stage.update(model="JC", max_rounds=1, optimizer_iterations=1)
    result = engine.infer(spark, str(tmp_path / "in.phy"), str(tmp_path / "out"), "gene", settings=settings)
    tree = parse_newick(spark.read.text(str(tmp_path / "out/newick")).first()[0])
    assert len(tree) == 7 and all(e[3] is not None for e in tree)
    assert {r.u for r in spark.read.parquet(str(tmp_path / "out/support")).collect()} <= {5, 6, 7}
    assert result["quality"]["stopped_by"].keys() == {"likelihood"}
    assert result["health"]["warnings"] == [] and result["health"]["variable_sites"] > 0
    assert json.loads(spark.read.text(str(tmp_path / "out/result")).first()[0])["taxa"] == 5
