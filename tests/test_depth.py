"""Deep trees: contraction, common ancestors and joint fits."""

import itertools
import math

import numpy as np
import pytest

from cladeframe.functions import models
from cladeframe.operators import ancestry, trees
from cladeframe.plans import contraction, likelihood, likelihood_search
from tests.test_likelihood import TREE, brute, data, patterns  # noqa: F401


def ladder(n):
    return [(0, n), (n - 1, 2 * n - 3)] + [(k, n + k - 1) for k in range(1, n - 1)] + [(n + k, n + k + 1) for k in range(n - 3)]


def random_edges(n, rng):
    """Leaves attached one after the other to random edges."""
    edges, inner = [(0, n), (1, n), (2, n)], n + 1
    for leaf in range(3, n):
        u, v = edges.pop(rng.integers(len(edges)))
        edges += [(u, inner), (v, inner), (leaf, inner)]
        inner += 1
    return [(min(e), max(e)) for e in edges]


def parents(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    up, stack, order = {0: None}, [0], []
    while stack:
        x = stack.pop()
        order.append(x)
        for y in near[x]:
            if y != up[x]:
                up[y] = x
                stack.append(y)
    return up, order


def states(n, sites, rng):
    values = rng.integers(0, 4, (1, sites)).repeat(n, 0)
    noise = rng.random(values.shape)
    values[noise < 0.2] = rng.integers(0, 4, (noise < 0.2).sum())
    values[noise > 0.93] = 4
    return values


def cells(spark, values):
    return spark.createDataFrame([(t, s, int(x)) for t, row in enumerate(values) for s, x in enumerate(row) if x < 4], "taxon long, site long, state int")


@pytest.mark.parametrize("shape", ["ladder", "random"])
def test_messages_of_deep_trees(spark, shape):
    rng = np.random.default_rng(4)
    n, sites = 2000, 3
    edges = ladder(n) if shape == "ladder" else random_edges(n, rng)
    values = states(n, sites, rng)
    nodes = trees.rooted(spark.createDataFrame(edges, "u long, v long"), n)
    up, order = parents(edges)
    stay = math.exp(-4 * 0.1 / 3)
    below, log = {}, np.zeros(sites)
    cost = {}
    for x in reversed(order[1:]):
        if x < n:
            seen = values[x]
            v = np.where((seen == 4) | (np.arange(4)[:, None] == seen), 1.0, 0.0)
            c = np.where(v > 0, 0, 10 ** 6)
        else:
            v, c = below[x], cost[x]
            log += np.log(v.sum(0))
            v = v / v.sum(0)
        sent = stay * v + (1 - stay) * v.sum(0) / 4
        below[up[x]] = below.get(up[x], 1.0) * sent
        cost[up[x]] = cost.get(up[x], 0) + np.minimum(c, c.min(0) + 1)
    root = np.where((values[0] == 4) | (np.arange(4)[:, None] == values[0]), 1.0, 0.0)
    want = (np.log((0.25 * root * below[0]).sum(0)) + log).sum()
    lengths = nodes.where("parent IS NOT NULL").selectExpr("node", "0.1D AS length")
    rows = cells(spark, values)
    got = likelihood.log_likelihood(nodes, rows, lengths, [0.25] * 4, [1.0] * 6, [1.0], [1.0]).first()
    assert got.log_likelihood == pytest.approx(want, rel=1e-10)
    leaf_cells, _ = likelihood.pattern_cells(rows)
    changes = sorted(r.changes for r in likelihood.parsimony(nodes, leaf_cells).collect())
    assert changes == sorted(np.where(root > 0, cost[0], 10 ** 6).min(0).tolist())


def test_parts_are_small_and_levels_few(spark):
    rng = np.random.default_rng(1)
    for edges in (ladder(500), random_edges(500, rng)):
        plan = contraction.schedule(trees.rooted(spark.createDataFrame(edges, "u long, v long"), 500), weight=8)
        assert plan.levels == 4
        for level in range(1, 5):
            rows = plan.items if level == 1 else plan.items.where(f"s{level - 1}")
            assert rows.groupBy(f"c{level}").count().agg({"count": "max"}).first()[0] <= 8 * 8
        assert plan.items.where("c4 <> 1").count() == 0


def topology(quartet, up):
    """(class, nodes of the inner path) from root paths."""
    def path(x):
        out = []
        while x is not None:
            out.append(x)
            x = up[x]
        return out[::-1]

    paths = [path(q) for q in quartet]
    common = lambda i, j: sum(a == b for a, b in zip(paths[i], paths[j]))
    sums = [common(0, 1) + common(2, 3), common(0, 2) + common(1, 3), common(0, 3) + common(1, 2)]
    cls = 0 if sums[0] >= max(sums[1:]) else 1 if sums[1] >= sums[2] else 2

    def met(i, j, k):
        depth, a = max((common(a, b), a) for a, b in ((i, j), (i, k), (j, k)))
        return paths[a][depth - 1]

    mate, first, last = [(1, 2, 3), (2, 1, 3), (3, 1, 2)][cls]
    return cls, met(0, mate, first), met(0, first, last)


@pytest.mark.parametrize("n, shape", [(7, "random"), (300, "random"), (10_000, "ladder")])
def test_quartets_in_deep_trees(spark, n, shape):
    rng = np.random.default_rng(n)
    edges = ladder(n) if shape == "ladder" else random_edges(n, rng)
    if n == 7:
        quartets = list(itertools.combinations(range(7), 4))
    else:
        quartets = sorted({tuple(sorted(map(int, rng.choice(n, 4, replace=False)))) for _ in range(60)} | {(0, 1, n - 2, n - 1), (0, 1, 2, 3)})
    table = spark.createDataFrame(edges, "u long, v long")
    places = ancestry.ancestry(table, n)
    found = ancestry.classify(spark.createDataFrame(quartets, "q0 long, q1 long, q2 long, q3 long"), places)
    got = {(r.q0, r.q1, r.q2, r.q3): (r.cls, r.p, r.q) for r in found.collect()}
    up, _ = parents(edges)
    assert got == {q: topology(q, up) for q in quartets}
    split = ancestry.discriminate(found, trees.frames(table, n), places).where("u IS NOT NULL").collect()
    near = trees.frames(table, n)
    frames = {(r.u, r.v): r for r in near.join(spark.createDataFrame([(r.u, r.v) for r in split] or [(-1, -1)], "u long, v long"), ["u", "v"]).collect()}
    for r in split:  # interchange 1 (b with c) makes the quartet what alt1 says
        f = frames[r.u, r.v]
        swapped = [e for e in edges if set(e) not in ({f.u, f.b}, {f.v, f.c})] + [(f.u, f.c), (f.v, f.b)]
        if n < 1000:
            assert topology((r.q0, r.q1, r.q2, r.q3), parents(swapped)[0])[0] == r.alt1
    assert split or n == 10_000


def test_joint_fit_reaches_the_optimum(spark, data, patterns):  # noqa: F811
    start = spark.createDataFrame(TREE, "u long, v long, length double").selectExpr("u", "v", "0.1D AS length")
    model = likelihood_search.Mixture([0.3, 0.2, 0.2, 0.3], [1.0] * 6, alpha=1.0, categories=2)
    edges, fitted, ll = likelihood_search.fit(start, 5, patterns, model, "012210", False, iterations=40, tolerance=1e-5)
    kept = data[:, (data < 4).any(0)]
    rows = [tuple(r) for r in edges.collect()]
    assert ll == pytest.approx(brute(rows, kept, fitted), abs=1e-6)
    # No step along any coordinate gains more than the tolerance of the test.
    for i, (u, v, t) in enumerate(rows):
        for factor in (0.9, 1.1):
            moved = [*rows[:i], (u, v, min(max(t * factor, 1e-6), 10.0)), *rows[i + 1:]]
            assert brute(moved, kept, fitted) <= ll + 2e-3
    free = likelihood_search.Parameters(fitted, "012210")
    assert free.names == ["1", "2", "alpha"]
    for step in itertools.chain(*[(0.1 * e, -0.1 * e) for e in np.eye(3)]):
        assert brute(rows, kept, free.at(np.clip(free.start + step, free.low, free.high))) <= ll + 2e-3


def test_gradient_matches_differences(spark, data, patterns):  # noqa: F811
    edges = spark.createDataFrame(TREE, "u long, v long, length double")
    model = likelihood_search.Mixture([0.3, 0.2, 0.2, 0.3], [1.0, 2.0, 0.5, 0.5, 2.0, 1.0], alpha=0.6, categories=2, invariant=0.15)
    free = likelihood_search.Parameters(model, "012210", True)
    tree = likelihood_search.Tree.of(edges, 5)
    ll, slopes, table = likelihood_search._slopes(tree, tree.lengths(edges), patterns, model, free.around(free.start, 1e-4))
    kept = data[:, (data < 4).any(0)]
    assert ll == pytest.approx(brute(TREE, kept, model), abs=1e-6)
    for i, slope in enumerate(slopes):
        ends = [brute(TREE, kept, free.at(free.start + h * np.eye(len(slopes))[i])) for h in (-1e-4, 1e-4)]
        assert slope == pytest.approx((ends[1] - ends[0]) / 2e-4, abs=1e-3)
    lower = {r.node: (r.u, r.v) for r in tree.nodes.collect()}
    for r in table.collect():
        ends = [brute([(u, v, t * math.exp(h) if (u, v) == lower[r.node] else t) for u, v, t in TREE], kept, model) for h in (-1e-4, 1e-4)]
        assert r.slope == pytest.approx((ends[1] - ends[0]) / 2e-4, abs=1e-3)


def test_transition_variants_follow_the_model():
    model = likelihood_search.Mixture([0.25] * 4, alpha=0.5, categories=4, invariant=0.2)
    q, pi, rates = model.variant()
    assert np.allclose(models.transitions(q, pi, np.array(rates)).sum(2), 1.0) and np.mean(rates) == pytest.approx(1 / 0.8)


def test_numbering_follows_the_topology(spark):
    rng = np.random.default_rng(5)
    n = 40
    edges = random_edges(n, rng)
    turned = dict(zip(range(n, 2 * n - 2), (n + rng.permutation(n - 2)).tolist()))
    other = [tuple(sorted((turned.get(u, u), turned.get(v, v)))) for u, v in edges]
    tables = [spark.createDataFrame(e, "u long, v long") for e in (edges, other)]
    got = [sorted(map(tuple, ancestry.relabelled(t, ancestry.canonical(t, n)).collect())) for t in tables]
    assert got[0] == got[1] and len(got[0]) == 2 * n - 3
    up, order = parents(edges)
    kids, least = {}, {}
    for x in reversed(order[1:]):
        least[x] = min([x] if x < n else [least[k] for k in kids[x]])
        kids.setdefault(up[x], []).append(x)
    label, stack = {}, [0]
    while stack:  # preorder, children by their smallest leaf
        x = stack.pop()
        label[x] = x if x < n else n + sum(k >= n for k in label)
        stack += sorted(kids.get(x, []), key=lambda k: -least[k])
    assert got[0] == sorted(tuple(sorted((label[u], label[v]))) for u, v in edges)


def test_medians_of_coverage(spark):
    from cladeframe.operators import pairs, sites
    rng = np.random.default_rng(2)
    seen = rng.random((9, 30)) < 0.5
    seen[4] = False
    rows = [(t, s, 1) for t in range(9) for s in range(30) if seen[t, s]]
    words = sites.words_of_cells(spark.createDataFrame(rows, "taxon long, site long, state int"))
    for panel, chosen in ((128, range(9)), (4, (0, 2, 5, 8))):
        both = [(seen[i] & seen[j]).sum() / 30 for i, j in itertools.combinations(chosen, 2)]
        any_ = [(seen[i] | seen[j]).sum() for i, j in itertools.combinations(chosen, 2)]
        row = pairs.coverage_medians(words, 9, 30, panel).first()
        jaccard = np.median([30 * b / a if a else 1.0 for a, b in zip(any_, both)])
        assert (row.median_overlap, row.median_jaccard) == pytest.approx((np.median(both), jaccard)) and row.pairs == len(both)


def test_reconstruction_makes_the_least_changes(spark):
    from cladeframe.plans import parsimony
    rng = np.random.default_rng(8)
    for n, edges in ((90, ladder(90)), (90, random_edges(90, rng)), (4, random_edges(4, rng))):
        values = states(n, 12, rng)
        values[0, :3] = 4
        nodes = trees.rooted(spark.createDataFrame(edges, "u long, v long"), n)
        leaf_cells, weight = likelihood.pattern_cells(cells(spark, values))
        found = parsimony.replacements(nodes, leaf_cells, weight).collect()
        up, order = parents(edges)
        cost, kids = {}, {}
        for x in reversed(order[1:]):
            cost[x] = np.where((values[x] == 4) | (np.arange(4)[:, None] == values[x]), 0, 10 ** 6) if x < n else sum(
                np.minimum(cost[k], cost[k].min(0) + 1) for k in kids[x])
            kids.setdefault(up[x], []).append(x)
        top = np.minimum(cost[order[1]], cost[order[1]].min(0) + 1)
        at = {0: np.where(values[0] < 4, values[0], top.argmin(0))}
        want = {}
        for x in order[1:]:
            at[x] = (cost[x] + (np.arange(4)[:, None] != at[up[x]])).argmin(0)
            for pair in zip(at[up[x]].tolist(), at[x].tolist()):
                want[x, *pair] = want.get((x, *pair), 0) + 1
        assert {(r.node, r.before, r.after): r.n for r in found} == want
        changes = likelihood.parsimony(nodes, leaf_cells).join(weight, "pattern").selectExpr("sum(changes * weight)").first()[0]
        assert sum(r.n for r in found if r.before != r.after) == changes
