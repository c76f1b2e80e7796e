"""Formulas against independent small computations."""

import itertools
import math

import numpy as np
import pytest

from cladeframe import config
from cladeframe.functions import distance, hashing, models, quartet
from cladeframe.plans.joining import join_exactly
from cladeframe.sources.alignments import parse_blocks
from cladeframe.sources.newick import parse_newick


def test_fifteen_orbits_in_order():
    assert quartet.ORBITS == ("0000 0001 0010 0011 0012 0100 0101 0102 0110 0111 0112 0120 0121 0122 0123").split()
    assert len(quartet.within_split_orders()) == 8 == len(set(quartet.within_split_orders()))


def test_reordered_moves_the_supporting_orbit():
    for topology, orbit in ((0, "0011"), (1, "0101"), (2, "0110")):
        read = quartet.reordered(quartet.ORDERS[topology])
        assert quartet.ORBITS[read[quartet.ORBITS.index("0011")]] == orbit


def test_gamma_rates_average_one_and_grow():
    for alpha in (0.05, 0.5, 1.0, 20.0):
        rates = models.gamma_rates(alpha, 4)
        assert rates.mean() == pytest.approx(1) and np.all(np.diff(rates) > 0)
    # Exponential rates (alpha = 1) have closed-form category means.
    cuts = [-math.log(1 - k / 4) for k in range(4)] + [math.inf]
    part = [(a + 1) * math.exp(-a) - ((b + 1) * math.exp(-b) if b < math.inf else 0) for a, b in zip(cuts, cuts[1:])]
    assert models.gamma_rates(1.0, 4) == pytest.approx([4 * p for p in part], rel=1e-9)


def test_transitions_match_the_series():
    pi, rates = np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 2.0, 0.5, 0.7, 3.0, 1.0])
    q = models.rate_matrix(pi, rates)
    assert -(pi * q.diagonal()).sum() == pytest.approx(1)
    want, term = np.eye(4), np.eye(4)
    for k in range(1, 60):
        term = term @ q * 0.3 / k
        want = want + term
    assert models.transitions(q, pi, np.array([0.3]))[0] == pytest.approx(want, abs=1e-12)


def test_model_names():
    full = models.parse_model("gtr+fo+i+g4")
    assert (full.base, full.frequencies, full.categories, full.invariant) == ("GTR", "ml", 4, True)
    assert models.parse_model("K2P").base == "K80"
    for bad in ("JC+F", "GTR+G1", "GTR+I+I", "LG", "GTR+X", "GTR+G2+G3", "GTR+F+FO", "GTR+", "", "GTR+G17"):
        with pytest.raises(ValueError):
            models.parse_model(bad)


def test_gamma_shape(spark):
    schema = "sites long, ab long, ac long, bc long, abc long"
    shape, usable = distance.gamma_shape(spark.createDataFrame([(10, 5, 5, 5, 3)] * 32, schema))
    assert usable == 0 and 0.01 <= shape <= 100
    # Expected counts of star triplets with a known shape lead back to it.
    rows, true = [], 0.7
    for a, b, c in ((0.1, 0.2, 0.3), (0.5, 0.1, 0.2), (0.05, 0.4, 0.3)):
        f = [(1 + 4 * d / 3 / true) ** -true for d in (a + b, a + c, b + c)]
        joint = (1 + 4 * (a + b + c) / 3 / true) ** -true
        every = (1 + 3 * sum(f) + 6 * joint) / 16
        rows.append((10**7, *[round(10**7 * (1 + 3 * x) / 4) for x in f], round(10**7 * every)))
    shape, usable = distance.gamma_shape(spark.createDataFrame(rows, schema))
    assert usable == 3 and shape == pytest.approx(true, rel=2e-3)


def test_gamma_rates_are_category_means():
    for alpha in (0.05, 0.5, 1.0, 7.0):
        rates = models.gamma_rates(alpha, 5)
        draws = np.sort(np.random.default_rng(1).gamma(alpha, 1 / alpha, 500_000)).reshape(5, -1).mean(1)
        assert rates.mean() == pytest.approx(1) and rates == pytest.approx(draws, abs=0.02)


def test_mix_is_a_32_bit_value():
    values = {hashing.mix32_value(k) for k in range(1000)}
    assert len(values) == 1000 and max(values) < 2**32


def test_neighbour_joining_recovers_an_additive_tree():
    # Leaves 0..5 on a caterpillar with unit edges.
    leaves, inner = 6, {0: 6, 1: 6, 2: 7, 3: 8, 4: 9, 5: 9}
    d = np.array([[0 if i == j else 2 + abs(inner[i] - inner[j]) for j in range(leaves)] for i in range(leaves)], float)
    links = join_exactly(d, np.arange(leaves), np.arange(leaves), leaves)
    parent = dict(links)
    assert parent[0] == parent[1] and parent[4] == parent[5] and len(links) == 2 * leaves - 3


@pytest.mark.parametrize("bad", ["(a,b", "(a,a);", "(a,b)c,d;", "((a,b),(c,d)", "(,b);", "(a:,b);", "a);", "(a:-1,b:2,c:3);", "(a:nan,b,c);", "(a:inf,b,c);", "(a[x,b);", "(a]x,b);", "('a,b);"])
def test_bad_newick(bad):
    with pytest.raises(ValueError):
        parse_newick(bad)


def test_newick_root_suppression_and_quotes():
    edges = parse_newick("((a:1,b:2):3,(c:4,'x''y':5):6);")
    assert len(edges) == 5 and {e[2] for e in edges if e[2]} == {"a", "b", "c", "x'y"}
    assert [e[3] for e in edges if e[2] is None] == [9.0]


def test_multi_locus_blocks():
    text = "2 4\na ACGT\nb\nAC\nGT\n3 6\nx ACG\ny ACG\nz AAA\nTTT\nGGG\nCCC\n"
    rows = parse_blocks(text)
    assert [r[2:] for r in rows] == [("a", "ACGT"), ("b", "ACGT"), ("x", "ACGTTT"), ("y", "ACGGGG"), ("z", "AAACCC")]
    with pytest.raises(ValueError):
        parse_blocks("2 4\na ACGT\nb ACG\n")


def test_settings():
    base = config.defaults("gene")
    assert config.normalize(None, "gene") == base == config.normalize(base, "gene")
    for change in ({"version": 2}, {"stages": base["stages"][:2]}, {"apnj": {"window": 0}}, {"apnj": {"other": 1}}):
        with pytest.raises(ValueError):
            config.normalize({**base, **change}, "gene")


def test_orders_cover_all_topologies():
    assert sorted(quartet.ORDERS.values()) == sorted({(0, *p) for p in itertools.permutations((1, 2, 3)) if p[1] < p[2]})
