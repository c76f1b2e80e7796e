"""Operators on small frames against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import evidence
from cladeframe.operators import candidates, moves, ordering, quartets, sites, trees
from cladeframe.plans import likelihood
from cladeframe.sources import alignments


def test_running_total_and_rank(spark):
    rng = random.Random(7)
    values = [rng.randrange(100) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "at long, v long")
    got = {r["at"]: r["run"] for r in ordering.running_total(df, "at", "v", "run", block=8).collect()}
    assert got == {i: sum(values[: i + 1]) for i in range(500)}
    ranked = ordering.global_rank(df.withColumn("g", F.col("at") % 3), ["g"], ["v", "at"]).collect()
    for g in range(3):
        rows = sorted((r for r in ranked if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(len(rows)))
        assert rows == sorted(rows, key=lambda r: (r.v, r["at"]))


def test_greedy_matching_equals_one_ordered_pass(spark):
    rng = random.Random(3)
    rows = {(a, b): rng.randrange(6) / 2 for a, b in (sorted(rng.sample(range(20), 2)) for _ in range(60))}
    df = spark.createDataFrame([(a, b, a, b, q) for (a, b), q in rows.items()],
                               "left long, right long, rank_left long, rank_right long, q double")
    used, want = set(), set()
    for (a, b), q in sorted(rows.items(), key=lambda r: (r[1], r[0])):
        if not {a, b} & used:
            want.add((a, b))
            used |= {a, b}
    assert {(r.left, r.right) for r in candidates.greedy_matching(df).collect()} == want


CATERPILLAR = [(0, 6), (1, 6), (6, 7), (2, 7), (7, 8), (3, 8), (8, 9), (4, 9), (5, 9)]


def test_all_interchanges_of_a_tree(spark):
    edges = spark.createDataFrame(CATERPILLAR, "u long, v long")
    trees.validate(edges, 6)
    frame = trees.frames(edges, 6)
    assert frame.count() == 3
    for choice in (1, 2):
        for row in frame.collect():
            one = spark.createDataFrame([row], frame.schema).withColumn("choice", F.lit(choice))
            trees.validate(moves.apply_interchanges(edges, one), 6)


def test_disjoint_moves(spark):
    edges = spark.createDataFrame(CATERPILLAR, "u long, v long")
    proposed = trees.frames(edges, 6).withColumn("order", F.struct("u", "v"))
    chosen = moves.pick_disjoint(proposed, moves.closed_neighborhood(proposed, trees.directed(edges)))
    assert {(r.u, r.v) for r in chosen.collect()} == {(6, 7)}


def test_support_example(spark):
    """Two votes for, one tie, and an edge without evidence."""
    rows = [(0, 1, 6, 7, 3.0, 1.0, 0.0), (0, 1, 6, 7, 1.0, 2.0, 0.0), (0, 1, 6, 7, 1.0, 1.0, 0.0), (0, 1, 6, 7, 1.0, 1.0, 1.0)]
    found = spark.createDataFrame(rows, "cls int, alt1 int, u long, v long, s0 double, s1 double, s2 double")
    edges = spark.createDataFrame([(6, 7), (7, 8)], "u long, v long")
    first, second = quartets.species_support(edges, found).orderBy("u").collect()
    assert (first.active, first.informative, first.ties) == (4, 3, 1)
    assert first.vote0 == pytest.approx(0.5) and first.vote1 == pytest.approx(0.5)
    assert first.margin == pytest.approx((2 - 1 + 0) / 3)
    assert second.value is None and second.margin is None and second.active == 0


def test_margin_index_and_weights(spark):
    df = spark.createDataFrame([(-1e100,), (-1.0,), (0.0,), (1.0,), (1e100,)], "m double")
    values = [r[0] for r in df.select(evidence.margin_index(F.col("m"))).collect()]
    assert values == sorted(values) and values[2] == 50 and 0 <= values[0] and values[-1] <= 100
    rows = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.0), (1, 3, 0.0, -10.0, -20.0), (1, 4, 0.0, 10000.0, -10000.0)],
                                 "u long, v long, base double, delta1 double, delta2 double")
    got = [r.value for r in quartets.gene_support(rows).orderBy("v").collect()]
    assert got[0] == pytest.approx(100 / 3) and got[1] > 99.99 and got[2] == 0


def test_readers(spark, tmp_path):
    phylip = tmp_path / "a.phy"
    phylip.write_text("4 7\na ACGTN-?\nb ACGTACG\nc ACGTACG\nd acgtacg\n")
    rows = alignments.with_taxa(alignments.read_alignment(spark, str(phylip)))
    assert [r.name for r in rows.orderBy("taxon").collect()] == ["a", "b", "c", "d"]
    fasta = tmp_path / "a.fa"
    fasta.write_text(">a\nACGT\nN-?\n>b\nACGTACG\n>c\nACGTACG\n>d\nacgt\nacg\n")
    got = {r.name: r.sequence for r in alignments.read_alignment(spark, str(fasta)).collect()}
    assert got == {"a": "ACGTN-?", "b": "ACGTACG", "c": "ACGTACG", "d": "ACGTACG"}
    for bad in ("4 7\na ACGTN-\nb ACGTACG\nc ACGTACG\nd ACGTACG\n", "4 4\na ACGT\na ACGT\nc ACGT\nd ACGT\n",
                "4 4\na ACGJ\nb ACGT\nc ACGT\nd ACGT\n", "3 4\na ACGT\nb ACGT\nc ACGT\nd ACGT\n"):
        phylip.write_text(bad)
        with pytest.raises(ValueError):
            alignments.read_alignment(spark, str(phylip))


def test_words_agree_with_cells(spark):
    rows = spark.createDataFrame([(0, "ACGTN-acgu" * 20), (1, "T")], "taxon long, sequence string")
    cells = sites.cells_of(rows)
    direct = {tuple(r) for r in sites.words_of(rows, 60).where("observed <> 0").collect()}
    assert direct == {tuple(r) for r in sites.words_of_cells(cells, 60).collect()}


def test_likelihood_by_enumeration(spark):
    import itertools
    import math
    nodes = spark.createDataFrame([(4, 0, 1), (1, 4, 2), (5, 4, 2), (2, 5, 3), (3, 5, 3)], "node long, parent long, depth long")
    lengths = nodes.select("node", (F.col("node") * 0.05 + 0.1).alias("length"))
    columns = ["0123", "0011", "0.11", "2...", ".222"]
    cells = spark.createDataFrame([(t, s, int(c)) for s, col in enumerate(columns) for t, c in enumerate(col) if c != "."]
                                  + [(0, 9, 4)], "taxon int, site long, state int")
    time = {n: n * 0.05 + 0.1 for n in (1, 2, 3, 4, 5)}

    def p(i, j, n):
        x = math.exp(-4 * time[n] / 3)
        return 0.25 + 0.75 * x if i == j else 0.25 - 0.25 * x

    want = 0.0
    for col in columns:
        total = 0.0
        for a, b, c, d, x, y in itertools.product(range(4), repeat=6):
            if all(k in ("." + str(v)) for k, v in zip(col, (a, b, c, d))):
                total += 0.25 * p(a, x, 4) * p(x, b, 1) * p(x, y, 5) * p(y, c, 2) * p(y, d, 3)
        want += math.log(total)
    got = likelihood.log_likelihood(nodes, cells, lengths, [0.25] * 4, [1.0] * 6, [1.0], [1.0]).first()
    assert got.log_likelihood == pytest.approx(want, abs=1e-8) and got.sites == len(columns) + 1
    _, history = likelihood.jc_steps(nodes, cells.where("site < 2"), lengths, 3)
    assert history == sorted(history)


def test_edge_scores_equal_brute_force(spark):
    from cladeframe.plans import placement
    edges = spark.createDataFrame(CATERPILLAR, "u long, v long")
    queries = spark.createDataFrame([(20,), (21,)], "query long")

    def predict(listed):
        h = [F.abs(F.hash("q0", "q1", "q2", "q3", F.lit(i))) % 97 + 1 for i in range(3)]
        return listed.select("q0", "q1", "q2", "q3", *[(h[i] / (h[0] + h[1] + h[2])).alias(f"s{i}") for i in range(3)])

    found = placement.potentials(placement.node_triples(edges, 6), queries, predict).collect()
    got = {(r["query"], r.u, r.v): r.score for r in placement.edge_scores(edges, 6, queries, predict).collect()}
    assert len(got) == 2 * len(CATERPILLAR)
    near = {}
    for u, v in CATERPILLAR:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)

    def toward(node, edge):
        for side in near[node]:
            seen, open_nodes = {node}, [side]
            while open_nodes:
                x = open_nodes.pop()
                seen.add(x)
                open_nodes += [y for y in near[x] if y not in seen]
            if set(edge) <= seen | {node} and (set(edge) - {node}) <= seen and side in seen:
                if all(e == node or e in seen for e in edge) and (node not in edge or side in edge):
                    return side
        raise AssertionError

    for query in (20, 21):
        p = {(r.node, r.dst): r.p for r in found if r["query"] == query}
        for edge in CATERPILLAR:
            want = sum(p[node, toward(node, edge)] for node in range(6, 10))
            assert got[(query, *edge)] == pytest.approx(want, abs=1e-7)


def test_newick_text(spark):
    from cladeframe.sources.newick import parse_newick, to_newick
    edges = spark.createDataFrame(CATERPILLAR, "u long, v long")
    nodes = trees.rooted(edges, 6)
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["a", "b b", "c", "d", "e", "x'y"])], "node long, name string")
    text = to_newick(nodes, names).first().newick
    assert text.startswith("(a,") and text.endswith(");")
    assert len(parse_newick(text)) == len(CATERPILLAR)
    lengths = nodes.where("parent IS NOT NULL").select("node", (F.col("node") / 7e5).alias("length"))
    labels = nodes.where("node > 6").select("node", F.concat(F.lit("s"), "node").alias("label"))
    text = to_newick(nodes, names, lengths, labels).first().newick
    assert text.count(":") == len(CATERPILLAR) and text.count("s") == 3 and "'b b':1.428571429E-6" in text
    assert sorted(e[3] for e in parse_newick(text)) == pytest.approx(sorted(r.length for r in lengths.collect()), rel=1e-9)


def test_ladders_have_a_text(spark):
    from cladeframe.sources.newick import parse_newick, to_newick
    n = 2000
    ladder = [(0, n), (n - 1, 2 * n - 3)] + [(k, n + k - 1) for k in range(1, n - 1)] + [(n + k, n + k + 1) for k in range(n - 3)]
    nodes = trees.rooted(spark.createDataFrame(ladder, "u long, v long"), n)
    names = spark.range(n).select(F.col("id").alias("node"), F.concat(F.lit("t"), "id").alias("name"))
    text = to_newick(nodes, names).first().newick
    assert len(parse_newick(text)) == len(ladder) == 2 * n - 3
    assert text.count("(") == text.count(")") == n - 2


def test_sparse_joining_rounds_find_cherries(spark):
    import numpy as np
    from cladeframe.plans import joining

    rng, n, length = np.random.default_rng(5), 16, 400

    def evolve(states, share):
        return np.where(rng.random(length) < share, rng.integers(0, 4, length), states)

    level = [rng.integers(0, 4, length)]
    while len(level) < n:
        level = [evolve(s, 0.1 if len(level) == n // 2 else 0.3) for s in level for _ in range(2)]
    rows = [(t, s, int(x)) for t, states in enumerate(level) for s, x in enumerate(states)]
    cells = spark.createDataFrame(rows, "taxon long, site long, state int")
    rounds = []
    options = joining.JoinOptions(terminal_limit=8, landmarks=8, window=4)
    edges = joining.apnj(cells, n, length, options, rounds.append)
    trees.validate(edges, n)
    above = {r.u: r.v for r in edges.collect() if r.u < n}
    assert rounds and rounds[-1]["active"] <= 8
    assert all(above[2 * k] == above[2 * k + 1] for k in range(n // 2))


def test_parameters_are_checked(spark, tmp_path):
    import hashlib
    from cladeframe.sources.assets import load_parameters

    file = tmp_path / "layers.csv"
    file.write_text("layer,i,j,w\n0,1,2,0.5\n0,-1,2,0.25\n")
    good, schema = hashlib.sha256(file.read_bytes()).hexdigest(), "layer int, i int, j int, w double"
    assert load_parameters(spark, str(file), good, schema).agg(F.sum("w")).first()[0] == 0.75
    assert load_parameters(spark, str(tmp_path), {"layers.csv": good}, schema).count() == 2
    for bad in ("0" * 64, {"layers.csv": good, "other.csv": good}):
        with pytest.raises(ValueError):
            load_parameters(spark, str(tmp_path), bad, schema)
