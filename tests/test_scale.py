"""Work whose bounds hold at size: broadcasts of written tables, quartets scored by groups, prefixes of the ordered pass."""

import random

import numpy as np

from cladeframe import session
from cladeframe.catalog import common
from cladeframe.catalog import trees as tree_queries
from cladeframe.functions import scorers
from cladeframe.operators import candidates, quartets, sites, trees
from cladeframe.plans import refine

SITES = 130


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_written_tables_are_not_broadcast(spark):
    few = session.cut_apart(spark.range(100).selectExpr("id", "id * 7 AS x"))
    many = session.cut_apart(spark.range(100_000).selectExpr("id", "xxhash64(id) AS x"))
    asked = spark.range(1 << 20).selectExpr("id", "id % 3 AS y")
    assert "BroadcastHashJoin" in _plan(asked.join(few, "id"))
    for joined in (asked.join(many, "id"), asked.join(many.where("x > 0").select("id", "x"), "id", "left"),
                   many.groupBy("id").count().join(asked, "id"), asked.join(many, "id", "left_anti")):
        joined.write.format("noop").mode("overwrite").save()
        assert "BroadcastHashJoin" not in _plan(joined)
    assert asked.join(many, "id").count() == 100_000


def test_rounds_over_trees_join_large_tables_by_shuffles(spark):
    assert trees.cut is session.cut_apart and refine.cut is session.cut_apart and quartets.cut is session.cut_apart


def _words(spark, taxa):
    draw = random.Random(3)
    rows = [(t, s, draw.randrange(5) if t != 5 else 4) for t in range(taxa) for s in range(SITES) if draw.random() < 0.8]
    return sites.words_of_cells(spark.createDataFrame(rows, "taxon int, site int, state int")).selectExpr("cast(taxon AS long) AS taxon", "word", "low", "high", "observed")


def test_groups_score_quartets_as_single_quartets_do(spark):
    words, count = _words(spark, 9), -(-SITES // sites.WORD)
    listed = [(0, 0, 1, 2, 3), (0, 0, 1, 2, 4), (0, 0, 1, 2, 4), (1, 0, 1, 2, 3), (1, 1, 2, 5, 8), (2, 4, 6, 7, 8), (2, 1, 2, 7, 40), (3, None, 2, 7, 8)]
    rows = spark.createDataFrame(listed, "g long, q0 long, q1 long, q2 long, q3 long")
    for predict in (refine.network_predictor(words, count, scorers.default_layers(spark)),
                    refine.kernel_predictor(words, count, scorers.default_kernel(spark))):
        single = {tuple(r[q] for q in quartets.KEY): [r.s0, r.s1, r.s2] for r in predict(rows.select(*quartets.KEY).distinct()).collect()}
        found = quartets.scored(predict, rows, ["g"]).collect()
        assert sorted((r.g, r.q0, r.q1, r.q2, r.q3) for r in found) == sorted(r for r in listed if r[1] is not None)
        for r in found:
            assert np.allclose([r.s0, r.s1, r.s2], single[tuple(r[q] for q in quartets.KEY)], rtol=0, atol=1e-12)


def test_orbits_of_whole_words_are_those_of_the_patterns():
    draw = np.random.default_rng(7)
    planes = draw.integers(0, 1 << sites.WORD, (3, 9, 4))
    planes[:2] &= planes[2]
    planes[:, 8] = 0
    low, high, seen = ((planes[..., None] >> np.arange(sites.WORD)) & 1)
    codes = np.where(seen == 1, low + 2 * high, 4).astype(np.uint8).reshape(9, -1)
    at = draw.integers(0, 9, (4, 200))
    found = quartets.count_orbits(planes, at)
    assert found.sum() > 0 and np.array_equal(found, quartets.count_patterns(codes, at) @ scorers._PATTERN_ORBITS)


def test_first_matches_are_those_of_the_whole_pass(spark, monkeypatch):
    draw = random.Random(5)
    pairs = {tuple(sorted(draw.sample(range(400), 2))) for _ in range(3000)}
    rows = [(a, b, a, b, 1.0, float(draw.randrange(40))) for a, b in sorted(pairs)]
    scored = spark.createDataFrame(rows, "left long, right long, rank_left long, rank_right long, distance double, q double")
    used, want = set(), []
    for r in sorted(rows, key=lambda r: (r[5], r[2], r[3], r[0], r[1])):
        if not used & {r[0], r[1]}:
            used |= {r[0], r[1]}
            want.append((r[0], r[1]))

    def whole(_):
        raise AssertionError("the whole matching was found")

    monkeypatch.setattr(candidates, "greedy_matching", whole)
    for count in (1, 2, 40, 1000):
        got = {(r.left, r.right) for r in candidates.first_matches(scored, count).collect()}
        assert got == set(want[:count])


def test_frames_of_trees_beyond_the_bound_are_not_broadcast(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(session, "BROADCAST_MOST", 0)
    _, rows, n = common.frame_quartets(spark, str(tmp_path), 2)
    other = tree_queries._moved(spark, str(tmp_path))
    for found in (rows, trees.frames(other, n)):
        found.write.format("noop").mode("overwrite").save()
        assert "BroadcastHashJoin" not in _plan(found) and "SortMergeJoin" in _plan(found)


def test_tables_of_some_thousand_rows_are_not_broadcast(spark):
    pairs = session.cut_apart(spark.range(2000).selectExpr("id AS src", "xxhash64(id) AS dst", "id % 7 AS x"))
    asked = spark.range(1 << 20).selectExpr("id AS src", "xxhash64(id) AS dst")
    joined = asked.join(pairs, ["src", "dst"])
    assert joined.count() == 2000
    assert "BroadcastHashJoin" not in _plan(joined) and "SortMergeJoin" in _plan(joined)
