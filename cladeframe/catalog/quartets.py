"""Quartet statistics, scores, evidence tables and support values."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.catalog.common import (CELLS, EDGES, FRAMES, LEAF_COUNT, LOCI, ORDER_CELLS, REACH, WORDS, edges, frame_quartets,
                                       loci, nearest_sql, rounded, tidy, with_, words)
from cladeframe.functions import evidence, quartet, scorers
from cladeframe.functions.encode import WORD
from cladeframe.operators import moves, quartets, sites
from cladeframe.session import cut_apart as cut
from cladeframe.sources import tables

KEY = quartets.KEY
X = ["x0", "x1", "x2", "x3"]


def _columns(names):
    return [F.col(name) for name in names]


def _distinct(rows):
    return rows.select(*quartets.canonical(*_columns(X))).distinct()


def _supplier_quartets(spark, folder, k):
    _, rows, _ = frame_quartets(spark, folder, k)
    return cut(_distinct(rows)), cut(words(spark, folder))


def quartet_hist256(spark, folder):
    return tidy(quartets.pattern_histogram(*_supplier_quartets(spark, folder, 2), WORDS))


def block_histogram(spark, folder):
    listed, _ = _supplier_quartets(spark, folder, 1)
    cells = tables.supplier_cells(spark, folder).withColumn("taxon", F.col("taxon").cast("long"))
    return tidy(quartets.block_histogram(listed, cells, 4))


def quartet_orbits15(spark, folder):
    counts = quartets.orbit_counts(*_supplier_quartets(spark, folder, 2), WORDS)
    return tidy(quartets.orbit_rows(counts).where("n > 0").select(*KEY, "orbit", "n"))


def _region_quartets(spark, folder):
    """All quartets of regions, by growing increasing chains."""
    region = tables.read(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("r"))
    rows = region.select(F.col("r").alias("q0"))
    for i in range(1, 4):
        rows = rows.join(region.select(F.col("r").alias(f"q{i}")), F.col(f"q{i}") > F.col(f"q{i - 1}"))
    return rows


def _order_words(spark, folder):
    return sites.words_of_cells(tables.order_cells(spark, folder)).withColumn("taxon", F.col("taxon").cast("long"))


def _order_count(spark, folder):
    last = tables.read(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0]
    return last // WORD + 1


def _order_orbits(spark, folder):
    return quartets.orbit_counts(_region_quartets(spark, folder), cut(_order_words(spark, folder)),
                                 _order_count(spark, folder), loci(spark, folder))


def locus_orbits(spark, folder):
    rows = quartets.orbit_rows(_order_orbits(spark, folder)).where("n > 0")
    return tidy(rows.select(*KEY, "locus", "orbit", "n"))


def locus_barycenter(spark, folder):
    rows = quartets.barycenter(_order_orbits(spark, folder))
    return rounded(tidy(rows), *[f"x{o}" for o in quartet.ORBITS])


def _kernel(spark, folder, k=2):
    listed, planes = _supplier_quartets(spark, folder, k)
    features = quartets.all_barycenters(listed, planes, WORDS)
    return scorers.kernel_scores(features, scorers.default_kernel(spark))


def kernel_scores(spark, folder):
    return rounded(tidy(_kernel(spark, folder)), "s0", "s1", "s2")


def _network(spark, folder, k=2):
    listed, planes = _supplier_quartets(spark, folder, k)
    return scorers.network_scores(listed, quartets.pattern_histogram(listed, planes, WORDS), scorers.default_layers(spark))


def network_scores(spark, folder):
    return rounded(tidy(_network(spark, folder)), "s0", "s1", "s2")


def _mapped(spark, folder):
    """Frame quartets with scores in group order: t0 = ab|cd, t1 = ac|bd, t2 = ad|bc."""
    _, rows, _ = frame_quartets(spark, folder, 2)
    rows = cut(rows)
    planes = cut(words(spark, folder))
    listed = _distinct(rows)
    scored = scorers.kernel_scores(quartets.all_barycenters(listed, planes, WORDS), scorers.default_kernel(spark))
    keyed = rows.select("u", "v", *X, *quartets.canonical(*_columns(X)))
    joined = keyed.join(scored, KEY)
    mapped = quartet.group_order_scores(*_columns(X), F.array("s0", "s1", "s2"))
    return joined.select("u", "v", *X, *[m.alias(f"t{i}") for i, m in enumerate(mapped)])


def class_remap(spark, folder):
    return rounded(tidy(_mapped(spark, folder)), "t0", "t1", "t2")


def edge_quartet_mean(spark, folder):
    return rounded(tidy(quartets.edge_means(_mapped(spark, folder))), "t0", "t1", "t2", digits=5)


def nni_best(spark, folder):
    """Best topology per edge with its margin, ties to the last and to the first class."""
    rows = quartets.edge_means(_mapped(spark, folder))
    t = [F.round(f"t{i}", 4) for i in range(3)]
    return tidy(rows.select("u", "v", moves.argmax_last(t).alias("best_last"), moves.argmax_first(t).alias("best_first"),
                            F.round(F.greatest(*t) - t[0], 4).alias("margin")))


def log_opinion_pool(spark, folder):
    rows = scorers.pooled(["u", "v"], _mapped(spark, folder), ["t0", "t1", "t2"], log_opinion=True)
    return rounded(tidy(rows), "t0", "t1", "t2", digits=5)


def _evidence(spark, folder):
    """Known evidence (one leaf per group) and proposals (two per group)."""
    scored = cut(_kernel(spark, folder))
    _, rows, _ = frame_quartets(spark, folder, 1)
    known = scored.join(_distinct(rows), KEY, "left_semi")
    return known, scored


def new_quartets(spark, folder):
    known, proposed = _evidence(spark, folder)
    return tidy(quartets.missing_quartets(proposed, known))


def evidence_merge(spark, folder):
    known, proposed = _evidence(spark, folder)
    added = proposed.join(known, KEY, "left_anti")
    return rounded(tidy(quartets.merge_evidence(known, added)), "s0", "s1", "s2")


def _classified(spark, folder):
    """Scored quartets with their topology in the supplier tree."""
    from cladeframe.operators import ancestry, trees
    n = tables.supplier_count(spark, folder)
    tree = cut(edges(spark, folder))
    known, proposed = _evidence(spark, folder)
    merged = cut(quartets.merge_evidence(known, proposed.join(known, KEY, "left_anti")))
    places = ancestry.ancestry(tree, n)
    return tree, n, ancestry.discriminate(ancestry.classify(merged, places), trees.frames(tree, n), places)


def streamsum_gains(spark, folder):
    return rounded(tidy(quartets.stream_gains(_classified(spark, folder)[2])), "gain1", "gain2", digits=5)


def evidence_totals(spark, folder):
    rows = quartets.evidence_totals(_classified(spark, folder)[2])
    return rounded(tidy(rows), "objective", "new_objective", "magnitude", digits=4)


def species_support(spark, folder):
    tree, n, found = _classified(spark, folder)
    inner = tree.where((F.col("u") >= n) & (F.col("v") >= n))
    rows = quartets.species_support(inner, found)
    return rounded(tidy(rows), "vote0", "vote1", "vote2", "margin", "value", digits=5)


def gene_support(spark, folder):
    """Local weights from per-edge score sums."""
    gains = quartets.stream_gains(_classified(spark, folder)[2])
    rows = gains.select("u", "v", F.lit(0.0).alias("base"), F.col("gain1").alias("delta1"), F.col("gain2").alias("delta2"))
    return rounded(tidy(quartets.gene_support(rows)), "value", "weight0", "weight1", "weight2", "gap", digits=5)


def margin_index(spark, folder):
    """Display value of every account balance read as a margin."""
    rows = tables.read(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), evidence.margin_index(F.col("c_acctbal") / 1000).alias("value"))
    return rounded(rows, "value")


def informative_quartets(spark, folder):
    """Winners and votes of scored quartets; coarse scores make real ties."""
    scored = rounded(_kernel(spark, folder), "s0", "s1", "s2", digits=1)
    w = evidence.winners([F.col(f"s{i}") for i in range(3)])
    rows = scored.select(*KEY, *[c.alias(f"win{i}") for i, c in enumerate(w)])
    return tidy(rows.withColumn("informative", F.col("win0") + F.col("win1") + F.col("win2") < 3))


QUERIES = {f.__name__: f for f in (
    quartet_hist256, block_histogram, quartet_orbits15, locus_orbits, locus_barycenter, kernel_scores, network_scores,
    class_remap, edge_quartet_mean, nni_best, log_opinion_pool, new_quartets, evidence_merge, streamsum_gains,
    evidence_totals, species_support, gene_support, margin_index, informative_quartets)}


def _panel(k: int, out: str = "panel") -> str:
    return f"""
{out} AS MATERIALIZED (SELECT f.u, f.v, w.leaf AS x0, x.leaf AS x1, y.leaf AS x2, z.leaf AS x3 FROM frame f
  JOIN nearest w ON w.src = f.u AND w.dst = f.a AND w.r <= {k} JOIN nearest x ON x.src = f.u AND x.dst = f.b AND x.r <= {k}
  JOIN nearest y ON y.src = f.v AND y.dst = f.c AND y.r <= {k} JOIN nearest z ON z.src = f.v AND z.dst = f.d AND z.r <= {k}),
{out}_q AS (SELECT DISTINCT list_sort([x0, x1, x2, x3]) AS q FROM {out})"""


def _quartets(k: int) -> list[str]:
    return [CELLS, EDGES, LEAF_COUNT, FRAMES, REACH, nearest_sql(k), _panel(k),
            "quartet AS MATERIALIZED (SELECT q[1] AS q0, q[2] AS q1, q[3] AS q2, q[4] AS q3 FROM panel_q)"]


def joint_sites(obs: str) -> str:
    """Jointly observed sites, one materialised join per taxon."""
    return f"""
seen AS MATERIALIZED (SELECT taxon, site, state FROM {obs}),
joint1 AS MATERIALIZED (SELECT q0, q1, q2, q3, site, state AS s0 FROM quartet JOIN seen ON taxon = q0),
joint2 AS MATERIALIZED (SELECT j.*, o.state AS s1 FROM joint1 j JOIN seen o ON o.taxon = q1 AND o.site = j.site),
joint3 AS MATERIALIZED (SELECT j.*, o.state AS s2 FROM joint2 j JOIN seen o ON o.taxon = q2 AND o.site = j.site),
joint AS MATERIALIZED (SELECT j.*, o.state AS s3 FROM joint3 j JOIN seen o ON o.taxon = q3 AND o.site = j.site)"""


_ORBIT = """
orbited AS (SELECT *, '0' || CASE WHEN s1 = s0 THEN '0' ELSE '1' END
  || CASE WHEN s2 = s0 THEN '0' WHEN s2 = s1 THEN '1' WHEN s1 = s0 THEN '1' ELSE '2' END
  || CASE WHEN s3 = s0 THEN '0' WHEN s3 = s1 THEN '1' WHEN s3 = s2 THEN (CASE WHEN s1 = s0 THEN '1' ELSE '2' END)
          ELSE CAST(len(list_distinct([s0, s1, s2])) AS VARCHAR) END AS orbit FROM joint)"""


def _barycenter(locus: str) -> str:
    return f"""
counted AS (SELECT q0, q1, q2, q3, {locus} AS locus, orbit, count(*) AS n FROM orbited GROUP BY ALL),
mass AS (SELECT q0, q1, q2, q3, locus, sum(n) AS m FROM counted WHERE orbit <> '0000' GROUP BY ALL),
root AS (SELECT q0, q1, q2, q3, orbit, sum(sqrt(n / m::DOUBLE)) AS r FROM counted JOIN mass USING (q0, q1, q2, q3, locus)
         WHERE orbit <> '0000' GROUP BY ALL),
norm AS (SELECT q0, q1, q2, q3, sqrt(sum(r * r)) AS l FROM root GROUP BY ALL),
feature AS (SELECT q0, q1, q2, q3, orbit, r / l AS x FROM root JOIN norm USING (q0, q1, q2, q3))"""


def _wide(prefix: str = "x", digits: int = 6) -> str:
    return ", ".join(
        f"round(coalesce(max(CASE WHEN orbit = '{o}' THEN x END), 0.0), {digits}) AS {prefix}{o}" for o in quartet.ORBITS)


def _kernel_sql() -> str:
    """Kernel scores over ``feature``: expanded landmarks as rows (m, topology, orbit, z)."""
    def unit(orbit):
        return [1.0 if o == orbit else 0.0 for o in quartet.ORBITS]

    marks = [(unit("0011"), 1.0), (unit("0101"), -0.25), ([0.0] + [14 ** -0.5] * 14, 0.25)]
    rows, heads = [], []
    for m, (z, w) in enumerate(marks):
        for g, order in enumerate(quartet.within_split_orders()):
            moved = [z[i] for i in quartet.reordered(order)]
            heads.append(f"({m * 8 + g}, {w / 8!r}::DOUBLE)")
            for t in range(3):
                read = quartet.reordered(quartet.ORDERS[t])
                rows += [f"({m * 8 + g}, {t}, '{quartet.ORBITS[read[i]]}', {moved[i]!r}::DOUBLE)" for i in range(15)]
    return f"""
landmark(m, w) AS (VALUES {', '.join(heads)}),
lz(m, t, orbit, z) AS (VALUES {', '.join(rows)}),
every AS (SELECT q0, q1, q2, q3, m, t, lz.orbit, z FROM quartet CROSS JOIN lz),
gap AS (SELECT q0, q1, q2, q3, m, t, sum((coalesce(x, 0) - z) * (coalesce(x, 0) - z)) AS d2
        FROM every LEFT JOIN feature USING (q0, q1, q2, q3, orbit) GROUP BY ALL),
kern AS (SELECT q0, q1, q2, q3, t, sum(w * exp(-d2 / (2 * {scorers.BANDWIDTH ** 2!r}::DOUBLE))) AS s FROM gap JOIN landmark USING (m) GROUP BY ALL),
score AS MATERIALIZED (SELECT q0, q1, q2, q3, max(CASE WHEN t = 0 THEN s END) AS s0, max(CASE WHEN t = 1 THEN s END) AS s1,
                 max(CASE WHEN t = 2 THEN s END) AS s2 FROM kern GROUP BY ALL)"""


def network_ctes() -> str:
    """Class probabilities of the default network over ``quartet`` and ``joint``, as exponentials e0, e1, e2."""
    return """
support AS (SELECT q0, q1, q2, q3, count(*) AS n, sum((s0 = s1 AND s2 = s3 AND s0 <> s2)::INT) / count(*)::DOUBLE AS f0,
  sum((s0 = s2 AND s1 = s3 AND s0 <> s1)::INT) / count(*)::DOUBLE AS f1,
  sum((s0 = s3 AND s1 = s2 AND s0 <> s1)::INT) / count(*)::DOUBLE AS f2 FROM joint GROUP BY ALL),
ex AS (SELECT quartet.*, exp(40 * coalesce(f0, 0)) AS e0, exp(40 * coalesce(f1, 0)) AS e1, exp(40 * coalesce(f2, 0)) AS e2
       FROM quartet LEFT JOIN support USING (q0, q1, q2, q3))"""


_SCORED = [*_quartets(2), joint_sites("obs"), _ORBIT, _barycenter("0"), _kernel_sql()]


def _rank(x: str) -> str:
    return "(" + " + ".join(f"({x} > {o})::INT" for o in ("x0", "x1", "x2", "x3")) + ")"


def class_score(y: str) -> str:
    low, high = f"least({_rank('x0')}, {_rank(y)})", f"greatest({_rank('x0')}, {_rank(y)})"
    return (f"CASE ({low}) * 10 + {high} WHEN 1 THEN s0 WHEN 23 THEN s0 WHEN 2 THEN s1 WHEN 13 THEN s1 ELSE s2 END")


_MAPPED = f"""
mapped AS (SELECT u, v, x0, x1, x2, x3, {class_score('x1')} AS t0, {class_score('x2')} AS t1, {class_score('x3')} AS t2
  FROM panel JOIN score ON [q0, q1, q2, q3] = list_sort([x0, x1, x2, x3]))"""
_MERGED = _panel(1, "first") + """,
merged AS MATERIALIZED (SELECT q0, q1, q2, q3, s0, s1, s2, [q0, q1, q2, q3] NOT IN (SELECT q FROM first_q) AS is_new FROM score),
slot AS (SELECT u, v, 0 AS g, u AS e, a AS x FROM frame UNION ALL SELECT u, v, 1, u, b FROM frame
         UNION ALL SELECT u, v, 2, v, c FROM frame UNION ALL SELECT u, v, 3, v, d FROM frame),
member AS MATERIALIZED (SELECT u, v, g, leaf FROM slot JOIN reach ON src = e AND dst = x),
spot1 AS MATERIALIZED (SELECT merged.*, u, v, g AS g0 FROM merged JOIN member ON leaf = q0),
spot2 AS MATERIALIZED (SELECT s.*, m.g AS g1 FROM spot1 s JOIN member m ON m.leaf = q1 AND m.u = s.u AND m.v = s.v WHERE m.g <> g0),
spot3 AS MATERIALIZED (SELECT s.*, m.g AS g2 FROM spot2 s JOIN member m ON m.leaf = q2 AND m.u = s.u AND m.v = s.v WHERE m.g <> g0 AND m.g <> g1),
spot AS MATERIALIZED (SELECT s.*, m.g AS g3 FROM spot3 s JOIN member m ON m.leaf = q3 AND m.u = s.u AND m.v = s.v
  WHERE m.g <> g0 AND m.g <> g1 AND m.g <> g2),
placed AS (SELECT *, CASE WHEN g0 // 2 = g1 // 2 THEN 0 WHEN g0 // 2 = g2 // 2 THEN 1 ELSE 2 END AS cls,
  CASE WHEN g1 = (g0 + 2) % 4 THEN 0 WHEN g2 = (g0 + 2) % 4 THEN 1 ELSE 2 END AS alt1 FROM spot),
voted AS (SELECT *, [s0, s1, s2][cls + 1] AS w0, [s0, s1, s2][alt1 + 1] AS w1, [s0, s1, s2][4 - cls - alt1] AS w2 FROM placed),
gains AS (SELECT u, v, sum(w1 - w0) AS gain1, sum(w2 - w0) AS gain2, count(*) AS active FROM voted GROUP BY u, v)"""
_CLASSIFIED = [*_SCORED, _MERGED]

ORACLES = {
    "quartet_hist256": with_(*_quartets(2), joint_sites("obs"), recursive=True) + """
SELECT q0, q1, q2, q3, ((s0 * 4 + s1) * 4 + s2) * 4 + s3 AS pattern, count(*) AS n FROM joint GROUP BY ALL""",
    "block_histogram": with_(*_quartets(1), joint_sites("obs"), recursive=True) + """
SELECT q0, q1, q2, q3, site % 4 AS block, ((s0 * 4 + s1) * 4 + s2) * 4 + s3 AS pattern, count(*) AS n FROM joint GROUP BY ALL""",
    "quartet_orbits15": with_(*_quartets(2), joint_sites("obs"), _ORBIT, recursive=True) + """
SELECT q0, q1, q2, q3, orbit, count(*) AS n FROM orbited GROUP BY ALL""",
    "kernel_scores": with_(*_SCORED, recursive=True) + "SELECT q0, q1, q2, q3, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM score",
    "network_scores": with_(*_quartets(2), joint_sites("obs"), network_ctes(), recursive=True) + """
SELECT q0, q1, q2, q3, round(e0 / (e0 + e1 + e2), 6) AS s0, round(e1 / (e0 + e1 + e2), 6) AS s1, round(e2 / (e0 + e1 + e2), 6) AS s2 FROM ex""",
    "class_remap": with_(*_SCORED, _MAPPED, recursive=True) + "SELECT u, v, x0, x1, x2, x3, round(t0, 6) AS t0, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM mapped",
    "edge_quartet_mean": with_(*_SCORED, _MAPPED, recursive=True) + """
SELECT u, v, count(*) AS quartets, round(avg(t0), 5) AS t0, round(avg(t1), 5) AS t1, round(avg(t2), 5) AS t2 FROM mapped GROUP BY u, v""",
    "nni_best": with_(*_SCORED, _MAPPED, """
mean AS (SELECT u, v, round(avg(t0), 4) AS t0, round(avg(t1), 4) AS t1, round(avg(t2), 4) AS t2 FROM mapped GROUP BY u, v)""", recursive=True) + """
SELECT u, v, CAST(CASE WHEN t2 >= t1 AND t2 >= t0 THEN 2 WHEN t1 >= t0 THEN 1 ELSE 0 END AS BIGINT) AS best_last,
  CAST(CASE WHEN t0 >= t1 AND t0 >= t2 THEN 0 WHEN t1 >= t2 THEN 1 ELSE 2 END AS BIGINT) AS best_first,
  round(greatest(t0, t1, t2) - t0, 4) AS margin FROM mean""",
    "log_opinion_pool": with_(*_SCORED, _MAPPED, """
pool AS (SELECT u, v, avg(ln(least(greatest(t0, 1e-8::DOUBLE), 1.0::DOUBLE))) AS a, avg(ln(least(greatest(t1, 1e-8::DOUBLE), 1.0::DOUBLE))) AS b,
  avg(ln(least(greatest(t2, 1e-8::DOUBLE), 1.0::DOUBLE))) AS c FROM mapped GROUP BY u, v)""", recursive=True) + """
SELECT u, v, round(exp(a) / (exp(a) + exp(b) + exp(c)), 5) AS t0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 5) AS t1,
  round(exp(c) / (exp(a) + exp(b) + exp(c)), 5) AS t2 FROM pool""",
    "new_quartets": with_(*_CLASSIFIED, recursive=True) + "SELECT q0, q1, q2, q3 FROM merged WHERE is_new",
    "evidence_merge": with_(*_CLASSIFIED, recursive=True) + "SELECT q0, q1, q2, q3, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, is_new FROM merged",
    "streamsum_gains": with_(*_CLASSIFIED, recursive=True) + "SELECT u, v, round(gain1, 5) AS gain1, round(gain2, 5) AS gain2, active FROM gains",
    "evidence_totals": with_(*_CLASSIFIED, recursive=True) + """
SELECT round(sum(w0), 4) AS objective, round(coalesce(sum(CASE WHEN is_new THEN w0 END), 0), 4) AS new_objective,
  count(*) AS active, round(sum(greatest(abs(s0), abs(s1), abs(s2))), 4) AS magnitude FROM voted""",
    "species_support": with_(*_CLASSIFIED, """
won AS (SELECT *, (m - w0 <= tol)::INT AS h0, (m - w1 <= tol)::INT AS h1, (m - w2 <= tol)::INT AS h2 FROM (
  SELECT *, greatest(w0, w1, w2) AS m, 64 * pow(2, -52) * greatest(1, abs(w0), abs(w1), abs(w2)) AS tol FROM voted)),
tallied AS (SELECT *, h0 + h1 + h2 AS k FROM won),
summed AS (SELECT u, v, count(*) AS active, count(CASE WHEN k < 3 THEN 1 END) AS informative, count(CASE WHEN k = 2 THEN 1 END) AS ties,
  sum(CASE WHEN k < 3 THEN h0 / k::DOUBLE ELSE 0 END) AS v0, sum(CASE WHEN k < 3 THEN h1 / k::DOUBLE ELSE 0 END) AS v1,
  sum(CASE WHEN k < 3 THEN h2 / k::DOUBLE ELSE 0 END) AS v2, avg(CASE WHEN k < 3 THEN w0 - greatest(w1, w2) END) AS margin
  FROM tallied GROUP BY u, v)""", recursive=True) + """
SELECT u, v, coalesce(active, 0) AS active, coalesce(informative, 0) AS informative, coalesce(ties, 0) AS ties,
  CASE WHEN informative > 0 THEN round(v0 / informative, 5) END AS vote0, CASE WHEN informative > 0 THEN round(v1 / informative, 5) END AS vote1,
  CASE WHEN informative > 0 THEN round(v2 / informative, 5) END AS vote2, round(margin, 5) AS margin,
  round(CASE WHEN margin >= 0 THEN 100 - 50 / (1 + abs(margin)) ELSE 50 / (1 + abs(margin)) END, 5) AS value
FROM frame LEFT JOIN summed USING (u, v)""",
    "gene_support": with_(*_CLASSIFIED, """
soft AS (SELECT u, v, exp(0 - greatest(0, gain1, gain2)) AS e0, exp(gain1 - greatest(0, gain1, gain2)) AS e1,
  exp(gain2 - greatest(0, gain1, gain2)) AS e2, 0 - greatest(gain1, gain2) AS gap FROM gains)""", recursive=True) + """
SELECT u, v, round(100 * e0 / (e0 + e1 + e2), 5) AS value, round(e0 / (e0 + e1 + e2), 5) AS weight0,
  round(e1 / (e0 + e1 + e2), 5) AS weight1, round(e2 / (e0 + e1 + e2), 5) AS weight2, round(gap, 5) AS gap FROM soft""",
    "margin_index": """
SELECT CAST(c_custkey AS BIGINT) AS id, round(CASE WHEN c_acctbal >= 0 THEN 100 - 50 / (abs(c_acctbal / 1000) + 1)
  ELSE 50 / (abs(c_acctbal / 1000) + 1) END, 6) AS value FROM customer""",
    "informative_quartets": with_(*_SCORED, """
coarse AS (SELECT q0, q1, q2, q3, round(max(CASE WHEN t = 0 THEN s END), 1) AS s0, round(max(CASE WHEN t = 1 THEN s END), 1) AS s1,
           round(max(CASE WHEN t = 2 THEN s END), 1) AS s2 FROM kern GROUP BY ALL),
win AS (SELECT q0, q1, q2, q3, (s0 >= greatest(s1, s2))::BIGINT AS win0, (s1 >= greatest(s0, s2))::BIGINT AS win1,
               (s2 >= greatest(s0, s1))::BIGINT AS win2 FROM coarse)""", recursive=True) + """
SELECT q0, q1, q2, q3, win0, win1, win2, win0 + win1 + win2 < 3 AS informative FROM win""",
}
_REGIONS = """
quartet AS (SELECT CAST(a.r_regionkey AS BIGINT) AS q0, CAST(b.r_regionkey AS BIGINT) AS q1, CAST(c.r_regionkey AS BIGINT) AS q2,
  CAST(d.r_regionkey AS BIGINT) AS q3 FROM region a JOIN region b ON b.r_regionkey > a.r_regionkey
  JOIN region c ON c.r_regionkey > b.r_regionkey JOIN region d ON d.r_regionkey > c.r_regionkey)"""
_BY_LOCUS = [ORDER_CELLS, LOCI, _REGIONS, joint_sites("oobs"), _ORBIT.replace("FROM joint", "FROM joint JOIN locus ON site >= stop - len AND site < stop")]
ORACLES["locus_orbits"] = with_(*_BY_LOCUS) + "SELECT q0, q1, q2, q3, locus, orbit, count(*) AS n FROM orbited GROUP BY ALL"
ORACLES["locus_barycenter"] = with_(*_BY_LOCUS, _barycenter("locus")) + f"""
SELECT q0, q1, q2, q3, {_wide()} FROM feature GROUP BY ALL"""
