"""Pair statistics, distance corrections, row sums and candidate graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.catalog.common import CELLS, cells, mix_sql, rounded, tidy, with_, words
from cladeframe.functions import distance
from cladeframe.functions.hashing import SEED, column_salt
from cladeframe.operators import candidates, pairs
from cladeframe.session import cut_apart as cut
from cladeframe.sources import tables

ALPHA = 0.7
PROJECTIONS, WINDOW, CAP, TOP, LANDMARKS = 16, 8, 32, 16, 32


def _leaf_ranks(planes):
    z = candidates.project(planes, PROJECTIONS)
    return cut(candidates.rank_projections(z.withColumnRenamed("taxon", "node")))


def _window(spark, folder):
    """Window pairs and the planes they were found on."""
    planes = cut(words(spark, folder))
    return candidates.window_pairs(_leaf_ranks(planes), WINDOW), planes


def projection(spark, folder):
    return tidy(candidates.project(words(spark, folder), PROJECTIONS))


def projection_ranks(spark, folder):
    return tidy(_leaf_ranks(words(spark, folder)))


def projection_window_pairs(spark, folder):
    return tidy(_window(spark, folder)[0])


def pair_moments(spark, folder):
    return tidy(pairs.pair_counts(*_window(spark, folder)))


def _distance(model):
    def query(spark, folder):
        rows = pairs.pair_distances(*_window(spark, folder), model, ALPHA)
        return rounded(tidy(rows.select("i", "j", "distance")), "distance")
    query.__name__ = f"pair_distance_{model}"
    return query


def triplet_counts(spark, folder):
    return tidy(pairs.triplet_counts(words(spark, folder), tables.supplier_count(spark, folder)))


def mixture_distance(spark, folder):
    """Clusters of two suppliers each, compared along the projection order."""
    members = tables.read(spark, folder, "supplier").select(
        F.floor(F.col("s_suppkey") / 2).alias("node"), F.col("s_suppkey").alias("taxon"), F.lit(0.5).alias("mass"))
    chain = members.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).distinct()
    ends = members.select(F.col("node").alias("b")).distinct()
    rows = pairs.mixture_distances(chain.join(ends, "b"), members, words(spark, folder), "k2p_gamma", ALPHA)
    return rounded(tidy(rows), "distance")


def _members(spark, folder):
    return tables.read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("node"), F.col("s_suppkey").alias("taxon"), F.lit(1.0).alias("mass"))


def _controls(spark, folder, n):
    observed = cells(spark, folder).where("state < 4").withColumn("taxon", F.col("taxon").cast("long"))
    return pairs.row_controls(observed, _members(spark, folder), n, tables.SITES)


def row_controls(spark, folder):
    n = tables.supplier_count(spark, folder)
    return rounded(tidy(_controls(spark, folder, n)), "mismatch_row", "transversion_row", "overlap_row")


def _landmark_counts(spark, folder, planes):
    chosen = pairs.pick_landmarks(_members(spark, folder).select("node"), LANDMARKS, SEED)
    return pairs.landmark_counts(planes, chosen)


def landmark_counts(spark, folder):
    return tidy(_landmark_counts(spark, folder, words(spark, folder)))


def _bases(spark, folder, planes):
    n = tables.supplier_count(spark, folder)
    sampled = pairs.raw_coordinates(_landmark_counts(spark, folder, planes), tables.SITES).withColumn(
        "distance", distance.corrected(F.col("n"), F.col("mismatch"), F.col("transversion"), "k2p_gamma", ALPHA))
    rows = pairs.landmark_rows(sampled.withColumnRenamed("taxon", "node"), _controls(spark, folder, n), n,
                               tables.SITES, "k2p_gamma", ALPHA, full=n <= LANDMARKS)
    return rows.withColumn("base", F.round("base", 9)), n


def landmark_rows(spark, folder):
    return rounded(tidy(_bases(spark, folder, words(spark, folder))[0]), "base")


def _scored(spark, folder):
    """Window pairs with distance and the criterion-adjusted candidate score."""
    planes = cut(words(spark, folder))
    base, n = _bases(spark, folder, planes)
    base = cut(base)
    ranks = _leaf_ranks(planes)
    found = pairs.pair_distances(candidates.window_pairs(ranks, WINDOW), planes, "k2p_gamma", ALPHA)
    left = base.select(F.col("node").alias("i"), F.col("base").alias("base_i"))
    right = base.select(F.col("node").alias("j"), F.col("base").alias("base_j"))
    rows = found.join(left, "i").join(right, "j")
    score = F.round(F.col("distance") - (F.col("base_i") + F.col("base_j")) / (n - 2), 9)
    return cut(rows.select("i", "j", F.round("distance", 9).alias("distance"), score.alias("score"),
                           F.col("i").alias("rank_i"), F.col("j").alias("rank_j"))), base, ranks, n


def topk_neighbors(spark, folder):
    return tidy(candidates.top_neighbors(_scored(spark, folder)[0], TOP))


def two_hop_expand(spark, folder):
    scored, _, ranks, _ = _scored(spark, folder)
    near = cut(candidates.top_neighbors(scored, TOP))
    return tidy(candidates.expand_two_hops(near, candidates.path_pairs(ranks)))


def _q(spark, folder):
    scored, base, ranks, n = _scored(spark, folder)
    rows = base.select("node", F.col("base").alias("row"), F.lit(0.0).alias("offset"), F.col("node").alias("rank"))
    kept = candidates.cap_by_owner(scored, rows, candidates.path_pairs(ranks), n, CAP)
    return candidates.q_scores(kept, rows, n).withColumn("q", F.round("q", 6))


def owner_cap(spark, folder):
    scored, base, ranks, n = _scored(spark, folder)
    rows = base.select("node", F.col("base").alias("row"), F.lit(0.0).alias("offset"), F.col("node").alias("rank"))
    return tidy(candidates.cap_by_owner(scored, rows, candidates.path_pairs(ranks), n, 4).select("i", "j"))


def nj_q_scores(spark, folder):
    return tidy(_q(spark, folder).select("left", "right", "q"))


def mutual_minima(spark, folder):
    return tidy(candidates.mutual_minima(cut(_q(spark, folder))).select("left", "right", "q"))


def bounded_merges(spark, folder):
    scored = cut(_q(spark, folder))
    return tidy(candidates.bounded_merges(scored, tables.supplier_count(spark, folder)).select("left", "right", "q"))


QUERIES = {f.__name__: f for f in (
    projection, projection_ranks, projection_window_pairs, pair_moments, *[_distance(m) for m in distance.MODELS],
    triplet_counts, mixture_distance, row_controls, landmark_counts, landmark_rows, topk_neighbors, two_hop_expand,
    owner_cap, nj_q_scores, mutual_minima, bounded_merges)}

_SALTS = "salts AS (SELECT unnest([%s]) AS projection, unnest([%s]) AS salt)" % (
    ", ".join(str(p) for p in range(PROJECTIONS)), ", ".join(str(column_salt(p)) for p in range(PROJECTIONS)))
_PROJECT = ",\n".join([_SALTS, "signed_states AS (SELECT DISTINCT site, state, projection, salt FROM obs, salts)",
                       mix_sql("signed_states", "site * 4 + state + salt", "mixed_states", "site, state, projection"), """
z AS (SELECT taxon, CAST(projection AS BIGINT) AS projection, CAST(sum((mixed & 1) * 2 - 1) AS BIGINT) AS z
      FROM obs JOIN mixed_states USING (site, state) GROUP BY 1, 2)"""])
_WINDOW = f"""
ranked AS (SELECT taxon AS node, projection, row_number() OVER (PARTITION BY projection ORDER BY z, taxon) - 1 AS rank FROM z),
path AS (SELECT least(a.node, b.node) AS i, greatest(a.node, b.node) AS j FROM ranked a JOIN ranked b
         ON a.projection = 0 AND b.projection = 0 AND b.rank = a.rank + 1),
pair AS (SELECT DISTINCT least(a.node, b.node) AS i, greatest(a.node, b.node) AS j FROM ranked a
         JOIN (SELECT unnest(range(1, {WINDOW + 1})) AS k) ON true
         JOIN ranked b ON b.projection = a.projection AND b.rank = a.rank + k)"""


def counts_sql(pair: str, out: str) -> str:
    return f"""
{out}_seen AS (SELECT i, j, count(*) AS n, count(CASE WHEN a.state <> b.state THEN 1 END) AS mismatch,
        count(CASE WHEN (a.state + b.state) % 2 = 1 THEN 1 END) AS transversion
  FROM {pair} JOIN obs a ON a.taxon = i JOIN obs b ON b.taxon = j AND b.site = a.site GROUP BY i, j),
{out} AS (SELECT i, j, coalesce(n, 0) AS n, coalesce(mismatch, 0) AS mismatch, coalesce(transversion, 0) AS transversion
  FROM {pair} LEFT JOIN {out}_seen USING (i, j))"""


def distance_sql(model: str, alpha: float = ALPHA) -> str:
    """SQL of the corrected distance over n, mismatch, transversion."""
    p = "(CASE WHEN n > 0 THEN mismatch / n::DOUBLE ELSE 0.75 END)"
    q = "(CASE WHEN n > 0 THEN transversion / n::DOUBLE ELSE 0.5 END)"
    floor = "(0.5::DOUBLE / (n + 1))"

    def g(f):
        return f"({alpha}::DOUBLE * (exp(least(30.0::DOUBLE, -ln({f}) / {alpha}::DOUBLE)) - 1))"

    identity = f"greatest(1.0::DOUBLE - 4.0::DOUBLE * {p} / 3, {floor})"
    return {
        "raw": p, "jc": f"(-0.75::DOUBLE * ln({identity}))", "jc_gamma": f"(0.75::DOUBLE * {g(identity)})",
        "k2p_gamma": f"(0.5::DOUBLE * {g(f'greatest(1.0::DOUBLE - 2 * {p} + {q}, {floor})')}"
                     f" + 0.25::DOUBLE * {g(f'greatest(1.0::DOUBLE - 2 * {q}, {floor})')})"}[model]


_PAIR = with_(CELLS, _PROJECT, _WINDOW, counts_sql("pair", "counted"))
_ROWS = """
totals AS (SELECT site, state, count(*) AS f FROM obs GROUP BY site, state),
grid AS (SELECT site, coalesce(max(CASE WHEN state = 0 THEN f END), 0) AS t0, coalesce(max(CASE WHEN state = 1 THEN f END), 0) AS t1,
         coalesce(max(CASE WHEN state = 2 THEN f END), 0) AS t2, coalesce(max(CASE WHEN state = 3 THEN f END), 0) AS t3 FROM totals GROUP BY site),
control AS (
  SELECT o.taxon AS node,
    (max(n) - 1) - sum(CASE state WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END - 1) / 512.0::DOUBLE AS mismatch_row,
    sum(CASE WHEN state % 2 = 0 THEN t1 + t3 ELSE t0 + t2 END) / 512.0::DOUBLE AS transversion_row,
    sum(t0 + t1 + t2 + t3 - 1) / 512.0::DOUBLE AS overlap_row
  FROM obs o JOIN grid USING (site), n_taxa GROUP BY o.taxon)"""
_LAND = ",\n".join([
    mix_sql("(SELECT CAST(s_suppkey AS BIGINT) AS node FROM supplier)", f"node * 2 + {SEED}", "node_key", "node"), f"""
landmark AS (SELECT node FROM node_key ORDER BY mixed, node LIMIT {LANDMARKS}),
probe AS (SELECT t.taxon AS i, l.node AS j FROM (SELECT DISTINCT taxon FROM obs) t JOIN landmark l ON t.taxon <> l.node)""",
    counts_sql("probe", "probed")])
_BASE = f"""
sampled AS (SELECT i AS node, {distance_sql('k2p_gamma')} AS d, 1 - (n - mismatch) / 512.0::DOUBLE AS p,
                   transversion / 512.0::DOUBLE AS q, n / 512.0::DOUBLE AS c FROM probed),
means AS (SELECT node, (max(n) - 1) * avg(d) AS sd, (max(n) - 1) * avg(p) AS sp, (max(n) - 1) * avg(q) AS sq, (max(n) - 1) * avg(c) AS sc
          FROM sampled, n_taxa GROUP BY node),
step1 AS (SELECT node, sd, sp, sq, sc, mismatch_row, transversion_row, overlap_row, mismatch_row / (n - 1) AS pbar,
                 transversion_row / (n - 1) AS qbar, overlap_row / (n - 1) AS cov, n FROM means JOIN control USING (node), n_taxa),
step2 AS (SELECT *, CASE WHEN cov > 0 THEN 1 / cov ELSE 0 END AS inv, 0.5::DOUBLE / (512.0::DOUBLE * cov + 1) AS floor FROM step1),
step3 AS (SELECT *, pbar + (pbar - 1) * (inv - 1) AS dp, qbar * inv AS dq FROM step2),
step4 AS (SELECT *, greatest(1 - 2 * dp + dq, floor) AS f1, greatest(1 - 2 * dq, floor) AS f2 FROM step3),
step5 AS (SELECT *,
  CASE WHEN 1 - 2 * dp + dq > floor AND -ln(f1) / {ALPHA} < 30 THEN exp(least(-ln(f1) / {ALPHA}::DOUBLE, 30.0::DOUBLE)) / f1 ELSE 0 END AS bp,
  CASE WHEN 1 - 2 * dq > floor AND -ln(f2) / {ALPHA} < 30 THEN exp(least(-ln(f2) / {ALPHA}::DOUBLE, 30.0::DOUBLE)) / f2 ELSE 0 END AS b2 FROM step4),
base AS (SELECT node, round(CASE WHEN n <= {LANDMARKS} THEN sd ELSE
    sd - bp * inv * (sp - mismatch_row) - 0.5 * (b2 - bp) * inv * (sq - transversion_row)
    - (bp * (1 - pbar) - 0.5 * (b2 - bp) * qbar) * inv * inv * (sc - overlap_row) END, 9) AS base FROM step5)"""
_SCORED = f"""
scored AS (SELECT i, j, round({distance_sql('k2p_gamma')}, 9) AS distance,
             round({distance_sql('k2p_gamma')} - (x.base + y.base) / (m.n_all - 2), 9) AS score
           FROM counted JOIN base x ON x.node = i JOIN base y ON y.node = j, (SELECT n AS n_all FROM n_taxa) m),
owned AS (SELECT i AS owner, j AS other, score, distance FROM scored UNION ALL SELECT j, i, score, distance FROM scored),
top AS (SELECT owner, other, r FROM (SELECT owner, other, row_number() OVER (PARTITION BY owner ORDER BY score, other) AS r FROM owned) WHERE r <= {TOP})"""
_FULL = with_(CELLS, _PROJECT, _WINDOW, counts_sql("pair", "counted"), _ROWS, _LAND, _BASE, _SCORED)


def _capped(cap: int) -> str:
    return f"""
capped AS (SELECT DISTINCT i, j FROM (SELECT least(owner, other) AS i, greatest(owner, other) AS j, row_number() OVER (
    PARTITION BY owner ORDER BY distance - base / (m.n_all - 2), other) AS r
  FROM owned JOIN base ON node = other, (SELECT n AS n_all FROM n_taxa) m) WHERE r <= {cap} UNION SELECT i, j FROM path)"""


_Q = _capped(CAP) + """,
q AS (SELECT i, j, round((m.n_all - 2) * distance - x.base - y.base, 6) AS q FROM scored JOIN capped USING (i, j)
      JOIN base x ON x.node = i JOIN base y ON y.node = j, (SELECT n AS n_all FROM n_taxa) m)"""

ORACLES = {
    "projection": with_(CELLS, _PROJECT) + "SELECT taxon, projection, z FROM z",
    "projection_ranks": with_(CELLS, _PROJECT, _WINDOW) + "SELECT node, projection, rank FROM ranked",
    "projection_window_pairs": with_(CELLS, _PROJECT, _WINDOW) + "SELECT i, j FROM pair",
    "pair_moments": _PAIR + "SELECT i, j, n, mismatch, transversion FROM counted",
    **{f"pair_distance_{m}": _PAIR + f"SELECT i, j, round({distance_sql(m)}, 6) AS distance FROM counted"
       for m in distance.MODELS},
    "triplet_counts": with_(CELLS, """
g AS (SELECT k AS triplet, k * n // 32 AS a, (k * n // 32 + greatest(1, n // 3)) % n AS b, (k * n // 32 + 2 * greatest(1, n // 3)) % n AS c
      FROM (SELECT unnest(range(0, 32)) AS k), n_taxa)""") + """
SELECT triplet, count(z.site) AS sites, count(CASE WHEN x.state = y.state AND z.site IS NOT NULL THEN 1 END) AS ab,
  count(CASE WHEN x.state = z.state THEN 1 END) AS ac, count(CASE WHEN y.state = z.state THEN 1 END) AS bc,
  count(CASE WHEN x.state = y.state AND x.state = z.state THEN 1 END) AS abc
FROM g LEFT JOIN obs x ON x.taxon = a LEFT JOIN obs y ON y.taxon = b AND y.site = x.site
LEFT JOIN obs z ON z.taxon = c AND z.site = x.site AND y.site IS NOT NULL GROUP BY triplet""",
    "mixture_distance": with_(CELLS, """
node_pair AS (SELECT DISTINCT s_suppkey // 2 AS a, s_suppkey // 2 + 1 AS b FROM supplier
         WHERE s_suppkey // 2 + 1 IN (SELECT s_suppkey // 2 FROM supplier)),
rep AS (SELECT a, b, x.s_suppkey AS x, y.s_suppkey AS y FROM node_pair JOIN supplier x ON x.s_suppkey // 2 = a
        JOIN supplier y ON y.s_suppkey // 2 = b),
pair AS (SELECT DISTINCT CAST(least(x, y) AS BIGINT) AS i, CAST(greatest(x, y) AS BIGINT) AS j FROM rep)""",
                              counts_sql("pair", "counted"), f"""
dist AS (SELECT i, j, {distance_sql('k2p_gamma')} AS d FROM counted)""") + """
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(sum(0.25::DOUBLE * d), 6) AS distance
FROM rep JOIN dist ON i = least(x, y) AND j = greatest(x, y) GROUP BY a, b""",
    "row_controls": with_(CELLS, _ROWS) + """
SELECT node, round(mismatch_row, 6) AS mismatch_row, round(transversion_row, 6) AS transversion_row,
  round(overlap_row, 6) AS overlap_row FROM control""",
    "landmark_counts": with_(CELLS, _LAND) + """
SELECT i AS taxon, j AS landmark, n, mismatch, transversion FROM probed""",
    "landmark_rows": with_(CELLS, _ROWS, _LAND, _BASE) + "SELECT node, round(base, 6) AS base FROM base",
    "topk_neighbors": _FULL + "SELECT owner, other, r AS at FROM top",
    "two_hop_expand": _FULL + """
SELECT DISTINCT least(x, y) AS i, greatest(x, y) AS j FROM (
  SELECT owner AS x, other AS y FROM top UNION ALL SELECT s.owner, t.other FROM top s JOIN top t ON t.owner = s.other
  UNION ALL SELECT i, j FROM path) WHERE x <> y""",
    "owner_cap": _FULL.rstrip() + "," + _capped(4) + "\nSELECT i, j FROM scored JOIN capped USING (i, j)",
    "nj_q_scores": _FULL.rstrip() + "," + _Q + '\nSELECT i AS "left", j AS "right", q FROM q',
    "mutual_minima": _FULL.rstrip() + "," + _Q + """,
ends AS (SELECT i AS node, q FROM q UNION ALL SELECT j, q FROM q), best AS (SELECT node, min(q) AS b FROM ends GROUP BY node)
SELECT i AS "left", j AS "right", q FROM q JOIN best x ON x.node = i JOIN best y ON y.node = j WHERE q = x.b AND q = y.b""",
    "bounded_merges": _FULL.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + "," + _Q + """,
ends AS (SELECT i AS node, q FROM q UNION ALL SELECT j, q FROM q), best AS (SELECT node, min(q) AS b FROM ends GROUP BY node),
flagged AS (SELECT i, j, q, q = x.b AND q = y.b AS m FROM q JOIN best x ON x.node = i JOIN best y ON y.node = j),
ord AS MATERIALIZED (SELECT i, j, q, m, row_number() OVER (ORDER BY NOT m, q, i, j) AS r FROM flagged),
goal AS (SELECT n - 3 AS most, least(n - 3, (n + 513) // 514) AS target FROM n_taxa),
pass AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS used
  UNION ALL SELECT o.r, CASE WHEN list_contains(used, i) OR list_contains(used, j) OR len(used) // 2 >= CASE WHEN m THEN most ELSE target END
                        THEN used ELSE list_concat(used, [i, j]) END
  FROM pass JOIN ord o ON o.r = pass.r + 1, goal),
final AS (SELECT used FROM pass ORDER BY r DESC LIMIT 1),
chosen AS (SELECT used[2 * k + 1] AS i, used[2 * k + 2] AS j FROM (SELECT used, unnest(range(0, len(used) // 2)) AS k FROM final))
SELECT i AS "left", j AS "right", q FROM q JOIN chosen USING (i, j)""",
}
