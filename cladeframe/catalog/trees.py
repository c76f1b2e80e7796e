"""Tree structure, rearrangements and comparisons on the supplier tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.catalog.common import EDGES, FRAMES, LEAF_COUNT, REACH, edges, nearest_sql, tidy, with_
from cladeframe.operators import ancestry, moves, trees
from cladeframe.session import cut_apart as cut
from cladeframe.sources import tables

# The operators take a set of taxa to keep or to anchor; here it is the suppliers in credit.
KEPT = "s_acctbal > 0"


def tree_validate(spark, folder):
    return tidy(trees.degree_report(edges(spark, folder), tables.supplier_count(spark, folder)))


def tree_components(spark, folder):
    """Components of the tree without its middle edges, by label propagation."""
    n = tables.supplier_count(spark, folder)
    parts = edges(spark, folder).where(~((F.col("u") >= n) & (F.col("v") >= n) & (F.col("v") < n + 14)))
    count = trees.component_count(parts)
    return parts.agg(F.count("*").alias("edges")).withColumn("components", F.lit(count).cast("long"))


def tree_depth(spark, folder):
    rows = trees.rooted(edges(spark, folder), tables.supplier_count(spark, folder))
    return tidy(rows.select("node", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", "tips"))


def tree_splits(spark, folder):
    n = tables.supplier_count(spark, folder)
    return tidy(trees.split_members(trees.rooted(edges(spark, folder), n), n))


def _names(spark, folder):
    return tables.read(spark, folder, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))


def _keys(spark, folder, tree):
    n = tables.supplier_count(spark, folder)
    return trees.split_keys(trees.rooted(tree, n), _names(spark, folder), n)


def split_fingerprints(spark, folder):
    return tidy(_keys(spark, folder, edges(spark, folder)))


def nni_frames(spark, folder):
    return tidy(trees.frames(edges(spark, folder), tables.supplier_count(spark, folder)))


def _moves(spark, folder, tree):
    """Interchanges on left-child edges of every third level; these never touch."""
    n = tables.supplier_count(spark, folder)
    place = F.col("u") - n + 2
    level = F.floor(F.log2(place.cast("double")))
    chosen = trees.frames(tree, n).where((F.col("v") - n + 2 == 2 * place) & (level % 3 == 1))
    return chosen.withColumn("choice", 1 + F.col("u") % 2)


def _moved(spark, folder):
    tree = cut(edges(spark, folder))
    return cut(moves.apply_interchanges(tree, cut(_moves(spark, folder, tree))))


def apply_nni(spark, folder):
    return tidy(_moved(spark, folder))


def rf_distance(spark, folder):
    first, second = _keys(spark, folder, edges(spark, folder)), _keys(spark, folder, _moved(spark, folder))
    return tidy(trees.compare_splits(first, second).withColumn("nrf", F.round("nrf", 6)))


def split_matches(spark, folder):
    """Splits of either tree with the trees that hold them."""
    first, second = _keys(spark, folder, edges(spark, folder)), _keys(spark, folder, _moved(spark, folder))
    key = ["side", "h1", "h2"]
    joined = first.select(*key, F.col("node").alias("node_a")).join(second.select(*key, F.col("node").alias("node_b")), key, "full")
    return tidy(joined.na.fill(-1, ["node_a", "node_b"]))


def topology_key(spark, folder):
    return tidy(trees.topology_key(_keys(spark, folder, edges(spark, folder))))


def nearest_leaves(spark, folder):
    near = trees.nearest_leaves(edges(spark, folder), tables.supplier_count(spark, folder), 4)
    return tidy(near.select("src", "dst", F.posexplode("near").alias("r", "s")).select(
        "src", "dst", (F.col("r") + 1).alias("r"), "s.d", "s.leaf"))


def _panel(spark, folder, size):
    n = tables.supplier_count(spark, folder)
    tree = cut(edges(spark, folder))
    near = trees.nearest_leaves(tree, n, size)
    return trees.round_robin_panel(trees.frame_lists(trees.frames(tree, n), near), size)


def nearest24_panel(spark, folder):
    groups = F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"l{x}").alias("items")) for g, x in enumerate("abcd")])
    rows = _panel(spark, folder, 24).select("u", "v", F.explode(groups).alias("_g"))
    return tidy(rows.select("u", "v", "_g.grp", F.explode("_g.items").alias("_i")).select("u", "v", "grp", "_i.leaf"))


def quartet_topology(spark, folder):
    """Quartets around the edges of one tree, classified in the rearranged tree."""
    from cladeframe.operators.quartets import canonical
    n = tables.supplier_count(spark, folder)
    tree = cut(edges(spark, folder))
    rows = trees.explode_lists(trees.frame_lists(trees.frames(tree, n), trees.nearest_leaves(tree, n, 2)))
    quartets = rows.select(*canonical(*[F.col(f"x{i}") for i in range(4)])).distinct()
    other = _moved(spark, folder)
    places = ancestry.ancestry(other, n)
    found = ancestry.discriminate(ancestry.classify(quartets, places), trees.frames(other, n), places)
    return tidy(found.na.fill(-1, ["u", "v", "alt1"]))


def canonical_edges(spark, folder):
    """The supplier tree with inner nodes numbered by topology alone."""
    n = tables.supplier_count(spark, folder)
    tree = edges(spark, folder)
    return tidy(ancestry.relabelled(tree, ancestry.canonical(tree, n)))


def attach_taxon(spark, folder):
    """One new leaf on the pendant edge of every kept supplier."""
    n = tables.supplier_count(spark, folder)
    kept = tables.read(spark, folder, "supplier").where(KEPT).select(F.col("s_suppkey").alias("u"))
    targets = edges(spark, folder).join(kept, "u", "left_semi").select(
        "u", "v", (F.col("u") + 2 * n).alias("leaf"), (F.col("u") + 3 * n).alias("center"))
    return tidy(trees.subdivide(edges(spark, folder), targets))


def _kept(spark, folder):
    return tables.read(spark, folder, "supplier").where(KEPT).select(F.col("s_suppkey").alias("leaf"))


def induced_subtree(spark, folder):
    return tidy(trees.induced(edges(spark, folder), tables.supplier_count(spark, folder), _kept(spark, folder)))


def backbone_veto(spark, folder):
    n = tables.supplier_count(spark, folder)
    tree = edges(spark, folder)
    return tidy(trees.anchored_frames(trees.frames(tree, n), trees.beyond_counts(tree, n, _kept(spark, folder))))


QUERIES = {f.__name__: f for f in (
    tree_validate, tree_components, tree_depth, tree_splits, split_fingerprints, nni_frames, apply_nni, rf_distance,
    split_matches, topology_key, nearest_leaves, nearest24_panel, quartet_topology, canonical_edges, attach_taxon, induced_subtree,
    backbone_veto)}

_ROOTED = """
walk AS (SELECT CAST(0 AS BIGINT) AS node, CAST(-1 AS BIGINT) AS parent, CAST(0 AS BIGINT) AS depth
  UNION ALL SELECT b.dst, w.node, w.depth + 1 FROM walk w JOIN both_ways b ON b.src = w.node AND b.dst <> w.parent),
below AS (SELECT node AS leaf, node, parent FROM walk CROSS JOIN n_leaf WHERE node < n AND node > 0
  UNION ALL SELECT b.leaf, w.node, w.parent FROM below b JOIN walk w ON w.node = b.parent)"""
_MOVED = """
move AS (SELECT *, 1 + u % 2 AS choice, CASE WHEN u % 2 = 0 THEN c ELSE d END AS x FROM frame, n_leaf
         WHERE v - n + 2 = 2 * (u - n + 2) AND CAST(floor(log2(u - n + 2)) AS BIGINT) % 3 = 1),
gone AS (SELECT least(u, b) AS u, greatest(u, b) AS v FROM move UNION ALL SELECT least(v, x), greatest(v, x) FROM move),
edge2 AS (SELECT u, v FROM edge WHERE (u, v) NOT IN (SELECT (u, v) FROM gone)
          UNION ALL SELECT least(u, x), greatest(u, x) FROM move UNION ALL SELECT least(v, b), greatest(v, b) FROM move)"""
_KEY = """
tip AS (SELECT CAST(s_suppkey AS BIGINT) AS leaf, CAST('0x' || substr(md5(s_name), 1, 10) AS BIGINT) AS t1,
               CAST('0x' || substr(md5(s_name), 11, 10) AS BIGINT) AS t2 FROM supplier)"""


def _second(text: str) -> str:
    """The same CTEs over the rearranged tree."""
    for name in ("both_ways", "walk", "below", "near", "frame", "reach"):
        text = text.replace(f"{name} ", f"{name}2 ")
    return text.replace("FROM edge ", "FROM edge2 ")


_BOTH2 = "both_ways2 AS (SELECT u AS src, v AS dst FROM edge2 UNION ALL SELECT v, u FROM edge2)"


def _keys_sql(below: str, out: str) -> str:
    return f"""
{out} AS (SELECT node, count(*) AS side, CAST(sum(t1) AS BIGINT) AS h1, CAST(sum(t2) AS BIGINT) AS h2
  FROM {below} JOIN tip USING (leaf), n_leaf GROUP BY node HAVING count(*) BETWEEN 2 AND max(n) - 2)"""


_TWO_KEYS = (EDGES, LEAF_COUNT, FRAMES, _MOVED, _BOTH2, _ROOTED, _second(_ROOTED), _KEY,
             _keys_sql("below", "key_a"), _keys_sql("below2", "key_b"))
_KEEP = f"keep AS (SELECT CAST(s_suppkey AS BIGINT) AS leaf FROM supplier WHERE {KEPT})"

ORACLES = {
    "canonical_edges": with_(EDGES, LEAF_COUNT, REACH, """
under AS MATERIALIZED (SELECT src AS parent, dst AS node, min(leaf) AS least FROM reach GROUP BY src, dst),
way AS (SELECT u.node, [u.least] AS path FROM under u WHERE u.parent = 0
  UNION ALL SELECT c.node, list_append(w.path, c.least) FROM way w JOIN under c ON c.parent = w.node
  WHERE c.least <> 0),
label AS MATERIALIZED (SELECT node, CAST(n - 1 + row_number() OVER (ORDER BY path) AS BIGINT) AS label FROM way, n_leaf WHERE node >= n
  UNION ALL SELECT CAST(s_suppkey AS BIGINT), CAST(s_suppkey AS BIGINT) FROM supplier)""", recursive=True) + """
SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v FROM edge JOIN label a ON a.node = u JOIN label b ON b.node = v""",
    "tree_validate": with_(EDGES, LEAF_COUNT, """
deg AS (SELECT src, count(*) AS n_rows, count(DISTINCT dst) AS deg FROM both_ways GROUP BY src)""") + """
SELECT count(*) AS nodes, count(CASE WHEN src < n AND deg = 1 THEN 1 END) AS good_leaves,
  count(CASE WHEN src >= n AND deg = 3 THEN 1 END) AS good_internal, CAST(sum(n_rows - deg) AS BIGINT) AS repeated,
  (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM edge WHERE u >= v) AS unordered FROM deg, n_leaf""",
    "tree_components": with_(EDGES, LEAF_COUNT, """
part AS (SELECT u, v FROM edge, n_leaf WHERE NOT (u >= n AND v >= n AND v < n + 14)),
link2 AS (SELECT u AS a, v AS b FROM part UNION ALL SELECT v, u FROM part),
comp AS (SELECT a AS node, a AS root FROM link2 UNION SELECT b, root FROM comp JOIN link2 ON a = node)""", recursive=True) + """
SELECT (SELECT count(*) FROM part) AS edges, count(DISTINCT low) AS components
FROM (SELECT node, min(root) AS low FROM comp GROUP BY node)""",
    "tree_depth": with_(EDGES, LEAF_COUNT, _ROOTED, recursive=True) + """
SELECT w.node, w.parent, w.depth, CASE WHEN w.node = 0 THEN max(n) ELSE count(b.leaf) END AS tips
FROM walk w LEFT JOIN below b ON b.node = w.node, n_leaf GROUP BY w.node, w.parent, w.depth""",
    "tree_splits": with_(EDGES, LEAF_COUNT, _ROOTED, """
size AS (SELECT node, count(*) AS s FROM below GROUP BY node)""", recursive=True) + """
SELECT node, leaf FROM below JOIN size USING (node), n_leaf WHERE s BETWEEN 2 AND n - 2""",
    "split_fingerprints": with_(EDGES, LEAF_COUNT, _ROOTED, _KEY, _keys_sql("below", "key_a"), recursive=True)
    + "SELECT node, side, h1, h2 FROM key_a",
    "topology_key": with_(EDGES, LEAF_COUNT, _ROOTED, _KEY, _keys_sql("below", "key_a"), f"""
mixed AS (SELECT xor(h1 % {trees.SPREAD_PRIME} * {trees.SPREAD[0]}, h2 % {trees.SPREAD_PRIME} * {trees.SPREAD[1]} + side) AS m FROM key_a)""",
                          recursive=True) + """
SELECT count(*) AS splits, CAST(bit_xor(m) AS BIGINT) AS mix, CAST(sum(m & 1099511627775) AS BIGINT) AS total FROM mixed""",
    "nni_frames": with_(EDGES, LEAF_COUNT, FRAMES) + "SELECT u, v, a, b, c, d FROM frame",
    "apply_nni": with_(EDGES, LEAF_COUNT, FRAMES, _MOVED) + "SELECT u, v FROM edge2",
    "rf_distance": with_(*_TWO_KEYS, recursive=True) + """
SELECT x AS splits_a, y AS splits_b, s AS shared, x + y - 2 * s AS rf, round((x + y - 2 * s) / (x + y)::DOUBLE, 6) AS nrf
FROM (SELECT (SELECT count(*) FROM key_a) AS x, (SELECT count(*) FROM key_b) AS y,
             (SELECT count(*) FROM key_a JOIN key_b USING (side, h1, h2)) AS s)""",
    "split_matches": with_(*_TWO_KEYS, recursive=True) + """
SELECT side, h1, h2, coalesce(a.node, -1) AS node_a, coalesce(b.node, -1) AS node_b
FROM key_a a FULL JOIN key_b b USING (side, h1, h2)""",
    "nearest_leaves": with_(EDGES, LEAF_COUNT, REACH, nearest_sql(4), recursive=True) + "SELECT src, dst, r, d, leaf FROM nearest",
    "nearest24_panel": with_(EDGES, LEAF_COUNT, FRAMES, REACH, nearest_sql(24), """
slots AS (SELECT u, v, 0 AS grp, u AS e, a AS x FROM frame UNION ALL SELECT u, v, 1, u, b FROM frame
          UNION ALL SELECT u, v, 2, v, c FROM frame UNION ALL SELECT u, v, 3, v, d FROM frame),
offered AS (SELECT u, v, grp, leaf, row_number() OVER (PARTITION BY u, v ORDER BY r, grp) AS k
            FROM slots JOIN nearest ON src = e AND dst = x)""", recursive=True) + """
SELECT u, v, CAST(grp AS BIGINT) AS grp, leaf FROM offered WHERE k <= 24""",
    "quartet_topology": with_(EDGES, LEAF_COUNT, FRAMES, _MOVED, _BOTH2, _second(FRAMES), REACH, _second(REACH),
                              nearest_sql(2), """
panel AS MATERIALIZED (SELECT w.leaf AS x0, x.leaf AS x1, y.leaf AS x2, z.leaf AS x3 FROM frame f
  JOIN nearest w ON w.src = f.u AND w.dst = f.a JOIN nearest x ON x.src = f.u AND x.dst = f.b
  JOIN nearest y ON y.src = f.v AND y.dst = f.c JOIN nearest z ON z.src = f.v AND z.dst = f.d),
qt AS (SELECT DISTINCT list_sort([x0, x1, x2, x3]) AS q FROM panel),
quartet AS MATERIALIZED (SELECT q[1] AS q0, q[2] AS q1, q[3] AS q2, q[4] AS q3 FROM qt),
hop AS MATERIALIZED (SELECT src AS x, leaf AS y, d + 1 AS d FROM reach2, n_leaf WHERE src < n),
cls AS (SELECT q0, q1, q2, q3, h01.d + h23.d AS s0, h02.d + h13.d AS s1, h03.d + h12.d AS s2 FROM quartet
  JOIN hop h01 ON h01.x = q0 AND h01.y = q1 JOIN hop h23 ON h23.x = q2 AND h23.y = q3
  JOIN hop h02 ON h02.x = q0 AND h02.y = q2 JOIN hop h13 ON h13.x = q1 AND h13.y = q3
  JOIN hop h03 ON h03.x = q0 AND h03.y = q3 JOIN hop h12 ON h12.x = q1 AND h12.y = q2),
slot2 AS (SELECT u, v, 0 AS g, u AS e, a AS x FROM frame2 UNION ALL SELECT u, v, 1, u, b FROM frame2
          UNION ALL SELECT u, v, 2, v, c FROM frame2 UNION ALL SELECT u, v, 3, v, d FROM frame2),
member AS MATERIALIZED (SELECT u, v, g, leaf FROM slot2 JOIN reach2 ON src = e AND dst = x),
spot1 AS MATERIALIZED (SELECT quartet.*, u, v, g AS g0 FROM quartet JOIN member ON leaf = q0),
spot2 AS MATERIALIZED (SELECT s.*, m.g AS g1 FROM spot1 s JOIN member m ON m.leaf = q1 AND m.u = s.u AND m.v = s.v WHERE m.g <> g0),
spot3 AS MATERIALIZED (SELECT s.*, m.g AS g2 FROM spot2 s JOIN member m ON m.leaf = q2 AND m.u = s.u AND m.v = s.v WHERE m.g <> g0 AND m.g <> g1),
spot AS MATERIALIZED (SELECT s.*, m.g AS g3 FROM spot3 s JOIN member m ON m.leaf = q3 AND m.u = s.u AND m.v = s.v
  WHERE m.g <> g0 AND m.g <> g1 AND m.g <> g2)""", recursive=True) + """
SELECT c.q0, c.q1, c.q2, c.q3, CAST(CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS BIGINT) AS cls,
  coalesce(u, -1) AS u, coalesce(v, -1) AS v,
  CAST(CASE WHEN u IS NULL THEN -1 WHEN g1 = (g0 + 2) % 4 THEN 0 WHEN g2 = (g0 + 2) % 4 THEN 1 ELSE 2 END AS BIGINT) AS alt1
FROM cls c LEFT JOIN spot USING (q0, q1, q2, q3)""",
    "attach_taxon": with_(EDGES, LEAF_COUNT, _KEEP, """
hit AS (SELECT u, v, u + 2 * n AS leaf, u + 3 * n AS center FROM edge, n_leaf WHERE u IN (SELECT leaf FROM keep))""") + """
SELECT u, v FROM edge WHERE (u, v) NOT IN (SELECT (u, v) FROM hit) UNION ALL SELECT least(u, center), greatest(u, center) FROM hit
UNION ALL SELECT least(v, center), greatest(v, center) FROM hit UNION ALL SELECT least(leaf, center), greatest(leaf, center) FROM hit""",
    "induced_subtree": with_(EDGES, LEAF_COUNT, REACH, _KEEP, """
beyond AS (SELECT DISTINCT src, dst FROM reach JOIN keep USING (leaf)),
stay AS (SELECT leaf AS node FROM keep UNION SELECT src FROM beyond GROUP BY src HAVING count(*) >= 3),
trail AS (SELECT s.node AS start, b.dst AS cur, b.src AS prev FROM stay s JOIN beyond b ON b.src = s.node
  UNION ALL SELECT t.start, b.dst, b.src FROM trail t JOIN beyond b ON b.src = t.cur AND b.dst <> t.prev
  WHERE t.cur NOT IN (SELECT node FROM stay))""", recursive=True) + """
SELECT DISTINCT least(start, cur) AS u, greatest(start, cur) AS v FROM trail WHERE cur IN (SELECT node FROM stay)""",
    "backbone_veto": with_(EDGES, LEAF_COUNT, FRAMES, REACH, _KEEP, """
beyond AS (SELECT DISTINCT src, dst FROM reach JOIN keep USING (leaf))""", recursive=True) + """
SELECT u, v, NOT ((u, a) IN (SELECT (src, dst) FROM beyond) AND (u, b) IN (SELECT (src, dst) FROM beyond)
  AND (v, c) IN (SELECT (src, dst) FROM beyond) AND (v, d) IN (SELECT (src, dst) FROM beyond)) AS allowed FROM frame""",
}
