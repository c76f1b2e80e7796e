"""Shared pieces of the named queries: alignments, trees and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.functions import hashing
from cladeframe.functions.encode import WORD
from cladeframe.operators import sites, trees
from cladeframe.session import cut_apart as cut
from cladeframe.sources import tables

WORDS = -(-tables.SITES // WORD)

CELLS = """
n_taxa AS (SELECT CAST(count(*) AS BIGINT) AS n FROM supplier),
hashed AS (
  SELECT CAST(l_suppkey AS BIGINT) AS taxon, CAST(l_partkey % 512 AS BIGINT) AS site,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS h
  FROM lineitem GROUP BY 1, 2),
clades AS (SELECT taxon, site, h, (n + taxon) >> CAST(1 + site % 10 AS BIGINT) AS clade FROM hashed, n_taxa),
cell AS (
  SELECT taxon, site, CAST(CASE WHEN h % 13 = 0 THEN 4 WHEN h % 7 = 0 THEN (site * 7 + h) % 4
         ELSE (clade * 7919 + site * 104729 + clade * site * 17) % 1009 % 4 END AS BIGINT) AS state
  FROM clades),
obs AS (SELECT taxon, site, state FROM cell WHERE state < 4)
"""

ORDER_CELLS = """
ocell_h AS (
  SELECT CAST(n_regionkey AS BIGINT) AS taxon, CAST(l_orderkey AS BIGINT) AS site,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS h
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
ocell AS (
  SELECT taxon, site, CAST(CASE WHEN h % 11 = 0 THEN 4 WHEN h % 5 = 0 THEN (site + h) % 4
         WHEN taxon >= 3 AND site % 3 = 0 THEN (site + 1) % 4
         WHEN taxon >= 2 AND site % 7 = 1 THEN (site + 2) % 4 ELSE site % 4 END AS BIGINT) AS state
  FROM ocell_h),
oobs AS (SELECT taxon, site, state FROM ocell WHERE state < 4)
"""

EDGES = """
heap AS (SELECT unnest([CAST(s_suppkey AS BIGINT) + n, CAST(s_suppkey AS BIGINT)]) AS p, n
         FROM supplier, (SELECT CAST(count(*) AS BIGINT) AS n FROM supplier)),
link AS (SELECT CASE WHEN p >= n THEN p - n ELSE p + n - 2 END AS x,
                CASE WHEN p = 3 THEN n ELSE (p // 2) + n - 2 END AS y FROM heap WHERE p >= 3),
edge AS (SELECT CAST(least(x, y) AS BIGINT) AS u, CAST(greatest(x, y) AS BIGINT) AS v FROM link),
both_ways AS (SELECT u AS src, v AS dst FROM edge UNION ALL SELECT v, u FROM edge)
"""

LOCI = """
locus AS (SELECT CAST(c_custkey AS BIGINT) AS locus,
                 CAST(sum(CAST(c_nationkey + 1 AS BIGINT)) OVER (ORDER BY c_custkey) AS BIGINT) AS stop,
                 CAST(c_nationkey + 1 AS BIGINT) AS len FROM customer)
"""

FRAMES = """
near AS (SELECT src AS node, list(dst ORDER BY dst) AS nb FROM both_ways GROUP BY src),
frame AS MATERIALIZED (
  SELECT u, v, list_filter(nu.nb, lambda t: t <> v)[1] AS a, list_filter(nu.nb, lambda t: t <> v)[2] AS b,
         list_filter(nv.nb, lambda t: t <> u)[1] AS c, list_filter(nv.nb, lambda t: t <> u)[2] AS d
  FROM edge JOIN near nu ON nu.node = u JOIN near nv ON nv.node = v, n_leaf WHERE u >= n AND v >= n)
"""
LEAF_COUNT = "n_leaf AS (SELECT CAST(count(*) AS BIGINT) AS n FROM supplier)"

# Leaves beyond every directed edge, by walking back from each leaf.
REACH = """
reach AS (
  SELECT src, dst, dst AS leaf, CAST(0 AS BIGINT) AS d FROM both_ways CROSS JOIN n_leaf WHERE dst < n
  UNION ALL
  SELECT b.src, b.dst, r.leaf, r.d + 1 FROM reach r JOIN both_ways b ON b.dst = r.src WHERE b.src <> r.dst)
"""


def nearest_sql(k: int) -> str:
    return f"""
ranked_near AS (SELECT src, dst, leaf, d, row_number() OVER (PARTITION BY src, dst ORDER BY d, leaf) AS r FROM reach),
nearest AS MATERIALIZED (SELECT src, dst, leaf, d, CAST(r AS BIGINT) AS r FROM ranked_near WHERE r <= {k})
"""


def mix_sql(source: str, x: str, out: str, keep: str) -> str:
    """CTE chain that applies the 32-bit mix to ``x`` of ``source``."""
    def times(c: int) -> str:
        return f"(((((x >> 16) * {c}) & 65535) * 65536) + (x & 65535) * {c}) & 4294967295"

    steps = ["xor(x, x >> 16)", times(hashing.MIX_FIRST), "xor(x, x >> 15)", times(hashing.MIX_SECOND), "xor(x, x >> 16)"]
    parts = [f"{out}_0 AS (SELECT {keep}, CAST(({x}) & 4294967295 AS BIGINT) AS x FROM {source})"]
    for i, step in enumerate(steps, 1):
        name = out if i == len(steps) else f"{out}_{i}"
        column = "mixed" if i == len(steps) else "x"
        parts.append(f"{name} AS (SELECT {keep}, CAST({step} AS BIGINT) AS {column} FROM {out}_{i - 1})")
    return ",\n".join(parts)


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"


def tidy(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so results compare by value."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[
        F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name) for f in df.schema])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(F.col(name), digits))
    return df


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return tables.supplier_cells(spark, folder)


def words(spark: SparkSession, folder: str) -> DataFrame:
    return sites.words_of_cells(cells(spark, folder)).withColumn("taxon", F.col("taxon").cast("long"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return tables.heap_edges(spark, folder)


def loci(spark: SparkSession, folder: str) -> DataFrame:
    """(locus, start, end) that tile the order alignment."""
    from cladeframe.sources.manifest import boundaries
    return boundaries(tables.locus_lengths(spark, folder))


def frame_quartets(spark: SparkSession, folder: str, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(edges, rows u, v, x0..x3 with one leaf per group, leaf count)."""
    n = tables.supplier_count(spark, folder)
    tree = cut(edges(spark, folder))
    near = trees.nearest_leaves(tree, n, k)
    return tree, trees.explode_lists(trees.frame_lists(trees.frames(tree, n), near)), n
