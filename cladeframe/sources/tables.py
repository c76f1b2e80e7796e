"""Alignments, loci and trees derived from the star-schema tables.

Every relation grows with its tables:

* ``supplier_cells``: suppliers are taxa, parts fold onto 512 sites. Site
  classes carry the clades of the supplier heap tree, so trees can be found.
* ``order_cells``: regions are taxa, every order is a site.
* ``document_sequences``: every document text is read as one sequence row.
* ``heap_edges``: unrooted binary tree whose leaves are the suppliers.
* ``ladder_edges``: the deepest such tree, one supplier after the other.
* ``locus_lengths``: one locus per customer, in key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = 512
LEVELS = 10


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def supplier_count(spark: SparkSession, folder: str) -> int:
    return read(spark, folder, "supplier").count()


def supplier_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(taxon, site, state): one row per supplier and site with any line."""
    n = supplier_count(spark, folder)
    lines = (
        read(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").cast("int").alias("taxon"),
                 (F.col("l_partkey") % SITES).cast("int").alias("site"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("h"))
    )
    site = F.col("site").cast("long")
    clade = F.call_function("shiftright", F.lit(n).cast("long") + F.col("taxon"), 1 + F.col("site") % LEVELS)
    inherited = (clade * 7919 + site * 104729 + clade * site * 17) % 1009 % 4
    state = F.when(F.col("h") % 13 == 0, 4).when(F.col("h") % 7 == 0, (site * 7 + F.col("h")) % 4).otherwise(inherited)
    return lines.select("taxon", "site", state.cast("int").alias("state"))


def order_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(taxon, site, state): regions observed at each order."""
    region = (
        read(spark, folder, "supplier")
        .join(read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_regionkey").cast("int").alias("taxon"))
    )
    lines = (
        read(spark, folder, "lineitem")
        .join(region, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("taxon", F.col("l_orderkey").alias("site"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("h"))
    )
    taxon, site, h = F.col("taxon"), F.col("site"), F.col("h")
    state = (
        F.when(h % 11 == 0, 4)
        .when(h % 5 == 0, (site + h) % 4)
        .when((taxon >= 3) & (site % 3 == 0), (site + 1) % 4)
        .when((taxon >= 2) & (site % 7 == 1), (site + 2) % 4)
        .otherwise(site % 4)
    )
    return lines.select("taxon", "site", state.cast("int").alias("state"))


def document_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """(taxon, name, sequence): whole document texts as sequence rows."""
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("taxon"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("sequence"),
    )


def heap_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(u, v) with u < v. Leaves are 0..n-1, internal nodes n..2n-3.

    Heap position p in 2..n-1 is internal node n + p - 2; position n + t is
    leaf t. The two children of position 1 are joined directly.
    """
    n = supplier_count(spark, folder)

    def node(position):
        return F.when(position >= n, position - n).otherwise(position + n - 2)

    positions = read(spark, folder, "supplier").select(F.explode(F.array(
        F.col("s_suppkey") + n, F.col("s_suppkey"))).alias("p")).where("p >= 3")
    child = node(F.col("p"))
    parent = F.when(F.col("p") == 3, node(F.lit(2))).otherwise(node(F.floor(F.col("p") / 2)))
    return positions.select(
        F.least(child, parent).cast("long").alias("u"), F.greatest(child, parent).cast("long").alias("v"))


def ladder_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(u, v) with u < v: leaves 1..n-2 hang from inner nodes n..2n-3 in a row, leaf 0 before and leaf n-1 behind them."""
    n = supplier_count(spark, folder)
    leaf = F.col("s_suppkey")
    pendant = F.struct(leaf.alias("u"), F.least(F.greatest(leaf - 1, F.lit(0)) + n, F.lit(2 * n - 3)).alias("v"))
    onward = F.when(leaf < n - 3, F.struct((leaf + n).alias("u"), (leaf + n + 1).alias("v")))
    return read(spark, folder, "supplier").select(F.inline(F.array_compact(F.array(pendant, onward)))).select(
        F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))


def locus_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(position, alignment_length): ordered locus manifest."""
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("position"), (F.col("c_nationkey") + 1).cast("long").alias("alignment_length"))
