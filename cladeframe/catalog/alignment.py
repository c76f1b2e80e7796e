"""Encoding, filters, patterns and per-site statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.catalog.common import CELLS, LOCI, ORDER_CELLS, cells, loci, mix_sql, rounded, tidy, with_, words
from cladeframe.functions import labels
from cladeframe.operators import pairs, sites
from cladeframe.sources import tables

DOC_CELLS = """
chars AS (SELECT CAST(doc_id AS BIGINT) AS taxon, unnest(string_split(text, '')) AS ch,
                 unnest(range(0, length(text))) AS site FROM documents),
dcell AS (SELECT taxon, CAST(site AS BIGINT) AS site, CAST(CASE WHEN ch IN ('A','a') THEN 0 WHEN ch IN ('C','c') THEN 1
          WHEN ch IN ('G','g') THEN 2 WHEN ch IN ('T','t','U','u') THEN 3 ELSE 4 END AS BIGINT) AS state FROM chars)
"""


def encode_states(spark, folder):
    rows = sites.cells_of(tables.document_sequences(spark, folder))
    k = F.col("state")
    return tidy(rows.groupBy("taxon").agg(
        *[F.count(F.when(k == s, 1)).alias(f"n{s}") for s in range(5)],
        F.sum(F.when(k < 4, F.col("site") * (k + 1)).otherwise(0)).cast("long").alias("position_sum")))


def sequence_words(spark, folder):
    rows = sites.words_of(tables.document_sequences(spark, folder), 32).where("observed <> 0")
    return tidy(rows.select("taxon", "word", "low", "high", "observed"))


def bitplanes(spark, folder):
    return tidy(sites.words_of_cells(cells(spark, folder), 32))


def nibble_bytes(spark, folder):
    return tidy(sites.pack_nibbles(cells(spark, folder)))


def nibble_round_trip(spark, folder):
    packed = sites.pack_nibbles(cells(spark, folder))
    back = sites.unpack_nibbles(packed, tables.SITES)
    return tidy(back.groupBy("taxon", "state").agg(F.count("*").alias("n"), F.sum("site").cast("long").alias("sites")))


def observed_cells(spark, folder):
    return tidy(sites.observed(cells(spark, folder)).select("taxon", "site", "state"))


def missing_per_taxon(spark, folder):
    """Missing sites of every customer; a customer without an order has no cell at all."""
    return rounded(tidy(sites.missing_per_taxon(*_customers(spark, folder), 1000)), "fraction")


def _customers(spark, folder):
    """Customers as taxa, their orders as cells; orders still in progress are missing states."""
    taxa = tables.read(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("taxon"))
    state = F.when(F.col("o_orderstatus") == "P", 4).otherwise(F.col("o_orderkey") % 4).cast("int")
    orders = tables.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("long").alias("taxon"), F.col("o_orderkey").alias("site"), state.alias("state"))
    return taxa, orders.where("state < 4")


def column_hash(spark, folder):
    """Hash of every column of the supplier alignment."""
    return tidy(sites.column_hashes(cells(spark, folder)))


def health_warnings(spark, folder):
    """Evidence of every locus of the order alignment and what it lacks."""
    rows = sites.assign_loci(tables.order_cells(spark, folder), loci(spark, folder))
    return tidy(sites.health(rows, ["locus"]).withColumn("warnings", F.array_join("warnings", "; ")))


def unobserved_taxa(spark, folder):
    return tidy(sites.unobserved_taxa(*_customers(spark, folder)))


def base_frequencies(spark, folder):
    return rounded(tidy(sites.base_frequencies(cells(spark, folder))), "share")


def region_frequencies(spark, folder):
    placed = sites.assign_loci(tables.order_cells(spark, folder), loci(spark, folder))
    return rounded(tidy(sites.base_frequencies(placed, ["locus"])), "share")


def locus_cells(spark, folder):
    placed = sites.assign_loci(tables.order_cells(spark, folder), loci(spark, folder))
    return tidy(placed.groupBy("locus").agg(F.count("*").alias("cells"), F.sum("site").cast("long").alias("site_sum")))


def locus_boundaries(spark, folder):
    return tidy(loci(spark, folder).select("locus", "start", F.col("end").alias("stop")))


def site_profile(spark, folder):
    return tidy(sites.site_profile(tables.order_cells(spark, folder)))


def variable_sites(spark, folder):
    profile = sites.site_profile(sites.observed(tables.order_cells(spark, folder)))
    return tidy(profile.where(F.bit_count("states") >= 2).select("site", "observed"))


def drop_constant_sites(spark, folder):
    return tidy(sites.drop_constant_sites(tables.order_cells(spark, folder), 5))


def drop_constant_sites_by_block(spark, folder):
    rows = sites.drop_constant_sites_by_block(tables.order_cells(spark, folder), 5, 4)
    return tidy(rows.select("block", "taxon", "site", "state"))


def site_evidence(spark, folder):
    return tidy(sites.evidence_totals(tables.order_cells(spark, folder)))


def sample_sites(spark, folder):
    return tidy(sites.sample_sites(tables.order_cells(spark, folder), 500, 20261022))


def select_sites(spark, folder):
    rows = tables.order_cells(spark, folder)
    return tidy(sites.select_sites(rows, sites.sample_sites(rows, 500, 20261022)))


def _pattern_text(df):
    text = F.array_join(F.transform("column", lambda s: F.concat_ws(":", s["taxon"], s["state"])), ",")
    return tidy(df.select(text.alias("pattern"), "weight", "first_site", "inv_code"))


def site_patterns(spark, folder):
    return _pattern_text(sites.site_patterns(tables.order_cells(spark, folder)))


def pattern_fold(spark, folder):
    rows = tables.order_cells(spark, folder)
    placed = sites.assign_loci(rows, loci(spark, folder))
    chunk = placed.groupBy("locus", "site").agg(
        F.array_sort(F.collect_list(F.when(F.col("state") < 4, F.struct("taxon", "state")))).alias("column"))
    first = chunk.groupBy("locus", "column").agg(F.count("*").alias("weight"), F.min("site").alias("first_site"))
    kinds = F.size(F.array_distinct(F.transform("column", lambda s: s["state"])))
    code = F.when(kinds == 0, 4).when(kinds > 1, 5).otherwise(F.get("column", F.lit(0))["state"])
    return _pattern_text(sites.fold_patterns(first.withColumn("inv_code", code)))


def coverage_medians(spark, folder):
    """Medians over the pairs of 128 evenly spaced suppliers, on all sites."""
    n = tables.supplier_count(spark, folder)
    return rounded(tidy(pairs.coverage_medians(words(spark, folder), n, tables.SITES)), "median_overlap", "median_jaccard", "sparsity_index")


def coverage_diagnostics(spark, folder):
    n = tables.supplier_count(spark, folder)
    rows = pairs.coverage_diagnostics(cells(spark, folder), n, tables.SITES)
    return rounded(rows, "mean_overlap", "pooled_jaccard", "sparsity_index")


def numeric_reorder(spark, folder):
    from cladeframe.sources.alignments import numeric_order
    names = tables.read(spark, folder, "customer").select(
        (F.lit(0) + F.col("c_custkey")).alias("taxon"), F.col("c_name").alias("name"))
    return tidy(numeric_order(names))


def locus_union_pad(spark, folder):
    from cladeframe.sources.alignments import pad_union
    rows = sites.assign_loci(tables.order_cells(spark, folder), loci(spark, folder))
    blocks = rows.join(loci(spark, folder), "locus").groupBy("locus", "taxon", "start", "end").agg(
        F.map_from_entries(F.collect_list(F.struct("site", F.col("state").cast("string")))).alias("m"))
    base = F.transform(F.sequence(F.col("start"), F.col("end") - 1), lambda s: F.coalesce(
        F.try_element_at(F.col("m"), s), F.lit("4")))
    seq = F.translate(F.array_join(base, ""), "01234", "ACGT-")
    return pad_union(blocks.select("locus", F.col("taxon").cast("string").alias("name"), seq.alias("sequence")))


def quoted_labels(spark, folder):
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit("'"))
    rows = tables.read(spark, folder, "part").select(F.col("p_partkey").alias("node"), name.alias("name"), "p_name")
    return rows.select("node", labels.quoted(F.col("name")).alias("label"),
                       labels.strictly_quoted(F.col("p_name")).alias("strict_label"))


QUERIES = {f.__name__: f for f in (
    encode_states, sequence_words, bitplanes, nibble_bytes, nibble_round_trip, observed_cells, missing_per_taxon,
    unobserved_taxa, base_frequencies, region_frequencies, locus_cells, locus_boundaries, site_profile, variable_sites,
    drop_constant_sites, drop_constant_sites_by_block, site_evidence, sample_sites, select_sites, site_patterns,
    pattern_fold, coverage_medians, coverage_diagnostics, column_hash, health_warnings, numeric_reorder, locus_union_pad, quoted_labels)}

_PLANE = """
  CAST(sum(CASE WHEN state IN (1, 3) THEN {bit} ELSE 0 END) AS BIGINT) AS low,
  CAST(sum(CASE WHEN state IN (2, 3) THEN {bit} ELSE 0 END) AS BIGINT) AS high,
  CAST(sum({bit}) AS BIGINT) AS observed"""
_BIT32 = "(CAST(1 AS BIGINT) << CAST(31 - site % 32 AS BIGINT))"
_PROFILE = """
profile AS (SELECT site, count(CASE WHEN state < 4 THEN 1 END) AS observed, count(*) AS n_rows,
                   CAST(bit_or(CAST(1 AS BIGINT) << state) AS BIGINT) AS states FROM ocell GROUP BY site)
"""
_KEPT = """
kept AS (SELECT site FROM profile WHERE bit_count(CASE WHEN n_rows < 5 THEN states | 16 ELSE states END) > 1)
"""
_SAMPLE = mix_sql("(SELECT DISTINCT site FROM ocell)", "site * 2 + 20261022", "site_key", "site") + """,
chosen AS (SELECT site FROM site_key ORDER BY mixed, site LIMIT 500)"""
_COLUMN = "coalesce(string_agg(CASE WHEN state < 4 THEN taxon || ':' || state END, ',' ORDER BY taxon), '')"
_INV = ("CAST(CASE WHEN count(DISTINCT CASE WHEN state < 4 THEN state END) = 0 THEN 4 "
        "WHEN count(DISTINCT CASE WHEN state < 4 THEN state END) > 1 THEN 5 "
        "ELSE min(CASE WHEN state < 4 THEN state END) END AS BIGINT)")
_SITE_LOCUS = "JOIN locus ON site >= stop - len AND site < stop"

ORACLES = {
    "encode_states": with_(DOC_CELLS) + """
SELECT taxon, count(CASE WHEN state = 0 THEN 1 END) AS n0, count(CASE WHEN state = 1 THEN 1 END) AS n1,
  count(CASE WHEN state = 2 THEN 1 END) AS n2, count(CASE WHEN state = 3 THEN 1 END) AS n3,
  count(CASE WHEN state = 4 THEN 1 END) AS n4,
  CAST(sum(CASE WHEN state < 4 THEN site * (state + 1) ELSE 0 END) AS BIGINT) AS position_sum
FROM dcell GROUP BY taxon""",
    "sequence_words": with_(DOC_CELLS) + f"""
SELECT taxon, site // 32 AS word, {_PLANE.format(bit=_BIT32)} FROM dcell WHERE state < 4 GROUP BY 1, 2""",
    "bitplanes": with_(CELLS) + f"""
SELECT taxon, site // 32 AS word, {_PLANE.format(bit=_BIT32)} FROM obs GROUP BY 1, 2""",
    "nibble_bytes": with_(CELLS) + """
SELECT taxon, site // 2 AS byte, CAST(coalesce(max(CASE WHEN site % 2 = 0 THEN state END), 4)
  + 16 * coalesce(max(CASE WHEN site % 2 = 1 THEN state END), 4) AS BIGINT) AS value FROM cell GROUP BY 1, 2""",
    "nibble_round_trip": with_(CELLS, """
bytes AS (SELECT DISTINCT taxon, site // 2 AS byte FROM cell),
slots AS (SELECT taxon, byte * 2 + k AS site FROM bytes, (SELECT unnest([0, 1]) AS k)),
back AS (SELECT s.taxon, s.site, coalesce(c.state, 4) AS state FROM slots s LEFT JOIN cell c
         ON c.taxon = s.taxon AND c.site = s.site WHERE s.site < 512)""") + """
SELECT taxon, CAST(state AS BIGINT) AS state, count(*) AS n, CAST(sum(site) AS BIGINT) AS sites FROM back GROUP BY 1, 2""",
    "observed_cells": with_(CELLS) + "SELECT taxon, site, state FROM obs",
    "missing_per_taxon": """
SELECT CAST(c_custkey AS BIGINT) AS taxon, 1000 - count(o_orderkey) AS missing, round((1000 - count(o_orderkey)) / 1000.0::DOUBLE, 6) AS fraction
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey""",
    "unobserved_taxa": """
SELECT CAST(c_custkey AS BIGINT) AS taxon FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')""",
    "column_hash": with_(CELLS, mix_sql("obs", "taxon * 8 + state", "first_mix", "site, taxon, state"),
                         mix_sql("(SELECT site, taxon, state, mixed AS m1 FROM first_mix)", "(taxon * 8 + state) * 31 + 17", "second_mix", "site, m1")) + """
SELECT site, CAST(bit_xor(((m1 & 2147483647) << 31) | (mixed & 2147483647)) AS BIGINT) AS h FROM second_mix GROUP BY site""",
    "health_warnings": with_(ORDER_CELLS, LOCI, f"""
col AS (SELECT locus, site, count(*) AS c, count(DISTINCT state) AS k FROM oobs {_SITE_LOCUS} GROUP BY locus, site),
sums AS (SELECT locus, count(CASE WHEN k > 1 THEN 1 END) AS variable_sites, count(CASE WHEN c > 1 THEN 1 END) AS jointly_observed_sites,
         CAST(sum(c * (c - 1) // 2) AS BIGINT) AS compared_pairs FROM col GROUP BY locus)""") + f"""
SELECT *, concat_ws('; ', CASE WHEN variable_sites = 0 THEN '{sites.HEALTH["variable_sites"]}' END,
  CASE WHEN jointly_observed_sites = 0 THEN '{sites.HEALTH["jointly_observed_sites"]}' END,
  CASE WHEN compared_pairs = 0 THEN '{sites.HEALTH["compared_pairs"]}' END) AS warnings FROM sums""",
    "base_frequencies": with_(CELLS, "total AS (SELECT count(*) AS t FROM obs)") + """
SELECT s.state, count(o.state) AS n, round(count(o.state) / max(t)::DOUBLE, 6) AS share
FROM (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS state) s LEFT JOIN obs o ON o.state = s.state, total GROUP BY s.state""",
    "region_frequencies": with_(ORDER_CELLS, LOCI, f"""
placed AS (SELECT locus, state FROM oobs {_SITE_LOCUS}),
total AS (SELECT locus, count(*) AS t FROM placed GROUP BY locus)""") + """
SELECT t.locus, s.state, count(p.state) AS n, round(count(p.state) / max(t.t)::DOUBLE, 6) AS share
FROM total t CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS state) s
LEFT JOIN placed p ON p.locus = t.locus AND p.state = s.state GROUP BY t.locus, s.state""",
    "locus_cells": with_(ORDER_CELLS, LOCI) + f"""
SELECT locus, count(*) AS cells, CAST(sum(site) AS BIGINT) AS site_sum FROM ocell {_SITE_LOCUS} GROUP BY locus""",
    "locus_boundaries": with_(LOCI) + "SELECT locus, stop - len AS start, stop FROM locus",
    "site_profile": with_(ORDER_CELLS, _PROFILE) + "SELECT site, observed, n_rows AS rows, states FROM profile",
    "variable_sites": with_(ORDER_CELLS) + """
SELECT site, count(*) AS observed FROM oobs GROUP BY site HAVING count(DISTINCT state) >= 2""",
    "drop_constant_sites": with_(ORDER_CELLS, _PROFILE, _KEPT, """
numbered AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS new_site FROM kept)""") + """
SELECT taxon, new_site AS site, state FROM ocell JOIN numbered USING (site)""",
    "drop_constant_sites_by_block": with_(ORDER_CELLS, _PROFILE, _KEPT, """
numbered AS (SELECT site, site % 4 AS block, row_number() OVER (PARTITION BY site % 4 ORDER BY site) - 1 AS new_site FROM kept)""") + """
SELECT block, taxon, new_site AS site, state FROM ocell JOIN numbered USING (site)""",
    "site_evidence": with_(ORDER_CELLS, """
per_site AS (SELECT site, count(*) AS n, count(DISTINCT state) AS kinds FROM oobs GROUP BY site)""") + """
SELECT count(CASE WHEN kinds >= 2 THEN 1 END) AS variable_sites, count(*) AS observed_sites,
  count(CASE WHEN n >= 2 THEN 1 END) AS jointly_observed_sites, CAST(sum(n) AS BIGINT) AS observed_bases FROM per_site""",
    "sample_sites": with_(ORDER_CELLS, _SAMPLE) + "SELECT site FROM chosen",
    "select_sites": with_(ORDER_CELLS, _SAMPLE, """
numbered AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS new_site FROM chosen)""") + """
SELECT taxon, new_site AS site, state FROM ocell JOIN numbered USING (site)""",
    "site_patterns": with_(ORDER_CELLS, f"""
col AS (SELECT site, {_COLUMN} AS pattern, {_INV} AS inv_code FROM ocell GROUP BY site)""") + """
SELECT pattern, count(*) AS weight, min(site) AS first_site, inv_code FROM col GROUP BY pattern, inv_code""",
    "coverage_medians": with_(CELLS, """
panel AS MATERIALIZED (SELECT DISTINCT (k * (n - 1)) // greatest(least(n, 128) - 1, 1) AS taxon FROM n_taxa, (SELECT unnest(range(0, 128)) AS k) WHERE k < n),
own AS MATERIALIZED (SELECT p.taxon, count(o.site) AS n FROM panel p LEFT JOIN obs o ON o.taxon = p.taxon GROUP BY p.taxon),
pair AS (SELECT x.taxon AS i, y.taxon AS j, x.n + y.n AS n FROM own x JOIN own y ON x.taxon < y.taxon),
both_seen AS (SELECT x.taxon AS i, y.taxon AS j, count(*) AS b FROM obs x JOIN obs y ON x.site = y.site AND x.taxon < y.taxon
  WHERE x.taxon IN (SELECT taxon FROM panel) AND y.taxon IN (SELECT taxon FROM panel) GROUP BY 1, 2),
share AS (SELECT coalesce(b, 0) / 512.0::DOUBLE AS o, CASE WHEN n - coalesce(b, 0) > 0 THEN coalesce(b, 0)::DOUBLE / (n - coalesce(b, 0)) ELSE 1.0 END AS j
  FROM pair LEFT JOIN both_seen USING (i, j))""") + """
SELECT round(median(o), 6) AS median_overlap, round(median(j), 6) AS median_jaccard, count(*) AS pairs, round((1 - median(o)) * median(j), 6) AS sparsity_index FROM share""",
    "coverage_diagnostics": with_(CELLS, """
size AS (SELECT taxon, count(*) AS s FROM obs GROUP BY taxon),
shared AS (SELECT count(*) AS k FROM obs a JOIN obs b ON a.site = b.site AND a.taxon < b.taxon),
base AS (SELECT k, (SELECT sum(s) FROM size) * (n - 1) - k AS u, n * (n - 1) / 2.0::DOUBLE * 512 AS p FROM shared, n_taxa)""") + """
SELECT round(k / p, 6) AS mean_overlap, round(k / u::DOUBLE, 6) AS pooled_jaccard, round((1 - k / p) * (k / u::DOUBLE), 6) AS sparsity_index FROM base""",
    "numeric_reorder": with_("""
idx AS (SELECT CAST(c_custkey AS BIGINT) AS taxon, c_name AS name,
               CAST(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS BIGINT) AS number FROM customer),
ok AS (SELECT count(*) = count(DISTINCT number) AND min(number) = 0 AND max(number) = count(*) - 1 AS good FROM idx)""") + """
SELECT CASE WHEN good THEN number ELSE taxon END AS taxon, name FROM idx, ok""",
    "locus_union_pad": with_(ORDER_CELLS, LOCI, f"""
present AS (SELECT DISTINCT locus, taxon FROM ocell {_SITE_LOCUS}),
sizes AS (SELECT DISTINCT locus, len, stop FROM locus WHERE locus IN (SELECT locus FROM present)),
taxa AS (SELECT DISTINCT taxon FROM present),
grid AS (SELECT s.locus, t.taxon, unnest(range(s.stop - s.len, s.stop)) AS site FROM sizes s CROSS JOIN taxa t)""") + """
SELECT g.locus, CAST(g.taxon AS VARCHAR) AS name,
  string_agg(CASE WHEN p.taxon IS NULL THEN '?' ELSE substr('ACGT-', CAST(coalesce(c.state, 4) + 1 AS BIGINT), 1) END, '' ORDER BY g.site) AS sequence
FROM grid g LEFT JOIN present p ON p.locus = g.locus AND p.taxon = g.taxon
LEFT JOIN ocell c ON c.taxon = g.taxon AND c.site = g.site GROUP BY g.locus, g.taxon""",
    "quoted_labels": """
SELECT CAST(p_partkey AS BIGINT) AS node, '''' || replace(p_name || ' ' || p_type || '''', '''', '''''') || '''' AS label,
  CASE WHEN regexp_matches(p_name, '^[A-Za-z0-9_.+-]+$') THEN p_name ELSE '''' || replace(p_name, '''', '''''') || '''' END AS strict_label
FROM part""",
}
ORACLES["pattern_fold"] = with_(ORDER_CELLS, LOCI, f"""
col AS (SELECT site, {_COLUMN} AS pattern, {_INV} AS inv_code FROM ocell {_SITE_LOCUS} GROUP BY site)""") + """
SELECT pattern, count(*) AS weight, min(site) AS first_site, inv_code FROM col GROUP BY pattern, inv_code"""
