"""A part of the named queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = ("bitplanes", "site_patterns", "drop_constant_sites", "locus_boundaries", "region_frequencies", "projection",
         "pair_distance_k2p_gamma", "row_controls", "nni_frames", "apply_nni", "tree_depth", "nearest_leaves",
         "quartet_orbits15", "kernel_scores", "network_scores", "parsimony_score", "paired_stats", "plateau_window")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size='1GB'; SET temp_directory='/tmp/duckdb-check'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())
