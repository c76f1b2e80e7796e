"""Phylogenetic analytics over aligned sequences and trees, as Spark DataFrames."""

__version__ = "0.1.0"
