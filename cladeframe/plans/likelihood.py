"""Likelihood and parsimony over site patterns.

Messages move over the tree by contraction (:mod:`cladeframe.plans.contraction`),
so the number of stages does not follow its depth. Patterns spread over the
cluster, and no task needs the whole tree. ``nodes`` is (node, parent), with
tour steps and tip counts where they are known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import models
from cladeframe.operators import sites
from cladeframe.plans import contraction
from cladeframe.session import cut_apart as cut, ship_package

M = ["m0", "m1", "m2", "m3"]


def pattern_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pattern, taxon, state), (pattern, weight)): distinct columns and their counts."""
    found = cut(sites.site_patterns(cells).select(F.col("first_site").alias("pattern"), "column", "weight", "inv_code"))
    rows = found.select("pattern", F.explode("column").alias("_s")).select(
        "pattern", F.col("_s.taxon").cast("long").alias("taxon"), F.col("_s.state").alias("state"))
    return rows, found.select("pattern", "weight", "inv_code")


def model_rates(pi, rates, categories) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(rate matrix, frequencies, rates of the categories)."""
    pi = np.asarray(pi, float)
    return models.rate_matrix(pi, np.asarray(rates, float)), pi, list(categories)


def transition_table(lengths: DataFrame, pi, rates, categories) -> DataFrame:
    """(node, cat, p00 .. p33) for the edge above every node.

    ``lengths`` is (node, length); ``categories`` lists site rates.
    """
    ship_package(lengths.sparkSession)
    q, pi = models.rate_matrix(np.asarray(pi), np.asarray(rates)), np.asarray(pi)
    names = [f"p{i}{j}" for i in range(4) for j in range(4)]

    def table(batches):
        for batch in batches:
            for cat, rate in enumerate(categories):
                p = models.transitions(q, pi, batch["length"].to_numpy() * rate).reshape(-1, 16)
                out = pd.DataFrame(p, columns=names)
                out.insert(0, "cat", cat)
                out.insert(0, "node", batch["node"].to_numpy())
                yield out

    return lengths.select("node", "length").mapInPandas(table, "node long, cat int, " + ", ".join(f"{n} double" for n in names))


def site_log_likelihoods(nodes: DataFrame, leaf_cells: DataFrame, lengths: DataFrame, pi, rates, categories, weights: list[float]) -> DataFrame:
    """(pattern, ll): log likelihood of each pattern with any observation.

    A missing state allows all four, so a leaf without an observation says nothing.
    """
    matrices = contraction.edge_matrices(lengths, [model_rates(pi, rates, categories)])
    plan = contraction.schedule(contraction.with_tour(nodes))
    found = contraction.Contraction(plan, matrices, contraction.Blocks.of(leaf_cells), contraction.SumProduct(pi))
    found.rise()
    arrived = found.arrived()
    root = leaf_cells.where("taxon = 0").select("pattern", F.col("state").alias("_root"))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cat") + 1)
    seen = [F.lit(float(pi[i])) * F.col(f"m{i}") * F.when(F.col("_root").isNull() | (F.col("_root") == i), 1.0).otherwise(0.0)
            for i in range(4)]
    rows = arrived.join(root, "pattern", "left").withColumn("_l", share * (seen[0] + seen[1] + seen[2] + seen[3]))
    top = rows.groupBy("pattern").agg(F.max("log").alias("_top"), F.collect_list(F.struct("_l", "log")).alias("_all"))
    total = F.expr("aggregate(_all, 0D, (a, s) -> a + s._l * exp(s.log - _top))")
    return top.select("pattern", (F.ln(total) + F.col("_top")).alias("ll"))


def log_likelihood(nodes: DataFrame, cells: DataFrame, lengths: DataFrame, pi, rates, categories, weights) -> DataFrame:
    """One row: total log likelihood and site count over all patterns."""
    leaf_cells, weight = pattern_cells(cells)
    scored = site_log_likelihoods(nodes, cut(leaf_cells), lengths, pi, rates, categories, weights)
    return weight.join(scored, "pattern", "left").agg(
        F.sum(F.col("weight") * F.coalesce("ll", F.lit(0.0))).alias("log_likelihood"), F.sum("weight").alias("sites"))


#: One change costs one, whatever it is.
CHANGE_COSTS = [0.0 if i == j else 1.0 for i in range(4) for j in range(4)]


def parsimony(nodes: DataFrame, leaf_cells: DataFrame) -> DataFrame:
    """(pattern, changes): least number of state changes on the tree."""
    plan = contraction.schedule(contraction.with_tour(nodes))
    matrices = plan.items.select("node", F.array(*[F.lit(c) for c in CHANGE_COSTS]).alias("p"))
    found = contraction.Contraction(plan, matrices, contraction.Blocks.of(leaf_cells), contraction.MinPlus())
    found.rise()
    root = leaf_cells.where("taxon = 0").select("pattern", F.col("state").alias("_root"))
    own = F.element_at(F.array(*M), F.col("_root") + 1)
    return found.arrived().join(root, "pattern", "left").select(
        "pattern", F.coalesce(own, F.least(*M)).cast("long").alias("changes"))


def jc_steps(nodes: DataFrame, cells: DataFrame, lengths: DataFrame, iterations: int = 32, tolerance: float = 1e-6,
             low: float = 1e-6, high: float = 10.0) -> tuple[DataFrame, list[float]]:
    """(node, length) after expectation-maximisation under JC69, and the log likelihood before each step.

    The expected share of sites that differ across an edge follows from what
    lies on either side of it, which one pass over the contracted tree sums up.
    Steps end when the likelihood gains less than ``tolerance`` a site.
    """
    leaf_cells, weight = pattern_cells(cells)
    leaf_cells, weight = cut(leaf_cells), cut(weight)
    pi, rates = [0.25] * 4, [1.0] * 6
    total = weight.agg(F.sum("weight")).first()[0]
    plan = contraction.schedule(contraction.with_tour(nodes))
    algebra, blocks = contraction.SumProduct(pi), contraction.Blocks.of(leaf_cells, weight)

    def emit(block, part):
        nodes, off, ll = [], [], []
        for item, node in zip(part.items, part.nodes):
            (v, log), (d, dlog) = part.value[item], part.outside[item]
            x = (4 * part.edge[item][0, 0, 0] - 1) / 3
            dot, sums = (d * v).sum(1)[0], (d.sum(1) * v.sum(1))[0]
            every = x * dot + (1 - x) * sums / 4
            nodes.append(node)
            off.append(float((part.weights[0] * (1 - x) * (sums - dot) / 4 / every).sum()))
            ll.append(float((part.weights[0] * (np.log(every / 4) + (log + dlog)[0])).sum()))
        return pa.table({"node": pa.array(nodes, pa.int64()), "off": pa.array(off, pa.float64()), "ll": pa.array(ll, pa.float64())})

    lengths, history, base = cut(lengths.select("node", "length")), [], None
    top = plan.items.where("c0 = 1").select("node").first()[0]
    for _ in range(iterations):
        matrices = contraction.edge_matrices(lengths, [model_rates(pi, rates, [1.0])])
        base = contraction.Contraction(plan, matrices, blocks, algebra) if base is None else base.with_edges(matrices)
        base.rise(to_root=False)
        sums = cut(base.descend(weight.select("pattern", "weight"), emit, "node long, off double, ll double").groupBy("node").agg(
            F.sum("off").alias("off"), F.sum("ll").alias("ll")))
        history.append(sums.where(F.col("node") == top).first()["ll"])
        if len(history) > 1 and (history[-1] - history[-2]) / total < tolerance:
            break
        expected = F.least(F.col("off") / total, F.lit(0.75 - 1e-8))
        lengths = cut(lengths.join(sums, "node", "left").select(
            "node", F.greatest(F.least(-0.75 * F.log1p(-4 * expected / 3), F.lit(high)), F.lit(low)).alias("length")))
    return lengths, history
