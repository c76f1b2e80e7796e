"""Interchange search by likelihood: scan, verify and halve, refit.

All sums run over site patterns in tables; the driver keeps the model, a few
totals and the history of the run. Lengths and model parameters are fitted
together by a quasi-Newton method whose vectors stay in tables: one pass over
the contracted tree gives the likelihood and its derivatives, and the driver
sees only their inner products.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import models
from cladeframe.operators import moves, trees
from cladeframe.operators.ordering import global_rank
from cladeframe.plans import contraction, likelihood
from cladeframe.session import cut_apart as cut

SHORTEST, LONGEST = 1e-6, 10.0


@dataclass(frozen=True)
class Mixture:
    """A substitution model: equally likely gamma categories and a share of invariant sites."""

    pi: list[float]
    rates: list[float] = field(default_factory=lambda: [1.0] * 6)
    alpha: float | None = None
    categories: int = 1
    invariant: float = 0.0

    def site_rates(self) -> list[float]:
        gamma = models.gamma_rates(self.alpha, self.categories) if self.categories > 1 else np.ones(1)
        # The mean over all sites is one, those that never change included.
        return [float(r) / (1 - self.invariant) for r in gamma]

    def variant(self) -> tuple[np.ndarray, np.ndarray, list[float]]:
        return likelihood.model_rates(self.pi, self.rates, self.site_rates())


@dataclass
class Patterns:
    """Distinct columns of an alignment with their weights, and a cell for every leaf; a null state is missing."""

    cells: DataFrame
    weight: DataFrame
    blocks: contraction.Blocks

    @staticmethod
    def of(cells: DataFrame, leaves: int) -> Patterns:
        rows, weight = likelihood.pattern_cells(cells)
        weight = cut(weight)
        # Messages of all leaves are what a search compares, so missing states are written out.
        every = weight.select("pattern", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))).alias("taxon"))
        return Patterns(cut(every.join(rows, ["pattern", "taxon"], "left")), weight, contraction.Blocks.of(cut(rows), weight))


@dataclass
class Tree:
    """A topology ready for messages: its parts, and the edge (u, v) above every node."""

    plan: contraction.Schedule
    nodes: DataFrame
    top: int

    @staticmethod
    def of(edges: DataFrame, leaves: int) -> Tree:
        nodes = cut(trees.rooted(edges.select("u", "v"), leaves))
        above = nodes.where("parent IS NOT NULL").select("node", "parent", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
        return Tree(contraction.schedule(nodes), cut(above), above.where("parent = 0").first()["node"])

    def lengths(self, edges: DataFrame) -> DataFrame:
        """(node, length) of edges (u, v, length)."""
        return self.nodes.join(edges.select("u", "v", "length"), ["u", "v"]).select("node", "length")

    def messages(self, lengths: DataFrame, patterns: Patterns, model: Mixture) -> contraction.Contraction:
        matrices = contraction.edge_matrices(lengths, [model.variant()])
        return contraction.Contraction(self.plan, matrices, patterns.blocks, contraction.SumProduct(model.pi))


def _mixed(rows: DataFrame, keys: list[str], values: list[str], model: Mixture, weight: DataFrame) -> DataFrame:
    """Sum over categories and invariant sites: ``keys`` and pattern with the log of each value.

    ``rows`` has keys, pattern, cat, log and the values at that log scale.
    """
    top = rows.groupBy(*keys, "pattern").agg(F.max("log").alias("_top"), F.collect_list(F.struct("log", *values)).alias("_all"))
    share = (1 - model.invariant) / model.categories
    frequency = F.element_at(F.array(*[F.lit(float(p)) for p in model.pi]), F.least(F.col("inv_code"), F.lit(3)) + 1)
    still = F.when(F.col("inv_code") == 4, 1.0).when(F.col("inv_code") == 5, 0.0).otherwise(frequency) * model.invariant
    out = top.join(weight, "pattern").withColumn("_still", still)
    for value in values:
        moving = F.ln(F.expr(f"aggregate(_all, 0D, (a, s) -> a + s.{value} * exp(s.log - _top))") * share) + F.col("_top")
        both = F.greatest(moving, F.ln("_still")) + F.log1p(F.exp(-F.abs(moving - F.ln("_still"))))
        out = out.withColumn(f"ll_{value}", F.when(F.col("_still") > 0, both).otherwise(moving))
    return out.select(*keys, "pattern", "weight", *[F.col(f"ll_{v}") for v in values])


def _across(left: list, right: list, pi: list[float]):
    """Likelihood of values at both ends of an edge whose matrix is p00 .. p33."""
    reached = [sum((F.col(f"p{i}{j}") * right[j] for j in range(1, 4)), F.col(f"p{i}0") * right[0]) for i in range(4)]
    return sum((F.lit(float(pi[i])) * left[i] * reached[i] for i in range(1, 4)), F.lit(float(pi[0])) * left[0] * reached[0])


def scan(edges: DataFrame, leaves: int, patterns: Patterns, model: Mixture) -> DataFrame:
    """(u, v, a, b, c, d, ll0, ll1, ll2): log likelihood of the tree and of both interchanges of every inner edge.

    All lengths stay as they are.
    """
    tree = Tree.of(edges, leaves)
    lengths = cut(tree.lengths(edges))
    table = cut(likelihood.transition_table(lengths, model.pi, model.rates, model.site_rates()))
    found = tree.messages(lengths, patterns, model)
    found.rise(to_root=False)
    up = cut(found.messages())
    step = table.join(tree.nodes.select("node", "parent"), "node")

    def pushed(values: DataFrame, letter: str, log: str, src: str, dst: str) -> DataFrame:
        through = [sum((F.col(f"p{i}{j}") * F.col(f"{letter}{j}") for j in range(4)), F.lit(0.0)).alias(f"m{i}") for i in range(4)]
        return values.join(step, ["node", "cat"]).select(F.col(src).alias("src"), F.col(dst).alias("dst"), "pattern", "cat", *through, F.col(log).alias("log"))

    toward = cut(pushed(up, "m", "log", "node", "parent").unionByName(pushed(up, "d", "dlog", "parent", "node")))
    frame = cut(trees.frames(edges.select("u", "v"), leaves))
    # Every inner edge is compared on every pattern: that is the sum itself.
    rows = frame.join(patterns.weight.select("pattern")).join(F.broadcast(table.select("cat").distinct()))
    for x, end in (("a", "u"), ("b", "u"), ("c", "v"), ("d", "v")):
        side = toward.select(F.col("src").alias(x), F.col("dst").alias(end), "pattern", "cat",
                             F.array("m0", "m1", "m2", "m3").alias(f"_{x}"), F.col("log").alias(f"_log_{x}"))
        rows = rows.join(side, [x, end, "pattern", "cat"])
    own = step.where("parent IS NOT NULL").select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"), "cat", *[f"p{i}{j}" for i in range(4) for j in range(4)])
    rows = rows.join(own, ["u", "v", "cat"])
    m = {x: [F.col(f"_{x}")[i] for i in range(4)] for x in "abcd"}

    def product(x: str, y: str) -> list:
        return [p * q for p, q in zip(m[x], m[y])]

    values = {f"l{t}": _across(product(*left), product(*right), model.pi)
              for t, (left, right) in enumerate((("ab", "cd"), ("ac", "bd"), ("ad", "bc")))}
    log = sum((F.col(f"_log_{x}") for x in "abcd"), F.lit(0.0))
    scored = rows.select("u", "v", "pattern", "cat", log.alias("log"), *[v.alias(k) for k, v in values.items()])
    mixed = _mixed(scored, ["u", "v"], list(values), model, patterns.weight)
    totals = mixed.groupBy("u", "v").agg(*[F.sum(F.col("weight") * F.col(f"ll_l{t}")).alias(f"ll{t}") for t in range(3)])
    return cut(frame.join(totals, ["u", "v"]))


def _invariant_share(model: Mixture):
    """Likelihood of a pattern at a site that never changes, from its code: one state, all missing (4) or several (5)."""
    frequency = F.element_at(F.array(*[F.lit(float(p)) for p in model.pi]), F.least(F.col("inv_code"), F.lit(3)) + 1)
    return F.when(F.col("inv_code") == 4, 1.0).when(F.col("inv_code") == 5, 0.0).otherwise(frequency)


def total(edges: DataFrame, leaves: int, patterns: Patterns, model: Mixture) -> float:
    """Log likelihood of the tree."""
    tree = Tree.of(edges, leaves)
    return _slopes(tree, cut(tree.lengths(edges)), patterns, model, [])[0]


def _slopes(tree: Tree, lengths: DataFrame, patterns: Patterns, model: Mixture, neighbours: list[Mixture], step: float = 1e-4) -> tuple[float, list[float], DataFrame]:
    """(log likelihood, its derivatives by the parameters, (node, slope) by the logarithm of each length).

    ``neighbours`` has two models for each parameter, ``step`` below and above.
    """
    share = (1 - model.invariant) / model.categories
    variants = [m.variant() for m in (model, *neighbours)]
    moved = [(b.invariant - a.invariant) / (2 * step) for a, b in zip(neighbours[::2], neighbours[1::2])]
    matrices = contraction.edge_matrices(lengths, variants, step)
    found = contraction.Contraction(tree.plan, matrices, patterns.blocks, contraction.SumProduct(model.pi))
    found.rise(to_root=False)
    pi, invariant, top, names = np.array(model.pi)[:, None], model.invariant, tree.top, [f"t{k}" for k in range(len(moved))]

    def emit(block, part):
        rows = []
        weight, still = part.weights
        for item, node in zip(part.items, part.nodes):
            (v, log), (d, dlog) = part.value[item], part.outside[item]
            log = np.broadcast_to(log + dlog, (part.cats, part.width))
            high = log.max(0)
            scale = share * np.exp(log - high)

            def across(p):
                return ((pi * d * np.matmul(p, v)).sum(1) * scale).sum(0)

            moving = across(part.edge[item])
            site = moving + invariant * still * np.exp(-high)
            site = np.where(site > 0, site, 1.0)
            slopes = [float((weight * across(p) / site).sum()) for p in part.more[item]]
            ll = 0.0
            if node == top:
                ll = float((weight * (np.log(site) + high)).sum())
                # The share of sites that never change also weighs the two parts of the sum.
                direct = float((weight * (still * np.exp(-high) - moving / (1 - invariant)) / site).sum())
                slopes[1:] = [s + m * direct for s, m in zip(slopes[1:], moved)]
            rows.append((node, ll, *slopes))
        columns = list(zip(*rows))
        return pa.table([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=["node", "ll", "slope", *names])

    weights = patterns.weight.select("pattern", "weight", _invariant_share(model).alias("still"))
    kind = "node long, " + ", ".join(f"{c} double" for c in ["ll", "slope", *names])
    sums = cut(found.descend(weights, emit, kind).groupBy("node").agg(*[F.sum(c).alias(c) for c in ["ll", "slope", *names]]))
    ll, *slopes = sums.agg(*[F.sum(c) for c in ["ll", *names]]).first()
    return ll, slopes, sums.select("node", "slope")


def gradient(edges: DataFrame, leaves: int, patterns: Patterns, model: Mixture) -> DataFrame:
    """(node, slope): derivative of the log likelihood by the logarithm of the length above each node, seen from leaf 0."""
    tree = Tree.of(edges, leaves)
    return _slopes(tree, cut(tree.lengths(edges)), patterns, model, [])[2]


MEMORY = 6  # steps that the quasi-Newton method remembers


def _direction(gram: np.ndarray, k: int) -> np.ndarray:
    """Weights of (steps, changes of the gradient, gradient) in the next step, from their inner products."""
    weight = np.zeros(2 * k + 1)
    weight[-1] = -1.0
    back = np.zeros(k)
    for i in reversed(range(k)):
        back[i] = weight @ gram[i] / gram[i, k + i]
        weight[k + i] -= back[i]
    if k:
        weight *= gram[k - 1, 2 * k - 1] / gram[2 * k - 1, 2 * k - 1]
    for i in range(k):
        weight[i] += back[i] - weight @ gram[k + i] / gram[i, k + i]
    return weight


class Parameters:
    """Free parameters of a model, each on the whole line: log rates, log shape, log odds of invariant sites."""

    def __init__(self, model: Mixture, classes: str = "", invariant: bool = False):
        self.model, self.classes = model, classes
        self.names = [c for c in sorted(set(classes)) if c != classes[-1]] if classes else []
        self.names += (["alpha"] if model.categories > 1 and classes else []) + (["invariant"] if invariant else [])
        rates = dict(zip(classes, model.rates))
        start = {"alpha": model.alpha, "invariant": max(model.invariant, 0.01)}
        value = [start.get(n, rates.get(n)) for n in self.names]
        self.start = np.array([np.log(v / (1 - v)) if n == "invariant" else np.log(v) for n, v in zip(self.names, value)])
        self.low = np.array([np.log(0.02) if n == "alpha" else -12.0 if n == "invariant" else np.log(1e-3) for n in self.names])
        self.high = np.array([np.log(100.0) if n == "alpha" else 3.0 if n == "invariant" else np.log(1e3) for n in self.names])

    def at(self, theta: np.ndarray) -> Mixture:
        given = dict(zip(self.names, theta))
        out = replace(self.model, rates=[float(np.exp(given[c])) if c in given else r for c, r in zip(self.classes, self.model.rates)] or self.model.rates)
        if "alpha" in given:
            out = replace(out, alpha=float(np.clip(np.exp(given["alpha"]), 0.02, 100.0)))
        if "invariant" in given:
            out = replace(out, invariant=float(1 / (1 + np.exp(-given["invariant"]))))
        return out

    def around(self, theta: np.ndarray, step: float) -> list[Mixture]:
        return [self.at(theta + sign * step * np.eye(len(theta))[i]) for i in range(len(theta)) for sign in (-1, 1)]


def fit(edges: DataFrame, leaves: int, patterns: Patterns, model: Mixture, classes: str = "", invariant: bool = False, iterations: int = 32,
        tolerance: float = 1e-3) -> tuple[DataFrame, Mixture, float]:
    """Edges, model and log likelihood after a joint fit of all lengths, and of rates, shape and invariant share where asked for.

    ``classes`` names the rate class of each base pair; the last class keeps
    its rate. L-BFGS with bounds: the lengths and the last steps are a table
    with a row for each edge, the few parameters live on the driver. It ends
    when a step gains less than ``tolerance``, or after ``iterations``.
    """
    tree, step = Tree.of(edges, leaves), 1e-4
    free = Parameters(model, classes, invariant)
    theta, low, high = free.start.copy(), float(np.log(SHORTEST)), float(np.log(LONGEST))
    none = F.expr("cast(array() as array<double>)")

    def bounded(x):
        return F.least(F.greatest(x, F.lit(low)), F.lit(high))

    def downhill(x: DataFrame, theta: np.ndarray):
        """(cost, gradient by the parameters, (node, x, g)); what would leave its bounds has no gradient."""
        lengths = x.select("node", F.exp("x").alias("length"))
        ll, by_theta, slopes = _slopes(tree, lengths, patterns, free.at(theta), free.around(theta, step), step)
        g = -np.array(by_theta, float)
        g = np.where((theta <= free.low) & (g > 0) | (theta >= free.high) & (g < 0), 0.0, g)
        own = F.when((F.col("x") <= low) & (F.col("slope") < 0) | (F.col("x") >= high) & (F.col("slope") > 0), 0.0).otherwise(-F.col("slope"))
        return -ll, g, x.join(slopes, "node").select("node", "x", own.alias("g"))

    x = cut(tree.lengths(edges).select("node", bounded(F.ln("length")).alias("x")))
    cost, g, state = downhill(x, theta)
    state = cut(state.select("*", none.alias("s"), none.alias("y")))
    past_s, past_y = [], []
    for _ in range(iterations):
        k = len(past_s)
        basis = [F.col("s")[i] for i in range(k)] + [F.col("y")[i] for i in range(k)] + [F.col("g")]
        own = [*past_s, *past_y, g]
        pairs = [(i, j) for i in range(2 * k + 1) for j in range(i, 2 * k + 1)]
        sums = state.agg(*[F.sum(basis[i] * basis[j]) for i, j in pairs]).first()
        gram = np.zeros((2 * k + 1,) * 2)
        for (i, j), v in zip(pairs, sums):
            gram[i, j] = gram[j, i] = v + float(own[i] @ own[j])
        if gram[-1, -1] < 1e-12:
            break
        if k and any(gram[i, k + i] <= 1e-12 for i in range(k)):
            past_s, past_y = [], []
            state = cut(state.select("node", "x", "g", none.alias("s"), none.alias("y")))
            continue
        weight = _direction(gram, k)
        slope = float(weight @ gram[-1])
        size = 1.0 if k else min(1.0, 1.0 / np.sqrt(gram[-1, -1]))
        move = sum((F.lit(float(w)) * b for w, b in zip(weight, basis)), F.lit(0.0))
        own_move = sum(w * b for w, b in zip(weight, own))
        for _ in range(12):
            x = cut(state.select("node", bounded(F.col("x") + F.lit(size) * move).alias("x")))
            there = np.clip(theta + size * own_move, free.low, free.high)
            new_cost, new_g, new = downhill(x, there)
            if new_cost <= cost + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        old = state.select("node", F.col("x").alias("_x"), F.col("g").alias("_g"), "s", "y")
        state = cut(new.join(old, "node").select(
            "node", "x", "g", F.slice(F.array_append("s", F.col("x") - F.col("_x")), -min(k + 1, MEMORY), MEMORY).alias("s"),
            F.slice(F.array_append("y", F.col("g") - F.col("_g")), -min(k + 1, MEMORY), MEMORY).alias("y")))
        past_s, past_y = [*past_s, there - theta][-MEMORY:], [*past_y, new_g - g][-MEMORY:]
        gain, cost, theta, g = cost - new_cost, new_cost, there, new_g
        if gain < tolerance:
            break
    fitted = cut(tree.nodes.join(state, "node").select("u", "v", F.exp("x").alias("length")))
    return fitted, free.at(theta), -cost


def fit_lengths(edges: DataFrame, leaves: int, patterns: Patterns, model: Mixture, rounds: int = 8, tolerance: float = 1e-3) -> tuple[DataFrame, float]:
    """Edges with better lengths, and the log likelihood."""
    edges, _, ll = fit(edges, leaves, patterns, model, iterations=rounds, tolerance=tolerance)
    return edges, ll


def likelihood_nni(edges: DataFrame, leaves: int, patterns: Patterns, model: Mixture, *, max_rounds: int | None = None, stop_ratio: float = 0.005,
                   min_gain: float = 1e-3, backbone: DataFrame | None = None, fit_rounds: int = 8, report=None) -> tuple[DataFrame, list[dict]]:
    """Interchanges that raise the likelihood; every accepted round is verified.

    ``edges`` has (u, v, length). The best disjoint interchanges are applied
    together. If the tree gets no better, the half with the larger gains is
    tried, and so on; lengths are fitted after each accepted round.
    """
    edges, ll = fit_lengths(edges, leaves, patterns, model, fit_rounds)
    history: list[dict] = []
    number, stop = 0, None
    while stop is None:
        number += 1
        scored = scan(edges, leaves, patterns, model)
        best = F.greatest("ll1", "ll2")
        proposed = scored.withColumn("choice", F.when(F.col("ll1") >= F.col("ll2"), 1).otherwise(2)).withColumn("gain", best - F.col("ll0")).where(F.col("gain") > min_gain)
        if backbone is not None:
            safe = trees.anchored_frames(scored.select("u", "v", "a", "b", "c", "d"), trees.beyond_counts(edges.select("u", "v"), leaves, backbone)).where("allowed")
            proposed = proposed.join(safe.select("u", "v"), ["u", "v"], "left_semi")
        proposed = cut(proposed.withColumn("order", F.struct((-F.col("gain")).alias("g"), "u", "v")))
        chosen = cut(moves.pick_disjoint(proposed, moves.closed_neighborhood(proposed, trees.directed(edges.select("u", "v")))))
        count, before = chosen.count(), ll
        ranked = cut(global_rank(chosen.withColumn("_g", -F.col("gain")), [], ["_g", "u", "v"], "_rank")) if count else None
        while count:
            trial = cut(moves.apply_interchanges(edges, ranked.where(F.col("_rank") < count)))
            if total(trial, leaves, patterns, model) > ll:
                edges, ll = fit_lengths(trial, leaves, patterns, model, fit_rounds)
                break
            count //= 2
        if not count:
            stop = "no interchange helps"
        elif count / max(leaves - 3, 1) <= stop_ratio:
            stop = "few interchanges"
        elif max_rounds is not None and number >= max_rounds:
            stop = "rounds"
        history.append({"stage": "likelihood", "round": number, "moves": count, "before": before, "after": ll, **({"stop": stop} if stop else {})})
        if report:
            report(history[-1])
    return edges, history
