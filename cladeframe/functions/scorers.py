"""Quartet scorers: parameters are tables, evaluation is an Arrow UDF.

No trained parameters exist in this package. The defaults below are small,
synthetic and only reward sites that support a split; pass tables of trained
parameters to use a real model. Parameter tables are bounded (landmarks by
``MAX_LANDMARKS``, layers by ``MAX_WEIGHTS``) before they are shipped to tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.quartet import ORBITS, ORDERS, reordered, within_split_orders
from cladeframe.operators.quartets import KEY
from cladeframe.session import ship_package

MAX_LANDMARKS = 8192
MAX_WEIGHTS = 4_000_000
BANDWIDTH = 0.7


def default_kernel(spark: SparkSession) -> DataFrame:
    """(landmark, z, coefficient): synthetic landmarks in orbit space."""
    def unit(orbit: str) -> list[float]:
        return [1.0 if o == orbit else 0.0 for o in ORBITS]

    flat = [0.0] + [14 ** -0.5] * 14
    return spark.createDataFrame(
        [(0, unit("0011"), 1.0), (1, unit("0101"), -0.25), (2, flat, 0.25)],
        "landmark int, z array<double>, coefficient double")


def default_layers(spark: SparkSession) -> DataFrame:
    """(layer, i, j, w): synthetic network that counts split-supporting patterns.

    Row i = -1 holds the bias of unit j.
    """
    rows = []
    for pattern in range(256):
        s = [(pattern >> shift) & 3 for shift in (6, 4, 2, 0)]
        for j, (a, b, c, d) in ORDERS.items():
            if s[a] == s[b] and s[c] == s[d] and s[a] != s[c]:
                rows.append((0, pattern, j, 1.0))
    rows += [(1, j, j, 40.0) for j in range(3)]
    return spark.createDataFrame(rows, "layer int, i int, j int, w double")


def load_kernel(params: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks under the eight within-split symmetries, and their weights."""
    rows = params.orderBy("landmark").limit(MAX_LANDMARKS + 1).collect()
    if not 0 < len(rows) <= MAX_LANDMARKS:
        raise ValueError(f"kernel parameters need 1..{MAX_LANDMARKS} landmarks")
    z = np.array([r.z for r in rows], dtype=float)
    weight = np.array([r.coefficient for r in rows], dtype=float)
    orders = [reordered(o) for o in within_split_orders()]
    return np.concatenate([z[:, o] for o in orders]), np.tile(weight / len(orders), len(orders))


def kernel_function(params: DataFrame, bandwidth: float = BANDWIDTH):
    """Rows of 15 barycenter values to rows of three kernel scores."""
    landmarks, weights = load_kernel(params)
    reads = [reordered(ORDERS[t]) for t in range(3)]
    squares = (landmarks ** 2).sum(1)

    def values_of(values: np.ndarray) -> np.ndarray:
        columns = []
        for read in reads:
            v = values[:, read]
            gap = (v ** 2).sum(1)[:, None] + squares - 2 * v @ landmarks.T
            columns.append(np.exp(-np.maximum(gap, 0) / (2 * bandwidth ** 2)) @ weights)
        return np.stack(columns, 1)

    return values_of


def histogram_barycenters(counts: np.ndarray) -> np.ndarray:
    """Rows of 256 pattern counts to barycenters of one locus, as in :func:`cladeframe.operators.quartets.barycenter`."""
    return orbit_barycenters(counts @ _PATTERN_ORBITS)


def orbit_barycenters(counts: np.ndarray) -> np.ndarray:
    """The same from rows of 15 orbit counts."""
    orbits = counts.copy()
    orbits[:, 0] = 0.0
    roots = np.sqrt(orbits / np.maximum(orbits.sum(1, keepdims=True), 1))
    norm = np.sqrt((roots ** 2).sum(1, keepdims=True))
    return roots / np.where(norm > 0, norm, 1.0)


def kernel_scores(features: DataFrame, params: DataFrame, bandwidth: float = BANDWIDTH) -> DataFrame:
    """(q.., s0, s1, s2): Gaussian kernel score of each topology.

    ``features`` holds the 15 barycenter columns x0000 .. x0123.
    """
    ship_package(params.sparkSession)
    values_of = kernel_function(params, bandwidth)

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(list(values_of(np.array(x.tolist(), dtype=float).reshape(-1, len(ORBITS)))))

    scored = features.select(*KEY, score(F.array(*[F.col(f"x{o}") for o in ORBITS])).alias("_s"))
    return scored.select(*KEY, *[F.col("_s")[t].alias(f"s{t}") for t in range(3)])


def _pattern_orbits() -> np.ndarray:
    """256 x 15: the orbit of every pattern."""
    table = np.zeros((256, len(ORBITS)))
    for pattern in range(256):
        states = [(pattern >> shift) & 3 for shift in (6, 4, 2, 0)]
        firsts = list(dict.fromkeys(states))
        table[pattern, ORBITS.index("".join(str(firsts.index(s)) for s in states))] = 1
    return table


_PATTERN_ORBITS = _pattern_orbits()


def load_layers(params: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) per layer; the input has 256 units."""
    if params.limit(MAX_WEIGHTS + 1).count() > MAX_WEIGHTS:
        raise ValueError(f"network parameters exceed {MAX_WEIGHTS} rows")
    table = params.toPandas()
    layers, width = [], 256
    for _, part in sorted(table.groupby("layer"), key=lambda item: item[0]):
        out = int(part["j"].max()) + 1
        weight, bias = np.zeros((width, out)), np.zeros(out)
        is_bias = (part["i"] < 0).to_numpy()
        weight[part["i"][~is_bias].to_numpy(), part["j"][~is_bias].to_numpy()] = part["w"][~is_bias]
        bias[part["j"][is_bias].to_numpy()] = part["w"][is_bias]
        layers.append((weight, bias))
        width = out
    if width != 3:
        raise ValueError("the last layer must have three outputs")
    return layers


def network_function(params: DataFrame):
    """Rows of 256 pattern counts to rows of three class probabilities, one third each without any count."""
    layers = load_layers(params)

    def classes(counts: np.ndarray) -> np.ndarray:
        sums = counts.sum(1, keepdims=True)
        x = counts / np.maximum(sums, 1)
        for at, (weight, bias) in enumerate(layers):
            x = x @ weight + bias
            if at + 1 < len(layers):
                x = np.maximum(x, 0)
        return _chances(x, sums)

    def of_sums(inputs: np.ndarray, sums: np.ndarray) -> np.ndarray:
        x = inputs / np.maximum(sums, 1) + layers[0][1]
        for weight, bias in layers[1:]:
            x = np.maximum(x, 0) @ weight + bias
        return _chances(x, sums)

    # The first layer is a sum over sites: its weights, and what follows from (their sums, the number of sites).
    classes.first, classes.of_sums = layers[0][0], of_sums
    return classes


def _chances(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return np.where(sums > 0, x / x.sum(1, keepdims=True), 1.0 / 3.0)


def network_scores(quartets: DataFrame, histogram: DataFrame, params: DataFrame) -> DataFrame:
    """(q.., s0, s1, s2): class probabilities from 256 pattern frequencies.

    A quartet without a jointly observed site carries no information and gets
    one third each.
    """
    ship_package(params.sparkSession)
    classes = network_function(params)

    @F.pandas_udf("array<double>")
    def forward(pattern: pd.Series, count: pd.Series) -> pd.Series:
        x = np.zeros((len(pattern), 256))
        sizes = pattern.map(len).to_numpy()
        if sizes.sum():
            row = np.repeat(np.arange(len(pattern)), sizes)
            x[row, np.concatenate(pattern.to_numpy())] = np.concatenate(count.to_numpy())
        return pd.Series(list(classes(x)))

    lists = histogram.groupBy(*KEY).agg(F.collect_list("pattern").alias("_p"), F.collect_list("n").alias("_n"))
    scored = lists.select(*KEY, forward("_p", "_n").alias("_s"))
    third = F.lit(1.0 / 3.0)
    return quartets.select(*KEY).join(scored, KEY, "left").select(
        *KEY, *[F.coalesce(F.col("_s")[t], third).alias(f"s{t}") for t in range(3)])


def pooled(groups: list[str], rows: DataFrame, scores: list[str], log_opinion: bool = False) -> DataFrame:
    """Mean of the scores per group, or their normalised geometric mean."""
    from cladeframe.functions.evidence import local_weights, safe_log
    if not log_opinion:
        return rows.groupBy(*groups).agg(*[F.avg(s).alias(s) for s in scores])
    logs = rows.groupBy(*groups).agg(*[F.avg(safe_log(F.col(s))).alias(s) for s in scores])
    parts: list[Column] = local_weights([F.col(s) for s in scores])
    return logs.select(*groups, *[p.alias(s) for p, s in zip(parts, scores)])
