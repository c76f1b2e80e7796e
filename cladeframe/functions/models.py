"""Stationary DNA models: names, discrete gamma rates, transition probabilities."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

# Rate classes in the order AC, AG, AT, CG, CT, GT, and name aliases.
RATE_CLASSES = {"JC": "000000", "F81": "000000", "K80": "010010", "HKY": "010010", "TN93": "010020",
                "SYM": "012345", "GTR": "012345"}
ALIASES = {"JC69": "JC", "K2P": "K80", "HKY85": "HKY", "TN": "TN93"}
EQUAL_BASES = {"JC", "K80", "SYM"}
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


@dataclass(frozen=True)
class Model:
    base: str
    classes: str
    frequencies: str  # equal, empirical or ml
    categories: int
    invariant: bool


# One name: a base, then at most one part for the frequencies (F), invariant sites (I) and gamma categories (G).
GRAMMAR = re.compile(r"""
    (?!.*\+(?P<twice>[FIG])\w*(?:\+\w+)*\+(?P=twice))
    (?P<base>[A-Z0-9]+)
    (?=(?:.*\+(?P<bases>F[OQ]?)(?!\w))?)(?=(?:.*\+(?P<fixed>I)(?!\w))?)(?=(?:.*\+(?P<gamma>G(?P<count>\d*))(?!\w))?)
    (?:\+(?:F[OQ]?|I|G\d*))*""", re.X)
FREQUENCIES = {"F": "empirical", "FO": "ml", "FQ": "equal"}


def parse_model(name: str) -> Model:
    """``BASE[+F|+FO|+FQ][+I][+Gk]`` with k categories in 2..16, 4 by default; parts come in any order."""
    parts = GRAMMAR.fullmatch(name.upper())
    base = parts and ALIASES.get(parts["base"], parts["base"])
    if base not in RATE_CLASSES:
        raise ValueError(f"not a DNA model: {name!r}")
    equal = base in EQUAL_BASES
    frequencies = FREQUENCIES[parts["bases"] or ("FQ" if equal else "F")]
    if equal and frequencies != "equal":
        raise ValueError(f"{base} is defined with equal base frequencies: {name!r}")
    categories = int(parts["count"] or 4) if parts["gamma"] else 1
    if parts["gamma"] and categories not in range(2, 17):
        raise ValueError(f"from 2 to 16 rate categories can be had: {name!r}")
    return Model(base, RATE_CLASSES[base], frequencies, categories, bool(parts["fixed"]))


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, series or continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return scale * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def gamma_rates(alpha: float, categories: int) -> np.ndarray:
    """Mean rate of each equally likely gamma category; the rates average one.

    With X of unit scale and mean a, E[X; X < x] = a P(a, x) - a g(x) for
    g(x) = x^a e^-x / Gamma(a + 1). The cuts lie where P(a, x) = i / k, so the
    mean of a category, divided by a, is 1 - k (g(upper) - g(lower)), and g is
    0 at both ends.
    """
    if not (0.02 <= alpha <= 100 and 2 <= categories <= 16):
        raise ValueError(f"no discrete rates for shape {alpha} in {categories} categories")
    edge = [0.0]
    for i in range(1, categories):
        # P(a, .) grows, so the cut is bracketed on a logarithmic scale and halved down to rounding.
        below, above = -700.0, math.log(alpha) + 8
        while above - below > 4e-15 * max(1.0, abs(below)):
            half = 0.5 * (below + above)
            below, above = (half, above) if lower_gamma(alpha, math.exp(half)) * categories < i else (below, half)
            if half in (below, above) and 0.5 * (below + above) == half:
                break
        edge.append(math.exp(alpha * above - math.exp(above) - math.lgamma(alpha + 1)))
    return 1 - categories * np.diff([*edge, 0.0])


def rate_matrix(pi: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Reversible rate matrix with mean rate one."""
    q = np.zeros((4, 4))
    for (i, j), r in zip(PAIRS, rates):
        q[i, j], q[j, i] = r * pi[j], r * pi[i]
    np.fill_diagonal(q, -q.sum(1))
    return q / -(pi * q.diagonal()).sum()


def transitions(q: np.ndarray, pi: np.ndarray, times: np.ndarray) -> np.ndarray:
    """exp(Q t) for many t through the symmetric form of a reversible Q."""
    root = np.sqrt(pi)
    values, vectors = np.linalg.eigh(q * root[:, None] / root[None, :])
    left, right = vectors / root[:, None], vectors.T * root[None, :]
    return np.maximum(np.einsum("ik,tk,kj->tij", left, np.exp(np.multiply.outer(times, values)), right), 0.0)
