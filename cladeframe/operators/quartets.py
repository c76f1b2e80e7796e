"""Quartet site statistics and the evidence tables built from them.

Quartets are rows (q0, q1, q2, q3). All four taxa meet on (taxon, word), so a
taxon that occurs in many quartets still spreads over the words of its row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import evidence, quartet
from cladeframe.functions.encode import WORD
from cladeframe.session import cut_apart as cut, ship_package

KEY = ["q0", "q1", "q2", "q3"]


def canonical(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """The four taxa in increasing order, without a sort of an array."""
    low1, high1 = F.least(a, b), F.greatest(a, b)
    low2, high2 = F.least(c, d), F.greatest(c, d)
    middle1, middle2 = F.greatest(low1, low2), F.least(high1, high2)
    return [F.least(low1, low2).alias("q0"), F.least(middle1, middle2).alias("q1"),
            F.greatest(middle1, middle2).alias("q2"), F.greatest(high1, high2).alias("q3")]


def quartet_words(quartets: DataFrame, words: DataFrame, count: int) -> DataFrame:
    """Planes of four taxa at every word where all four are present.

    ``count`` is the number of words of the alignment.
    """
    rows = quartets.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("word"))
    for i, q in enumerate(KEY):
        rows = rows.join(words.select(
            F.col("taxon").alias(q), "word", F.col("low").alias(f"l{i}"), F.col("high").alias(f"h{i}"),
            F.col("observed").alias(f"o{i}")), [q, "word"])
    every = F.col("o0").bitwiseAND(F.col("o1")).bitwiseAND(F.col("o2")).bitwiseAND(F.col("o3"))
    return rows.where(every != 0)


def _planes() -> tuple[list[Column], list[Column], list[Column]]:
    return tuple([F.col(f"{k}{i}") for i in range(4)] for k in "lho")


def pattern_histogram(quartets: DataFrame, words: DataFrame, count: int, width: int = WORD) -> DataFrame:
    """(q.., pattern, n): sites per joint state 64*s0 + 16*s1 + 4*s2 + s3.

    Only patterns that occur are listed; a quartet without a shared site has
    no row.
    """
    every = F.col("o0").bitwiseAND(F.col("o1")).bitwiseAND(F.col("o2")).bitwiseAND(F.col("o3"))

    def bit(plane: str) -> Column:
        return F.call_function("shiftright", F.col(plane), F.col("_k")).bitwiseAND(F.lit(1)).cast("int")

    pattern = F.lit(0)
    for i in range(4):
        pattern = pattern * 4 + bit(f"l{i}") + 2 * bit(f"h{i}")
    return (
        quartet_words(quartets, words, count).withColumn("every", every)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        .where(bit("every") == 1)
        .groupBy(*KEY, pattern.alias("pattern")).agg(F.count("*").alias("n"))
    )


PLANES = ("low", "high", "observed")
SLICE = 1 << 22  # sites of quartets that a task compares at once


def score_in_groups(listed: DataFrame, keys: list[str], words: DataFrame, count: int,
                    score: Callable[[np.ndarray], np.ndarray], width: int = WORD, orbits: bool = False) -> DataFrame:
    """``listed`` with s0, s1, s2: ``score`` of the pattern histogram of every row's quartet.

    Quartets of a group share few taxa. A group gets the words of each of its
    taxa once, so neither words nor patterns of single quartets are shuffled.
    ``score`` takes rows of 256 counts as in :func:`pattern_histogram`, or of
    15 counts with ``orbits``, and returns three columns; without a shared
    site all counts are zero.
    """
    ship_package(listed.sparkSession)
    asked = listed.where(" AND ".join(f"{q} IS NOT NULL" for q in KEY))
    rows = word_lists(words, count)
    own = [f"_{k}" for k in keys]
    members = asked.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.explode(F.array(*KEY)).alias("taxon")).distinct().join(rows, "taxon")
    names = listed.columns

    def run(table: pa.Table, leaves: pa.Table) -> pa.Table:
        rows = word_planes(leaves, count) if orbits else site_codes(leaves, count, width)
        taxa = leaves["taxon"].to_numpy()
        order = np.argsort(taxa)
        quartets = np.stack([table[q].to_numpy() for q in KEY])
        # A taxon without any word stands behind the others, where nothing is observed.
        at = np.searchsorted(taxa[order], quartets)
        known = at < len(taxa)
        known[known] = taxa[order][at[known]] == quartets[known]
        at = np.where(known, np.append(order, len(taxa))[at], len(taxa))
        step = max(1, SLICE // (count * width))
        counted = count_orbits if orbits else count_patterns
        found = [score(counted(rows, at[:, i:i + step])) for i in range(0, at.shape[1], step)]
        scores = np.concatenate(found) if found else np.zeros((0, 3))
        return pa.table([*[table[n] for n in names], *[pa.array(scores[:, t]) for t in range(3)]], names=[*names, "s0", "s1", "s2"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema], "s0 double, s1 double, s2 double"])
    return asked.groupBy(*keys).cogroup(members.groupBy(*own)).applyInArrow(run, schema)


def word_lists(words: DataFrame, count: int) -> DataFrame:
    """(taxon, word, low, high, observed): the words of every taxon as lists."""
    listed = F.collect_list(F.struct("word", *PLANES)).alias("_w")
    return words.where(F.col("word").between(0, count - 1)).groupBy("taxon").agg(listed).select(
        "taxon", *[F.col("_w")[c].alias(c) for c in ("word", *PLANES)])


def scored(predict, listed: DataFrame, keys: list[str]) -> DataFrame:
    """``listed`` with s0, s1, s2 of a predictor, by groups where it can use them."""
    if hasattr(predict, "in_groups"):
        return predict.in_groups(listed, keys)
    listed = cut(listed)
    return listed.join(predict(cut(listed.select(*KEY).distinct())), KEY)


def site_codes(leaves: pa.Table, count: int, width: int = WORD) -> np.ndarray:
    """State 0..3 of every leaf and site as bytes, 4 where nothing is observed; one more row without any."""
    planes = word_planes(leaves, count)
    low, high, seen = ((plane[..., None] >> np.arange(width)) & 1 for plane in planes)
    return np.where(seen == 1, low + 2 * high, 4).astype(np.uint8).reshape(len(leaves) + 1, -1)


def word_planes(leaves: pa.Table, count: int) -> np.ndarray:
    """(plane, leaf, word): low, high and observed bits of every leaf; one more leaf without any."""
    planes = np.zeros((3, len(leaves) + 1, count), dtype=np.int64)
    for i in range(len(leaves)):
        at = np.array(leaves["word"][i].as_py(), dtype=np.int64)
        for plane, name in zip(planes, PLANES):
            plane[i, at] = leaves[name][i].as_py()
    return planes


def count_orbits(planes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Jointly observed sites per orbit of the quartets whose four leaves are the columns of ``at``, whole words at a time."""
    low, high, seen = ([plane[row] for row in at] for plane in planes)
    every = seen[0] & seen[1] & seen[2] & seen[3]
    differ = {(i, j): (low[i] ^ low[j]) | (high[i] ^ high[j]) for i in range(4) for j in range(i + 1, 4)}
    # As in quartet.orbit_masks: earlier taxa of the same class are represented by the first one.
    masks = {"0": every}
    for j in range(1, 4):
        longer = {}
        for orbit, mask in masks.items():
            for state in map(str, range(len(set(orbit)) + 1)):
                part = mask
                for i in range(j):
                    if orbit.index(orbit[i]) == i:
                        part = part & (~differ[i, j] if orbit[i] == state else differ[i, j])
                longer[orbit + state] = part
        masks = longer
    return np.stack([np.bitwise_count(masks[orbit]).sum(1, dtype=np.int64) for orbit in quartet.ORBITS], 1).astype(float)


def count_patterns(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Histograms of 256 joint states of the quartets whose four rows of ``codes`` are the columns of ``at``."""
    a, b, c, d = (codes[row] for row in at)
    every = (a < 4) & (b < 4) & (c < 4) & (d < 4)
    pattern = ((a.astype(np.int64) * 4 + b) * 4 + c) * 4 + d + 256 * np.arange(len(a))[:, None]
    return np.bincount(pattern[every], minlength=256 * len(a)).reshape(-1, 256).astype(float)


ORDERED = 1 << 24  # whole numbers that single precision adds without error


def order_class(x: np.ndarray, y: np.ndarray, taxa: list[np.ndarray]) -> np.ndarray:
    """:func:`cladeframe.functions.quartet.pair_class` over arrays."""
    rank = [sum((t > o).astype(np.int8) for o in taxa) for t in (x, y)]
    low, high = np.minimum(*rank), np.maximum(*rank)
    if (high == 0).any():
        raise ValueError("a quartet holds a taxon twice")
    return np.where(low == 0, high - 1, np.where(low == 1, np.where(high == 2, 2, np.where(high == 3, 1, 0)), 0))


def against_triples(codes: np.ndarray, query: np.ndarray, asked: np.ndarray, triples: np.ndarray, taxa: np.ndarray, classes) -> np.ndarray:
    """(query, triple, 3): scores of query and t0, t1 and t2 against the other two, for all pairs of a query and a triple.

    ``query`` and ``triples`` are rows of ``codes``, ``asked`` and ``taxa``
    the taxa there. With the triple given, each site and state of the query
    adds a known row of the first layer, so the sums of all pairs are one
    product of matrices: the states of the queries times these rows.
    """
    weights = np.concatenate([classes.first, np.ones((256, 1))], 1)
    sites, width = codes.shape[1], weights.shape[1]
    whole = np.array_equal(weights, np.round(weights)) and np.abs(weights).max() * sites < ORDERED
    kind = np.float32 if whole else np.float64
    weights = np.concatenate([weights, np.zeros((1, width))]).astype(kind)
    states = (codes[query][:, None, :] == np.arange(4)[:, None]).reshape(len(query), -1).astype(kind)
    order = np.argsort(taxa, axis=1, kind="stable")
    a, b, c = (codes[np.take_along_axis(triples, order[:, i:i + 1], 1)[:, 0]].astype(np.int64) for i in range(3))
    seen = (a < 4) & (b < 4) & (c < 4)
    place = (asked[:, None, None] > taxa).sum(2)
    out = np.zeros((len(query), len(triples), width), kind)
    for p in np.unique(place):
        some = np.flatnonzero((place == p).any(0))
        steps = [4 ** (3 - i) for i in range(4) if i != p]
        base = a[some] * steps[0] + b[some] * steps[1] + c[some] * steps[2]
        pattern = np.where(seen[some], base, 256)[:, None, :] + np.where(seen[some], 4 ** (3 - p), 0)[:, None, :] * np.arange(4)[:, None]
        rows = weights[pattern.reshape(len(some), -1)].transpose(1, 0, 2).reshape(4 * sites, -1)
        found = (states @ rows).reshape(len(query), len(some), width)
        out[:, some] = np.where((place[:, some] == p)[..., None], found, out[:, some])
    flat = out.reshape(-1, width).astype(float)
    scores = classes.of_sums(flat[:, :-1], flat[:, -1:]).reshape(len(query), len(triples), 3)
    own = np.broadcast_to(asked[:, None], place.shape)
    others = [np.broadcast_to(taxa[:, i], place.shape) for i in range(3)]
    index = np.stack([order_class(own, t, [own, *others]) for t in others], 2)
    return np.take_along_axis(scores, index, 2)


def block_histogram(quartets: DataFrame, cells: DataFrame, blocks: int) -> DataFrame:
    """The same histogram per site block ``site % blocks``."""
    rows = None
    for i, q in enumerate(KEY):
        part = cells.where("state < 4").select(F.col("taxon").alias(q), "site", F.col("state").alias(f"s{i}"))
        rows = quartets.select(*KEY).join(part, q) if rows is None else rows.join(part, [q, "site"])
    pattern = ((F.col("s0") * 4 + F.col("s1")) * 4 + F.col("s2")) * 4 + F.col("s3")
    return rows.groupBy(*KEY, (F.col("site") % blocks).cast("int").alias("block"), pattern.alias("pattern")).agg(
        F.count("*").alias("n"))


def orbit_counts(quartets: DataFrame, words: DataFrame, count: int, loci: DataFrame | None = None,
                 width: int = WORD) -> DataFrame:
    """(q.., locus, o0000 .. o0123): jointly observed sites per orbit.

    Without ``loci`` the whole alignment is locus 0. A word that crosses a
    locus border is counted once per locus under the mask of its sites.
    """
    masks = quartet.orbit_masks(*_planes())
    rows = quartet_words(quartets, words, count)
    if loci is None:
        rows = rows.withColumn("locus", F.lit(0).cast("long")).withColumn("inside", F.lit(-1).cast("long"))
    else:
        rows = rows.join(locus_words(loci, width), "word")
    return rows.groupBy(*KEY, "locus").agg(
        *[F.sum(F.bit_count(m.bitwiseAND(F.col("inside")))).cast("long").alias(f"o{orbit}") for orbit, m in masks.items()])


def locus_words(loci: DataFrame, width: int = WORD) -> DataFrame:
    """(locus, word, inside): the sites of a locus as a mask in each word it touches."""
    touched = loci.where("end > start").select(
        "locus", "start", "end", F.explode(F.sequence(
            F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("word"))
    first = F.greatest(F.col("start") - F.col("word") * width, F.lit(0))
    last = F.least(F.col("end") - F.col("word") * width, F.lit(width))
    # Site k of a word is bit width-1-k: sites first..last-1 are bits width-last..width-1-first.
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), (last - first).cast("int")) - 1
    mask = F.call_function("shiftleft", ones, (F.lit(width) - last).cast("int"))
    return touched.select("locus", F.col("word").cast("long").alias("word"), mask.alias("inside"))


def orbit_rows(counts: DataFrame) -> DataFrame:
    """Wide orbit counts as rows (q.., locus, orbit, n)."""
    parts = [F.struct(F.lit(o).alias("orbit"), F.col(f"o{o}").alias("n")) for o in quartet.ORBITS]
    keys = [c for c in counts.columns if not c.startswith("o0")]
    return counts.select(*keys, F.explode(F.array(*parts)).alias("_o")).select(*keys, "_o.orbit", "_o.n")


def barycenter(counts: DataFrame) -> DataFrame:
    """(q.., x0000 .. x0123): Hellinger mean of the loci, unit length.

    Constant sites are dropped, every locus is scaled to mass one, square
    roots are summed over loci and the sum is scaled to length one. A locus
    without varying sites adds nothing.
    """
    varying = quartet.ORBITS[1:]
    mass = sum((F.col(f"o{o}") for o in varying[1:]), F.col(f"o{varying[0]}"))
    roots = counts.withColumn("_mass", mass).groupBy(*KEY).agg(*[
        F.sum(F.when(F.col("_mass") > 0, F.sqrt(F.col(f"o{o}") / F.col("_mass"))).otherwise(F.lit(0.0))).alias(f"r{o}")
        for o in varying])
    square = sum((F.col(f"r{o}") * F.col(f"r{o}") for o in varying), F.lit(0.0))
    norm = F.when(F.col("_square") > 0, F.sqrt("_square")).otherwise(F.lit(1.0))
    return roots.withColumn("_square", square).select(
        *KEY, F.lit(0.0).alias("x0000"), *[(F.col(f"r{o}") / norm).alias(f"x{o}") for o in varying])


def all_barycenters(quartets: DataFrame, words: DataFrame, count: int, loci: DataFrame | None = None) -> DataFrame:
    """Barycenters of every listed quartet; quartets without shared sites are zero."""
    found = barycenter(orbit_counts(quartets, words, count, loci))
    return quartets.select(*KEY).join(found, KEY, "left").na.fill(0.0)


def missing_quartets(proposed: DataFrame, known: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Proposed quartets without evidence yet, once each; with ``carry``, columns of one of its rows."""
    return proposed.select(*KEY, *carry).dropDuplicates(KEY).join(known.select(*KEY), KEY, "left_anti")


def merge_evidence(known: DataFrame, added: DataFrame) -> DataFrame:
    """Known and added scores with ``is_new``; overlap is an error."""
    columns = [*KEY, "s0", "s1", "s2"]
    both = known.select(*columns).withColumn("is_new", F.lit(False)).unionByName(
        added.select(*columns).withColumn("is_new", F.lit(True)))
    once = both.groupBy(*KEY).agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("s0", "s1", "s2", "is_new")])
    clash = F.raise_error(F.lit("new evidence overlaps known quartets")).cast("boolean")
    return once.withColumn("is_new", F.when(F.col("_n") > 1, clash).otherwise(F.col("is_new"))).drop("_n")


def edge_means(mapped: DataFrame) -> DataFrame:
    """Mean of the three topology scores over the quartets of an edge."""
    return mapped.groupBy("u", "v").agg(
        F.count("*").alias("quartets"), *[F.avg(f"t{i}").alias(f"t{i}") for i in range(3)])


def stream_gains(classified: DataFrame) -> DataFrame:
    """Per edge, score changes of both alternatives summed over its quartets.

    ``classified`` has (cls, alt1, u, v, s0, s1, s2); rows without an edge do
    not contribute.
    """
    scores = F.array("s0", "s1", "s2")
    current = F.element_at(scores, F.col("cls") + 1)
    first = F.element_at(scores, F.col("alt1") + 1)
    second = F.element_at(scores, F.lit(4) - F.col("cls") - F.col("alt1"))
    return classified.where("u is not null").groupBy("u", "v").agg(
        F.sum(first - current).alias("gain1"), F.sum(second - current).alias("gain2"), F.count("*").alias("active"))


def evidence_totals(classified: DataFrame) -> DataFrame:
    """Objective over all quartets, its new part, active rows and magnitude."""
    scores = F.array("s0", "s1", "s2")
    current = F.element_at(scores, F.col("cls") + 1)
    return classified.agg(
        F.coalesce(F.sum(current), F.lit(0.0)).alias("objective"),
        F.coalesce(F.sum(F.when(F.col("is_new"), current)), F.lit(0.0)).alias("new_objective"),
        F.count("u").alias("active"),
        F.coalesce(F.sum(F.greatest(F.abs("s0"), F.abs("s1"), F.abs("s2"))), F.lit(0.0)).alias("magnitude"))


def species_support(edges: DataFrame, classified: DataFrame) -> DataFrame:
    """Per edge: vote shares, mean margin and display value of its quartets.

    A three-way tie is uninformative, a two-way tie splits its vote. Edges
    without an informative quartet have NULL values, never zero.
    """
    scores = F.array("s0", "s1", "s2")
    ordered = classified.where("u is not null").select(
        "u", "v", F.element_at(scores, F.col("cls") + 1).alias("w0"),
        F.element_at(scores, F.col("alt1") + 1).alias("w1"),
        F.element_at(scores, F.lit(4) - F.col("cls") - F.col("alt1")).alias("w2"))
    w = [F.col(f"w{i}") for i in range(3)]
    wins = evidence.winners(w)
    rows = ordered.withColumn("win", F.array(*wins)).withColumn(
        "tied", F.element_at("win", 1) + F.element_at("win", 2) + F.element_at("win", 3))
    informative = F.col("tied") < 3
    votes = [F.sum(F.when(informative, F.element_at("win", i + 1) / F.col("tied")).otherwise(F.lit(0.0))) for i in range(3)]
    summed = rows.groupBy("u", "v").agg(
        F.count("*").alias("active"), F.count(F.when(informative, 1)).alias("informative"),
        F.count(F.when(F.col("tied") == 2, 1)).alias("ties"),
        F.avg(F.when(informative, w[0] - F.greatest(w[1], w[2]))).alias("margin"),
        *[v.alias(f"_v{i}") for i, v in enumerate(votes)])
    decided = F.col("informative") > 0
    return edges.select("u", "v").join(summed, ["u", "v"], "left").select(
        "u", "v", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("active", "informative", "ties")],
        *[F.when(decided, F.col(f"_v{i}") / F.col("informative")).alias(f"vote{i}") for i in range(3)],
        F.col("margin"), evidence.margin_index(F.col("margin")).alias("value"))


def gene_support(rows: DataFrame) -> DataFrame:
    """Local topology weights times 100 from (u, v, base, delta1, delta2)."""
    weights = evidence.local_weights([F.col("base"), F.col("delta1"), F.col("delta2")])
    gap = F.col("base") - F.greatest("delta1", "delta2")
    return rows.select("u", "v", (100 * weights[0]).alias("value"),
                       *[w.alias(f"weight{i}") for i, w in enumerate(weights)], gap.alias("gap"))
