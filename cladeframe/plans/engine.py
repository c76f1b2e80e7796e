"""From an alignment file to a tree: the staged inference of both tasks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe import config
from cladeframe.functions import evidence as evidence_weights
from cladeframe.functions import models, scorers
from cladeframe.functions.encode import WORD
from cladeframe.operators import quartets, sites, trees
from cladeframe.plans import joining, likelihood_search, placement, refine
from cladeframe.session import cut_apart as cut
from cladeframe.sources import alignments, manifest, newick


def infer(spark: SparkSession, source: str, out: str, task: str, *, settings: dict | None = None,
          loci: str | None = None, stop_ratio: float | None = None, rounds: int | None = None, kernel: DataFrame | None = None,
          layers: DataFrame | None = None, support: bool = True, report=None) -> dict:
    """Infer a tree and write ``newick``, ``edges`` and ``support`` tables under ``out``.

    Parameter tables of trained scorers may be given; without them the
    synthetic defaults are used. Gene trees end with the likelihood stage: a
    model fit, verified interchanges, branch lengths and edge support.
    """
    settings = config.normalize(settings, task)
    if task == "gene" and loci is not None:
        raise ValueError("loci are for species trees")
    if stop_ratio is not None and rounds is not None:
        raise ValueError("stop ratio and rounds exclude each other")
    if stop_ratio is not None and not 0 <= stop_ratio < 1:
        raise ValueError("stop ratio must be in [0, 1)")
    rows = cut(alignments.with_taxa(alignments.read_alignment(spark, source)))
    n, length = alignments.check(rows)
    names = rows.select(F.col("taxon").alias("node"), "name")
    cells = cut(sites.cells_of(rows))
    if sites.unobserved_taxa(rows.select("taxon"), cells).limit(1).count():
        raise ValueError("a taxon has no observed state")
    words, count = cut(sites.words_of(rows).where("observed <> 0")), -(-length // WORD)
    join = joining.JoinOptions(**settings["apnj"])
    model = joining.MODELS[join.distance_model]
    edges, evidence = joining.apnj(cells, n, length, join, report), None
    regions = None
    if loci is not None:
        regions = cut(manifest.boundaries(manifest.read_manifest(spark, loci)))
        manifest.check_tiling(regions, length)
    history, labels = [], None
    for stage in (s for s in settings["stages"] if s["enabled"]):
        common = {"max_rounds": rounds or stage["max_rounds"],
                  "stop_ratio": stage["stop_ratio"] if stop_ratio is None else stop_ratio, "report": report}
        if stage["id"] == "distance":
            alpha = joining.shape_of(words, n)[0]
            common["stop_ratio"] = stage["stop_ratio"]
            common["max_rounds"] = stage["max_rounds"]
            edges, steps = refine.distance_nni(edges, n, words, model, alpha, representatives=stage["representatives"],
                                               min_gain=stage["min_gain"], **common)
        elif stage["id"] == "mlp":
            varying = cut(sites.words_of_cells(sites.drop_constant_sites(cells, n)))
            predict = refine.network_predictor(varying, count, layers or scorers.default_layers(spark))
            common["stop_ratio"], common["max_rounds"] = stage["stop_ratio"], stage["max_rounds"]
            edges, steps = refine.network_nni(edges, n, predict, representatives=stage["representatives"],
                                              min_margin=stage["min_margin"], **common)
        elif stage["id"] == "kernel":
            predict = refine.kernel_predictor(words, count, kernel or scorers.default_kernel(spark), regions)
            edges, evidence, steps = refine.kernel_nni(edges, n, predict, min_gain=stage["min_gain"], **common)
        elif stage["id"] == "likelihood":
            patterns = likelihood_search.Patterns.of(cells, n)
            parsed = models.parse_model(stage["model"])
            edges, mixture, fitted = likelihood_search.fit(edges.withColumn("length", F.lit(START_LENGTH)), n, patterns, starting_mixture(cells, parsed),
                                                           parsed.classes, parsed.invariant, stage["optimizer_iterations"])
            edges, steps = likelihood_search.likelihood_nni(edges, n, patterns, mixture, min_gain=stage["min_gain"], **common)
            steps = [{"stage": "model", "rates": mixture.rates, "alpha": mixture.alpha, "invariant": mixture.invariant, "after": fitted}, *steps]
            if support:
                lls = likelihood_search.scan(edges, n, patterns, mixture)
                weights = evidence_weights.local_weights([F.col(f"ll{t}") for t in range(3)])
                labels = cut(lls.select("u", "v", weights[0].alias("support")))
        history += steps
    write_tree(edges, n, names, out, labels)
    if labels is not None:
        labels.write.parquet(f"{out}/support")
    if support and evidence is not None:
        inner = edges.where((F.col("u") >= n) & (F.col("v") >= n))
        quartets.species_support(inner, refine.classified_evidence(edges, n, evidence)).write.parquet(f"{out}/support")
    result = {"task": task, "taxa": n, "sites": length, "history": history, "settings": settings, "quality": quality(history), "health": health_of(cells)}
    spark.createDataFrame([(json.dumps(result),)], "value string").coalesce(1).write.text(f"{out}/result")
    return result


def health_of(cells: DataFrame) -> dict:
    """Counts of usable evidence in the whole alignment, and warnings where one is zero."""
    found = sites.health(cells.withColumn("run", F.lit(0)), ["run"]).drop("run").first()
    return found.asDict() if found else {"warnings": list(sites.HEALTH.values())[:3]}


START_LENGTH = 0.1


def starting_mixture(cells: DataFrame, model: models.Model) -> likelihood_search.Mixture:
    """Equal rates, shape one and a tenth of invariant sites where the model has them; observed base frequencies."""
    shares = {r.state: r.share for r in sites.base_frequencies(cells).collect()}  # four rows
    pi = [0.25] * 4 if model.frequencies == "equal" else [max(float(shares.get(k) or 0.0), 1e-6) for k in range(4)]
    return likelihood_search.Mixture([p / sum(pi) for p in pi], alpha=1.0 if model.categories > 1 else None,
                                     categories=model.categories, invariant=0.1 if model.invariant else 0.0)


def quality(history: list[dict]) -> dict:
    """Whether every search of the run came to its own end, and what stopped those that did not."""
    last = {}
    for step in history:
        if "moves" in step:
            last[step["stage"]] = step
    stopped = {stage: step.get("stop", "rounds") for stage, step in last.items()}
    early = {stage: why for stage, why in stopped.items() if why in ("rounds", "guard")}
    return {"search_converged": not early, "stopped_by": stopped, "warnings": [f"{stage}: ended by {why}" for stage, why in early.items()]}


def write_tree(edges: DataFrame, n: int, names: DataFrame, out: str, support: DataFrame | None = None) -> None:
    """``edges`` may have lengths; ``support`` is (u, v, support) of inner edges."""
    nodes = cut(trees.rooted(edges.select("u", "v"), n))
    edges.write.parquet(f"{out}/edges")
    above = nodes.where("parent IS NOT NULL").select("node", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    lengths = above.join(edges, ["u", "v"]).select("node", "length") if "length" in edges.columns else None
    labels = None if support is None else above.where(F.col("node") >= n).join(support, ["u", "v"]).select("node", F.format_string("%.4f", "support").alias("label"))
    newick.to_newick(nodes, names, lengths, labels).write.text(f"{out}/newick")


def complete(edges: DataFrame, leaves: int, missing: list[int], predict, **options) -> tuple[DataFrame, list[dict]]:
    """Place missing taxa one after another on a backbone of leaves 0..leaves-1.

    Missing taxa are numbered leaves, leaves + 1, ... in placement order. Leaf
    numbers must stay below inner numbers, so inner nodes move up by one for
    every placed taxon.
    """
    choices = []
    for query in missing:
        if query != leaves:
            raise ValueError("missing taxa must be numbered after the backbone leaves, in order")
        edges, choice = placement.place(edges, leaves, query, predict, (-1, -2), **options)
        top = 2 * leaves - 2
        shift = [F.when(F.col(x) == -1, leaves).when(F.col(x) == -2, top + 1).when(F.col(x) >= leaves, F.col(x) + 1)
                 .otherwise(F.col(x)) for x in ("u", "v")]
        edges = cut(edges.select(F.least(*shift).alias("u"), F.greatest(*shift).alias("v")))
        leaves += 1
        choices.append(choice)
    return edges, choices
