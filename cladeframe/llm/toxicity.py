"""Toxic passages by maximum-scoring segments.

Every word has the log-odds of toxic against clean text, with a Dirichlet
prior in proportion to its frequency in the whole corpus; words whose log-odds
are not significant only carry a small negative drift. One linear scan finds
all maximal segments of positive score. Their scores follow an extreme-value
law on clean text, whose two constants come from the clean training texts, so
each segment has an expected number of chance passages as high. A logistic fit
turns the best segment and the number of significant ones into a probability.

Words fall into a fixed number of buckets by hash, so tables and model have a
fixed size. Labels come from at most about ``per_class`` texts of each class,
chosen by a hash of the id; counts for the prior cover all texts. Null and
empty texts have no words and no segments. Rows without id or label are scored
but not learned from. Several labels of one document count as toxic if one is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import LOWER, Rolling, prepare, text_slices, word_bounds
from cladeframe.llm.decontam import IS_WORD
from cladeframe.session import cut

BUCKET_BITS = 18
PRIOR = 0.02  # weight of the prior, in words for each labelled word
SIGNIFICANT = 3.0  # standard errors
DRIFT = 0.25
LONGEST_X, MOST_SEGMENTS = 60.0, 20  # where the calibration table ends; beyond it the curve goes on flat


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def _buckets(octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and the first word of every row."""
    low = LOWER[octets]
    starts, ends, of_row = word_bounds(low, IS_WORD, offsets)
    return (Rolling(low).of(starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), of_row


def training_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, toxic, weight) of the chosen training labels, 2 * per_class rows or little more."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = known.groupBy("toxic").count()
    share = F.least(F.lit(1.0), F.lit(per_class) / F.col("count"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return cut(known.join(F.broadcast(sizes), "toxic").where(place <= share).select("doc_id", "toxic", (1 / share).alias("weight")))


def word_counts(docs: DataFrame, chosen: DataFrame) -> np.ndarray:
    """Rows clean, toxic, all; a column for each bucket."""
    def run(batches):
        tally = np.zeros((3, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, octets, offsets in text_slices(batch, "text"):
                words, of_row = _buckets(octets, offsets)
                kind = np.repeat(toxic[first:last], np.diff(of_row))
                for k in (0, 1):
                    tally[k] += np.bincount(words[kind == k], minlength=tally.shape[1])
                tally[2] += np.bincount(words, minlength=tally.shape[1])
        some = np.flatnonzero(tally[2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(t[some]) for t in tally]], names=["bucket", "clean", "toxic", "every"])

    # The labels are bounded by training_labels.
    marked = docs.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("toxic", F.lit(-1)).cast("int").alias("toxic"))
    sums = marked.mapInArrow(run, "bucket long, clean long, toxic long, every long").groupBy("bucket").agg(
        F.sum("clean"), F.sum("toxic"), F.sum("every"))
    out = np.zeros((3, 1 << BUCKET_BITS))
    for bucket, *values in sums.collect():  # a row for each bucket at most
        out[:, bucket] = values
    return out


def word_scores(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """(score of each bucket, scale of the extreme-value law on clean text)."""
    clean, toxic, every = counts
    weight = PRIOR * (clean.sum() + toxic.sum()) + 1
    prior = weight * (every + 0.01) / (every + 0.01).sum()
    odds = []
    for own in (toxic, clean):
        share = (own + prior) / (own.sum() + weight)
        odds.append(np.log(share) - np.log1p(-share))
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    raw = odds[0] - odds[1]
    scores = np.where(np.abs(raw) >= SIGNIFICANT * error, raw, 0.0) - DRIFT
    # The scale is the positive root of E[exp(scale * score)] = 1 on clean text.
    share = (clean + prior) / (clean.sum() + weight)
    low, high = 0.0, 1.0
    if scores.max() <= 0:
        return scores, 1.0
    mean = lambda s: float(share @ np.exp(np.minimum(s * scores, 500)))
    while mean(high) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return scores, max(high, 1e-3)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one sequence, in linear time.

    Between two positive scores only the running sum matters, so the loop
    visits positive places alone. A stack holds the candidates with the sums
    before and after each; a candidate is joined to the nearest earlier one
    that starts lower, if that one ends lower too.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    after = np.cumsum(scores)
    before = after - scores
    stack: list[list] = []  # start, end, sum before, sum after, index of the nearest candidate with a lower sum before
    for i, low, high in zip(places.tolist(), before[places].tolist(), after[places].tolist()):
        start = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append([start, i + 1, low, high, j])
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def scan(docs: DataFrame, scores: np.ndarray) -> DataFrame:
    """(doc_id, n_words, best, passages); passages are (first word, word after the last, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(scores.astype(np.float64))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for first, last, octets, offsets in text_slices(batch, "text"):
                words, of_row = _buckets(octets, offsets)
                values = shared.value[words]
                hot = np.concatenate(([0], np.cumsum(values > 0)))
                some = np.diff(hot[of_row]) > 0
                found = [segments(values[of_row[i]:of_row[i + 1]]) if some[i] else [] for i in range(last - first)]
                listed = pa.array([[{"start": a, "end": b, "score": s} for a, b, s in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(np.diff(of_row), pa.int64()),
                    pa.array([max((s for _, _, s in f), default=0.0) for f in found], pa.float64()), listed], names=["doc_id", "n_words", "best", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, best double, passages array<struct<start: long, end: long, score: double>>")


def _logistic(rows: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Weights of (1, x, segments) by Newton's method on (x, segments, label, weight) rows."""
    w = np.zeros(3)
    if not rows:
        return np.array([-30.0, 0.0, 0.0])
    table = np.array(rows, float)
    design = np.column_stack([np.ones(len(table)), table[:, 0] / 10, np.log1p(table[:, 1])])
    goal, weight = table[:, 2], table[:, 3]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (goal - p)) - 1e-2 * w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, per_class: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every document.

    ``passages`` lists the significant ones: first word, word after the last,
    score, and the number of passages as high that chance would give.
    """
    prepare(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    chosen = training_labels(labels.select("doc_id", "toxic"), per_class)
    weights, scale = word_scores(word_counts(texts, chosen))
    scanned = cut(scan(texts, weights))

    trained = scanned.join(F.broadcast(chosen), "doc_id")
    clean = trained.where("toxic = 0")
    level = clean.agg(F.percentile_approx("best", 0.9, 1000)).first()[0] or 0.0
    above, length = clean.agg(F.sum(F.when(F.col("best") >= level, F.col("weight")).otherwise(0.0)), F.sum(F.col("n_words") * F.col("weight"))).first()
    # Chance passages that reach s in n words: k * n * exp(-scale * s).
    k = max(above or 0.0, 1.0) * math.exp(min(scale * level, 500)) / max(length or 0.0, 1.0) if level else 0.1
    k = min(max(k, 1e-6), 1.0)

    def surprise(s):
        return F.lit(scale) * s - F.log(F.lit(k) * F.greatest(F.col("n_words"), F.lit(1)))

    def features(df: DataFrame) -> DataFrame:
        listed = F.transform(F.filter("passages", lambda p: surprise(p["score"]) > 0), lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), p["score"].alias("score"), F.exp(-surprise(p["score"])).alias("expected")))
        x = F.when(F.col("best") > 0, F.least(F.greatest(surprise(F.col("best")), F.lit(-20.0)), F.lit(LONGEST_X))).otherwise(-20.0)
        return df.withColumn("passages", listed).withColumn("x", x).withColumn("n", F.least(F.size("passages"), F.lit(MOST_SEGMENTS)))

    # At most a few thousand cells reach the driver, however many documents there are.
    cells = features(trained).groupBy(F.round(F.col("x") * 4).alias("x4"), "n", "toxic").agg(F.sum("weight").alias("w"))
    w = _logistic([(r["x4"] / 4, r["n"], r["toxic"], r["w"]) for r in cells.collect()])
    linear = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("x") / 10 + F.lit(float(w[2])) * F.log1p("n")
    return features(scanned).select(
        "doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-linear))).alias("score"), "passages").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "held_out", "score", "predicted", "passages")
