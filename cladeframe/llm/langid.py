"""Language identification with string kernels.

Two texts are as alike as the n-grams of bytes, n = 1 to 3, that both contain:
the blended-spectrum kernel on presence, each n normalised. Nyström landmarks
turn the kernel into a finite map, kernel ridge regression is solved once for
each language against the rest, and the landmarks are folded into one matrix,
so a batch of texts is scored by one matrix product.

The fit takes at most about ``per_language`` labelled texts of each language,
chosen by a hash of the row; whole texts are read both there and in scoring.
Null texts and texts without a letter are ``und`` with score 0, as is
everything where nothing is labelled. Equal texts get equal results. Rows
without an id are never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import LOWER, prepare, row_key, slices_of

UNKNOWN = "und"
WIDTHS = (256, 1 << 13, 1 << 14)  # buckets for n = 1, 2, 3
EDGES = np.cumsum((0, *WIDTHS))
ROWS = 128  # texts in one product
RIDGE = 1e-3


def presence(octets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of n-gram flags for each text."""
    rows = len(offsets) - 1
    flags = np.zeros((rows, EDGES[-1]), bool)
    low = LOWER[octets].astype(np.uint32)
    row_of = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    code = np.zeros(len(low), np.uint32)
    for n, width in enumerate(WIDTHS, 1):
        if len(low) < n:
            break
        code = (code[:len(low) - n + 1] << np.uint32(8)) | low[n - 1:]
        whole = row_of[:len(code)] == row_of[n - 1:]
        bucket = code if n == 1 else (code * np.uint32(2654435761)) >> np.uint32(32 - width.bit_length() + 1)
        flags.reshape(-1)[(row_of[:len(code)] * EDGES[-1] + EDGES[n - 1] + bucket)[whole]] = True
    return flags


def _has_letter(octets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = LOWER[octets]
    ascii_letter = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    wide = np.concatenate(([0], np.cumsum(low >= 128)))
    found = np.diff(ascii_letter[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(wide[offsets]) > 0)):
        found[i] = any(c.isalpha() for c in octets[offsets[i]:offsets[i + 1]].tobytes().decode())
    return found


def _chunks(values: pa.Array):
    for first, last, octets, offsets in slices_of(values):
        for a in range(0, last - first, ROWS):
            cut = offsets[a:min(a + ROWS, last - first) + 1]
            yield octets[cut[0]:cut[-1]], cut - cut[0]


def _normalised(flags: np.ndarray) -> np.ndarray:
    out = flags.astype(np.float32)
    for a, b in zip(EDGES[:-1], EDGES[1:]):
        out[:, a:b] /= np.sqrt(np.maximum(out[:, a:b].sum(1, keepdims=True), 1)) * np.sqrt(len(WIDTHS))
    return out


def learned(docs: DataFrame) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0


class Model:
    """Languages and, for each n-gram bucket, its weight in each language's regression."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return _normalised(flags) @ self.weights + self.bias


def fit(docs: DataFrame, per_language: int = 200, landmarks: int = 32) -> Model:
    """Learn from (doc_id, text, lang); rows that ``learned`` excludes are not read."""
    spark = docs.sparkSession
    prepare(spark)
    known = docs.where(learned(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", row_key("doc_id", "text").alias("row"))
    sizes = known.groupBy("lang").count()
    # Keep a row if its hash lies below its language's share: about per_language rows each.
    share = F.least(F.lit(1.0), F.lit(per_language) / F.col("count"))
    place = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(F.broadcast(sizes), "lang").where(place <= share).select("lang", "row", "text")

    def run(batches):
        for batch in batches:
            packed = [r.tobytes() for c in _chunks(batch.column(2)) for r in np.packbits(presence(*c), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["lang", "row", "bits"])

    rows = sorted(chosen.mapInArrow(run, "lang string, row long, bits binary").collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((EDGES[-1], 0), np.float32), np.zeros(0, np.float32))

    def flags_of(some):
        return np.unpackbits(np.frombuffer(b"".join(r[2] for r in some), np.uint8).reshape(len(some), -1), axis=1)[:, :EDGES[-1]].astype(bool)

    marks = [r for lang in languages for r in [r for r in rows if r[0] == lang][:landmarks]]
    z = _normalised(flags_of(marks))
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    kept = values > values[-1] * 1e-6
    nystrom = vectors[:, kept] / np.sqrt(values[kept])
    mapped = np.concatenate([_normalised(flags_of(rows[i:i + ROWS])) @ z.T for i in range(0, len(rows), ROWS)]).astype(float) @ nystrom
    mapped = np.column_stack([mapped, np.ones(len(mapped))])
    goal = np.array([[1.0 if r[0] == lang else -1.0 for lang in languages] for r in rows])
    solved = np.linalg.solve(mapped.T @ mapped + RIDGE * np.eye(mapped.shape[1]), mapped.T @ goal)
    return Model(languages, (z.T @ (nystrom @ solved[:-1])).astype(np.float32), solved[-1].astype(np.float32))


def predictor(spark, model: Model):
    """Column function: text to struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        model = shared.value
        names, scores = [], []
        for octets, offsets in _chunks(text):
            sure = _has_letter(octets, offsets)
            if not model.languages:
                sure[:] = False
            some = np.flatnonzero(sure)
            best, share = np.zeros(len(sure), int), np.zeros(len(sure))
            if len(some):
                raw = 4 * model.scores(presence(octets, offsets)).astype(float)
                odds = np.exp(raw - raw.max(1, keepdims=True))
                best, share = raw.argmax(1), odds.max(1) / odds.sum(1)
            names.extend(model.languages[b] if s else UNKNOWN for b, s in zip(best, sure))
            scores.extend(np.where(sure, share, 0.0).tolist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, per_language: int = 200) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    model = fit(docs.select("doc_id", "text", "lang"), per_language)
    predict = predictor(docs.sparkSession, model)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.*")
