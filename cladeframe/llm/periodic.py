"""Runs of periodic words: stretches that repeat a few words again and again.

A run is a stretch of words with smallest period q (words q apart are equal)
of at least max(6, 4 q) words that cannot be extended. Every word of a run
occurs in it at least four times, so a word that occurs less often within a
segment lies in no run there and splits the segment. Counting and splitting
go on until nothing changes; only segments that survive are scanned by lag.

The scan of a lag q looks at every q-th word alone: a run has three equal
steps in a row among them. So all lags of a segment cost n log n, and only
where three steps agree are the words around compared one by one.

Null and empty texts have no words, no runs and an empty collapsed text.
Repeated rows are treated each on their own; a null id stays null. Other
columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import prepare, text_slices, word_array, word_bounds

SHORTEST, PERIODS = 6, 4  # a run has at least so many words, and so many periods
LEVELS = 64  # of splitting; what is left then is scanned as it is, with the same result
IS_WORD = np.ones(256, bool)
IS_WORD[0x20] = IS_WORD[0x09:0x0E] = False
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def surviving(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the segments in which every word occurs at least ``PERIODS`` times."""
    kinds = int(ids.max()) + 1 if len(ids) else 1
    for _ in range(LEVELS):
        long = ends - starts >= SHORTEST
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        lengths = ends - starts
        segment = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(segment)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        _, which, counts = np.unique(segment * kinds + ids[at], return_inverse=True, return_counts=True)
        often = counts[which] >= PERIODS
        if often.all():
            break
        apart = segment[1:] != segment[:-1]
        first, last = often.copy(), often.copy()
        first[1:] &= ~often[:-1] | apart
        last[:-1] &= ~often[1:] | apart
        starts, ends = at[first], at[last] + 1
    return starts, ends


def _equal_stretch(ids: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The longest [first, last) around ``at`` whose words equal those ``lag`` later."""
    most = len(ids) - lag
    last, step = at, 64
    while last < most:
        unlike = ids[last:min(last + step, most)] != ids[last + lag:min(last + step, most) + lag]
        place = int(unlike.argmax())
        if unlike[place]:
            last += place
            break
        last, step = last + len(unlike), 2 * step
    first, step = at, 64
    while first > 0:
        low = max(first - step, 0)
        unlike = (ids[low:first] != ids[low + lag:first + lag])[::-1]
        place = int(unlike.argmax())
        if unlike[place]:
            first -= place
            break
        first, step = low, 2 * step
    return first, last


def scan_lags(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    found: dict[int, list[tuple[int, int]]] = {}  # period -> (start, end), in order
    for lag in range(1, len(ids) // PERIODS + 1):
        some = ids[::lag]
        same = some[1:] == some[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * lag
        for period in found if len(hits) else ():
            if lag % period == 0 and len(hits):
                # Inside a run whose period divides the lag, the lag is not the smallest period.
                starts, ends = np.array(found[period]).T
                run = np.searchsorted(starts, hits, "right") - 1
                hits = hits[(run < 0) | (ends[run] <= hits + 3 * lag)]
        runs, judged = [], -1
        for at in hits.tolist():
            if at >= judged:
                first, judged = _equal_stretch(ids, lag, at)
                # A run has three steps of its own; one that holds fewer of these is found from them, or is no run of this lag.
                if judged > at + 2 * lag and judged + lag - first >= max(SHORTEST, PERIODS * lag):
                    runs.append((first, judged + lag))
        if runs:
            found[lag] = runs
    return sorted((start, end - start, period) for period, runs in found.items() for start, end in runs)


def runs_of(ids: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each run, its start in the row, length and period) by row, start and period; row i has words of_row[i]:of_row[i + 1]."""
    starts, ends = surviving(ids, of_row[:-1], of_row[1:])
    found = [(a + start, length, period) for a, b in zip(starts.tolist(), ends.tolist()) for start, length, period in scan_lags(ids[a:b])]
    table = np.array(found, np.int64).reshape(-1, 3)
    rows = np.searchsorted(of_row, table[:, 0], "right") - 1
    table[:, 0] -= of_row[rows]
    return rows, table


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` is ordered by start and period. ``collapsed`` is the text with one
    space between words and, of every run, only the first period.
    """
    def run(batches):
        for batch in batches:
            for first, last, octets, offsets in text_slices(batch, "text"):
                starts, ends, of_row = word_bounds(octets, IS_WORD, offsets)
                ids = word_array(octets, IS_WORD, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)
                rows, table = runs_of(ids, of_row)
                kept = np.ones(len(ids), bool)
                for row, (start, length, period) in zip(rows.tolist(), table.tolist()):
                    kept[of_row[row] + start + period:of_row[row] + start + length] = False
                texts = pa.Array.from_buffers(pa.large_string(), last - first, [None, *_joined(octets, offsets, starts, ends, of_row, kept)])
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(rows, np.arange(last - first + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], fields=list(RUN)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(np.diff(of_row), pa.int64()), runs, texts.cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RUNS)


def _joined(octets: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_row: np.ndarray, kept: np.ndarray):
    """Offsets and bytes of the rows' kept words, one space between them."""
    stays = IS_WORD[octets]
    for a, b in zip(starts[~kept].tolist(), ends[~kept].tolist()):
        stays[a:b] = False
    before = np.concatenate(([0], np.cumsum(kept)))[:-1]
    row = np.repeat(np.arange(len(of_row) - 1), np.diff(of_row))
    later = kept & (before > np.concatenate((before, [0]))[of_row[:-1]][row])  # not the row's first kept word
    spaced = octets.copy()
    spaced[starts[later] - 1] = 0x20
    stays[starts[later] - 1] = True
    lengths = np.concatenate(([0], np.cumsum(stays)))
    return pa.py_buffer(lengths[offsets]), pa.py_buffer(spaced[stays])


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text), with a periodic tail in each text whose id asks for one.

    With h the crc32 of the decimal id and g = h // 10: where h % 10 is 0 and
    there are n > 0 words, word i >= a = g % n becomes word a + (i - a) % p,
    p = 1 + (n - a) // (3 + g % 8). Other texts, and those of null ids, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    asked = (h % 10 == 0) & F.col("text").isNotNull()
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(asked, words).alias("w")).withColumn("n", F.size("w"))
    n, g = F.col("n"), F.col("g")
    a = g % n
    placed = split.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))))

    def source(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))

    tail = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", source(i).cast("int")))
    return placed.select("doc_id", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest one, and digests of the runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    b = F.col("longest")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), (-b["l"]).alias("length"), b["period"].alias("period"),
        F.floor(-1000 * b["l"] / b["period"]).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
