"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item is read in windows of ``window`` consecutive words (a shorter item is
one window). A window can only occur where its rarest shingle occurs, so that
one shingle is the necessary prefix of the window in the order of rarity.
Documents send the places of such shingles only, each with the words around
it; the join is on the shingle, the place must leave room for the whole window
on both sides, and the words are then compared exactly.

Null and empty texts and items have no words and hit nothing. Repeated
documents are reported each, repeated items by their id once. A word may be of
any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import LOWER, UPPER, Rolling, mix, prepare, row_key, text_slices, word_bounds
from cladeframe.session import cut

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
FILTER_BITS = 23  # the filter that documents are read against is one megabyte, however many shingles there are
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def _words(text: str):
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), NOT_WORD), lambda w: w != "")


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words) of every distinct window of every item."""
    listed = items.select("item_id", _words("text").alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - window, F.lit(0))
    return listed.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice("all", i + 1, window))).alias("words")).distinct()


def _shingles(words: str):
    """Shingles of a window: three words each, or all words of a shorter one."""
    size = F.least(F.size(words), F.lit(SHINGLE))
    return F.transform(F.sequence(F.lit(0), F.size(words) - size),
                       lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, size), " ").alias("shingle")))


def _chain(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes from each place."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = mix(out * np.uint64(0x100000001B3) + words[i:i + n])
    return out


def _hashed(shingles: DataFrame) -> DataFrame:
    """Add to distinct (shingle) the ``hash`` that documents use for the same words."""
    def run(batches):
        for batch in batches:
            out = []
            for _, _, octets, offsets in text_slices(batch, "shingle"):
                starts, ends, of_row = word_bounds(octets, IS_WORD, offsets)
                words = Rolling(octets).of(starts, ends)
                out.extend(int(_chain(words[a:b], b - a)[0].view(np.int64)) for a, b in zip(of_row[:-1], of_row[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["shingle", "hash"])

    return shingles.select("shingle").mapInArrow(run, "shingle string, hash long")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Fixed-size bit filter of a table of 64-bit ``hash`` values, gathered as at most 2**17 words of 64 bits."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = hashes.select(F.shiftright(place, 6).alias("word"),
                          F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 AS int))").alias("bit"))
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).collect():
        filled[word] = bits
    return filled.view(np.uint64)


def _scan(docs: DataFrame, bits, sizes: list[int], reach: int, counts: bool) -> DataFrame:
    """Read (row, doc_id, text) against the filter.

    With ``counts``: (hash, times), partial numbers of places. Else one row for
    each place with the words around it, and for each document one row without
    a hash that has its number of words.
    """
    def places(octets, offsets):
        shared = bits.value
        starts, ends, of_row = word_bounds(octets, IS_WORD, offsets)
        hashes = Rolling(octets).of(starts, ends)
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(of_row))
        for size in sizes:
            chain = _chain(hashes, size)
            place = chain >> np.uint64(64 - FILTER_BITS)
            at = np.flatnonzero((shared[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            at = at[row_of[at] == row_of[at + size - 1]]
            yield size, at, chain[at].view(np.int64), row_of[at], starts, ends, of_row

    def count(batches):
        tally: dict[int, int] = {}
        for batch in batches:
            for _, _, octets, offsets in text_slices(batch, "text"):
                for _, _, found, *_ in places(LOWER[octets], offsets):
                    for v, t in zip(*(x.tolist() for x in np.unique(found, return_counts=True))):
                        tally[v] = tally.get(v, 0) + t
            if len(tally) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (tally.keys(), tally.values())], names=["hash", "times"])
                tally = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (tally.keys(), tally.values())], names=["hash", "times"])

    def find(batches):
        names = ["row", "doc_id", "hash", "at", "left", "around", "n_words"]
        for batch in batches:
            keys = [batch.column(0), batch.column(1)]
            for first, last, octets, offsets in text_slices(batch, "text"):
                octets = LOWER[octets]
                raw, n, none = octets.tobytes(), last - first, pa.nulls(last - first, pa.int64())
                sizes_of = np.zeros(n, np.int64)
                for size, at, found, rows, starts, ends, of_row in places(octets, offsets):
                    sizes_of = np.diff(of_row)
                    low = np.maximum(at - (reach - size), of_row[rows])
                    high = np.minimum(at + reach, of_row[rows + 1])
                    around = [[raw[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                              for a, b in zip(low.tolist(), high.tolist())]
                    yield pa.RecordBatch.from_arrays([
                        *[k.take(pa.array(first + rows)) for k in keys], pa.array(found), pa.array(at - of_row[rows]),
                        pa.array(at - low), pa.array(around, pa.list_(pa.string())), pa.nulls(len(at), pa.int64())], names=names)
                if not sizes:
                    sizes_of = np.diff(word_bounds(octets, IS_WORD, offsets)[2])
                yield pa.RecordBatch.from_arrays([*[k.slice(first, n) for k in keys], none, none, none,
                                                  pa.nulls(n, pa.list_(pa.string())), pa.array(sizes_of, pa.int64())], names=names)

    if counts:
        return docs.select("row", "doc_id", "text").mapInArrow(count, "hash long, times long")
    return docs.select("row", "doc_id", "text").mapInArrow(
        find, "row long, doc_id long, hash long, at long, left long, around array<string>, n_words long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = cut(windows(items, window).withColumn("wid", F.md5(F.array_join("words", " "))))
    parts = pairs.select("wid", "words").distinct().select("wid", "words", F.explode(_shingles("words")).alias("s")).select("wid", "words", "s.*")
    coded = cut(_hashed(parts.select("shingle").distinct()))
    sizes = sorted(r[0] for r in pairs.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())  # 3 rows at most

    often = _scan(texts, spark.sparkContext.broadcast(_bitmap(coded)), sizes, window, True)
    often = often.groupBy("hash").agg(F.sum("times").alias("times"))
    ranked = parts.join(coded, "shingle").join(often, "hash", "left").fillna(0, ["times"])
    # The order of rarity: the first shingle of a window in it is the window's prefix.
    index = cut(ranked.groupBy("wid", "words").agg(F.min(F.struct("times", "at", "hash")).alias("first"))
                .select("wid", "words", F.col("first.at").alias("inside"), "first.hash"))

    seen = cut(_scan(texts, spark.sparkContext.broadcast(_bitmap(index)), sizes, window, False))
    start = F.col("left") - F.col("inside")
    hits = cut(seen.where("hash IS NOT NULL").join(index, "hash")
               .where((start >= 0) & (F.slice("around", F.greatest(start, F.lit(0)).cast("int") + 1, F.size("words")) == F.col("words")))
               .select("row", "wid", (F.col("at") - F.col("inside")).alias("start"), F.size("words").alias("length")).distinct())
    # Words inside several windows count once: each window adds what it reaches beyond the windows before it.
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    covered = hits.select("row", "start", "length").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("row", "wid").distinct().join(pairs.select("wid", "item_id"), "wid").groupBy("row").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("names"))
    found = covered.join(named, "row", "left")
    zero = F.lit(0).cast("long")
    return seen.where("hash IS NULL").select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("names").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
