"""How far the sources of a language diverge in their words, by chunk factorization.

A chunk is a maximal stretch without white space. Tasks gather documents into
blocks and count chunks for each document; a block has one row for each of its
chunks and languages, with the occurrences in each source, the number of
documents and, where these are few, their places in the block. So a very
frequent word has a row a block and no group grows with the corpus.

Every globally distinct chunk is split into its terms once, and the terms are
joined back. The documents of a term's chunks add up to an upper bound of its
own, the chunk with most of them is a lower one. Only where the bound of
``least`` documents lies in between, the places of its chunks, few as they
are, are united and counted.

Each group (language, source) gives each kept term an integer share p of a
billion, smoothed by two, and two groups differ by the sum of
floor((p - q)^2 / (p + q)).

Null text, language and source are ''. Every row of the input is a document of
its own, repeated ones too; ids are not read. An empty table has no groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import UPPER, prepare, slices_of, word_array, word_bounds
from cladeframe.llm.periodic import IS_WORD
from cladeframe.session import cut

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_BYTES, PLACE_BITS = 24 << 20, 18  # a block is closed when it has so much text; at most 2**18 documents
SLOTS = 1 << 20  # of the filter that holds back chunks before a join
WHOLE = 1_000_000_000
TERMS, SOURCES = 1024, 256  # of one comparison task
UNITS = "block long, lang string, chunk string, docs int, places array<int>, by array<long>"


class Block:
    """Documents of one task, gathered until there is enough text."""

    def __init__(self, number: int):
        self.number, self.size, self.rows = number, 0, 0
        self.words: list[pa.Array] = []
        self.places: list[np.ndarray] = []
        self.groups: list[tuple[str, int]] = []

    def add(self, octets: np.ndarray, offsets: np.ndarray, groups: list[tuple[str, int]]) -> None:
        starts, ends, of_row = word_bounds(octets, IS_WORD, offsets)
        self.words.append(word_array(octets, IS_WORD, starts, ends))
        self.places.append(np.repeat(np.arange(self.rows, self.rows + len(groups), dtype=np.int32), np.diff(of_row)))
        self.groups += groups
        self.rows, self.size = self.rows + len(groups), self.size + len(octets)

    def units(self, least: int):
        """One row a chunk and language."""
        names = sorted(set(self.groups))
        number = {name: i for i, name in enumerate(names)}
        mine = np.array([number[g] for g in self.groups], np.int64)
        langs = sorted({lang for lang, _ in names})
        code = {lang: i for i, lang in enumerate(langs)}
        lang_of = np.array([code[lang] for lang, _ in names], np.int64)
        source = np.array([number for _, number in names], np.int64)

        coded = pa.chunked_array(self.words, pa.large_binary()).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        place = np.concatenate(self.places)
        key = (coded.indices.to_numpy().astype(np.int64) * len(names) + mine[place]) << PLACE_BITS | place
        key.sort()
        one = _firsts(key)  # a chunk in a document
        key, counts = key[one], np.diff(np.append(one, len(key)))
        pair = key >> PLACE_BITS
        two = _firsts(pair)  # a chunk in a source
        n = np.add.reduceat(counts, two) if len(two) else counts
        chunk, group = np.divmod(pair[two], len(names))
        outer = _firsts(chunk * len(langs) + lang_of[group])  # a chunk in a language
        bounds = np.append(two[outer], len(key))
        docs = np.diff(bounds)
        few = np.repeat(docs < least, docs)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(outer), self.number)),
            pa.array(langs, pa.string()).take(pa.array(lang_of[group[outer]])),
            coded.dictionary.take(pa.array(chunk[outer])).cast(pa.large_string()).cast(pa.string()),
            pa.array(docs, pa.int32()),
            pa.ListArray.from_arrays(pa.array(_bounds(np.where(docs < least, docs, 0)), pa.int32()),
                                     pa.array(key[few] & ((1 << PLACE_BITS) - 1), pa.int32())),
            pa.ListArray.from_arrays(pa.array(np.append(outer, len(two)), pa.int32()), pa.array(source[group] << 32 | n, pa.int64()))],
            names=["block", "lang", "chunk", "docs", "places", "by"])


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ``values``."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))[:len(values)])


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def numbered(docs: DataFrame) -> DataFrame:
    """(lang, source, number): all groups, numbered inside their language."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return docs.select("lang", "source").distinct().select("lang", "source", place.alias("number"))


def units(docs: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(block, lang, chunk, docs, places, by): chunks of each block; ``by`` has the number of each source << 32 | its occurrences.

    ``places`` lists the documents where there are fewer than ``least``.
    """
    most_bytes, most_rows = BLOCK_BYTES, 1 << PLACE_BITS - 1

    def run(batches):
        made = 0
        block = None
        for batch in batches:
            lang, number = (batch.column(k).to_pylist() for k in (1, 2))
            for first, last, octets, offsets in slices_of(batch.column(0)):
                if block is None:
                    block = Block((TaskContext.get().partitionId() << 32) + made)
                    made += 1
                block.add(octets, offsets, list(zip(lang[first:last], number[first:last])))
                if block.size >= most_bytes or block.rows > most_rows:
                    yield from block.units(least)
                    block = None
        if block is not None:
            yield from block.units(least)

    prepare(docs.sparkSession)
    # Spark sees the size of the written groups and broadcasts them only where they are few.
    return docs.join(groups, ["lang", "source"]).select("text", "lang", "number").mapInArrow(run, UNITS)


def chunk_terms(rows: DataFrame) -> DataFrame:
    """(chunk, terms, langs): every distinct chunk with its terms, repeated ones too or none, and its documents in each language."""
    # Most chunks of a block are in no other block of its task, so sums before the shuffle would not make it smaller.
    sums = rows.select("chunk", "lang", "docs").repartition("chunk").groupBy("chunk", "lang").agg(F.sum("docs").alias("docs"))
    chunks = sums.groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs")).alias("langs"))  # one entry a language
    found = F.regexp_extract_all(F.translate("chunk", UPPER, UPPER.lower()), F.lit(TERM), F.lit(0))
    # No condition on the terms: it would be moved below both sums and split every row of every block.
    return chunks.select("chunk", found.alias("terms"), "langs")


def _held(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` joined with ``wanted`` on language and chunk; a filter of fixed size holds back most others before the shuffle."""
    slot = F.pmod(F.hash("chunk"), F.lit(SLOTS)).alias("slot")
    slots = wanted.select(slot).distinct()  # at most SLOTS numbers
    near = rows.select("lang", "chunk", *columns, slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    return near.join(wanted, ["chunk", "lang"])  # sorted by the chunk first, as rows of a language tie


def kept_terms(rows: DataFrame, chunks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, term) in at least ``least`` documents, (lang, chunk, term) of terms that may be, once an occurrence in the chunk)."""
    each = chunks.select("chunk", F.explode("langs").alias("l"), "terms").select("chunk", "l.lang", "l.docs", "terms")
    bounds = each.select("lang", "docs", F.explode(F.array_distinct("terms")).alias("term")).groupBy("lang", "term").agg(
        F.sum("docs").alias("most"), F.max("docs").alias("some"))
    possible = cut(bounds.where(F.col("most") >= least).select("lang", "term", (F.col("some") >= least).alias("sure")))
    of_chunk = cut(each.select("lang", "chunk", F.explode("terms").alias("term")).join(possible, ["term", "lang"]))
    open_ = of_chunk.where("NOT sure").select("lang", "chunk", "term").distinct()
    # All chunks of an open term have fewer documents than ``least``, so their places are complete.
    united = _held(rows, open_, ["block", "places"]).select("lang", "term", "block", F.explode("places").alias("place")).distinct()
    enough = united.groupBy("lang", "term").count().where(F.col("count") >= least).select("lang", "term")
    return cut(possible.where("sure").select("lang", "term").union(enough)), of_chunk.select("lang", "chunk", "term")


def term_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, source, number) of all groups, (lang, source, term, n) of the kept terms)."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = cut(numbered(plain))
    rows = cut(units(plain, groups, least))
    kept, of_chunk = kept_terms(rows, cut(chunk_terms(rows)), least)
    held = _held(rows, of_chunk.join(kept, ["term", "lang"], "left_semi"), ["by"]).select("lang", "term", F.explode("by").alias("e"))
    counted = held.select("lang", "term", F.shiftright("e", 32).alias("number"), F.col("e").bitwiseAND((1 << 32) - 1).alias("n")).groupBy(
        "lang", "number", "term").agg(F.sum("n").alias("n"))
    return groups, counted.join(groups, ["lang", "number"]).select("lang", "source", "term", "n")


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + 2) / (total + 2 * kept)); exact, whatever the counts."""
    whole = F.lit(WHOLE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", whole, (total + 2 * kept).cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _compare(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the distances of a tile of sources from all sources of the language, over a part of its terms."""
    lang, _, tile = (k.as_py() for k in key)
    names = groups.column("source").to_pylist()
    number = {name: i for i, name in enumerate(names)}
    codes = terms.column("term").combine_chunks().dictionary_encode()
    shares = np.tile(groups.column("floor").to_numpy(), (max(len(codes.dictionary), 1), 1))[:len(codes.dictionary)]
    mine = np.array([number[s] for s in terms.column("source").to_pylist()], np.int64)
    if len(mine):
        shares[codes.indices.to_numpy(), mine] = terms.column("p").to_numpy()
    out: list[tuple[str, str, int]] = []
    for i in np.flatnonzero(groups.column("tile").to_numpy() == tile).tolist():
        own = shares[:, i:i + 1]
        gap = own - shares
        total = (gap * gap // (own + shares)).sum(axis=0)
        out += [(names[i], name, int(v)) for j, (name, v) in enumerate(zip(names, total)) if j != i]
    a, b, v = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(a, pa.string()),
                     "item": pa.array(b, pa.string()), "value": pa.array(v, pa.int64())})


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group.

    Part ``pair`` has the other sources of the language, the most distant
    first; part ``term`` the ``top`` terms that set the group apart from its
    language. Equal values are ordered by item.
    """
    named, counts = term_counts(docs, least)
    counts = cut(counts)
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    known = counts.join(kept, ["term", "lang"])
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(named.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", "number", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")]).withColumn(
        "tile", F.floor(F.col("number") / SOURCES).cast("int")))
    shared = known.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))

    # A language without kept terms still has one part, of zeros.
    parts = F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1))
    part = F.pmod(F.xxhash64("term"), parts).alias("part")
    tiles = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
    copies = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("for")
    floor = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(1).alias("floor")
    left = shared.join(tiles, "lang").select("lang", part, copies, "source", "term", "p")
    right = groups.join(tiles, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "tiles", "source", "tile", floor).select(
        "lang", "part", copies, "source", "tile", "floor")
    pairs = left.groupBy("lang", "part", "for").cogroup(right.groupBy("lang", "part", "for")).applyInArrow(
        _compare, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = shared.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select("*", F.lit("pair").alias("part"), place).select(*columns).union(
        terms.select("*", F.lit("term").alias("part"), place).where(F.col("rank") <= top).select(*columns))
