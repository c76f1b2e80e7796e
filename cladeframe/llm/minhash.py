"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``groups`` hashes are computed, each hash made of
``width`` minima. A table key is a pair of one hash of either collection, so
``groups ** 2`` tables of ``2 * width`` minima cost ``2 * groups * width``
minima. Documents with the same set of shingles are one class from the start.

A bucket never emits all its pairs: in each round its classes are compared
with one pivot or a few, and linked classes merge; a bucket whose classes are all in
one component is done. The classes of buckets that are then still open meet on
the hashes of one collection, each pair at the first hash they share, and the
join itself compares their sets, so no candidate is left out and only links
come out of it. Every link is confirmed on the full texts.

A document with fewer words than a shingle has is one shingle; one without
words, or null, has none and is linked with nothing. Repeated rows fall into
one class. Rows without an id can be linked, but the smallest id names the
group; a group without ids has a null one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import LOWER, ROW, mix, prepare, row_key, text_slices, word_array, word_bounds
from cladeframe.llm.graph import components
from cladeframe.session import cut, discard, empty

IS_WORD = np.ones(256, bool)
IS_WORD[0x20] = IS_WORD[0x09:0x0E] = False
STEP = np.uint64(0x100000001B3)
SEED = 0x5DEECE66D


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; each distinct one is hashed once, by its bytes as a whole.

    Sums of powers would let words be built that collide whatever the base.
    """
    coded = word_array(low, IS_WORD, starts, ends).dictionary_encode()
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy()]


def shingle_hashes(octets: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle of the rows; a row with fewer words than ``size`` is one shingle."""
    low = LOWER[octets]
    starts, ends, of_row = word_bounds(low, IS_WORD, offsets)
    words = word_hashes(low, starts, ends)
    counts = np.diff(of_row)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = max(len(words) - size + 1, 0)
    chain = np.full(n, np.uint64(size))
    for i in range(size):
        chain = mix(chain * STEP + words[i:i + n])
    whole = rows[:n] == rows[size - 1:]
    short = np.flatnonzero((counts > 0) & (counts < size))
    brief = np.array([_chained(words[of_row[r]:of_row[r + 1]]) for r in short], np.uint64)
    hashes = np.concatenate([chain[whole], brief])
    owner = np.concatenate([rows[:n][whole], short])
    return hashes, owner


def _chained(words: np.ndarray) -> np.uint64:
    out = np.full(1, np.uint64(len(words)))
    for w in words:
        out = mix(out * STEP + w)
    return out[0]


def sketches(docs: DataFrame, size: int, groups: int, width: int) -> DataFrame:
    """(row, doc_id, n_shingles, node, keys): node is the hash of the set, keys the hashes of both collections."""
    seeds = mix(np.arange(1, 2 * groups * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for first, last, octets, offsets in text_slices(batch, "text"):
                hashes, rows = shingle_hashes(octets, offsets, size)
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                fresh = np.ones(len(rows), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                hashes, rows = hashes[fresh], rows[fresh]
                n = np.bincount(rows, minlength=last - first)
                some = np.flatnonzero(n)
                node = np.zeros(last - first, np.uint64)
                keys = np.zeros((last - first, 2 * groups), np.uint64)
                if len(some):
                    at = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                    node[some] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5)), at) + mix(np.bitwise_xor.reduceat(hashes, at)))
                    for g in range(2 * groups):
                        key = np.full(len(some), np.uint64(g + 1))
                        for seed in seeds[g * width:(g + 1) * width]:
                            turned = hashes * seed
                            key = mix(key * STEP + np.minimum.reduceat(turned ^ (turned >> np.uint64(32)), at))
                        keys[some, g] = key
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, 2 * groups, 0)))), pa.int32()),
                    pa.array(keys[n > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).slice(first, last - first) for i in (0, 1)], pa.array(n, pa.int64()),
                    pa.array(node.view(np.int64)), listed], names=["row", "doc_id", "n_shingles", "node", "keys"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_shingles long, node long, keys array<long>")


def _exact_set(text: str, size: int) -> set:
    words = text.encode().lower().split()
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)} - {()}


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (x, y) pairs whose full sets have 100 * intersection >= percent * union."""
    def run(batches):
        name, known = None, set()
        for batch in batches:
            xs, ys, links = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, y in enumerate(ys):
                if y != name:
                    name, known = y, _exact_set(batch.column(3)[i].as_py(), size)
                own = _exact_set(batch.column(2)[i].as_py(), size)
                both = len(own & known)
                if 100 * both >= percent * (len(own) + len(known) - both):
                    links.append((xs[i], y))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in links], pa.int64()) for k in (0, 1)], names=["x", "y"])

    one = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    two = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def hashed_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, members): the distinct shingle hashes of every text, in 32 bits."""
    def run(batches):
        for batch in batches:
            for first, last, octets, offsets in text_slices(batch, "text"):
                hashes, rows = shingle_hashes(octets, offsets, size)
                member = np.unique((rows.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
                ends = np.concatenate(([0], np.cumsum(np.bincount((member >> np.uint64(32)).astype(np.int64), minlength=last - first))))
                short = (member & np.uint64(2**32 - 1)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(short))], names=["node", "members"])

    return texts.select("node", "text").mapInArrow(run, "node long, members array<int>")


def remaining_links(open_: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, groups: int) -> DataFrame:
    """All (x, y) of open nodes in different components that share a table key and whose sets may be alike.

    Nodes meet on the keys of one collection that lead to open buckets, each
    pair at the first key it shares. Shingles of one set may fall together in
    32 bits, so the common ones are bounded from above; a link is never missed.
    """
    nodes = open_.select("node", "root").distinct().join(
        classes.select("node", "n_shingles", F.slice("keys", 1, groups).alias("a"), F.slice("keys", groups + 1, groups).alias("b")), "node")
    crossed = nodes.select("node", "b", F.explode("a").alias("key")).select("node", "key", F.explode("b").alias("_b"))
    leading = crossed.withColumn("bucket", F.xxhash64("key", "_b")).join(open_.select("bucket").distinct(), "bucket", "left_semi").select("node", "key").distinct()
    sets = hashed_sets(texts.join(nodes.select("node"), "node", "left_semi"), size)
    rows = cut(leading.join(nodes.join(sets, "node"), "node"))
    other = rows.select(F.col("key").alias("other_key"), *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "n_shingles", "a", "b", "members")])
    both = F.col("n_shingles") + F.col("other_n_shingles")
    first_shared = F.element_at(F.array_intersect("a", "other_a"), 1) == F.col("key")
    common = F.size(F.array_intersect("members", "other_members")) + F.col("n_shingles") - F.size("members")
    alike = (F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root"))
    alike &= 100 * F.least("n_shingles", "other_n_shingles") >= percent * F.greatest("n_shingles", "other_n_shingles")
    alike &= first_shared & F.arrays_overlap("b", "other_b")
    alike &= (100 + percent) * common >= percent * both
    found = cut(rows.join(other, (F.col("key") == F.col("other_key")) & alike).select(F.col("node").alias("x"), F.col("other_node").alias("y")))
    discard(rows)
    return found


def links(classes: DataFrame, docs: DataFrame, size: int, percent: int, groups: int, pivots: tuple[int, ...]) -> tuple[DataFrame | None, DataFrame | None]:
    """(confirmed (x, y) links that span all components, (node, root)); None where no two classes share a table key.

    ``classes`` holds (node, n_shingles, keys, row).
    """
    keys = classes.select("node", F.posexplode("keys").alias("at", "key"))
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    halves = keys.join(shared, "key").groupBy("node").agg(
        F.collect_list(F.when(F.col("at") < groups, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("at") >= groups, F.col("key"))).alias("b"))
    tables = cut(halves.join(classes.select("node", "n_shingles"), "node")
                 .select("node", "n_shingles", "b", F.explode("a").alias("a")).select("node", "n_shingles", "a", F.explode("b").alias("b"))
                 .select("node", "n_shingles", F.xxhash64("a", "b").alias("bucket")))
    full = tables.groupBy("bucket").count().where("count > 1").select("bucket")
    open_ = cut(tables.join(full, "bucket").withColumn("root", F.col("node")))
    discard(tables)
    if empty(open_):
        return None, None
    involved = open_.select("node").distinct().join(classes.select("node", "row"), "node")
    texts = cut(docs.join(involved, "row").select("node", "text").dropDuplicates(["node"]))
    alike = (100 * F.least("n_shingles", "other_n") >= percent * F.greatest("n_shingles", "other_n")) & (F.col("root") != F.col("other_root"))

    found, roots = None, None
    seed = 0
    for r, several in enumerate((*pivots, 0)):
        if not several:
            pairs = remaining_links(open_, classes, texts, size, percent, groups)
        else:
            # Each seed names one class of every bucket its pivot; a class is compared with one pivot a seed.
            seeds = range(seed, seed + several)
            seed += several
            named = open_.groupBy("bucket").agg(F.array(*[F.min(F.struct(
                F.xxhash64("node", F.lit(k)).alias("h"), F.lit(k).alias("seed"), F.col("node").alias("other"), F.col("n_shingles").alias("other_n"),
                F.col("root").alias("other_root"))) for k in seeds]).alias("p"))
            pairs = (open_.join(named, "bucket").select("node", "n_shingles", "root", F.explode("p").alias("p")).select("node", "n_shingles", "root", "p.*")
                     .where(alike).groupBy("node", "seed").agg(F.min(F.struct("h", "other"))["other"].alias("other")))
            pairs = cut(pairs.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct())
        fresh = cut(verify(pairs, texts, size, percent))
        found = fresh if found is None else found.union(fresh)
        discard(pairs, roots)
        roots = components(found)
        if r == len(pivots):
            break
        placed = open_.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        left = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        still = cut(placed.join(left, "bucket"))
        discard(open_)
        open_ = still
        if empty(open_):
            break
    discard(texts, open_)
    return found, roots


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, groups: int = 15, width: int = 4,
                    pivots: tuple[int, ...] = (1, 1, 4, 8)) -> DataFrame:
    """(row, doc_id, n_shingles, root, component_id, kept) of every document.

    A pair at the limit of 80 percent shares a table key with probability
    (1 - (1 - 0.8 ** width) ** groups) ** 2, 0.9993 at the defaults.
    """
    prepare(docs.sparkSession)
    texts = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = cut(sketches(texts, size, groups, width))
    sets = drawn.where("n_shingles > 0")
    classes = cut(sets.groupBy("node").agg(
        F.min(F.struct("row", "n_shingles", "keys")).alias("first"), F.min("doc_id").alias("least")).select("node", "first.*", "least"))
    _, roots = links(classes, texts, size, percent, groups, pivots)
    named = classes.select("node", "least")
    if roots is not None:
        rooted = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.join(smallest, "root").select("node", "root", "component_id")
    else:
        named = named.select("node", F.col("node").alias("root"), F.col("least").alias("component_id"))
    # Documents without words have no class; each is its own group.
    own = drawn.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("row").alias("root"), F.col("doc_id").alias("component_id"))
    return (sets.join(named, "node").select("row", "doc_id", "n_shingles", "root", "component_id").union(own)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest id, then the smallest row hash.

    All columns stay. Of repeated rows one stays. Documents without words all
    stay, but repeated ones among them only once.
    """
    groups = near_duplicates(docs, size, percent)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias(ROW))
    marked = docs.withColumn(ROW, row_key("doc_id", "text"))
    return marked.join(first, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)
