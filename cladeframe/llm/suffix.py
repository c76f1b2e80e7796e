"""Removal of byte strings that occur more than once, by a distributed merge sort of suffixes.

Every 200-byte window has an anchor: the place of its least 32-byte gram by
hash, the leftmost of equals. It depends on the window alone, so equal windows
have their anchors at the same place inside, and only suffixes that start at
anchors need to be sorted. Each task sorts the suffixes of its texts, cut off
where the windows of the anchor end, with the bytes before the anchor behind
them. It sends them front-coded, as the length of the prefix shared with the
suffix before and the rest. Suffixes with the same gram go to the same part,
where a loser tree merges the runs. It keeps for each run the prefix that its
head shares with the last output, so known prefixes are never compared again.
Suffixes that are equal throughout repeat all their windows; among the others
of one gram, windows are compared one by one.

Grams that occur once are dropped before, through a filter of fixed size that
lets some of them through but holds back none that repeats. A gram with more
suffixes than ``GROUP`` is not settled in its task: its windows are counted by
Spark instead, with the same result. Equal texts of one task are sorted once.

Null text is empty. Texts shorter than a window keep all their bytes. Repeated
rows are documents of their own, so their windows occur elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import Rolling, mix, prepare, slices_of
from cladeframe.session import cut

U1, U2, SPANS = "__cladeframe_u1__", "__cladeframe_u2__", "__cladeframe_spans__"
GRAM = 32
SCOPE = 8  # bytes before each suffix that name the texts it is compared with
FILTER_BITS = 25  # four megabytes, whatever the size of the corpus
RUN_BYTES = 12 << 20  # a task sorts so much at a time
PART_BYTES = 16 << 20  # text for each part of the merge
GROUP = 1 << 15
BATCH = 2 << 20
PLACE_BITS = np.uint64(32)


def anchors(octets: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, gram hash) of every anchor; a window is named by its start."""
    grams = Rolling(octets).grams(GRAM)
    span = window - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    # The least of (hash, place) in every span, from running minima of blocks in both directions.
    keyed = np.full(-(-len(grams) // span) * span, np.uint64(2**64 - 1))
    keyed[:len(grams)] = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    blocks = keyed.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[:n], ahead[span - 1:span - 1 + n])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(row[:n] == row[window - 1:window - 1 + n])
    at = (least[starts] & np.uint64(2**32 - 1)).astype(np.int64)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    fresh = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.append(fresh[1:], len(starts)) - 1
    return row[starts[fresh]], starts[fresh], starts[last], at[fresh], grams[at[fresh]]


def _scoped(gram: np.ndarray, row: np.ndarray, scope: np.ndarray) -> np.ndarray:
    return mix(gram ^ scope.view(np.uint64)[row])


def repeated_grams(texts: DataFrame, window: int) -> DataFrame:
    """(gram) of all anchors whose gram is an anchor of their scope more than once."""
    def run(batches):
        for batch in batches:
            scope = batch.column(0).to_numpy()
            for first, last, octets, offsets in slices_of(batch.column(1)):
                row, _, _, _, gram = anchors(octets, offsets, window)
                gram, times = np.unique(_scoped(gram, row, scope[first:last]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], names=["gram", "times"])

    return texts.select("scope", "text").mapInArrow(run, "gram long, times int").groupBy("gram").agg(F.sum("times").alias("times")).where("times > 1").select("gram")


def gram_filter(grams: DataFrame) -> np.ndarray:
    """A bit for each hash of FILTER_BITS bits; at most 2**(FILTER_BITS - 6) numbers reach the driver."""
    place = f"shiftrightunsigned(gram, {64 - FILTER_BITS})"
    words = grams.select(F.expr(f"cast(shiftright({place}, 6) AS int)").alias("word"), F.expr(f"shiftleft(1L, cast({place} & 63 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    filled[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return filled.view(np.uint64)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    odd = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (odd.bit_length() + 7) // 8


def front_code(keys: list[bytes], names: list[int], many: list[bool]) -> bytes:
    """A sorted run of distinct keys: for each its name, whether it occurs more than once, shared prefix and rest."""
    shared = [0] + [shared_prefix(a, b) for a, b in zip(keys, keys[1:])]
    rests = [k[s:] for k, s in zip(keys, shared)]
    head = np.zeros((len(keys), 4), "<u4")
    head[:, 0], head[:, 1], head[:, 2], head[:, 3] = names, many, shared, [len(r) for r in rests]
    return np.uint32(len(keys)).tobytes() + head.tobytes() + b"".join(rests)


def decoded(blob: bytes):
    """(key, prefix shared with the key before, name, many) of a front-coded run, one by one."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    head = np.frombuffer(blob, "<u4", 4 * n, 4).reshape(n, 4).tolist()
    at, key = 4 + 16 * n, b""
    for name, many, shared, size in head:
        key = key[:shared] + blob[at:at + size]
        at += size
        yield key, shared, name, many


def merged(runs: list):
    """Merge sorted iterators of (key, shared, ...) with a loser tree.

    Yields (source, item, prefix shared with the item before). ``known[i]`` is
    the prefix that the head of source i shares with the last output: a head
    that shares more comes first, and only heads that share equally much are
    compared, from there on.
    """
    heads = [next(r, None) for r in runs]
    k = 1
    while k < len(runs):
        k *= 2
    heads += [None] * (k - len(heads))
    known, loser = [0] * k, [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two sources."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        p, q, h = x[0], y[0], known[a]
        s = shared_prefix(p, q, h)
        if s < len(q) and (s == len(p) or p[s] < q[s]) or s == len(p) == len(q):
            known[b] = s
            return a, b
        known[a] = s
        return b, a

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    top, prefix = winners[1], 0
    while heads[top] is not None:
        yield top, heads[top], prefix
        heads[top] = following = next(runs[top], None)
        known[top] = following[1] if following else 0
        node, winner = (top + k) // 2, top
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
        top, prefix = winner, known[winner]


def sorted_runs(texts: DataFrame, bits, parts: int, window: int) -> DataFrame:
    """Front-coded runs (kind 0: part, run, blob), places of their suffixes (kind 1: run, name, u1, u2, start) and texts that a task saw more than once (kind 2: u1, u2, start = 0, size)."""
    names = ["kind", "part", "run", "name", "u1", "u2", "start", "size", "blob"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def rows(kind: int, n: int, **columns):
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, np.int32)) if name == "kind" else pa.array(columns[name], t) if name in columns else pa.nulls(n, t)
            for name, t in zip(names, kinds)], names=names)

    def flush(run: int, found: list[tuple], seen: dict):
        found.sort(key=lambda f: (f[0], f[1]))
        keys, many, part, name_of = [], [], [], []
        for f in found:
            if keys and keys[-1] == f[1] and part[-1] == f[0]:
                many[-1] = True
            else:
                part.append(f[0])
                keys.append(f[1])
                many.append(False)
            name_of.append(len(keys) - 1)
        cuts = [i for i in range(len(part)) if not i or part[i] != part[i - 1]] + [len(part)]
        for a, b in zip(cuts, cuts[1:]):
            yield rows(0, 1, part=[part[a]], run=[run], blob=[front_code(keys[a:b], list(range(a, b)), many[a:b])])
        for a in range(0, len(found), 50_000):
            some = found[a:a + 50_000]
            yield rows(1, len(some), run=[run] * len(some), name=name_of[a:a + 50_000], u1=[f[2][0] for f in some], u2=[f[2][1] for f in some], start=[f[3] for f in some])
        again = [(u, size) for u, (size, times) in seen.items() if times > 1 and size >= window]
        if again:
            yield rows(2, len(again), u1=[u[0] for u, _ in again], u2=[u[1] for u, _ in again], start=[0] * len(again), size=[s for _, s in again])

    def run(batches):
        shared = bits.value
        number, found, seen, held = TaskContext.get().partitionId() << 20, [], {}, 0
        for batch in batches:
            u1, u2, scope = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for first, last, octets, offsets in slices_of(batch.column(3)):
                own = []
                for i in range(last - first):
                    u, size = (u1[first + i], u2[first + i]), int(offsets[i + 1] - offsets[i])
                    times = seen.get(u, (size, 0))[1]
                    seen[u] = (size, times + 1)
                    if not times and size >= window:
                        own.append(i)
                if len(own) < last - first:
                    octets = np.concatenate([octets[offsets[i]:offsets[i + 1]] for i in own]) if own else octets[:0]
                    offsets = np.concatenate(([0], np.cumsum([offsets[i + 1] - offsets[i] for i in own]))).astype(np.int64)
                row, low, high, at, gram = anchors(octets, offsets, window)
                gram = _scoped(gram, row, scope[first:last][own])
                place = gram >> np.uint64(64 - FILTER_BITS)
                some = np.flatnonzero((shared[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                part = (mix(gram[some]) % np.uint64(parts)).astype(np.int64)
                raw, named = octets.tobytes(), [int(x).to_bytes(SCOPE, "big", signed=True) for x in scope[first:last][own]]
                ids = [(u1[first + i], u2[first + i]) for i in own]
                for p, r, a, b, c in zip(part.tolist(), row[some].tolist(), low[some].tolist(), high[some].tolist(), at[some].tolist()):
                    right = raw[c:b + window]
                    found.append((p, named[r] + right + raw[a:c][::-1] + bytes((len(right),)), ids[r], a - int(offsets[r])))
                    held += b + window - a
                if held > RUN_BYTES:
                    yield from flush(number, found, seen)
                    number, found, seen, held = number + 1, [], {}, 0
        yield from flush(number, found, seen)

    return texts.select("u1", "u2", "scope", "text").mapInArrow(
        run, "kind int, part int, run long, name long, u1 long, u2 long, start long, size long, blob binary")


def _flags(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every window of the strings, string of each)."""
    octets = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    owner = np.repeat(np.arange(len(strings)), sizes - window + 1)
    starts = np.arange(len(owner)) + owner * (window - 1)
    return Rolling(octets).of(starts, starts + window), owner


def merge_parts(runs: DataFrame, window: int, most: int = GROUP) -> DataFrame:
    """(run, name, first, last, hash, gram): windows first to last of a suffix repeat, or, with a hash, the one window has that hash and is still open."""
    def original(key: bytes) -> bytes:
        middle = SCOPE + key[-1]
        return key[middle:-1][::-1] + key[SCOPE:middle]

    def merge(table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]

        def settle(groups: list[list]):
            """groups: suffixes [key, places, many], two or more of one gram and scope."""
            members = [m for g in groups for m in g]
            strings = [original(m[0]) for m in members]
            hashes, owner = _flags(strings, window)
            value, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
            again = times[inverse] > 1
            first = np.searchsorted(owner, np.arange(len(members)))
            edge = np.flatnonzero(np.diff(np.concatenate(([False], again, [False])).astype(np.int8)))
            # Runs of repeated windows end where a string ends.
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                for m in range(owner[a], owner[b - 1] + 1):
                    if not members[m][2]:
                        tell(members[m][1], max(a, first[m]) - first[m], min(b, first[m + 1] if m + 1 < len(members) else len(owner)) - 1 - first[m])

        def tell(places, a, b, hashed=None, gram=None):
            for run, name in places:
                for column, v in zip(out, (run, name, int(a), int(b), hashed, gram)):
                    column.append(v)

        def leave_open(member):
            hashes, _ = _flags([original(member[0])], window)
            gram = int.from_bytes(hashlib.blake2b(member[0][:SCOPE + GRAM], digest_size=8).digest(), "big", signed=True)
            for w, h in enumerate(hashes.view(np.int64).tolist()):
                tell(member[1][:1], w, w, h, gram)

        group: list[list] = []
        wide = False
        batch, held = [], 0

        def close():
            nonlocal group, wide, batch, held
            for m in group:
                if m[2]:
                    tell(m[1], 0, len(m[0]) - SCOPE - 1 - window)
            if wide:
                for m in group:
                    leave_open(m)
            elif len(group) > 1:
                batch.append(group)
                held += sum(len(m[0]) for m in group)
                if held > BATCH:
                    settle(batch)
                    batch, held = [], 0
            group, wide = [], False

        names = table.column("run").to_pylist()
        sources = [decoded(b.as_py()) for b in table.column("blob")]
        for source, (key, _, name, many), prefix in merged(sources):
            place = (names[source], name)
            if group and prefix == len(key) == len(group[-1][0]):
                group[-1][1].append(place)
                group[-1][2] = True
                continue
            if prefix < SCOPE + GRAM:
                close()
            elif len(group) >= most:
                # Too many to settle here: what is known of them goes on, window by window.
                for m in group[:-1]:
                    if m[2]:
                        tell(m[1], 0, len(m[0]) - SCOPE - 1 - window)
                    leave_open(m)
                group, wide = group[-1:], True
            group.append([key, [place], bool(many)])
        close()
        if batch:
            settle(batch)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("run", "name", "first", "last", "hash", "gram"), out)})

    return runs.select("part", "run", "blob").groupBy("part").applyInArrow(
        merge, "run long, name long, first long, last long, hash long, gram long")


def identified(docs: DataFrame, *scope: str, text: str = "text") -> DataFrame:
    """Add the 128-bit identity of the text (and of the ``scope`` columns) as U1, U2."""
    text = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({U1: F.xxhash64(*scope, text), U2: F.xxhash64(F.octet_length(text), F.lit("second"), *scope, text)})


def repeated_spans(texts: DataFrame, window: int, total: int, most: int = GROUP) -> DataFrame:
    """(U1, U2, SPANS): byte intervals covered by windows that occur elsewhere in texts of the same scope.

    Takes (U1, U2, scope, text) of about ``total`` bytes; texts without such windows are left out.
    """
    spark = texts.sparkSession
    prepare(spark)
    texts = texts.select(F.col(U1).alias("u1"), F.col(U2).alias("u2"), "scope", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)
    bits = spark.sparkContext.broadcast(gram_filter(repeated_grams(texts, window)))
    runs = cut(sorted_runs(texts, bits, parts, window))
    verdicts = cut(merge_parts(runs.where("kind = 0"), window, most))
    open_ = verdicts.where("hash IS NOT NULL")
    again = open_.groupBy("hash", "gram").count().where("count > 1")
    settled = open_.join(again, ["hash", "gram"], "left_semi")
    windows = verdicts.where("hash IS NULL").union(settled.select(*verdicts.columns)).select("run", "name", "first", "last")
    places = runs.where("kind = 1").select("run", "name", "u1", "u2", "start")
    spans = windows.join(places, ["run", "name"]).select(
        "u1", "u2", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + window).alias("b"))
    whole = runs.where("kind = 2").select("u1", "u2", F.col("start").alias("a"), F.col("size").alias("b"))
    return spans.union(whole).groupBy(F.col("u1").alias(U1), F.col("u2").alias(U2)).agg(F.collect_set(F.struct("a", "b")).alias(SPANS))


def _document_spans(docs: DataFrame, window: int, most: int = GROUP) -> DataFrame:
    named = identified(docs.select("text")).withColumn("scope", F.lit(0).cast("long"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return repeated_spans(named, window, total, most)


def joined(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for s in sorted((s["a"], s["b"]) for s in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


MEASURES = "struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string, spans: array<struct<a: long, b: long>>>"


def _measured(text: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for t, s in zip(text, spans):
        octets, digest, at = (t.as_py() or "").encode(), hashlib.sha256(), 0
        runs = joined(s.as_py())
        for a, b in runs:
            digest.update(octets[at:a])
            at = b
        digest.update(octets[at:])
        rows.append({"n_bytes": len(octets), "n_removed": sum(b - a for a, b in runs), "n_spans": len(runs),
                     "kept_sha256": digest.hexdigest(), "spans": [{"a": a, "b": b} for a, b in runs]})
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", span)]))


def _stripped(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The text without the characters all of whose bytes are removed."""
    out = []
    for t, s in zip(text, spans):
        runs = joined(s.as_py())
        if not runs or not t.is_valid:
            out.append(t.as_py())
            continue
        octets, kept, at = t.as_py().encode(), [], 0
        for a, b in runs:
            while b < len(octets) and octets[b] & 0xC0 == 0x80:  # the last character is not all inside
                b -= 1
            while a < b and octets[a] & 0xC0 == 0x80:  # nor the first
                a += 1
            kept.append(octets[at:a])
            at = max(at, b)
        out.append((b"".join(kept) + octets[at:]).decode())
    return pa.array(out, pa.string())


def repeats(docs: DataFrame, window: int = 200, most: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document."""
    spans = _document_spans(docs, window, most)
    marked = identified(docs.select("doc_id", "text")).join(spans, [U1, U2], "left")
    return marked.select("doc_id", F.arrow_udf(_measured, MEASURES)("text", SPANS).alias("m")).select("doc_id", "m.*")


def without_repeats(docs: DataFrame, window: int = 200) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text``; all rows and columns stay, n_chars follows the text."""
    spans = _document_spans(docs, window)
    marked = identified(docs).join(spans, [U1, U2], "left").withColumn("text", F.arrow_udf(_stripped, "string")("text", SPANS))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return marked.drop(U1, U2, SPANS)
