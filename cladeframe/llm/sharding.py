"""Sharding by a minimax contiguous partition: DataFrame functions only.

Rows with equal text form one atomic group. Groups stand in the order of the
MD5 of their text; a shard is a run of groups. The smallest capacity with
which a greedy pass needs no more than the given number of shards is found by
a search over capacities, several at a time, and the cuts of that pass are the
shards. Where one group sets that capacity, a second search finds the smallest
capacity for the others, with every group above it in a shard of its own.
Shards that the pass leaves over halve the largest ones, so none stays empty
while there are groups enough.

Null text counts as empty text of no bytes. An empty table gives an empty
result. Repeated rows each take a slot of their own.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import spread_rank
from cladeframe.session import cut

BLOCK_BITS = 16
CANDIDATES = 255  # capacities tried in one pass


def sized_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("key"))


def _block() -> Column:
    return F.conv(F.substring("key", 1, BLOCK_BITS // 4), 16, 10).cast("int")


class _Prefix:
    """Running sums of the group sizes: blocks on the driver (65,536 at most), groups inside a block as a table."""

    def __init__(self, rows: DataFrame):
        sums = rows.groupBy("key").agg(F.sum("size").alias("weight"))
        inside = Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        self.groups = cut(sums.withColumn("block", _block()).repartitionByRange("block")
                          .withColumn("upto", F.sum("weight").over(inside)))
        blocks = self.groups.groupBy("block").agg(
            F.sum("weight"), F.max("weight"), F.max("key")).orderBy("block").collect()
        self.blocks = [b[0] for b in blocks]
        self.last_key = [b[3] for b in blocks]
        self.starts = [0]
        for b in blocks:
            self.starts.append(self.starts[-1] + b[1])
        self.total = self.starts[-1]
        self.largest = max((b[2] for b in blocks), default=0)

    def reach(self, targets: dict[int, int]) -> dict[int, tuple[int, str | None]]:
        """For each target, the largest running sum not above it and the key of the group that ends there."""
        found, asked = {}, []
        for name, target in targets.items():
            b = bisect_right(self.starts, target) - 1
            if b >= len(self.blocks):
                found[name] = (self.total, self.last_key[-1])
                continue
            found[name] = (self.starts[b], self.last_key[b - 1] if b else None)
            asked.append((name, self.blocks[b], target - self.starts[b], self.starts[b]))
        for name, start, upto, key in self._inside(asked, "upto <= room", F.max):
            found[name] = (start + upto, key)
        return found

    def after(self, positions: dict) -> dict:
        """For each position below the total, the next running sum above it and the key of the group that ends there."""
        asked = []
        for name, p in positions.items():
            b = bisect_right(self.starts, p) - 1
            asked.append((name, self.blocks[b], p - self.starts[b], self.starts[b]))
        return {name: (start + upto, key) for name, start, upto, key in self._inside(asked, "upto > room", F.min)}

    def _inside(self, asked: list[tuple], wanted: str, end) -> list[tuple]:
        """(name, start, upto, key) of the first or last group of a block for each (name, block, room, start)."""
        if not asked:
            return []
        spark = self.groups.sparkSession
        probes = spark.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(n).cast("long").alias("name"), F.lit(b).alias("block"), F.lit(r).cast("long").alias("room"),
                     F.lit(s).cast("long").alias("start")) for n, b, r, s in asked])))
        some = self.groups.where(F.col("block").isin(sorted({a[1] for a in asked})))
        # The probes are CANDIDATES rows at most.
        hits = some.join(F.broadcast(probes), "block").where(wanted)
        return [(r["name"], r["start"], r["m"]["upto"], r["m"]["key"])
                for r in hits.groupBy("name", "start").agg(end(F.struct("upto", "key")).alias("m")).collect()]

    def greedy(self, capacities: list[int], shards: int) -> dict[int, list[tuple] | None]:
        """(running sum, last key) of each shard for each capacity that suffices, None for the others.

        A group above the capacity is a shard of its own.
        """
        at = dict.fromkeys(capacities, 0)
        ends: dict[int, list[tuple]] = {c: [] for c in capacities}
        for _ in range(shards):
            open_ = {c: p + c for c, p in at.items() if p < self.total}
            reached = self.reach(open_)
            reached.update(self.after({c: at[c] for c, (p, _) in reached.items() if p == at[c]}))
            for c, end in reached.items():
                at[c] = end[0]
                ends[c].append(end)
        return {c: ends[c] if at[c] >= self.total else None for c in capacities}

    def smallest(self, short: int, capacity: int, best: list[tuple], shards: int) -> tuple[int, list[tuple]]:
        """(capacity, ends) of the smallest capacity above ``short`` that suffices; ``capacity`` does, with the ends ``best``."""
        while capacity - short > 1:
            step = max(1, -(-(capacity - short) // (CANDIDATES + 1)))
            tried = self.greedy(list(range(short + step, capacity, step))[:CANDIDATES], shards)
            enough = [c for c, e in tried.items() if e is not None]
            if enough:
                capacity, best = min(enough), tried[min(enough)]
            short = max([short, *[c for c, e in tried.items() if e is None and c < capacity]])
        return capacity, best

    def filled(self, ends: list[tuple], shards: int) -> list[tuple]:
        """The largest shards of two or more groups are halved until there are enough."""
        ends, whole = list(ends), set()
        while len(ends) < shards:
            starts = [0, *(p for p, _ in ends)]
            i = max((i for i in range(len(ends)) if ends[i][0] not in whole), key=lambda i: ends[i][0] - starts[i], default=None)
            if i is None:
                break
            low, high = starts[i], ends[i][0]
            end = self.reach({0: (low + high) // 2})[0]
            if end[0] <= low:
                end = self.after({0: low})[0]
            if end[0] >= high:
                whole.add(high)
            else:
                ends.insert(i, end)
        return ends


def cuts(rows: DataFrame, shards: int) -> tuple[list[str], int]:
    """(last key of each shard, smallest capacity)."""
    prefix = _Prefix(rows)
    if not prefix.total:
        return [], 0
    even = -(-prefix.total // shards)
    capacity = low = max(even, prefix.largest)
    best = prefix.greedy([low], shards)[low]
    if best is None:
        # One shard never passes over more than the largest group, so this much always suffices.
        capacity = even + prefix.largest
        capacity, best = prefix.smallest(low, capacity, prefix.greedy([capacity], shards)[capacity], shards)
    elif prefix.largest > even:
        _, best = prefix.smallest(0, capacity, best, shards)
    return [key for _, key in prefix.filled(best, shards)], capacity


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law ``bytes``."""
    rows = sized_rows(docs)
    ends, _ = cuts(rows, shards)
    number = F.lit(0)
    for end in ends[:-1]:
        number = number + F.when(F.col("key") > F.lit(end), 1).otherwise(0)
    placed = rows.withColumn("shard", number.cast("int"))
    ranked = spread_rank(placed, ["shard"], ["doc_id", "key"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
