"""Packing documents into sequences by a plan over the histogram of piece lengths.

Each task cuts its documents into pieces. Only the number of pieces of each
length (at most ``width`` numbers) reaches the driver, which runs best fit,
longest first, on counts instead of documents: one step places as many equal
pieces as fill all open sequences with the tightest room. Every step is one
row of the plan, and a piece finds its place by its rank within its length.

Ids are those of the JSON tokenizer without special tokens of its own: a
special string that stands in a text is one id, what lies between is encoded
by the rank file of the same vocabulary.

Null text is empty and packs as the closing id alone. Repeated rows are packed
each on their own. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import prepare, spread_rank
from cladeframe.session import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(ranks_path: str, vocabulary_path: str):
    """The byte-level vocabulary as a fast encoder; the added tokens of the JSON file in a text are one id each."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(vocabulary_path, encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def pieces(docs: DataFrame, ranks: str, width: int = 2048, closing: int = 0, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Pieces of every document: its ids and then ``closing``; the first piece of a long one takes the remainder.

    ``ranks`` and ``vocabulary`` name files of the installed vocabulary package, found anew on each executor.
    """

    def run(batches):
        import public_tokenizers

        coder = encoder(public_tokenizers.path(ranks), public_tokenizers.path(vocabulary))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.encode(text.as_py() or "", allowed_special="all")
                ids.append(closing)
                coded = np.array(ids, "<u4")
                first = (len(coded) - 1) % width + 1
                for piece, start in enumerate([0, *range(first, len(coded), width)]):
                    part = coded[start:start + width] if start else coded[:first]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], width: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, pieces a sequence, offset there).

    Sequences that stand equally full are one interval of numbers, so the cost
    follows the number of lengths, not of pieces.
    """
    rows, made = [], 0
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> intervals of sequence numbers

    def put(room: int, first: int, last: int) -> None:
        if room and last > first:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, last))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, last = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first = width, made
                last = made = made + -(-left // (width // length))
            each = room // length  # the tightest sequence stays the tightest until it is full
            full = min(last - first, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, width - room))
                put(room - each * length, first, first + full)
                rank, left, first = rank + full * each, left - full * each, first + full
            if left and first < last:
                rows.append((length, rank, rank + left, first, left, width - room))
                put(room - left * length, first, first + 1)
                rank, left, first = rank + left, 0, first + 1
            put(room, first, last)
    return rows


def pack_pieces(cut_pieces: DataFrame, width: int = 2048) -> DataFrame:
    """Add sequence_id and offset to (doc_id, piece, start, length, ids_crc32)."""
    spark = cut_pieces.sparkSession
    histogram = {r[0]: r[1] for r in cut_pieces.groupBy("length").count().collect()}  # ``width`` rows at most
    steps = spark.createDataFrame(plan(histogram, width) or [(0, 0, 0, 0, 1, 0)],
                                  "length long, low long, high long, first long, each long, base long")
    ranked = spread_rank(cut_pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")
    # The plan has a few rows for each length, whatever the number of pieces.
    at = (F.col("rank") - F.col("low")).alias("at")
    joined = ranked.join(F.broadcast(steps), "length").where("rank >= low AND rank < high").withColumn("at", at)
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(F.col("at") / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.col("at") % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", width: int = 2048) -> DataFrame:
    return pack_pieces(cut(pieces(docs, ranks, width)), width)
