"""Secrets in texts: fixed patterns, and strings that a primed compressor cannot shorten.

Every text is searched for the three base patterns and for candidates, strings
of at least ``LEAST`` characters of the alphabet of keys that begin within
``REACH`` bytes after a sensitive word. A candidate costs the bytes by which
it lengthens the zstandard frame of the text around it, where the compressor
is primed with a dictionary of identifiers. What stands in the dictionary or
nearby costs a few bytes however long it is; a random string costs most of its
length. Candidates that mix digits with letters and cost at least ``COST``
bytes, and ``SHARE`` bytes a character, are reported as kind ``novel`` unless a
base span covers them. Base spans carry their cost too and always stay.

The dictionary has the identifiers of the surroundings of all candidates of
all documents, by the number of distinct surroundings that hold them, so
copies of a text count once; at most ``WORDS`` identifiers reach the driver,
and ``PRIMER`` bytes of them each task. Strings with digits and candidates are
no identifiers, so a secret in many copies stays novel.

Null and empty texts have no spans. Repeated rows are judged each on their
own, a null id stays null, other columns are not read. Spans count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import prepare
from cladeframe.session import cut

KINDS = ("assign", "access", "hex", "novel")  # in the order of equal starts
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")  # of lower-cased bytes
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

SENSITIVE = re.compile(rb"pass|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie|license|access|akia")  # of lower-cased bytes
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{14,}=*")
IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{4,40}(?![A-Za-z0-9+/_=-])")
LEAST, REACH = 15, 64
BEFORE, AFTER = 512, 256  # bytes of the surroundings
COST, SHARE = 12, 0.72
WORDS, PRIMER, LEVEL = 4096, 1 << 15, 9

PLACE = "struct<kind: int, start: long, end: long, value: binary, before: binary, after: binary>"
SPAN = "struct<kind: string, start: long, end: long, cost: long>"


def base_places(octets: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(kind, first byte, byte after the last) of the base patterns; ``low`` is lower-cased."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(low) if m.end() - m.start(1) >= ASSIGN_LEAST]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(octets) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(2, m.start(), m.end()) for m in HEX.finditer(octets)]


def candidate_places(octets: bytes, low: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, first byte, byte after the last) of strings that begin soon after a sensitive word."""
    reached = -1
    for word in SENSITIVE.finditer(low):
        at, limit = max(word.end(), reached), word.end() + REACH
        while at <= limit:
            m = CANDIDATE.search(octets, at, limit + LEAST)
            if not m:
                break
            m = CANDIDATE.match(octets, m.start())  # its end may lie farther
            yield 3, m.start(), m.end()
            at = reached = m.end()


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, places) of every row; a place has its bytes and those around it."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = []
            for text in texts:
                octets = text.as_py() or b""
                low = octets.lower()
                base = base_places(octets, low)
                found = base + [c for c in candidate_places(octets, low) if not any(s <= c[1] and c[2] <= e for _, s, e in base)]
                if not found:
                    rows.append([])
                    continue
                points = np.concatenate(([0], np.cumsum((np.frombuffer(octets, np.uint8) & 0xC0) != 0x80)))
                rows.append([{"kind": kind, "start": int(points[s]), "end": int(points[e]), "value": octets[s:e],
                              "before": octets[max(s - BEFORE, 0):s], "after": octets[e:e + AFTER]} for kind, s, e in found])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                                       ("value", pa.binary()), ("before", pa.binary()), ("after", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "places"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, places array<{PLACE}>")


def identifiers(found: DataFrame, words: int = WORDS) -> list[bytes]:
    """The identifiers of most distinct surroundings, the commonest first."""
    def run(batches):
        for batch in batches:
            names = [w for around in batch.column(0).to_pylist() for w in set(IDENTIFIER.findall(CANDIDATE.sub(b" ", around)))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], names=["word"])

    around = found.select(F.explode("places").alias("p")).select(
        F.concat(F.col("p.before"), F.lit(b"\n"), F.col("p.after")).alias("around")).distinct()
    counts = around.mapInArrow(run, "word binary").groupBy("word").count()
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("count"), "word").limit(words).collect()]


def primer(names: list[bytes], size: int = PRIMER) -> bytes:
    """The dictionary: the commonest names stand at its end, where they are cheapest to point at."""
    return b"\n".join(reversed(names))[-size:]


def compressor(names: bytes):
    import zstandard

    options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(names) < 8:
        return zstandard.ZstdCompressor(**options)
    trained = zstandard.ZstdCompressionDict(names, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=trained, **options)


def cost(coder, before: bytes, value: bytes, after: bytes) -> int:
    """Bytes that ``value`` adds to the frame of the text around it."""
    return len(coder.compress(before + value + after)) - len(coder.compress(before + after))


def is_novel(value: bytes, added: int) -> bool:
    mixed = any(48 <= b <= 57 for b in value) and any(b > 57 for b in value)
    return mixed and added >= COST and added >= SHARE * len(value)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans are (kind, start, end, cost) by start and kind."""
    found = cut(places(docs))
    names = primer(identifiers(found))

    def run(batches):
        coder = compressor(names)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.int64())]))
        for batch in batches:
            rows = []
            for listed in batch.column(1).to_pylist():
                spans = []
                for p in listed:
                    added = cost(coder, p["before"], p["value"], p["after"])
                    if p["kind"] < 3 or is_novel(p["value"], added):
                        spans.append((p["start"], p["kind"], p["end"], added))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "cost": c} for s, k, e, c in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return found.mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def digests(found: DataFrame) -> DataFrame:
    """One row a document: numbers of base spans, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
