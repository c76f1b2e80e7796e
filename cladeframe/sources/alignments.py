"""Aligned DNA readers: strict PHYLIP, FASTA, multi-locus PHYLIP blocks, zstd.

Each reader returns rows (position, name, sequence) or, for several loci,
(locus, position, name, sequence). Files are split into lines by Spark; only
the small multi-locus parser looks at a file as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.operators.ordering import running_total
from cladeframe.session import ship_package

# Accepted alignment characters.
DNA = r"^[ACGTRYSWKMBDHVNacgtryswkmbdhvn? .\-]*$"
MIN_TAXA = 4
MAX_TAXA = (2**31 - 1) // 273


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file with their order.

    The order inside a file follows the splits Spark reads, so line numbers
    come from per-partition counts and no file passes through one task.
    """
    from cladeframe.session import cut
    rows = cut(spark.read.text(path).select(
        "value", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
        F.input_file_block_start().alias("_block")))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_block").alias("_start"))
    # One row per input split; splits of a file are ordered by their offset.
    before = Window.partitionBy(F.lit(0)).orderBy("_start", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return rows.join(starts, "_part").select((F.col("_at") + F.col("_shift")).alias("line"), "value")


def decompress_zstd(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a zstd file; a compressed frame is one task's work."""
    ship_package(spark)

    def lines(batches):
        import io

        import pandas as pd
        import zstandard
        for batch in batches:
            for content in batch["content"]:
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)), "utf-8")
                at, block = 0, []
                for text in reader:
                    block.append(text.rstrip("\r\n"))
                    if len(block) == 4096:
                        yield pd.DataFrame({"line": range(at, at + len(block)), "value": block})
                        at, block = at + len(block), []
                if block:
                    yield pd.DataFrame({"line": range(at, at + len(block)), "value": block})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "line long, value string")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return decompress_zstd(spark, path) if path.endswith(".zst") else numbered_lines(spark, path)


def _fail(condition, text: str, value):
    return F.when(condition, F.raise_error(F.lit(text)).cast(value[1])).otherwise(value[0])


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """Strict sequential PHYLIP: header ``taxa sites``, then one row per line."""
    lines = _lines(spark, path).where("trim(value) <> ''")
    header = lines.orderBy("line").limit(1).first()
    parts = header.value.split() if header else []
    if len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise ValueError("PHYLIP starts with two integers: taxa and sites")
    taxa, length = map(int, parts)
    rows = lines.where(F.col("line") > header.line).select(
        F.col("line").alias("position"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ", 2).alias("_p"))
    rows = rows.select("position", F.get("_p", F.lit(0)).alias("name"),
                       F.regexp_replace(F.coalesce(F.get("_p", F.lit(1)), F.lit("")), r"\s", "").alias("sequence"))
    check(rows, taxa, length)
    return rows


def check(rows: DataFrame, taxa: int | None = None, length: int | None = None) -> tuple[int, int]:
    """Reject malformed alignments; returns the numbers of taxa and sites."""
    got = rows.agg(
        F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.min(F.length("sequence")).alias("short"),
        F.max(F.length("sequence")).alias("long"), F.count(F.when(~F.col("sequence").rlike(DNA), 1)).alias("foreign"),
        F.count(F.when(F.col("name").isNull() | (F.col("name") == ""), 1)).alias("unnamed")).first()
    if got.unnamed or got.names != got.n:
        raise ValueError("taxon names must be present and unique")
    if got.foreign:
        raise ValueError("aligned DNA characters expected")
    if got.n < MIN_TAXA or got.n > MAX_TAXA or not got.short:
        raise ValueError(f"between {MIN_TAXA} and {MAX_TAXA} taxa and at least one site required")
    if got.short != got.long or (length is not None and got.short != length):
        raise ValueError("sequences must have the stated, equal length")
    if taxa is not None and got.n != taxa:
        raise ValueError("row count differs from the header")
    return got.n, got.short


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records: wrapped lines joined, upper case, names without spaces."""
    lines = _lines(spark, path).select("line", F.trim("value").alias("value")).where("value <> ''")
    marked = running_total(lines, "line", F.when(F.col("value").startswith(">"), 1).otherwise(0), "record")
    body = F.upper(F.regexp_replace("value", r"\s", ""))
    header = F.col("value").startswith(">")
    rows = marked.groupBy("record").agg(
        F.min("line").alias("position"),
        F.max(F.when(header, F.trim(F.substring("value", 2, 1 << 30)))).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(~header, F.struct("line", body.alias("text"))))), lambda s: s["text"]), "").alias("sequence"))
    bad = rows.where((F.col("record") == 0) | F.col("name").rlike(r"\s") | (F.col("name") == ""))
    if bad.limit(1).count():
        raise ValueError("FASTA records start with a header and a name without spaces")
    rows = rows.select("position", "name", "sequence")
    check(rows)
    return rows


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """FASTA when the first non-blank character is '>', else PHYLIP; .zst is unpacked."""
    first = _lines(spark, path).where("trim(value) <> ''").orderBy("line").limit(1).first()
    if first is None:
        raise ValueError("empty alignment file")
    return read_fasta(spark, path) if first.value.lstrip().startswith(">") else read_phylip(spark, path)


def numeric_order(names: DataFrame) -> DataFrame:
    """Renumber taxa by the first integer in each name iff these are 0..n-1."""
    indexed = names.withColumn("number", F.nullif(F.regexp_extract("name", r"(\d+)", 1), F.lit("")).cast("long"))
    one = indexed.agg(F.count("*").alias("n"), F.countDistinct("number").alias("kinds"),
                      F.min("number").alias("low"), F.max("number").alias("high"))
    good = one.select(((F.col("n") == F.col("kinds")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("good"))
    return indexed.crossJoin(good).select(  # one-row flag
        F.when(F.col("good"), F.col("number")).otherwise(F.col("taxon")).alias("taxon"), "name")


def with_taxa(rows: DataFrame) -> DataFrame:
    """(taxon, name, sequence): file order numbered 0.., then the numeric rule."""
    from cladeframe.operators.ordering import global_rank
    ranked = global_rank(rows, [], ["position"], "taxon")
    return numeric_order(ranked.select("taxon", "name")).join(ranked.select("name", "sequence"), "name").select(
        "taxon", "name", "sequence")


def parse_blocks(text: str) -> list[tuple[int, int, str, str]]:
    """(locus, position, name, sequence) of repeated PHYLIP blocks.

    A block is ``taxa sites`` and its rows: one line per taxon, wrapped
    sequences, a name alone on its line, or interleaved stripes. The
    sequential reading is tried first.
    """
    tokens = [line.split() for line in text.splitlines()]
    lines = [t for t in tokens if t]
    out, at, locus = [], 0, 0

    def is_header(t: list[str]) -> bool:
        return len(t) == 2 and all(x.isdigit() for x in t)

    def sequential(start: int, taxa: int, length: int):
        rows, i = [], start
        for _ in range(taxa):
            if i >= len(lines):
                return None
            name, seq = lines[i][0], "".join(lines[i][1:])
            i += 1
            while len(seq) < length and i < len(lines) and not is_header(lines[i]):
                seq += "".join(lines[i])
                i += 1
            if len(seq) != length:
                return None
            rows.append((name, seq))
        return rows, i

    def interleaved(start: int, taxa: int, length: int):
        if start + taxa > len(lines):
            return None
        rows = [[t[0], "".join(t[1:])] for t in lines[start:start + taxa]]
        i = start + taxa
        while any(len(s) < length for _, s in rows):
            if i + taxa > len(lines):
                return None
            for row, t in zip(rows, lines[i:i + taxa]):
                part = t[1:] if t[0] == row[0] and len(t) > 1 else t
                row[1] += "".join(part)
            i += taxa
        if any(len(s) != length for _, s in rows):
            return None
        return [tuple(r) for r in rows], i

    while at < len(lines):
        if not is_header(lines[at]):
            raise ValueError("expected a block header with taxa and sites")
        taxa, length = map(int, lines[at])
        found = sequential(at + 1, taxa, length) or interleaved(at + 1, taxa, length)
        if found is None or taxa < 1 or length < 1:
            raise ValueError(f"block {locus + 1} does not hold {taxa} rows of {length} sites")
        rows, at = found
        if len({name for name, _ in rows}) != len(rows):
            raise ValueError("taxon names must be unique inside a block")
        out += [(locus, k, name, seq.upper()) for k, (name, seq) in enumerate(rows)]
        locus += 1
    return out


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, locus, position, name, sequence) of multi-locus PHYLIP files, one task per file."""
    ship_package(spark)

    def rows(batches):
        import pandas as pd
        for batch in batches:
            for file, text in zip(batch["file"], batch["value"]):
                parsed = pd.DataFrame(parse_blocks(text), columns=["locus", "position", "name", "sequence"])
                parsed.insert(0, "file", file)
                yield parsed

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(rows, "file string, locus long, position long, name string, sequence string")


def pad_union(blocks: DataFrame) -> DataFrame:
    """Every taxon in every locus; absent taxa are '?' over the locus length.

    The grid of loci and taxa is the output itself.
    """
    sizes = blocks.groupBy("locus").agg(F.max(F.length("sequence")).alias("_len"))
    grid = sizes.crossJoin(blocks.select("name").distinct())
    return grid.join(blocks.select("locus", "name", "sequence"), ["locus", "name"], "left").select(
        "locus", "name", F.coalesce("sequence", F.expr("repeat('?', cast(_len as int))")).alias("sequence"))
