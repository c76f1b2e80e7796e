"""Operators over alignment cells (taxon, site, state) and sequence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import encode
from cladeframe.functions.encode import MISSING, WORD
from cladeframe.functions.hashing import add_mix32
from cladeframe.operators.ordering import global_rank

CHUNK = 1 << 16  # sites per exploded piece of a sequence row


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(taxon, at, piece): pieces of whole sequences, dealt over tasks by taxon and place.

    One pass cuts a sequence; only its pieces go on, so a long row costs what
    its length costs and is encoded by many tasks.
    """
    pieces = rows.select("taxon", F.posexplode(F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("_c", "_p"))
    return pieces.repartition("taxon", "_c").select(
        "taxon", (F.col("_c").cast("long") * size).alias("at"), encode.clean(F.col("_p")).alias("piece"))


def cells_of(rows: DataFrame) -> DataFrame:
    """Long form (taxon, site, state) of sequence rows, missing states kept."""
    return (
        chunks(rows)
        .select("taxon", "at", F.posexplode(F.split("piece", "")).alias("_i", "_c"))
        .where("_c <> ''")
        .select("taxon", (F.col("at") + F.col("_i")).alias("site"), encode.state_of(F.col("_c")).alias("state"))
    )


def words_of(rows: DataFrame, width: int = WORD) -> DataFrame:
    """Bit planes (taxon, word, low, high, observed) straight from sequence text.

    Sixty sites become three integers with string functions, without a row
    per character.
    """
    size = CHUNK // width * width
    return (
        chunks(rows, size)
        .select("taxon", F.floor(F.col("at") / width).alias("_at"),
                F.posexplode(F.regexp_extract_all("piece", F.lit(f".{{1,{width}}}"), F.lit(0))).alias("_w", "_p"))
        .select("taxon", "_at", "_w", F.rpad("_p", width, "N").alias("_p"))
        .select("taxon", (F.col("_at") + F.col("_w")).alias("word"), encode.low_plane(F.col("_p")).alias("low"),
                encode.high_plane(F.col("_p")).alias("high"), encode.observed_plane(F.col("_p")).alias("observed"))
    )


def words_of_cells(cells: DataFrame, width: int = WORD) -> DataFrame:
    """Bit planes of long-form cells; one partial aggregate per word."""
    bit = encode.site_bit(F.col("site"), width)
    zero = F.lit(0).cast("long")
    state = F.col("state")
    return (
        cells.where(state < MISSING)
        .groupBy("taxon", F.floor(F.col("site") / width).cast("long").alias("word"))
        .agg(
            F.bit_or(F.when(state % 2 == 1, bit).otherwise(zero)).alias("low"),
            F.bit_or(F.when(state >= 2, bit).otherwise(zero)).alias("high"),
            F.bit_or(bit).alias("observed"),
        )
    )


def observed(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("state") < MISSING)


def pack_nibbles(cells: DataFrame) -> DataFrame:
    """(taxon, byte, value): two sites per byte, odd tails padded as missing."""
    def half(odd: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("site") % 2 == odd, F.col("state"))), F.lit(MISSING))

    return (
        cells.groupBy("taxon", F.floor(F.col("site") / 2).cast("long").alias("byte"))
        .agg(encode.pack_pair(half(0), half(1)).alias("value"))
    )


def unpack_nibbles(packed: DataFrame, length: int) -> DataFrame:
    return (
        packed.select("taxon", "byte", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("odd"))
        .select("taxon", (F.col("byte") * 2 + F.col("odd")).alias("site"),
                encode.nibble(F.col("value"), F.col("odd")).alias("state"))
        .where(F.col("site") < length)
    )


def select_sites(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """Keep the listed sites and number them 0.. in order."""
    numbered = global_rank(sites.select("site").distinct(), [], ["site"], "new_site")
    return cells.join(numbered, "site").select("taxon", F.col("new_site").alias("site"), "state")


def sample_sites(cells: DataFrame, cap: int, seed: int) -> DataFrame:
    """Seeded sample of ``cap`` distinct sites without replacement; all when fewer."""
    keyed = add_mix32(cells.select("site").distinct(), f"site * 2 + {seed}", "_key")
    return keyed.orderBy("_key", "site").limit(cap).select("site")


def site_profile(cells: DataFrame) -> DataFrame:
    """Per site: observed rows, states seen, all-missing and raw-constant flags."""
    state = F.col("state")
    return cells.groupBy("site").agg(
        F.count(F.when(state < MISSING, 1)).alias("observed"),
        F.count("*").alias("rows"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), state)).alias("states"),
    )


def drop_constant_sites(cells: DataFrame, taxa: int) -> DataFrame:
    """Drop raw-constant sites, where missing counts as a state, and renumber.

    An absent cell is a missing state, so a site with fewer rows than taxa
    also holds the missing state.
    """
    absent = F.when(F.col("rows") < taxa, F.lit(1 << MISSING)).otherwise(F.lit(0))
    keep = site_profile(cells).where(F.bit_count(F.col("states").bitwiseOR(absent)) > 1).select("site")
    return select_sites(cells, keep)


def drop_constant_sites_by_block(cells: DataFrame, taxa: int, blocks: int) -> DataFrame:
    """The same filter with the stratum ``site % blocks`` of each kept site."""
    absent = F.when(F.col("rows") < taxa, F.lit(1 << MISSING)).otherwise(F.lit(0))
    keep = site_profile(cells).where(F.bit_count(F.col("states").bitwiseOR(absent)) > 1)
    keep = keep.select("site", (F.col("site") % blocks).cast("int").alias("block"))
    numbered = global_rank(keep, ["block"], ["site"], "new_site")
    return cells.join(numbered, "site").select("block", "taxon", F.col("new_site").alias("site"), "state")


def evidence_totals(cells: DataFrame) -> DataFrame:
    """Variable, observed and jointly observed sites and observed bases."""
    profile = site_profile(observed(cells))
    return profile.agg(
        F.count(F.when(F.bit_count("states") >= 2, 1)).alias("variable_sites"),
        F.count("*").alias("observed_sites"),
        F.count(F.when(F.col("observed") >= 2, 1)).alias("jointly_observed_sites"),
        F.coalesce(F.sum("observed"), F.lit(0)).cast("long").alias("observed_bases"),
    )


def missing_per_taxon(taxa: DataFrame, cells: DataFrame, length: int) -> DataFrame:
    """Missing sites of every listed taxon; one without any cell misses them all."""
    counted = observed(cells).groupBy("taxon").agg(F.count("*").alias("_seen"))
    missing = F.lit(length) - F.coalesce("_seen", F.lit(0))
    return taxa.select("taxon").join(counted, "taxon", "left").select(
        "taxon", missing.cast("long").alias("missing"), (missing / F.lit(length)).alias("fraction"))


def unobserved_taxa(taxa: DataFrame, cells: DataFrame) -> DataFrame:
    """Taxa without a single observed state; must be empty for inference."""
    return taxa.select("taxon").join(observed(cells).select("taxon").distinct(), "taxon", "left_anti")


def base_frequencies(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """State counts and shares, over everything or per ``by`` columns."""
    by = by or []
    state = F.col("state")
    counts = observed(cells).groupBy(*by).agg(
        *[F.count(F.when(state == k, 1)).alias(f"n{k}") for k in range(4)], F.count("*").alias("_all"))
    parts = [F.struct(F.lit(k).alias("state"), F.col(f"n{k}").alias("n")) for k in range(4)]
    return (
        counts.select(*by, "_all", F.explode(F.array(*parts)).alias("_s"))
        .select(*by, "_s.state", "_s.n", (F.col("_s.n") / F.col("_all")).alias("share"))
    )


def column_hashes(cells: DataFrame) -> DataFrame:
    """(site, h): 62-bit hash of every column, the same whatever the order of its cells.

    Equal columns have equal hashes, so the hash can group columns; it never
    proves that two columns are equal.
    """
    keyed = observed(cells).select("site", (F.col("taxon").cast("long") * 8 + F.col("state")).alias("_x"))
    keyed = add_mix32(add_mix32(keyed, "_x", "_a"), "_x * 31 + 17", "_b")
    return keyed.groupBy("site").agg(F.bit_xor(F.expr("shiftleft(_a & 2147483647L, 31) | (_b & 2147483647L)")).alias("h"))


HEALTH = {
    "variable_sites": "no site varies, so the topology cannot be told; a balanced tree stands in",
    "jointly_observed_sites": "no site is observed in two taxa, so nothing can be compared",
    "compared_pairs": "no two taxa share a site; their distances are placeholders",
    "usable_triplets": "no triplet informs the gamma shape; its value is a fallback",
}


def health(cells: DataFrame, by: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Counts of usable evidence in each group of ``by`` columns, with a list of warnings.

    ``extra`` adds counts of the same groups, such as usable_triplets; a
    count of zero that is listed in ``HEALTH`` gives a warning.
    """
    columns = observed(cells).groupBy(*by, "site").agg(F.count("*").alias("c"), F.countDistinct("state").alias("k"))
    rows = columns.groupBy(*by).agg(
        F.count(F.when(F.col("k") > 1, 1)).alias("variable_sites"), F.count(F.when(F.col("c") > 1, 1)).alias("jointly_observed_sites"),
        F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0)).alias("compared_pairs"))
    if extra is not None:
        rows = rows.join(extra, by, "left")
    told = [F.when(F.col(name) == 0, F.lit(text)) for name, text in HEALTH.items() if name in rows.columns]
    return rows.withColumn("warnings", F.array_compact(F.array(*told)))


# Class of a column, 0..3 constant base, 4 all missing, 5 variable.
ALL_MISSING, VARIABLE = 4, 5


def site_patterns(cells: DataFrame) -> DataFrame:
    """Identical columns once, with multiplicity, first site and column class.

    The grouping key is the exact column: (taxon, state) pairs in taxon
    order, missing states left out. A column has at most one entry per taxon.
    Hot columns combine before the shuffle.
    """
    state = F.col("state")
    columns = (
        cells.groupBy("site")
        .agg(
            F.array_sort(F.collect_list(F.when(state < MISSING, F.struct("taxon", "state")))).alias("column"),
            F.bit_or(F.when(state < MISSING, F.call_function("shiftleft", F.lit(1), state)).otherwise(0)).alias("_seen"),
        )
    )
    code = (
        F.when(F.col("_seen") == 0, ALL_MISSING).when(F.bit_count("_seen") > 1, VARIABLE)
        .otherwise(F.round(F.log2(F.col("_seen").cast("double"))))
    )
    return (
        columns.groupBy("column", "_seen")
        .agg(F.count("*").alias("weight"), F.min("site").alias("first_site"))
        .select("column", "weight", "first_site", code.cast("int").alias("inv_code"))
    )


def fold_patterns(chunked: DataFrame) -> DataFrame:
    """Merge patterns of several chunks: weights add, the first site represents."""
    return chunked.groupBy("column", "inv_code").agg(
        F.sum("weight").alias("weight"), F.min("first_site").alias("first_site"))


def assign_loci(cells: DataFrame, loci: DataFrame, block: int = 4096) -> DataFrame:
    """Locus of every cell for half-open intervals [start, end).

    Each interval is listed once per site block it touches, so the range
    condition becomes an equality on the block. A cell outside all loci is an
    error, not a loss.
    """
    touched = loci.where(F.col("end") > F.col("start")).select(
        "locus", "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("_at"))
    inside = (F.col("_block") == F.col("_at")) & (F.col("site") >= F.col("start")) & (F.col("site") < F.col("end"))
    placed = cells.withColumn("_block", F.floor(F.col("site") / block)).join(touched, inside, "left")
    lost = F.raise_error(F.concat(F.lit("site outside all loci: "), F.col("site").cast("string")))
    return placed.withColumn("locus", F.coalesce("locus", lost.cast(loci.schema["locus"].dataType))).drop("_block", "_at", "start", "end")
