"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows it gets and returns
all of their columns, but for the last one, which returns the packed pieces.
An empty table passes through every stage. Null texts go in the first stage,
as do texts without a letter. Columns beside doc_id and text stay as they are;
n_chars follows the text where a stage changes it.

A stage begins by deleting the intermediate tables of the stage before it, but
for those that its own input still reads: write a result before the next stage
is called, as ``run`` does.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import decontam, langid, minhash, packing, suffix
from cladeframe.llm.common import ROW, row_key, table
from cladeframe.session import cut, discard, scratch, sweep


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 6); the model learns from the labelled ones among them."""
    predict = langid.predictor(spark, langid.fit(docs.select("doc_id", "text", "lang")))
    return docs.withColumn(ROW, predict("text")).where(F.col(ROW)["lang_pred"] != langid.UNKNOWN).drop(ROW)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 1)."""
    return minhash.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur elsewhere (operator 10)."""
    return suffix.without_repeats(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item (operator 9)."""
    found = decontam.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("row").alias(ROW)).distinct()
    return docs.withColumn(ROW, row_key("doc_id", "text")).join(hit, ROW, "left_anti").drop(ROW)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens (operator 4)."""
    return packing.pack(docs)


def _swept(stage, scope: str = "pipeline"):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, scope, docs)
        with scratch(scope):
            return stage(spark, docs, sf_dir)

    return run_stage


_PLAIN = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]
STAGES = [(name, _swept(stage)) for name, stage in _PLAIN]

#: Language identification and tokens cannot be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scope = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for number, (_, stage) in enumerate(_PLAIN, 1):
        before, docs = docs, _swept(stage, scope)(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
            discard(before)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
