"""A training corpus from raw documents: five stages, each of which calls one operator and writes what it keeps.

Every stage takes null, empty and long texts, rows that repeat, null ids, more columns of any name, and empty tables, with
the result that its operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, ngram_join, packing, pii, quality, suffix_dedup


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, counted anew, and the columns of like."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the forest takes for anomalous go."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of least doc_id."""
    return ngram_join.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand anywhere else too are cut out; where a cut parts a character, its bytes
    become U+FFFD."""
    cut = suffix_dedup.remove_repeats(docs, suffix_dedup.PASSAGE, least_words=suffix_dedup.PASSAGE_WORDS)
    return _with_text(cut.withColumn("text", F.when(F.col("text").isNotNull(), suffix_dedup.kept_text())), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by a mark that names its kind."""
    return _with_text(pii.redact(docs), docs)


def power_of_two_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents whose lengths are powers of two, with their token ids.

    Slices are a quarter as large as else, as the executors still hold what the stages before have left in memory.
    """
    return packing.pack(docs, slice_bytes=common.SLICE_BYTES // 4)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("personal_data", personal_data),
    ("power_of_two_packing", power_of_two_packing),
]

#: SQL can express neither a forest of random splits nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
