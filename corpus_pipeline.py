"""A corpus from raw documents to packed sequences: quality rules, line dedup, near-dedup, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import divergence, line_join, packing, simhash, substrings
from offerloom.llm.arrow import stored


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars after the text was changed, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    # A plain filter would be pushed below the histograms and written out into one vast expression; a numbered row
    # is a bound that filters do not cross.
    judged = divergence.judge(docs).withColumn("q_wall", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("q_wall") >= 0)).select("q_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one."""
    return _measured(line_join.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of four words, fingerprints within 4 bits."""
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of long passages found in an earlier one."""
    return _measured(substrings.without_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences, and their token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("substrings", repeats),
    ("packing", packed),
]

#: Fingerprints and token ids cannot be had in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
