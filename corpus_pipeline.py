"""A corpus pipeline of five of the operators: language ID, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm import decontamination, language_id, line_dedup, minhash_dedup, packing
from snapweave.llm.scratch import Scratch, released


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages that the lang column knows.

    What goes: texts without letters, of no language for the most part, of scripts that no language has, and of five words or more that are
    less like their languages than any string is. Where lang has no value, nothing is known of languages and all documents stay.
    """
    return language_id.in_known_language(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document (or line) has; one that loses all of its text goes. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.col(out.columns[-1]) == 0) | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more."""
    return minhash_dedup.one_of_each_group(docs, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table, whatever its numbers, names and units."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", in_known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The stages learn, hash and tokenise in ways that SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
