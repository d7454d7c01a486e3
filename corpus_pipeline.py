"""A corpus pipeline of five stages. Each takes what its predecessor kept and returns a DataFrame.

quality     documents that the quality classifier rejects go
lines       repeated and nearly repeated lines go
copies      of each group of near copies one document stays
mix         sources are brought to their target weights by repetition
pack        documents become pieces of context windows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import line_dedup, mixing, packing, quality_classifier, queries, simhash
from schemaloom.llm.common import checkpointed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of characters, where there is such a column, follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.tempered(docs), copy=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs, queries.tokenizer()))


STAGES = [("quality", quality), ("lines", lines), ("copies", copies), ("mix", mix), ("pack", pack)]
#: Tokenisation and classification can't be written in SQL; the tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
