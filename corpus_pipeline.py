"""From raw documents to packed token ids: each stage reads what the one before has written.

Every stage takes any number of further columns, whatever their names, and all but the last return the columns that they
got; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import decontaminate, mixing, neardup, packing, quality
from veilframe.llm.scratch import MADE, Scratch, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep.

    A null, empty or blank text has too few words and goes; a very long one is measured whole; repeated rows are judged alike,
    rows without an id like others.
    """
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id.

    Texts without words are no copies of each other and stay, as do rows without an id; of equal rows under one id one stays,
    of different texts under one id each is judged for itself.  Very long texts are compared on all their shingles.
    """
    return neardup.drop_near_duplicates(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay; very long ones are searched whole; repeated rows are judged alike, rows without an
    id like others; an empty benchmark, or items without words, let all documents stay.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words have no size and are not taken; a null source is one source, the last; equal rows are units of their own
    whose decisions add up, with an id or without; a document of any length is taken whole, three times at most.
    """
    return mixing.take_mix(docs)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids.

    Null and empty texts have no tokens and stand in no sequence; texts longer than a sequence are split without loss; repeated
    rows are packed each, rows without an id under a null one.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("source mix", source_mix),
    ("packed tokens", packed_tokens),
]

#: Expectation-maximisation, sampling and encoding are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = len(MADE)
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        release(spark, before)  # what the stage needed on its way
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
