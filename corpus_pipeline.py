"""A corpus from raw documents to packed training sequences, in five stages; each gets the rows that the one before it kept.

quality_rules and quality_classifier drop the documents they reject, near_dedup keeps one document of each group of near-duplicates,
decontamination drops documents that hold a benchmark item, packing returns the token pieces and their places in sequences.
Each stage sends whole texts to Python, and so has light batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quirespark.llm import decontaminate, near_dedup, quality_classifier, quality_rules
from quirespark.llm.common import light_batches, passing, written
from quirespark.llm.queries import pack_documents, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def light(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        light_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@light
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


@light
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on rated documents of the whole table, since the rules have dropped most of low quality; scores what is left."""
    return quality_classifier.keep_clean(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@light
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


@light
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@light
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: No SQL: the stages fit a model, link fingerprints and encode with a tokenizer. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is a written table that the next one reads. What a stage writes on its way is deleted when it is done."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), name)
    return docs
