"""From raw documents to packed sequences: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontaminate, lines, near, packing, quality, queries

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Word forms that a worker keeps while it packs: few, since other stages share the workers' memory.
CACHED_WORDS = 100_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go. Null and empty texts are scored too; a score of 0.5 stays."""
    return quality.keep_quality(docs, queries.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats too often go; no document does. Null texts stay null; null sources are one source."""
    return lines.without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest id stays. Texts without words (null
    too) are copies of each other; rows without an id are behind those with one."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain nothing."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences: a row for each piece. A null text is its end alone; no documents give no rows."""
    return packing.pack(docs, queries.TOKENIZER, cached_words=CACHED_WORDS)


STAGES: list[tuple[str, Stage]] = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("packing", pack)]

#: A trained network and a tokenizer can't be put in SQL; tests/llm/test_guarantees.py holds the result against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
