"""The corpus pipeline: documents through quality, exact and near duplicates, benchmark leaks and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import forget, stored, table, written
from .decontaminate import without_leaks
from .exact_dedup import exact_filter
from .ngram_join import near_filter
from .quality import quality_filter
from .registry import packed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null text is scored as an empty one, repeated rows stay or go together, an empty table stays empty.
    """
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text but for white space, the longest, then of the least id.

    Of all documents without text one stays, of repeated rows one; an empty table stays empty.
    """
    return exact_filter(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates, one row of each class.

    Documents without a word stay; of repeated rows one does; an empty table stays empty.
    """
    return near_filter(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Documents without text stay, repeated rows stay or go together, an empty table stays empty.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences.

    A document without text is its end token alone, repeated rows are packed each, an empty table gives no pieces.
    """
    return packed(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("decontaminate", leaks), ("packing", packing)]

#: Its first stage is a trained classifier, which SQL can't express; tests hold each stage against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again as the next one's input.

    What a stage wrote for itself, and its input, are deleted once its result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(spark, since=before, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
