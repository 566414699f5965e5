"""The corpus pipeline: documents without toxic ones, near copies and secrets, mixed to target weights and packed into windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumflow.llm.mixing import mixed
from vellumflow.llm.neardup import deduplicated
from vellumflow.llm.packing import packed
from vellumflow.llm.secrets import redacted
from vellumflow.llm.shared import deleted, scratch, written
from vellumflow.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, by the labels and all texts of ``docs``.

    Null, empty and blank texts stay. Rows that repeat, also under one doc_id, are judged each by its text. Without labels the built-in lexicons decide. Columns of
    any name stay as they are. An empty table stays empty.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies stays, with all its columns.

    Rows without a doc_id stay; null texts are copies of empty ones, blank texts only of the same. Of rows that repeat a doc_id the one of least text stays. An empty table stays
    empty.
    """
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by the rule's name, and n_chars follows. Null and empty texts stay as they are."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target weights of source, language and topic.

    Texts without a token are never sampled, nulls of source and lang are a value of their own, rows of one doc_id (or without one) share their fate. An empty table
    stays empty.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows: window_id, doc_id, part, start, length, offset; no row for a text without a token, a null doc_id for rows without one."""
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trained classifier nor the packing; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's rows written as Parquet in the shared folder and read again; what a stage needed for itself, and the stage before, are deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch(spark) as own:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept = own.pop()
        own.extend(before)
        deleted(spark, own)
        before = [kept]
    return docs
