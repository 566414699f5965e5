"""Whole jobs over files: each reads, computes and writes, and gives back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.operators import evaluate, runs, search, stats
from vellumflow.sources import codecs


def create_dictionary(docs: DataFrame, target: str) -> DataFrame:
    """The occurrence dictionary of a folder's documents, as a file ``value;occurence``."""
    codecs.write_dictionary(stats.dictionary(docs), target)
    return codecs.read_dictionary(docs.sparkSession, target)


def calc_oov(words: DataFrame, known: DataFrame) -> float:
    """The share of all occurrences in ``words`` whose term another dictionary lacks."""
    return stats.unknown_mass(words, known).first()["oov_mass"]


def run_kws(docs: DataFrame, queries: DataFrame, target: str) -> DataFrame:
    """The hits of a table of queries in the documents' lines, as a table by query."""
    hits = search.table_hits(search.line_table(docs), queries)
    hits.write.mode("overwrite").parquet(target)
    return docs.sparkSession.read.parquet(target)


def create_queries_and_truth(docs: DataFrame, target: str, min_len: int = 1, max_len: int = 0, min_occ: int = 1, max_occ: int = -1) -> tuple[DataFrame, DataFrame]:
    """Keywords by length and frequency, and how often each document has each of them."""
    chosen = search.keywords(docs, min_len, max_len, min_occ, max_occ)
    chosen.write.mode("overwrite").parquet(f"{target}/queries")
    own = docs.sparkSession.read.parquet(f"{target}/queries")
    truth = stats.dictionary(docs, keys=("doc_id",)).join(own.select("term"), "term", "left_semi")
    truth.write.mode("overwrite").parquet(f"{target}/truth")
    return own, docs.sparkSession.read.parquet(f"{target}/truth")


def evaluate_htr(pairs: DataFrame, keys: tuple[str, ...], bound: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Error rates of all lines together by the first of ``keys``, and the lines (by all keys) of an error rate above ``bound``."""
    return evaluate.error_rate(pairs, keys[:1]), evaluate.error_rate(pairs, keys).where(F.col("cer") > bound)


def semi_supervised_folds(names: DataFrame, name: str, k: int) -> DataFrame:
    """For each fold the names that are not in it: left_out, name."""
    return runs.all_but_fold(runs.folds(names, name, k), "fold", k).select("left_out", name)


def train_info(spark: SparkSession, path: str, metric: str = "CER") -> DataFrame:
    """phase, seq, value, best, is_best of a training log's lines."""
    from vellumflow.streaming import trainlog

    lines = spark.read.text(path).select(F.lit(0).cast("long").alias("key"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return runs.best_so_far(trainlog.parsed(lines, metric), ["phase"], ["seq"], "value").select("phase", "seq", "value", "best", "is_best")
