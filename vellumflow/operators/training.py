"""What training runs report: error rates, run times, match counts, names and stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_rates(rows: DataFrame, keys: list[str], errors: str, total: str) -> DataFrame:
    """keys, rate: errors over the total, summed before the division; null where there is nothing."""
    return rows.groupBy(*keys).agg((F.sum(errors) / F.nullif(F.sum(total), F.lit(0))).alias("rate"))


def mean_run_time(rows: DataFrame, keys: list[str], time: str, count: str) -> DataFrame:
    """keys, mean: the time of all threads over their counts."""
    return rows.groupBy(*keys).agg((F.sum(time) / F.nullif(F.sum(count), F.lit(0))).alias("mean"))


def match_counts(rows: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """keys, kind, n: how often each kind (reference, reading, match) occurs."""
    return rows.groupBy(*(keys or []), kind).agg(F.count("*").alias("n"))


def merged_weights(rows: DataFrame) -> DataFrame:
    """unit, dy, dx, weight: the mean of the weights that share a place."""
    return rows.groupBy("unit", "dy", "dx").agg(F.avg("weight").alias("weight"))


def model_label(name: Column, *paths: Column) -> Column:
    """A model's name, or the file names of its parts joined by colons."""
    return F.coalesce(name, F.concat_ws(":", *[F.regexp_extract(p, r"([^/]*)$", 1) for p in paths]))


def model_key(*parts: Column) -> Column:
    """One identity for the paths that make a model; a missing part is not an empty one."""
    return F.md5(F.concat(*[F.concat(F.coalesce(F.length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]).cast("binary"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH:mm:ss")
