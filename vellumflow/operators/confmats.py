"""Cost matrices of lines (position x channel, channel 0 is no character): containers, joins, readings and keyword costs.

A container is a Parquet table of page_id, line_id, baseline (as text), mat (array of arrays of costs). No recogniser comes with this library: matrices are read, not made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_container(mats: DataFrame, path: str) -> None:
    mats.select("page_id", "line_id", "baseline", "mat").write.mode("overwrite").parquet(path)


def read_container(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id string, line_id string, baseline string, mat array<array<double>>").parquet(path)


def by_baseline(lines: DataFrame, mats: DataFrame) -> DataFrame:
    """Lines (page_id, baseline, ..) with their matrices, by the value of the baseline; null baselines have none."""
    return lines.join(mats.select("page_id", "baseline", "mat"), ["page_id", "baseline"])


def on_pages(mats: DataFrame, pages: DataFrame) -> DataFrame:
    """Matrices with the columns of their page."""
    return mats.join(pages, "page_id")


def migrated(old: DataFrame, lines: DataFrame) -> DataFrame:
    """Matrices of single files (page_id, name ``region_line``, mat) as rows of a container, by the ids in their names; files of unknown lines are left out."""
    parts = F.split("name", "_(?=[^_]*$)")
    told = old.select("page_id", F.get(parts, 0).alias("region_id"), F.get(parts, 1).alias("line_id"), "mat")
    return told.join(lines.select("page_id", "region_id", "line_id", "baseline"), ["page_id", "region_id", "line_id"]).select("page_id", "line_id", "baseline", "mat")


def best_channels(mat: Column) -> Column:
    """The cheapest channel of each position, the first of equal ones."""
    return F.transform(mat, lambda row: (F.array_position(row, F.array_min(row)) - 1).cast("int"))


def best_path(mat: Column, chars: Column) -> Column:
    """The reading: cheapest channels, repeats joined, channel 0 left out; ``chars`` has the character of channel k at k (from 0)."""
    best = best_channels(mat)
    once = F.filter(best, lambda c, i: (c > 0) & ((i == 0) | (c != F.get(best, i - 1))))
    return F.array_join(F.transform(once, lambda c: F.get(chars, c)), "")


def least_cost(mat: Column, channels: list[int]) -> Column:
    """A bound of a keyword's cost that takes no order into account: for each of its channels the least cost of any position."""
    of = lambda c: F.array_min(F.transform(mat, lambda row: F.get(row, F.lit(c))))
    cheapest = [of(c) for c in channels]
    return sum(cheapest[1:], cheapest[0]) if cheapest else F.lit(0.0)


def occurrence(mat: np.ndarray, channels: list[int]) -> tuple[float, int, int]:
    """(cost, start, end) of the keyword's cheapest occurrence at any place: each channel for one or more positions, with channel 0 for any number between; equal channels need one."""
    rows, k = len(mat), len(channels)
    if not rows or not k:
        return (0.0, 0, 0) if not k else (math.inf, 0, 0)
    on, off, best = [(math.inf, 0)] * k, [(math.inf, 0)] * k, (math.inf, 0, 0)
    for t, row in enumerate(mat):
        before_on, before_off = on, off
        on, off = [], []
        for j, c in enumerate(channels):
            ways = [before_on[j], (0.0, t)] if j == 0 else [before_on[j], before_off[j - 1]]
            if j and channels[j - 1] != c:
                ways.append(before_on[j - 1])
            cost, start = min(ways)
            on.append((cost + row[c], start))
            cost, start = min(before_off[j], before_on[j])
            off.append((cost + row[0], start))
        best = min(best, (on[-1][0], on[-1][1], t + 1))
    return best


def widened(best: list[int], start: int, end: int, first: int, last: int) -> tuple[int, int]:
    """A span of positions, grown over repeats of its first and last channel in the best path and the positions of no character beyond them."""
    for side in (first, 0):
        while start > 0 and best[start - 1] == side:
            start -= 1
    for side in (last, 0):
        while end < len(best) and best[end] == side:
            end += 1
    return start, end


def keyword_cascade(mats: DataFrame, keywords: dict[str, list[int]], min_conf: float, scale: float = 1.0) -> DataFrame:
    """page_id, line_id, query, reason, conf, start, end of each keyword (its channels) in each line.

    Reasons, the cheap tests first: ``leastcost`` (the bound is too dear), ``occurance`` (so is the cheapest occurrence), ``occurance expand`` (so is its cost for each character over the widened
    span), ``found``. conf, start and end are those of what was found.
    """
    limit = -math.log(min_conf)
    names = list(keywords)
    bounds = F.array(*[F.struct(F.lit(i).alias("i"), least_cost(F.col("mat"), keywords[n]).alias("bound")) for i, n in enumerate(names)])
    told = mats.select("page_id", "line_id", "mat", F.inline(bounds))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for page, line, m, i, bound in part.itertuples(index=False):
                if bound >= limit * scale:
                    rows.append((page, line, names[i], "leastcost", None, None, None))
                    continue
                mat, channels = np.array([list(r) for r in m]), keywords[names[i]]
                cost, start, end = occurrence(mat, channels)
                if cost > limit * scale:
                    rows.append((page, line, names[i], "occurance", None, None, None))
                    continue
                start, end = widened(mat.argmin(1).tolist(), start, end, channels[0], channels[-1])
                each = occurrence(mat[start:end], channels)[0] / len(channels)
                rows.append((page, line, names[i], "found", math.exp(-each), start, end) if each <= limit else (page, line, names[i], "occurance expand", None, None, None))
            yield pd.DataFrame(rows, columns=["page_id", "line_id", "query", "reason", "conf", "start", "end"]).astype({"conf": "float64", "start": "Int64", "end": "Int64"})

    return told.mapInPandas(run, "page_id string, line_id string, query string, reason string, conf double, start long, end long")


def reason_counts(cascade: DataFrame) -> DataFrame:
    """query, reason, n, with a row ``all`` for each query."""
    return cascade.groupBy("query", "reason").agg(F.count("*").alias("n")).unionByName(cascade.groupBy("query").agg(F.lit("all").alias("reason"), F.count("*").alias("n")))
