"""Streams of training-log lines: parsing, the best so far, early stop, and several sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"


def parsed(lines: DataFrame, metric: str = "CER") -> DataFrame:
    """key, seq, phase, value of ``Train: CER = x`` and ``Val: CER = x`` lines (columns key, seq, line); others are left out."""
    pattern = rf"\b(Train|Val): {metric} = {NUMBER}"
    told = lines.select("key", "seq", F.lower(F.regexp_extract("line", pattern, 1)).alias("phase"), F.regexp_extract("line", pattern, 2).try_cast("double").alias("value"))
    return told.where("phase <> '' and value is not null")


def progress(values: DataFrame, patience: int) -> DataFrame:
    """key, seq, value, best, is_best, since, stop for a stream or table of (key, seq, value), in the order of seq within each batch.

    State is one row a key: the best value and the rows since. ``stop`` is set on the row that is the ``patience``-th without a better one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, since = state.get if state.exists else (float("inf"), 0)
        rows = []
        own = pd.concat(list(batches)).sort_values("seq")
        for seq, value in zip(own.seq, own.value, strict=True):
            better = value < best
            best, since = (value, 0) if better else (best, since + 1)
            rows.append((key[0], seq, value, best, better, since, since == patience))
        state.update((float(best), int(since)))
        yield pd.DataFrame(rows, columns=["key", "seq", "value", "best", "is_best", "since", "stop"])

    return values.groupBy("key").applyInPandasWithState(step, "key long, seq long, value double, best double, is_best boolean, since long, stop boolean", "best double, since long", "append", GroupStateTimeout.NoTimeout)


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch to all sinks, computed once."""

    def run(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, epoch)
        finally:
            kept.unpersist()

    return run


def last_lines(lines: DataFrame, n: int = 20) -> DataFrame:
    """The last n lines of each key; a rank limit keeps only n lines of a key in any task."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return lines.withColumn("_rank", rank).where(F.col("_rank") <= n).select("key", "seq", "line")


def windowed(events: DataFrame, stamp: str, length: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by tumbling window with a watermark; an extra beyond the reference."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, length), *keys).agg(F.count("*").alias("n"))
