"""Ordered rows: runs, running bests, smoothing, folds, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.shared import checkpointed


def run_ids(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run_id") -> DataFrame:
    """Numbers the maximal runs of one value in order, from 0, within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    told = rows.withColumn("_new", new)
    return told.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def runs(rows: DataFrame, keys: list[str], order: str, value: str, drop: Column | None = None) -> DataFrame:
    """keys, run_id, value, first, last, n of each run; rows of ``drop`` break runs and are left out."""
    told = run_ids(rows, keys, [order], value)
    if drop is not None:
        told = told.where(~drop)
    return told.groupBy(*keys, "run_id", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def parts(rows: DataFrame, keys: list[str], order: str, label: str, exclude: list[str]) -> DataFrame:
    """Maximal runs of rows whose label isn't in ``exclude``: keys, part, first, last."""
    told = run_ids(rows.withColumn("_out", F.coalesce(F.col(label).isin(exclude), F.lit(False))), keys, [order], "_out", "part")
    return told.where("not _out").groupBy(*keys, "part").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def merged_disorder(rows: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """Rows join the run before while their number is not above the run's first, which is the greatest number up to there."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.max(number).over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = rows.withColumn("_new", F.when(before.isNull() | (F.col(number) > before), 1).otherwise(0))
    told = told.withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    told = told.withColumn("_label", F.when(F.lag(number).over(Window.partitionBy(*keys, "run_id").orderBy(order)).eqNullSafe(F.col(number)), None).otherwise(F.struct(order, number)))
    label = F.array_join(F.transform(F.array_sort(F.collect_list("_label")), lambda s: s[number].cast("string")), "_")
    return told.groupBy(*keys, "run_id").agg(label.alias("label"), F.count("*").alias("n"))


def best_so_far(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds best (the least value so far) and is_best (below all before)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("is_best", before.isNull() | (F.col(value) < before)).withColumn("best", F.least(before, F.col(value)))


def early_stop(rows: DataFrame, keys: list[str], order: list[str], value: str, patience: int, below: float | None = None) -> DataFrame:
    """For each key the first row that is the ``patience``-th since the last best; with ``below``, counted once a value was under it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    told = best_so_far(rows, keys, order, value).withColumn("epoch", F.row_number().over(w))
    last = F.max(F.when(F.col("is_best"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    live = F.lit(True) if below is None else F.col("best") < below
    told = told.withColumn("since", F.when(live, F.col("epoch") - last).otherwise(0))
    return told.where(F.col("since") >= patience).groupBy(*keys).agg(F.min("epoch").alias("stop_epoch"))


def smooth(rows: DataFrame, keys: list[str], order: list[str], value: str, mass: str, name: str = "smooth") -> DataFrame:
    """Moving average of weights 1, 2, 1 (2, 1 at the ends) times mass; without mass the plain mean of those values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a, b, am, bm = F.lag(value).over(w), F.lead(value).over(w), F.lag(mass).over(w), F.lead(mass).over(w)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    top, bottom = z(a * am) + 2 * F.col(value) * F.col(mass) + z(b * bm), z(am) + 2 * F.col(mass) + z(bm)
    there = F.lit(1) + F.when(a.isNotNull(), 1).otherwise(0) + F.when(b.isNotNull(), 1).otherwise(0)
    return rows.withColumn(name, F.when(bottom > 0, top / bottom).otherwise((z(a) + F.col(value) + z(b)) / there))


def last_above(rows: DataFrame, keys: list[str], order: str, value: str, share: float = 0.25) -> DataFrame:
    """For each key the last position whose value is at least ``share`` of the greatest up to there."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("_max", F.max(value).over(w))
    return told.groupBy(*keys).agg(F.max(F.when(F.col(value) >= share * F.col("_max"), F.col(order))).alias("last"))


def folds(names: DataFrame, name: str, k: int) -> DataFrame:
    """Round-robin folds over the sorted distinct names (folders, sources: a list that a driver holds)."""
    ranked = names.select(name).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(name)) - 1)
    return ranked.select(name, (F.col("_rank") % k).cast("int").alias("fold"))


def all_but_fold(rows: DataFrame, fold: str, k: int) -> DataFrame:
    """Each row once for each fold that it isn't in (``left_out``); of a single fold, itself."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (j != F.col(fold)) | F.lit(k == 1))
    return rows.withColumn("left_out", F.explode(others))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """In the order of a seeded hash: reproducible whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def batches(rows: DataFrame, key: str, seed: int, size: int, most: int = -1) -> DataFrame:
    """A seeded epoch of at most ``most`` rows in numbered batches; the last incomplete batch is left out.

    Rows are numbered by partitions of a range of hashes: each partition's own count, and the counts of those before (a row for each partition on the driver).
    """
    picked = shuffled(rows, key, seed).limit(most) if most >= 0 else rows
    told = checkpointed(picked.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).repartitionByRange("_h", key).withColumn("_part", F.spark_partition_id()))
    start, first = 0, {}
    for part, n in sorted(told.groupBy("_part").count().collect()):
        first[part], start = start, start + n
    before = F.coalesce(*[F.when(F.col("_part") == p, n) for p, n in first.items()], F.lit(0)) if first else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)) - 1 + before
    told = told.withColumn("batch", F.floor(rank / size))
    return told.where(F.col("batch") < start // size).drop("_h", "_part")


def newest(rows: DataFrame, keys: list[str], stamp: str, name: str, keep: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(stamp), name)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= keep).drop("_rank")
