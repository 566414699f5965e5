"""Where tables that cut lineage live: the folder that all executors share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder of its own; any
    other master is refused, as a machine's own folder is not seen by the other executors.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if (own := getattr(spark, "_vellum_shared", None)) is None:
        own = spark._vellum_shared = "file://" + tempfile.mkdtemp(prefix="vellum-")
        sc.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for own in getattr(spark, "_vellum_scratch", []):
        own.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The paths that are made in the shared folder meanwhile, in order, for whoever knows when nothing reads them any more."""
    every = spark._vellum_scratch = getattr(spark, "_vellum_scratch", [])
    own: list[str] = []
    every.append(own)
    try:
        yield own
    finally:
        every[:] = [x for x in every if x is not own]


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Removes paths below the shared folder, whatever file system has it."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back without its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder, for small tables within loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fitted(sample: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> object:
    """What ``fit`` pickles as its one row, over a bounded sample in one task; an empty sample may have no task, so there the driver fits on nothing."""
    row = sample.coalesce(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(row[0] if row else next(fit(iter(()))).column(0)[0].as_py())


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column (Spark's names have no case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
