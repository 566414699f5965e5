"""Where tables that cut lineage live: the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one for a local master, and an error for any other."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_vellum_own", None) or "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark._vellum_own = found
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, its rows in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
