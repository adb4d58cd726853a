"""Lineage cuts in the folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. Only where none is set and Spark runs in one process (tests) a local one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="courtlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for each call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lost executors don't bring the work before it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, upon which Spark removes the shuffle files of plans that are gone.

    Spark's event queue holds on to the last query until another one has ended, hence the query of one row.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables of `cut` that nothing reads any more, and the shuffle files that made them; others are left alone."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if tables:
        free_shuffles(tables[0].sparkSession)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a written table of at most `limit` rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
