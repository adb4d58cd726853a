"""Tables in the folder that driver and executors share: lineage cuts, and layouts that joins and windows read without a shuffle."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="courtlake-")  # one process, as in tests
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written and read again, so that lost executors don't bring the work before it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write a table as Parquet, in folders by a column of few values (games by night) if one is given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, key: str, order: list[str], buckets: int) -> DataFrame:
    """Write a fact table as `buckets` files by a hash of `key`, each sorted by key and `order`, and read it.

    Tables of one key and number of buckets join, group and window by that key without an exchange. Rows are dealt by
    the same hash before, so each bucket is one file. `path` lies in a store that all executors reach.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
