"""Byte-balanced contiguous shards from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import cut


def text_size(text: str | Column, overhead: int = 8) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed cost for each row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def shard_rows(rows: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Add `shard` and `slot` to narrow rows.

    Rows are put in order by a range shuffle, and each partition is summed. Sums of the partitions before give each
    partition's offset, so a row's global position is its offset and its place in the partition. A row goes to the
    shard that holds the middle of its bytes; shards are contiguous and differ from the mean by less than one row.

    Only the columns in `rows` are moved. Rows that tie on all of `order` and on size may stand in either order.
    Null keys come first. An empty table gives an empty table. `rows` is written to the shared folder once.
    """
    clash = {"_part", "_before", "_start", "_index", "_first", "_rows", "_bytes", "_all"} & {*rows.columns}
    if clash:
        raise ValueError(f"reserved columns: {sorted(clash)}")
    keys = [F.col(c) for c in order]
    dealt = cut(rows.repartitionByRange(*keys, F.col(size)).withColumn("_part", F.spark_partition_id()), "shard-order")
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # one row for each partition, so these windows see as many rows as there were tasks
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_index"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys, F.col(size))
    placed = (
        dealt.withColumn("_before", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
        .withColumn("_rows", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_index", F.col("_index") + F.col("_rows"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * (_start + _before) + `{size}`) * {n_shards}L) div (2 * _all)")).cast("int"))
    )
    # at most n_shards rows
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(*rows.columns, "shard", (F.col("_index") - F.col("_first")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Place every document: id, size, text_crc32, law, shard, slot, grown_shard (whole: after all columns of `docs`).

    Documents are ordered by id, then checksum and size. Null text counts as empty (size 8, checksum 0); a null id
    comes first; repeated rows each get a slot of their own; other columns of `docs` are left out unless `whole` is set,
    in which case they win over placement columns of the same name and the texts move once, to their shards. `grown_shard` is
    null, for the law is `bytes`.
    """
    text = F.col(text_col)
    facts = F.col(id_col).alias("_id"), text_size(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    rows = docs.select(*facts, *([F.struct(*docs.columns).alias("_row")] if whole else []))
    placed = shard_rows(rows, n_shards, ["_id", "text_crc32"]).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    if whole:
        return placed.select("_row.*", *(c for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard") if c not in docs.columns))
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
