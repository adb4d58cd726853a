"""Find short test items inside long documents by size-partitioned MinHash sketches (DataFrame functions only).

Items are partitioned by size. In each size class [2^k, 2^(k+1)) an item's bottom-k MinHash sketch is as long as its
largest member needs: with containment t, at most n - ceil(t * n) of its n shingles can be missing, so of one more
than that, the smallest by hash, at least one is in the document.

Documents are partitioned by size as well. A partition's documents can only hold items of size classes whose smallest
member needs no more shingles than the partition's largest document has; their MinHash sketch keeps the hashes up to
the largest one in those classes' sketches, as none beyond it can meet an item. A document and an item whose sketches
share no hash can't reach t, so nothing is lost; for the others all of the item's shingles are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import cut, small
from .words import GAP

SHINGLE, CONTAINMENT = 5, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _starts(w: Column, n: int) -> Column:
    """0, 1, ... for each run of n words; none where there are fewer."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.expr("cast(array() as array<int>)"))


def hashes(w: Column, n: int) -> Column:
    return F.transform(_starts(w, n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n)), F.lit(n)))


def shingles(w: Column, n: int) -> Column:
    return F.transform(_starts(w, n), lambda i: F.concat_ws(" ", F.slice(w, i + 1, n)))


def item_shingles(items: DataFrame, id_col: str, text_col: str, n: int, share: float) -> DataFrame:
    """One row for each distinct shingle: item_id, length (words in it), shingle, hash, item_size, size_class, sketch (boolean).

    An item of fewer than n words is one shingle of that many. The sketch of a size class [2^k, 2^(k+1)) is as long
    as the class's largest size asks for.
    """
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("_w"))
    parts = [
        w.where(F.size("_w") >= n if m == n else F.size("_w") == m)
        .select("item_id", F.lit(m).alias("length"), F.explode(F.array_distinct(F.arrays_zip(shingles(F.col("_w"), m).alias("shingle"), hashes(F.col("_w"), m).alias("hash")))).alias("_s"))
        for m in range(1, n + 1)
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("item_id", "length", "_s.shingle", "_s.hash").distinct()
    of = Window.partitionBy("item_id")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("item_size").cast("double"))) + 1) - 1
    return (
        rows.withColumn("item_size", F.count(F.lit(1)).over(of))
        .withColumn("_rank", F.row_number().over(of.orderBy("hash", "shingle")))
        .withColumn("sketch", F.col("_rank") <= upper - F.ceil(upper * share) + 1)
        .withColumn("size_class", F.floor(F.log2(F.col("item_size").cast("double"))).cast("int"))
        .drop("_rank")
    )


def row_key(id_col: str, text_col: str) -> Column:
    """A 256-bit digest that tells documents apart even if ids are null or repeat."""
    of = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.sha2(F.concat(of, F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))), 256))


def partition_tops(table: DataFrame, share: float) -> list[int | None]:
    """For each size partition of documents [2^k, 2^(k+1)) the largest hash that its sketches keep; None: no item fits.

    `table` is item_shingles'; the driver sees one row for each size class of items.
    """
    classes = table.where("sketch").groupBy("size_class").agg(F.max("hash").alias("top"), F.min(F.ceil(F.col("item_size") * share)).alias("needs")).collect()
    return [max((r["top"] for r in classes if r["needs"] < 2 ** (k + 1)), default=None) for k in range(32)]


def document_sketches(docs: DataFrame, lengths: list[int], tops: list[int | None], text_col: str = "_text") -> DataFrame:
    """_key and hash of each sketch's members; a document's partition goes by its number of shingles, repeats counted."""
    w = F.col("_w")
    many = sum((F.greatest(F.size(w) - (m - 1), F.lit(0)) for m in lengths), F.lit(0))
    top = F.get(F.array(*(F.lit(t).cast("long") for t in tops)), F.floor(F.log2(many.cast("double"))).cast("int"))
    rows = docs.select("_key", words(F.col(text_col)).alias("_w"))
    return rows.select("_key", top.alias("_top"), F.explode(F.concat(*(hashes(w, m) for m in lengths))).alias("hash")).where(F.col("hash") <= F.col("_top")).select("_key", "hash")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, share: float = CONTAINMENT) -> DataFrame:
    """_key, id, item_id and containment of each item of which a document holds at least `share` of the shingles.

    Items that are null or without words are found nowhere, and empty documents hold nothing. Items of the same id
    count as one. Rows that repeat id and text are one document. Only ids and hashes are shuffled; the items' side
    is broadcast if its counted size allows.
    """
    table = cut(item_shingles(items, item_id, item_text, n, share), "bench-shingles")
    lengths = sorted(r[0] for r in table.select("length").distinct().collect())  # at most n numbers
    keyed = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    if not lengths:
        return keyed.where("false").select("_key", F.col("_id").alias(id_col), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("containment"))
    sketch = small(table.where("sketch").select("item_id", "hash"))
    found = document_sketches(keyed, lengths, partition_tops(table, share)).join(sketch, "hash").select("_key", "item_id").distinct()
    candidates = cut(found, "bench-candidates")
    texts = keyed.join(small(candidates.select("_key").distinct()), "_key")
    w = F.col("_w")
    exact = (
        texts.select("_key", "_id", words(F.col("_text")).alias("_w")).dropDuplicates(["_key"])
        .select("_key", "_id", F.explode(F.array_distinct(F.concat(*(shingles(w, m) for m in lengths)))).alias("shingle"))
        .join(small(table.select("item_id", "shingle", "item_size")), "shingle")
    )
    return (
        exact.groupBy("_key", "_id", "item_id").agg((F.count(F.lit(1)) / F.first("item_size")).alias("containment"))
        .where(F.col("containment") >= share).join(candidates, ["_key", "item_id"], "left_semi")
        .select("_key", F.col("_id").alias(id_col), "item_id", "containment")
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row for each contaminated document: id, n_items, items (ids in order), containment (the largest)."""
    return (
        contained_items(docs, items, id_col=id_col, **kw).groupBy("_key", id_col)
        .agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"), F.max("containment").alias("containment"))
        .drop("_key")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents in which no item is contained, with all their columns, whatever their names."""
    bad = cut(contained_items(docs, items, id_col=id_col, text_col=text_col, **kw).select("_key").distinct(), "bench-found")
    rows = docs.select(row_key(id_col, text_col).alias("_key"), F.struct(*docs.columns).alias("_row"))
    return rows.join(small(bad), "_key", "left_anti").select("_row.*")
