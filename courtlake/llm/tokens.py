"""Token counts through a cache of content digests."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, new_path

CACHE_SCHEMA = "digest binary, n_tokens long"
#: Words that a task remembers at most, and the longest one that it remembers.
MEMO_WORDS, MEMO_CHARS = 300_000, 64
_LOADED: dict = {}


def version_digest(path: str) -> str:
    """Of the tokenizer's file and its library's version; counts of another version are never used."""
    import tokenizers

    return hashlib.sha256(Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()


def normalised(text: str) -> Column:
    """What the counts depend on: the tokenizer takes each run of white space as one separator."""
    return F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r]+", " "))


def _digest(content: Column, version: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(version + "\n"), content), 256))


def _count(path: str, texts: list[str], memo: dict[str, int]) -> list[int]:
    """Counts of normalised texts. No token reaches over a blank, so a text's count is the sum of its words' counts."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    encode = _LOADED[path].encode_batch
    counts = []
    for text in texts:
        words = text.split(" ")
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = list(dict.fromkeys(words))
            memo.update(zip(new, (len(e.ids) for e in encode(new, add_special_tokens=False)), strict=True))
        counts.append(sum(map(memo.__getitem__, words)))
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
    return counts


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """digest and n_tokens of (digest, content) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            counts = [c for at in range(0, b.num_rows, 256) for c in _count(path, b.column("content").slice(at, 256).to_pylist(), memo)]
            yield pa.RecordBatch.from_arrays([b.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return misses.select("digest", "content").mapInArrow(run, CACHE_SCHEMA)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table is laid down where there is none yet."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    `cache` is a folder of Parquet files that later calls, also with other tokenizers, can share; None takes a new
    one. Digests that it lacks are encoded once each, whatever the number of documents that hold them, and appended.
    Null text counts as empty. Repeated rows and null ids are kept as they are; other columns are left out. Text is
    shuffled once, by id and digest, so a text that many rows repeat doesn't meet in one task.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-cache")
    version = version_digest(tokenizer)
    texts = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), normalised(text_col).alias("content"))
    texts = texts.withColumn("digest", _digest(F.col("content"), version))
    keys = cut(texts.select(id_col, "n_bytes", "digest"), "token-keys")
    misses = keys.groupBy("digest").agg(F.min(id_col).alias("_first")).join(open_cache(spark, cache), "digest", "left_anti")
    found = texts.join(misses.withColumnRenamed("digest", "_digest"), (F.col("digest") == F.col("_digest")) & F.col(id_col).eqNullSafe(F.col("_first")))
    # rows that repeat an id and its text are encoded alike
    encode_misses(found, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache)
    # jobs that share a cache may both have appended a digest
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).join(keys.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(stored, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
