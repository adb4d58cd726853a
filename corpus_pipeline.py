"""From raw documents to shards: language, near copies, benchmark leaks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.llm.decontam import decontaminate
from courtlake.llm.langid import UNKNOWN, held_out, identify, teaching
from courtlake.llm.mixing import mix_documents
from courtlake.llm.ngram_join import keep_first
from courtlake.llm.scratch import new_path
from courtlake.llm.sharding import shard_documents


#: Most bytes of an Arrow batch between Spark and Python. Each task holds batches on both sides, beside the heap.
BATCH = 8 << 20


def _small_batches(spark: SparkSession) -> None:
    """Whole rows with long texts go to Python here: the session's limit is lowered to BATCH unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH:
        spark.conf.set(key, f"{BATCH}b")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go: null, without a letter, or too long to be short of evidence yet
    coded shorter by no learned language than by equal odds of all symbols, as noise is. Where nothing can be learned all stay. Rows keep all columns, a very
    long text is coded in pieces, repeated rows and ids are judged alike.
    """
    _small_batches(spark)
    training = docs.where(~held_out("doc_id"))
    if teaching(training).isEmpty():
        return docs
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return identify(rows, training, keep=["_row"], judge=True).where(F.col("lang_pred") != UNKNOWN).select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of word shingles join the one of the smallest id stays; null and empty texts link with nothing."""
    _small_batches(spark)
    return keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's shingles go, also where ids are null or repeat."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice; a source that is null is one of its own."""
    return mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place; texts don't move. shard_documents(whole=True) gives the rows themselves, for two more shuffles of whole texts."""
    return shard_documents(docs, 24)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]

#: SQL has neither the tree model of the first stage nor the draws of the fourth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
