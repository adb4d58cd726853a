"""Page views, upload jobs and ledgers as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def view_stream(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    """Page views as they are appended to a folder."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.select(F.col("event_type").alias("path"), F.col("user_id").alias("visitor"), F.col("ts").alias("created_at"))


#: Parts that a page's visitors are dealt to, so that a busy page's state isn't in one place.
PARTS = 16


def hourly(views: DataFrame, late: str = "1 hour", zone: str = "UTC", parts: int = PARTS) -> DataFrame:
    """hour, path, part, views and visitors of tumbling hours, exact, each time they change; rows of hours that `late` has passed are dropped.

    The state of an hour, page and part of the visitors is its count and who was seen, and goes when the hour has passed.
    A visitor is always in the same part, so parts add up.
    """
    local = views.withColumn("at", F.from_utc_timestamp("created_at", zone)).withWatermark("at", late)
    keyed = local.select("at", F.date_trunc("hour", "at").alias("hour"), "path", F.pmod(F.xxhash64("visitor"), F.lit(parts)).cast("int").alias("part"), F.col("visitor").cast("string").alias("visitor"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        end = int(pd.Timestamp(key[0]).tz_localize("UTC").timestamp() * 1000) + 3_600_000
        if end <= state.getCurrentWatermarkMs():
            return
        n, seen = state.get if state.exists else (0, [])
        seen = set(seen)
        for f in frames:
            n += len(f)
            seen.update(f["visitor"].dropna())
        state.update((n, sorted(seen)))
        state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"hour": [key[0]], "path": [key[1]], "part": [key[2]], "views": [n], "visitors": [len(seen)]})

    out, kept = "hour timestamp, path string, part int, views long, visitors long", "views long, visitors array<string>"
    return keyed.groupBy("hour", "path", "part").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.EventTimeTimeout)


def latest(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run `hourly` over what there is; hour, path, views and visitors as they last were, open hours included.

    Each batch is a folder of its own that a repeated batch overwrites, so nothing counts twice after a failure.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType(stream.schema.fields + [T.StructField("batch", T.LongType())])).parquet(path)
    last = rows.groupBy("hour", "path", "part").agg(F.max_by(F.struct("views", "visitors"), "batch").alias("v"))
    return last.groupBy("hour", "path").agg(F.sum("v.views").alias("views"), F.sum("v.visitors").alias("visitors"))


def dedupe(rows: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: one mail per player and night, one post per short and place."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


#: Parts that jobs are dealt to; each one's open jobs are a state of their own.
JOB_PARTS = 256


def reap(jobs: DataFrame, silent_ms: int = 180_000, parts: int = JOB_PARTS) -> DataFrame:
    """job_id, status: a job fails when nothing was heard of it for `silent_ms` of event time, else its last status.

    A state holds the staging jobs of one part and when each is due, so a batch costs a call for each part, not for each job.
    """
    rows = jobs.withWatermark("updated_at", "1 minute").select("job_id", "status", "updated_at", F.unix_millis("updated_at").alias("_ms"), F.pmod(F.xxhash64("job_id"), F.lit(parts)).cast("int").alias("_part"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        ids, due = state.get if state.exists else ([], [])
        waits = pd.Series(due, index=pd.Index(ids, dtype="int64"), dtype="int64")
        if not state.hasTimedOut:
            last = pd.concat(list(frames)).sort_values("updated_at", kind="stable").drop_duplicates("job_id", keep="last")
            staging = last["status"] == "staging"
            heard = last[staging]
            waits = pd.concat([waits[~waits.index.isin(last["job_id"])], pd.Series((heard["_ms"] + silent_ms).clip(lower=now + 1).to_numpy(), index=heard["job_id"].to_numpy(), dtype="int64")])
            yield last.loc[~staging, ["job_id", "status"]]
        silent = waits.index[waits < now]
        yield pd.DataFrame({"job_id": silent.to_numpy(), "status": ["failed"] * len(silent)})
        waits = waits[waits >= now]
        if len(waits):
            state.update((waits.index.tolist(), waits.tolist()))
            state.setTimeoutTimestamp(int(waits.min()))
        elif state.exists:
            state.remove()

    return rows.groupBy("_part").applyInPandasWithState(step, "job_id long, status string", "job_id array<long>, due array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is and read the table that it appended to."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
