"""Match documents: nested JSON bundles to tables, corrections beside pipeline output, court calibrations, table files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.functions.names import file_stem

#: Explicit schema of a bundle; optional keys are null.
BUNDLE = """name string, recorded_at string, source_file string,
 video struct<width: double, height: double, fps: double, file: string>,
 rallies array<struct<start: double, `end`: double, phase: string, clip: string, ball: array<array<double>>, contacts: array<struct<t: double, x: double, y: double, play: string, cluster: bigint, tracklet: bigint, dist_px: double, side: int>>>>,
 tracklets array<struct<id: bigint, rally: int, t0: double, t1: double, cluster: bigint, crops: array<string>, emb: array<double>, boxes: array<array<double>>>>,
 clusters array<struct<cluster: bigint, size: bigint, crops: array<string>>>,
 pipeline struct<vbpipe_version: string, stages: map<string, struct<at: string, vbpipe_version: string, config: map<string, string>, params: map<string, string>, env: map<string, string>>>>"""


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document under a path, with the name of its file."""
    return spark.read.schema(BUNDLE).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def flatten_bundles(bundles: DataFrame) -> dict[str, DataFrame]:
    """games, rallies, plays, identities, tracklets, boxes and ball of documents.

    Keys are made of the document's file and array positions, so that imports repeat with the same keys. Phases are
    `game` by default, and of crops the first four are kept.
    """
    game_id = F.xxhash64("file")
    docs = bundles.withColumn("game_id", game_id)
    games = docs.select("game_id", F.coalesce("name", file_stem(F.col("file"))).alias("name"), F.to_timestamp("recorded_at").alias("recorded_at"), "source_file", "pipeline.vbpipe_version", F.map_keys("pipeline.stages").alias("stages"))
    r = docs.select("game_id", F.posexplode("rallies").alias("idx", "r"))
    key = lambda *c: F.xxhash64("game_id", *c)
    rallies = r.select(key("idx").alias("rally_id"), "game_id", "idx", F.col("r.start").alias("start_s"), F.col("r.end").alias("end_s"), F.coalesce("r.phase", F.lit("game")).alias("phase"), F.col("r.clip").alias("clip_file"))
    touches = r.select("game_id", "idx", F.posexplode("r.contacts").alias("k", "c"))
    plays = touches.select(key("idx", "k").alias("play_id"), key("idx").alias("rally_id"), "game_id", "c.t", "c.x", "c.y", F.col("c.play").alias("play_type"), F.col("c.cluster").alias("cluster_id"), F.when(F.col("c.tracklet").isNotNull(), key("c.tracklet")).alias("tracklet_id"), F.lit(False).alias("corrected"), F.lit(False).alias("deleted"))
    t = docs.select("game_id", F.explode("tracklets").alias("t"))
    tracklets = t.select(key("t.id").alias("tracklet_id"), key("t.rally").alias("rally_id"), "game_id", "t.t0", "t.t1", F.col("t.cluster").alias("cluster_id"), F.slice("t.crops", 1, 4).alias("crops"), F.col("t.emb").alias("embedding"))
    boxes = t.select("game_id", key("t.id").alias("tracklet_id"), key("t.rally").alias("rally_id"), F.col("t.cluster").alias("cluster_id"), F.posexplode("t.boxes").alias("seq", "b")).select("game_id", "rally_id", "tracklet_id", "cluster_id", "seq", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("t", "x", "y", "w", "h"))))
    ball = r.select("game_id", key("idx").alias("rally_id"), F.posexplode("r.ball").alias("seq", "p")).select("game_id", "rally_id", "seq", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("t", "x", "y", "conf"))))
    identities = docs.select("game_id", F.explode("clusters").alias("c")).select(key("c.cluster").alias("identity_id"), "game_id", F.col("c.cluster").alias("cluster_id"), F.lit(None).cast("string").alias("name"), F.slice("c.crops", 1, 4).alias("rep_crops"), F.col("c.size"))
    return {"games": games, "rallies": rallies, "plays": plays, "identities": identities, "tracklets": tracklets, "boxes": boxes, "ball": ball}


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cluster_embeddings(tracklets: DataFrame) -> DataFrame:
    """game_id, cluster_id, embedding: the mean of the tracklets' vectors at unit length, five decimals."""
    dims = tracklets.where("embedding is not null").select("game_id", "cluster_id", F.posexplode("embedding").alias("k", "v"))
    mean = dims.groupBy("game_id", "cluster_id", "k").agg(F.avg("v").alias("v")).groupBy("game_id", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("m"))
    n = _norm(F.col("m"))
    return mean.select("game_id", "cluster_id", F.transform("m", lambda x: F.round(F.when(n > 0, x / n).otherwise(x), 5)).alias("embedding"))


def typicality(tracklets: DataFrame, clusters: DataFrame) -> DataFrame:
    """tracklet_id, typicality: cosine of each tracklet to its cluster; the order of lists takes -1 where it is missing."""
    from courtlake.functions.names import cosine

    rows = tracklets.join(clusters.withColumnRenamed("embedding", "_c"), ["game_id", "cluster_id"], "left")
    return rows.select("tracklet_id", F.coalesce(cosine(F.col("embedding"), F.col("_c")), F.lit(-1.0)).alias("typicality"))


def parse_pipeline(bundles: DataFrame) -> DataFrame:
    """file, stage, at, version, config, params, env of each stage that a document was made by, and training: whether it tells its version.

    A stage's own version counts before the document's. Documents without a stamp have one row without a stage, for
    evaluation alone. Settings are maps of texts, so that generations can be grouped by any of them.
    """
    rows = bundles.select("file", F.col("pipeline.vbpipe_version").alias("_v"), F.explode_outer("pipeline.stages").alias("stage", "s"))
    version = F.coalesce("s.vbpipe_version", "_v")
    return rows.select("file", "stage", F.to_timestamp("s.at").alias("at"), version.alias("version"), "s.config", "s.params", "s.env", (F.col("stage").isNotNull() & version.isNotNull()).alias("training"))


#: The court and the net that stand where a video has no calibration, in shares of the picture.
DEFAULT_COURT = [(0.297, 0.5), (0.664, 0.493), (0.805, 0.653), (0.781, 0.944), (0.078, 0.993), (0.074, 0.917)]
DEFAULT_NET = [(0.34, 0.667), (0.7, 0.796)]


def court_for(games: DataFrame, calibrations: DataFrame) -> DataFrame:
    """game_id, court, net, source: the calibration of a game's video, else the one called _default, else the built-in one.

    A calibration has playing_area and net_base, or court_poly and net as older files call them; one that lacks either
    leaves that to the built-in values, as a whole file's entry counts before the default's.
    """
    points = "array<array<double>>"
    of = lambda *names: F.coalesce(*(F.col(n) if n in calibrations.columns else F.lit(None).cast(points) for n in names))
    known = calibrations.select("video", F.struct(of("playing_area", "court_poly").alias("court"), of("net_base", "net").alias("net")).alias("c"))
    default = known.where("video = '_default'").agg(F.first("c").alias("_d"))  # one row
    rows = games.select("game_id", "name").join(known.where("video <> '_default'").withColumnRenamed("video", "name"), "name", "left").crossJoin(F.broadcast(default))
    chosen = rows.withColumn("_c", F.coalesce("c", "_d"))
    fixed = lambda at: F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in at))
    source = F.when(F.col("c").isNotNull(), "video").when(F.col("_d").isNotNull(), "default").otherwise("built-in")
    return chosen.select("game_id", F.coalesce("_c.court", fixed(DEFAULT_COURT)).alias("court"), F.coalesce("_c.net", fixed(DEFAULT_NET)).alias("net"), source.alias("source"))


def load_pairs(corrections: DataFrame, found: DataFrame) -> DataFrame:
    """stem, correction and pipeline files of the same normalised stem."""
    stem = lambda c: F.regexp_replace(F.lower(file_stem(F.col(c))), "[^a-z0-9]+", "-")
    a = corrections.select(stem("file").alias("stem"), F.struct(*corrections.columns).alias("corrections"))
    b = found.select(stem("file").alias("stem"), F.struct(*found.columns).alias("found"))
    return a.join(b, "stem")
