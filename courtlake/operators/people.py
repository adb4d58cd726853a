"""Who is who by appearance: tracklet vectors, names suggested from other games, representative crops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.operators.sequences import Columns, per_group

#: Rows of each side that one task compares at once.
BLOCK = 2048


def tracklet_vectors(crops: DataFrame) -> DataFrame:
    """tracklet_id, embedding: the normalised mean of the normalised vectors of a tracklet's crops (tracklet_id, embedding).

    Null and zero vectors count as none and as zeros; a tracklet without a vector has no row. Components are averaged
    before the shuffle, so a tracklet of many crops is no hot group.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-9
    v = F.transform("embedding", lambda x: x.cast("double"))
    parts = crops.where("embedding is not null").select("tracklet_id", v.alias("v")).withColumn("_n", norm(F.col("v"))).select("tracklet_id", F.posexplode(F.transform("v", lambda x: x / F.col("_n"))).alias("i", "x"))
    means = parts.groupBy("tracklet_id", "i").agg(F.avg("x").alias("x")).groupBy("tracklet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return means.withColumn("_n", norm(F.col("v"))).select("tracklet_id", F.transform("v", lambda x: x / F.col("_n")).alias("embedding"))


def suggest_names(identities: DataFrame, least: float = 0.82, block: int = BLOCK) -> DataFrame:
    """identity_id, name, player_id, sim (whole per cent): for each unnamed identity the most similar named one of another game.

    identities: identity_id, game_id, name, player_id, embedding (unit vectors), live ones only. Similarity must exceed
    `least`; of equal ones the smallest identity counts. Both sides are dealt to blocks, each pair of blocks is one task's
    product of two matrices, and only the best of each row leaves it, never a table of pairs.
    """
    fine = identities.where("embedding is not null")
    blank = F.coalesce(F.col("name"), F.lit("")) == ""
    unnamed, named = fine.where(blank), fine.where(~blank)
    n_left, n_right = (max(1, -(-df.count() // block)) for df in (unnamed, named))
    of = lambda n: F.pmod(F.xxhash64("identity_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["identity_id", "game_id", "embedding"]
    left = unnamed.select(of(n_left).alias("i"), every(n_right).alias("j"), F.lit(0).alias("own"), *columns)
    right = named.select(every(n_left).alias("i"), of(n_right).alias("j"), F.lit(1).alias("own"), *columns)

    def one(rows: Columns) -> Columns:
        ask, have = (np.nonzero(rows["own"] == k)[0] for k in (0, 1))
        best, sim = np.zeros(len(ask), np.int64), np.full(len(ask), -np.inf)
        if len(have) and len(ask):
            e = rows["embedding"]
            product = np.stack([np.asarray(e[i], float) for i in ask]) @ np.stack([np.asarray(e[i], float) for i in have]).T
            product[rows["game_id"][ask][:, None] == rows["game_id"][have][None]] = -np.inf
            at = product.argmax(1)  # rows are in order of identity
            best, sim = rows["identity_id"][have][at], product[np.arange(len(ask)), at]
        good = sim > least
        return {"identity_id": rows["identity_id"][ask][good], "like": best[good], "sim": sim[good]}

    found = per_group(left.unionByName(right), ["i", "j"], ["own", "identity_id"], one, "identity_id long, like long, sim double")
    top = found.groupBy("identity_id").agg(F.max_by(F.struct("like", "sim"), F.struct("sim", -F.col("like"))).alias("b"))
    who = named.select(F.col("identity_id").alias("like"), "name", "player_id")
    return top.select("identity_id", "b.like", "b.sim").join(who, "like").select("identity_id", "name", "player_id", F.floor(F.col("sim") * 100 + 0.5).cast("long").alias("sim"))


def cluster_summary(clusters: DataFrame, tracklets: DataFrame) -> DataFrame:
    """game_id, cluster, n_boxes, rep_crops: the size of each cluster and two crops of each of its three longest tracklets.

    clusters: game_id, tracklet_id, cluster; tracklets: tracklet_id, n_boxes, crops.
    """
    w = Window.partitionBy("game_id", "cluster").orderBy(F.desc("n_boxes"), "tracklet_id")
    rows = clusters.join(tracklets.select("tracklet_id", "n_boxes", "crops"), "tracklet_id").withColumn("_r", F.row_number().over(w))
    crops = F.when(F.col("_r") <= 3, F.struct("_r", F.slice("crops", 1, 2).alias("c")))
    out = rows.groupBy("game_id", "cluster").agg(F.sum("n_boxes").cast("long").alias("n_boxes"), F.sort_array(F.collect_list(crops)).alias("_c"))
    return out.select("game_id", "cluster", "n_boxes", F.flatten("_c.c").alias("rep_crops"))
