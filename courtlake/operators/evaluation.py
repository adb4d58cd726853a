"""Predictions against reviewed labels: rallies by overlap, touches by time, the funnel and its rates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.functions.names import touch_family
from courtlake.operators.sequences import Columns, per_group, take_nearest


def map_rallies(reviewed: DataFrame, found: DataFrame, bucket: float = 60.0) -> DataFrame:
    """game_id, rally_id, found_id: the found rally that overlaps a reviewed one longest, if by over 20 % of its length; the earlier on ties.

    A reviewed rally without times takes the found one of its number `idx`, where both sides have that column. Both
    sides are spread over buckets of time within their game, so that pairs come from an equi-join.
    """
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_s") / bucket), F.floor(F.greatest("start_s", "end_s") / bucket))))
    timed = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    a = spread(reviewed.where(timed).select("game_id", "rally_id", "start_s", "end_s"))
    b = spread(found.select("game_id", "found_id", "start_s", "end_s")).withColumnsRenamed({"start_s": "s", "end_s": "e"})
    overlap = F.least("end_s", "e") - F.greatest("start_s", "s")
    pairs = a.join(b, ["game_id", "_b"]).withColumn("o", overlap).where((F.col("o") > 0) & (F.col("o") > 0.2 * F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.1))))
    best = pairs.groupBy("rally_id").agg(F.max_by("found_id", F.struct("o", -F.col("s"), -F.col("found_id"))).alias("found_id"))
    if "idx" in reviewed.columns and "idx" in found.columns:
        numbered = reviewed.where(~timed & (F.col("idx") >= 0)).select("game_id", "idx", "rally_id").join(found.select("game_id", "idx", "found_id"), ["game_id", "idx"])
        best = best.unionByName(numbered.groupBy("rally_id").agg(F.min("found_id").alias("found_id")))
    return reviewed.select("game_id", "rally_id").join(best, "rally_id", "left")


def judge_touches(predicted: DataFrame, truth: DataFrame, mapping: DataFrame, survivors: DataFrame, tol: float = 0.5) -> DataFrame:
    """game_id, play, named, play_type, truly: one row for each matched pair, each prediction and each touch left over.

    predicted: game_id, found_id, pred_id, t, play, cluster; truth: rally_id, true_id, t, play_type, cluster_id; mapping as
    map_rallies gives it; survivors: game_id, cluster_id, survivor of merges. Predictions of found rallies that no
    reviewed one maps to aren't judged. `hit` tells pairs (3), predictions (1) and touches (2); `named` is the prediction's
    player after merges. Touches and predictions meet once, in their found rally, with all that the counts need.
    """
    judged = mapping.where("found_id is not null").select("game_id", "found_id").distinct()
    p = predicted.join(judged, ["game_id", "found_id"], "left_semi").join(survivors.withColumnRenamed("cluster_id", "cluster"), ["game_id", "cluster"], "left")
    p = p.select("game_id", "found_id", F.lit(0).alias("own"), "t", F.col("pred_id").alias("id"), F.col("play").alias("kind"), F.coalesce("survivor", "cluster").cast("double").alias("who"))
    q = truth.join(mapping.where("found_id is not null"), "rally_id").select("game_id", "found_id", F.lit(1).alias("own"), "t", F.col("true_id").alias("id"), F.col("play_type").alias("kind"), F.col("cluster_id").cast("double").alias("who"))

    def one(rows: Columns) -> Columns:
        mine, true = (np.nonzero(rows["own"] == k)[0] for k in (0, 1))
        took = take_nearest(rows["t"][mine], rows["t"][true], tol)
        met = took >= 0
        left = np.delete(true, took[met])
        none, blank = np.full(len(left), None), np.full(len(left), np.nan)
        other = [rows["kind"][true[j]] if j >= 0 else None for j in took]
        whose = [rows["who"][true[j]] if j >= 0 else np.nan for j in took]
        return {
            "game_id": np.full(len(mine) + len(left), rows["game_id"][0]), "hit": np.concatenate([np.where(met, 3, 1), np.full(len(left), 2)]),
            "play": np.concatenate([rows["kind"][mine], none]).astype(object), "named": np.concatenate([rows["who"][mine], blank]),
            "play_type": np.concatenate([np.array(other, object), rows["kind"][left]]).astype(object), "truly": np.concatenate([np.array(whose, float), rows["who"][left]]),
        }

    out = per_group(p.unionByName(q), ["game_id", "found_id"], ["own", "t", "id"], one, "game_id long, hit int, play string, named double, play_type string, truly double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c).cast("long")) for c in ("named", "truly")})


def funnel(judged: DataFrame, mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts of each game and of all games (game_id null): labelled, captured, right family, joint, matched, fp, fn, attribution, and what was missed.

    Touches of reviewed rallies that no found one covers count as labelled, and as missed_touches of missed_rallies.
    """
    both = F.col("hit") == 3
    typed = both & F.col("play_type").isNotNull()
    family = typed & (F.coalesce(touch_family(F.col("play")), F.lit("")) == touch_family(F.col("play_type")))
    tried = typed & F.col("truly").isNotNull()
    right = tried & F.coalesce(F.col("named") == F.col("truly"), F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    seen = judged.groupBy("game_id").agg(
        count((F.col("hit") >= 2) & F.col("play_type").isNotNull()).alias("labelled"), count(typed).alias("captured"), count(family).alias("family_ok"), count(family & (right | F.col("truly").isNull())).alias("joint"),
        count(both).alias("matched"), count(F.col("hit") == 1).alias("fp"), count(F.col("hit") == 2).alias("fn"),
        count(right).alias("attr_ok"), count(tried & F.col("named").isNotNull()).alias("attr_total"), count(tried & F.col("named").isNull()).alias("attr_none"),
    )
    gone = mapping.where("found_id is null").join(truth.where("play_type is not null").groupBy("rally_id").agg(F.count(F.lit(1)).alias("_k")), "rally_id", "left")
    missed = gone.groupBy("game_id").agg(F.count(F.lit(1)).alias("missed_rallies"), F.coalesce(F.sum("_k"), F.lit(0)).alias("missed_touches"))
    games = seen.join(missed, "game_id", "full").na.fill(0).withColumn("labelled", F.col("labelled") + F.col("missed_touches"))
    names = [c for c in games.columns if c != "game_id"]
    out = games.rollup("game_id").agg(*(F.sum(c).cast("long").alias(c) for c in names))
    rate = lambda a, b: F.try_divide(a, b)
    return out.withColumn("precision", rate(F.col("matched"), F.col("matched") + F.col("fp"))).withColumn("recall", rate(F.col("matched"), F.col("matched") + F.col("fn")))


def confusions(judged: DataFrame, top: int = 3) -> DataFrame:
    """play_type, touches, exact, confused: of matched touches of each type how many were typed right, and the most frequent wrong types."""
    pairs = judged.where("hit = 3 and play_type is not null").groupBy("play_type", "play").agg(F.count(F.lit(1)).alias("n"))
    wrong = F.when(~F.coalesce(F.col("play") == F.col("play_type"), F.lit(False)), F.struct((-F.col("n")).alias("k"), F.coalesce("play", F.lit("?")).alias("play")))
    out = pairs.groupBy("play_type").agg(F.sum("n").alias("touches"), F.coalesce(F.sum(F.when(F.col("play") == F.col("play_type"), F.col("n"))), F.lit(0)).alias("exact"), F.sort_array(F.collect_list(wrong)).alias("_w"))
    return out.select("play_type", "touches", "exact", F.array_join(F.transform(F.slice("_w", 1, top), lambda x: F.concat(x["play"], F.lit("x"), (-x["k"]).cast("string"))), ", ").alias("confused"))
