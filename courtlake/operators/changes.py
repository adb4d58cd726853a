"""Change logs applied to tables: merges, dismissals, splits, renames, links and deletions, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.operators.scope import resequence


def apply_merges(plays: DataFrame, log: DataFrame) -> DataFrame:
    """Touches of a merged cluster (log: game_id, cluster_id, target) point to its target."""
    return plays.join(log, ["game_id", "cluster_id"], "left").withColumn("cluster_id", F.coalesce("target", "cluster_id")).drop("target")


def apply_dismissals(plays: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touches, remembered): touches of dismissed clusters (log: game_id, cluster_id) lose them; per cluster their ids are kept."""
    gone = log.select("game_id", "cluster_id").distinct().withColumn("_gone", F.lit(True))
    marked = plays.join(gone, ["game_id", "cluster_id"], "left")
    kept = marked.where("_gone").groupBy("game_id", "cluster_id").agg(F.sort_array(F.collect_list("play_id")).alias("dismissed_plays"))
    return marked.withColumn("cluster_id", F.when(F.col("_gone").isNull(), F.col("cluster_id"))).drop("_gone"), kept


def undo_dismissals(plays: DataFrame, remembered: DataFrame, tracklets: DataFrame | None = None) -> DataFrame:
    """Remembered touches get their cluster back if nobody has credited them meanwhile.

    A dismissal that remembers none (dismissed_plays null or empty) takes back the touches of its own tracklets
    (game_id, tracklet_id, cluster_id), as older ones kept no list.
    """
    back = remembered.select(F.explode("dismissed_plays").alias("play_id"), F.col("cluster_id").alias("_back"))
    if tracklets is not None:
        blank = remembered.where(F.coalesce(F.size("dismissed_plays"), F.lit(0)) <= 0).select("game_id", "cluster_id")
        linked = tracklets.select("game_id", "tracklet_id", "cluster_id").join(blank, ["game_id", "cluster_id"])
        back = back.unionByName(plays.where("cluster_id is null").join(linked.select("tracklet_id", F.col("cluster_id").alias("_back")), "tracklet_id").select("play_id", "_back"))
    return plays.join(back, "play_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "_back")).drop("_back")


def apply_reassign(tracklets: DataFrame, plays: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracklets, touches): split-off tracklets (log: tracklet_id) get a new cluster of their game each, and their touches follow.

    New numbers are the game's largest and the place among the game's split tracklets.
    """
    from pyspark.sql.window import Window

    top = tracklets.groupBy("game_id").agg(F.max("cluster_id").alias("_top"))
    moved = tracklets.join(log.select("tracklet_id").distinct(), "tracklet_id", "left_semi").join(top, "game_id")
    w = Window.partitionBy("game_id").orderBy("tracklet_id")
    new = moved.select("tracklet_id", (F.col("_top") + F.row_number().over(w)).cast("long").alias("_new"))
    follow = lambda df: df.join(new, "tracklet_id", "left").withColumn("cluster_id", F.coalesce("_new", "cluster_id")).drop("_new")
    return follow(tracklets), follow(plays)


def apply_splits(rallies: DataFrame, plays: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rallies, touches): rallies split at a time (log: rally_id, at) that lies a second or more inside.

    Both halves keep the rally's id and get a half number; the later one takes the outcome and the touches from `at` on.
    """
    fit = rallies.join(log, "rally_id", "left").withColumn("at", F.when((F.col("at") >= F.col("start_s") + 1) & (F.col("at") <= F.col("end_s") - 1), F.col("at")))
    halves = fit.withColumn("half", F.explode(F.when(F.col("at").isNotNull(), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    first = F.col("half") == 1
    out = halves.withColumns({
        "start_s": F.when((F.col("half") == 2) & F.col("at").isNotNull(), F.col("at")).otherwise(F.col("start_s")), "end_s": F.when(first, F.col("at")).otherwise(F.col("end_s")),
        "outcome_type": F.when(~first, F.col("outcome_type")), "outcome_cluster": F.when(~first, F.col("outcome_cluster")), "half": F.col("half").cast("long"),
    }).drop("at")
    touches = plays.join(fit.select("rally_id", "at"), "rally_id").withColumn("half", F.when(F.col("at").isNull() | (F.col("t") >= F.col("at")), 2).otherwise(1).cast("long")).drop("at")
    return out, touches


def apply_player_changes(identities: DataFrame, merges: DataFrame, renames: DataFrame) -> DataFrame:
    """Identities of merged players (player_id, into) move along; names of renamed ones (player_id, new_name) spread to them."""
    moved = identities.join(merges, "player_id", "left").withColumn("player_id", F.coalesce("into", "player_id")).drop("into")
    return moved.join(renames, "player_id", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def apply_roster_links(users: DataFrame, links: DataFrame) -> DataFrame:
    """Upsert by e-mail (links: email, player_id, name): the player is set, a name only fills a blank one."""
    new = links.select(F.lower("email").alias("email"), F.col("player_id").alias("_p"), F.col("name").alias("_n"))
    rows = users.join(new, "email", "full")
    return rows.select("email", F.coalesce("_p", "player_id").alias("player_id"), F.when(F.coalesce("name", F.lit("")) == "", F.col("_n")).otherwise(F.col("name")).alias("name"))


def link_conflicts(users: DataFrame) -> DataFrame:
    """player_id, emails: players that more than one address claims."""
    return users.where("player_id is not null").groupBy("player_id").agg(F.sort_array(F.collect_set("email")).alias("emails")).where(F.size("emails") > 1)


def delete_games(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the deleted games' rows; the nights' slots are counted anew."""
    keep = lambda df, key, ids: df.join(ids, key, "left_anti")
    rallies = tables["rallies"].join(gone, "game_id", "left_semi").select("rally_id")
    out = {k: keep(df, "game_id", gone) if "game_id" in df.columns else keep(df, "rally_id", rallies) if "rally_id" in df.columns else df for k, df in tables.items()}
    return out | {"slots": resequence(out["games"])}
