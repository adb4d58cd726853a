"""Grades of touches from their order, the rally's outcome and the teams; scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def touches(plays: DataFrame, rallies: DataFrame, identities: DataFrame) -> DataFrame:
    """Plays with their rally's outcome and their own identity (null where the game has none of that cluster).

    A rally gets the identities of its own clusters as a map, so that plays move by rally alone, or not at all where both
    tables are bucketed by it; the windows of grades need that same partitioning. Of a rally, only its clusters go to its
    game, and only their identities come back.
    """
    who = F.struct("cluster_id", F.struct("team", "player_id", "name").alias("who"))
    rosters = identities.where("cluster_id is not null").groupBy("game_id").agg(F.map_from_entries(F.collect_list(who)).alias("_all"))
    met = plays.select("rally_id", "cluster_id").join(rallies.select("rally_id", "game_id"), "rally_id")
    met = met.groupBy("rally_id").agg(F.first("game_id").alias("game_id"), F.collect_set("cluster_id").alias("_met"))
    own = met.join(rosters, "game_id").select("rally_id", F.map_filter("_all", lambda k, v: F.array_contains("_met", k)).alias("_who"))
    rows = plays.join(rallies, "rally_id").join(own, "rally_id", "left").withColumn("_own", F.try_element_at("_who", F.col("cluster_id")))
    return rows.withColumns({c: F.col(f"_own.{c}") for c in ("team", "player_id", "name")}).drop("_who", "_own")


def derive_grades(plays: DataFrame, rallies: DataFrame, identities: DataFrame, typed_only: bool = False) -> DataFrame:
    """Add `grade` to the touches; a reviewer's non-empty grade wins. Order is (t, play_id).

    All expressions share one partitioning by rally and one order, so the plan sorts once.
    """
    df = touches(plays, rallies, identities)
    if typed_only:
        df = df.where("play_type is not null")
    w = Window.partitionBy("rally_id").orderBy("t", "play_id")
    whole = Window.partitionBy("rally_id")
    i, out, kind = F.col("_i"), F.col("outcome_type"), F.col("play_type")
    mine = F.col("outcome_cluster").isNull() | F.coalesce(F.col("cluster_id") == F.col("outcome_cluster"), F.lit(False))
    last = lambda cond: F.max(F.when(cond, i)).over(whole)
    # what one window can tell is asked of it at once
    df = df.withColumns({"_i": F.row_number().over(w), "_next_team": F.lead("team").over(w), "_next_type": F.lead("play_type").over(w)})
    df = df.withColumns({
        "_n": F.count(F.lit(1)).over(whole), "_kill": last((out == "kill") & (kind == "attack") & mine), "_atkerr": last((out == "attack_error") & (kind == "attack") & mine),
        "_blocked": last((out == "block") & (kind == "attack")), "_stuff": last((out == "block") & (kind == "block") & mine), "_rec": last((out == "ace") & (kind == "receive")),
    }).withColumn("_kill_team", F.max(F.when(i == F.col("_kill"), F.col("team"))).over(whole))
    same = lambda other: F.coalesce(F.col("team") == other, F.lit(True))
    is_last, before_kill = i == F.col("_n"), F.coalesce(i == F.col("_kill") - 1, F.lit(False))
    over = before_kill & F.coalesce(F.col("team") != F.col("_kill_team"), F.lit(False))
    other_error = F.coalesce(out == "other_error", F.lit(False)) & is_last & mine
    grade = (
        F.when((kind == "serve") & (out == "ace") & mine, "ace")
        .when((kind == "serve") & (out == "service_error") & mine & is_last, "error")
        .when((kind == "attack") & (i == F.col("_kill")), "kill")
        .when((kind == "attack") & (i == F.col("_atkerr")), "error")
        .when((kind == "attack") & (i == F.col("_blocked")), "blocked")
        .when((kind == "attack") & over, "error")
        .when((kind == "block") & (i == F.col("_stuff")), "stuff")
        .when((kind == "set") & before_kill & same(F.col("_kill_team")), "assist")
        .when((kind == "receive") & (i == F.col("_rec")), "error")
        .when(kind.isin("set", "dig", "receive") & (over | other_error), "error")
        .when((kind == "dig") & ~is_last & same(F.col("_next_team")), "success")
        .when((kind == "receive") & (F.col("_next_type") == "set") & same(F.col("_next_team")), "positive")
        .otherwise("in_play")
    )
    df = df.withColumn("grade", F.when(F.coalesce(F.col("grade"), F.lit("")) != "", F.col("grade")).otherwise(grade))
    return df.select([c for c in df.columns if not c.startswith("_")])


def winner(outcome: Column, team: Column) -> Column:
    """The team that won a rally: of the outcome's player for points, the other one for errors; else null."""
    other = F.when(team == "A", "B").when(team == "B", "A")
    return F.when(outcome.isin("kill", "ace", "block"), team).when(outcome.isNotNull(), other)


def rally_winners(rallies: DataFrame, identities: DataFrame) -> DataFrame:
    teams = identities.select("game_id", F.col("cluster_id").alias("outcome_cluster"), "team")
    return rallies.join(teams, ["game_id", "outcome_cluster"], "left").withColumn("winner", winner(F.col("outcome_type"), F.col("team"))).drop("team")


def scores(rallies: DataFrame, identities: DataFrame) -> DataFrame:
    """game_id, a, b, approx (some rally couldn't be counted); games in which nothing counted have no row."""
    decided = rally_winners(rallies, identities).where("outcome_type is not null")
    return (
        decided.groupBy("game_id")
        .agg(F.count_if(F.col("winner") == "A").alias("a"), F.count_if(F.col("winner") == "B").alias("b"), F.max(F.col("winner").isNull()).alias("approx"))
        .where("a + b > 0")
    )


def rally_positions(rallies: DataFrame, identities: DataFrame) -> DataFrame:
    """Ordinal, total, neighbours and the running score of each rally, ordered by (played_on, rally_id)."""
    w = Window.partitionBy("game_id").orderBy("played_on", "rally_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    won = lambda t: F.sum(F.when(F.col("winner") == t, 1).otherwise(0)).over(run).cast("long").alias(t.lower())
    return rally_winners(rallies, identities).select(
        "game_id", "rally_id", F.row_number().over(w).cast("long").alias("ordinal"), F.count(F.lit(1)).over(Window.partitionBy("game_id")).alias("total"),
        F.lag("rally_id").over(w).alias("prev_id"), F.lead("rally_id").over(w).alias("next_id"), won("A"), won("B"),
    )
