"""Participants, rosters, careers, team suggestions, highlights and predicted types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.operators.stats import player_key

POINTS = ["kill", "ace", "block"]
#: The type that follows a touch, and the weight of a rally's outcome among highlights.
NEXT = {"serve": "receive", "receive": "set", "dig": "set", "set": "attack", "attack": "dig", "block": "dig"}
WEIGHT = {"kill": 10.0, "block": 9.0, "ace": 7.0, "attack_error": 2.0, "service_error": 0.0, "other_error": 1.0}


def _literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def touch_counts(plays: DataFrame, rallies: DataFrame) -> DataFrame:
    """game_id, cluster_id, touches."""
    return plays.where("cluster_id is not null").join(rallies.select("rally_id", "game_id"), "rally_id").groupBy("game_id", "cluster_id").agg(F.count(F.lit(1)).alias("touches"))


def careers(plays: DataFrame, rallies: DataFrame, identities: DataFrame) -> DataFrame:
    """player_id, games, touches, points of linked players.

    Touches and points are counted per game and cluster before identities are joined, so the join moves counts.
    """
    points = rallies.where(F.col("outcome_type").isin(POINTS) & F.col("outcome_cluster").isNotNull()).groupBy("game_id", F.col("outcome_cluster").alias("cluster_id")).agg(F.count(F.lit(1)).alias("points"))
    rows = identities.where("player_id is not null").join(touch_counts(plays, rallies), ["game_id", "cluster_id"], "left").join(points, ["game_id", "cluster_id"], "left")
    return rows.groupBy("player_id").agg(
        F.countDistinct("game_id").alias("games"), F.coalesce(F.sum("touches"), F.lit(0)).alias("touches"), F.coalesce(F.sum("points"), F.lit(0)).alias("points")
    )


def player_games(players: DataFrame, identities: DataFrame) -> DataFrame:
    """player_id, games of every player, those without a game included."""
    seen = identities.where("player_id is not null").select("player_id", "game_id").distinct().groupBy("player_id").agg(F.count(F.lit(1)).alias("games"))
    return players.select("player_id").join(seen, "player_id", "left").select("player_id", F.coalesce("games", F.lit(0)).alias("games"))


def participants(plays: DataFrame, rallies: DataFrame, identities: DataFrame) -> DataFrame:
    """Distinct names with a touch or an outcome; clusters are made distinct before names are joined."""
    touched = plays.join(rallies.select("rally_id", "game_id"), "rally_id").select("game_id", "cluster_id")
    decided = rallies.where("outcome_type is not null").select("game_id", F.col("outcome_cluster").alias("cluster_id"))
    return touched.unionByName(decided).distinct().join(identities.where("name is not null"), ["game_id", "cluster_id"]).select("name").distinct()


def game_rosters(identities: DataFrame) -> DataFrame:
    """game_id and the sorted names, comma-joined, of team A, team B and others; a game has few identities."""
    names = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("name")))), ",")
    return identities.where("name is not null").groupBy("game_id").agg(
        names(F.col("team") == "A").alias("team_a"), names(F.col("team") == "B").alias("team_b"), names(F.col("team").isNull()).alias("others")
    )


def scope_header(rallies: DataFrame) -> DataFrame:
    """games, scored: distinct games and rallies with an outcome, in one row."""
    by_game = rallies.groupBy("game_id").agg(F.count("outcome_type").alias("scored"))
    return by_game.agg(F.count(F.lit(1)).alias("games"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))


def team_suggestions(plays: DataFrame, rallies: DataFrame, least: int = 8, own: int = 2, share: float = 0.7) -> DataFrame:
    """game_id, cluster_id, team, conf from the side of the net (median x of a game's touches) a cluster plays on."""
    rows = plays.where("x is not null and cluster_id is not null").join(rallies.select("rally_id", "game_id"), "rally_id").select("game_id", "cluster_id", "x")
    net = rows.groupBy("game_id").agg(F.percentile("x", F.lit(0.5)).alias("net"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    side = rows.join(net, "game_id").groupBy("game_id", "cluster_id").agg(F.count_if(F.col("x") < F.col("net")).alias("_left"), F.count(F.lit(1)).alias("_n"))
    part = F.greatest(F.col("_left"), F.col("_n") - F.col("_left")) / F.col("_n")
    return side.where((F.col("_n") >= own) & (part >= share)).select(
        "game_id", "cluster_id", F.when(F.col("_left") > F.col("_n") - F.col("_left"), "A").otherwise("B").alias("team"), F.floor(part * 100 + 0.5).cast("long").alias("conf")
    )


def favourite_hitters(connections: DataFrame, least: int = 2) -> DataFrame:
    """setter, hitter, kills: whom each setter fed most, from `least` kills on; the smaller key on ties."""
    best = connections.groupBy("setter").agg(F.min_by("hitter", F.struct(-F.col("kills"), "hitter")).alias("hitter"), F.max("kills").alias("kills"))
    return best.where(F.col("kills") >= least)


def predicted_types(plays: DataFrame) -> DataFrame:
    """rally_id, play_id, play_type and the type predicted from the touch before."""
    before = F.lag("play_type").over(Window.partitionBy("rally_id").orderBy("t", "play_id"))
    guess = F.when(before.isNull(), "serve").otherwise(F.coalesce(F.try_element_at(_literal_map(NEXT), before), F.lit("attack")))
    return plays.select("rally_id", "play_id", "play_type", guess.alias("predicted"))


def confusion(truth_and_guess: DataFrame, top: int = 3) -> DataFrame:
    """play_type, predicted, n, share (of the type) and rank of its `top` most frequent wrong predictions (null rank: right)."""
    counts = truth_and_guess.groupBy("play_type", "predicted").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("play_type")
    wrong = F.col("play_type") != F.col("predicted")
    rank = F.when(wrong, F.row_number().over(Window.partitionBy("play_type", wrong).orderBy(F.desc("n"), "predicted"))).cast("long")
    return counts.select("play_type", "predicted", "n", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"), rank.alias("rank")).where(F.col("rank").isNull() | (F.col("rank") <= top))


def board_checks(graded: DataFrame, rallies: DataFrame) -> DataFrame:
    """check_name, smaller, larger, ok: grades that follow from outcomes can't outnumber them."""
    g = graded.agg(*(F.count_if((F.col("play_type") == t) & (F.col("grade") == x)).alias(c) for c, t, x in (("kills", "attack", "kill"), ("stuffs", "block", "stuff"), ("assists", "set", "assist"))))
    o = rallies.agg(F.count_if(F.col("outcome_type") == "kill").alias("o_kills"), F.count_if(F.col("outcome_type") == "block").alias("o_blocks"))
    rows = F.expr("stack(3, 'kills', kills, o_kills, 'stuffs', stuffs, o_blocks, 'assists', assists, o_kills) as (check_name, smaller, larger)")
    # both sides are one row each
    return g.withColumn("_one", F.lit(1)).join(o.withColumn("_one", F.lit(1)), "_one").select(rows).withColumn("ok", F.col("smaller") <= F.col("larger"))


def highlights(rallies: DataFrame, plays: DataFrame, top: int = 10) -> DataFrame:
    """game_id, rank, rally_id, score, touches: the best rallies of a game by outcome, duration and touches.

    The duration is in column `duration`; rallies shorter than 4 s don't take part.
    """
    counts = plays.where("play_type is not null").groupBy("rally_id").agg(F.count(F.lit(1)).alias("touches"))
    weight = F.coalesce(F.try_element_at(_literal_map(WEIGHT), F.col("outcome_type")), F.lit(3.0))
    rows = rallies.where("duration >= 4").join(counts, "rally_id", "left").withColumn("touches", F.coalesce("touches", F.lit(0)))
    score = F.bround(weight + F.least("duration", F.lit(25.0)) / 5 + F.least("touches", F.lit(14)) / 3, 2)
    rank = F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("score"), "rally_id")).cast("long")
    return rows.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= top).select("game_id", "rank", "rally_id", "score", "touches")


def longest_rallies(rallies: DataFrame, plays: DataFrame) -> DataFrame:
    """played_on, rally_id, seconds, touches of each night's longest rally in rounded seconds; the first one on ties."""
    best = rallies.where("duration is not null").groupBy("played_on").agg(F.min_by(F.struct("rally_id", "duration"), F.struct(-F.floor(F.col("duration") + 0.5), "rally_id")).alias("b")).select("played_on", "b.*")
    counts = plays.groupBy("rally_id").agg(F.count(F.lit(1)).alias("touches"))
    return best.join(counts, "rally_id", "left").select("played_on", "rally_id", F.floor(F.col("duration") + 0.5).cast("long").alias("seconds"), F.coalesce("touches", F.lit(0)).alias("touches"))


def volume_floors(stats: DataFrame) -> DataFrame:
    """attack_floor and defence_floor: three tenths of the busiest player's volume, 8 at least."""
    floor = lambda c: F.greatest(F.lit(8), F.ceil(F.lit(0.3) * F.coalesce(F.max(c), F.lit(0)))).cast("long")
    return stats.agg(floor(F.col("attack")).alias("attack_floor"), floor(F.col("receive") + F.col("dig")).alias("defence_floor"))


def page_views(views: DataFrame) -> DataFrame:
    """path, views, visitors of all pages, most viewed first; ties by name."""
    by_page = views.groupBy("path").agg(F.count(F.lit(1)).alias("views"), F.countDistinct("visitor").alias("visitors"))
    return by_page.orderBy(F.desc("views"), "path")


def referrers(views: DataFrame, top: int = 10) -> DataFrame:
    """referrer, views of the `top` most frequent referrers; ties by name. Null and empty ones don't count."""
    return views.where("referrer <> ''").groupBy("referrer").agg(F.count(F.lit(1)).alias("views")).orderBy(F.desc("views"), "referrer").limit(top)


def named_touches(graded: DataFrame, kind: str, grade: str) -> DataFrame:
    """Clip search: rally_id, play_id, ordinal (the touch's number in its whole rally) and key of touches of a type and grade."""
    numbered = graded.withColumn("ordinal", F.row_number().over(Window.partitionBy("rally_id").orderBy("t", "play_id")).cast("long"))
    return numbered.where((F.col("play_type") == kind) & (F.col("grade") == grade)).select("rally_id", "play_id", "ordinal", player_key().alias("key"))
