"""Counters of players, boards, connections, nights, traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.sources.store import written

#: Counters of touches as (type, grade or None), and of rally outcomes.
TOUCH = {
    "serve": ("serve", None), "receive": ("receive", None), "dig": ("dig", None), "set": ("set", None), "attack": ("attack", None), "block": ("block", None),
    "blocked": ("attack", "blocked"), "assist": ("set", "assist"), "set_err": ("set", "error"), "dig_ok": ("dig", "success"), "dig_err": ("dig", "error"),
    "rec_pos": ("receive", "positive"), "rec_err": ("receive", "error"),
}
OUTCOME = {"kill": "kill", "atk_err": "attack_error", "ace": "ace", "srv_err": "service_error", "stuff": "block"}


def player_key() -> Column:
    return F.coalesce(F.concat(F.lit("pid:"), F.col("player_id").cast("string")), F.concat(F.lit("name:"), F.col("name")))


def player_stats(graded: DataFrame, rallies: DataFrame, identities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """key, name, games and 18 counters of each active player (by: within each of these columns of the rallies).

    Touches and outcomes become rows of one shape, so a single aggregation, combined before its shuffle, counts
    both and the distinct games of either. A player's name is that of the smallest game and cluster.
    """
    by, zero = by or [], F.lit(0)
    from_touches = graded.where("name is not null").select(
        *by, player_key().alias("key"), "name", "game_id", "cluster_id",
        *(F.when((F.col("play_type") == t) & (F.col("grade") == g if g else F.lit(True)), 1).otherwise(0).alias(c) for c, (t, g) in TOUCH.items()),
        *(zero.alias(c) for c in OUTCOME),
    )
    people = identities.where("name is not null").select("game_id", F.col("cluster_id").alias("outcome_cluster"), player_key().alias("key"), "name")
    from_rallies = rallies.where("outcome_type is not null").join(people, ["game_id", "outcome_cluster"]).select(
        *by, "key", "name", "game_id", F.col("outcome_cluster").alias("cluster_id"),
        *(zero.alias(c) for c in TOUCH), *(F.when(F.col("outcome_type") == o, 1).otherwise(0).alias(c) for c, o in OUTCOME.items()),
    )
    counters = [*TOUCH, *OUTCOME]
    by_game = from_touches.unionByName(from_rallies).groupBy(*by, "key", "game_id").agg(F.min_by("name", "cluster_id").alias("name"), *(F.sum(c).alias(c) for c in counters))
    total = by_game.groupBy(*by, "key").agg(F.min_by("name", "game_id").alias("name"), F.count(F.lit(1)).alias("games"), *(F.sum(c).alias(c) for c in counters))
    return total.where("serve + receive + dig + `set` + attack + block + kill + ace + stuff > 0")


def ratios(stats: DataFrame) -> DataFrame:
    """key and the rates of each player; null where nothing was tried."""
    rate = lambda num, den: F.expr(f"CASE WHEN {den} > 0 THEN ({num}) / {den} END")
    return stats.select(
        "key", rate("kill - atk_err - blocked", "attack").alias("attack_efficiency"), rate("kill", "attack").alias("kill_share"), rate("ace", "serve").alias("ace_share"),
        rate("rec_pos - rec_err", "receive").alias("reception_efficiency"), rate("dig_ok", "dig").alias("dig_share"), rate("kill + ace + stuff", "games").alias("points_per_game"),
    )


#: Measure: (numerator, denominator, shown decimals, direction).
SHEET = {
    "points / game": ("kill + ace + stuff", "games", 1, 1), "attack efficiency": ("kill - atk_err - blocked", "attack", 2, 1), "kill %": ("kill", "attack", 2, 1),
    "ace %": ("ace", "serve", 2, 1), "serve error %": ("srv_err", "serve", 2, -1), "reception efficiency": ("rec_pos - rec_err", "receive", 2, 1), "dig success %": ("dig_ok", "dig", 2, 1),
    "assist %": ("assist", "`set`", 2, 1), "errors / game": ("atk_err + srv_err + set_err + dig_err + rec_err + blocked", "games", 1, -1), "touches / game": ("serve + receive + dig + `set` + attack + block", "games", 1, 0), "games": ("games", "1", 0, 0),
}


def compare_players(stats: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, key, shown, leads: the comparison sheet of the players of each group.

    Leaders are found by the number as it is shown. Nobody leads with fewer than two in the running, or if the best of
    a measure that should be high is 0.
    """
    one = lambda m, num, den, digits, way: F.struct(
        F.lit(m).alias("measure"), F.lit(way).alias("way"), F.expr(f"CASE WHEN {den} > 0 THEN floor(({num}) / {den} * {10**digits} + 0.5D) / {10**digits} END").cast("double").alias("shown")
    )
    rows = stats.select(*by, "key", F.explode(F.array(*(one(m, *v) for m, v in SHEET.items()))).alias("_m")).select(*by, "key", "_m.*")
    w = Window.partitionBy(*by, "measure")
    best = F.when(F.col("way") > 0, F.max("shown").over(w)).otherwise(F.min("shown").over(w))
    contest = (F.col("way") != 0) & (F.count("shown").over(w) >= 2) & ~((best == 0) & (F.col("way") > 0))
    return rows.select(*by, "measure", "key", "shown", F.coalesce(contest & (F.col("shown") == best), F.lit(False)).alias("leads"))


def leaderboards(stats: DataFrame, top: int | None = None) -> DataFrame:
    """board, rank, key, metric, per_game of seven boards; players without any are hidden but on the scorers' board.

    All others are listed; `top` keeps the first ones of each board only. A range shuffle by board and metric deals the
    rows, and counts of the tasks before give each task's first ranks, so no board is sorted in one task.
    """
    boards = {"scorers": "kill + ace + stuff", "attackers": "kill", "blockers": "stuff", "servers": "ace", "setters": "assist", "diggers": "dig_ok", "receivers": "rec_pos"}
    rows = stats.select("key", "games", F.explode(F.array(*(F.struct(F.lit(b).alias("board"), F.expr(e).cast("long").alias("metric")) for b, e in boards.items()))).alias("m")).select("m.*", "key", "games")
    order = [F.col("board"), F.desc("metric"), F.col("key")]
    dealt = written(rows.where("metric > 0 or board = 'scorers'").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "boards")
    # one row for each task and board
    counts = dealt.groupBy("_part", "board").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("board").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", "board", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", "board").orderBy(F.desc("metric"), "key")
    ranked = dealt.withColumn("_r", F.row_number().over(inside)).join(before, ["_part", "board"]).withColumn("rank", F.col("_r") + F.col("_before"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("board", "rank", "key", "metric", F.round(F.col("metric") / F.col("games"), 4).alias("per_game"))


def kill_connections(graded: DataFrame) -> DataFrame:
    """setter, hitter, kills: the assist of a rally and its kill."""
    named = graded.where("name is not null and outcome_type = 'kill'")
    pair = named.groupBy("rally_id").agg(F.min_by(player_key(), F.when(F.col("grade") == "assist", F.col("play_id"))).alias("setter"), F.max_by(player_key(), F.when(F.col("grade") == "kill", F.col("play_id"))).alias("hitter"))
    return pair.where("setter is not null and hitter is not null").groupBy("setter", "hitter").agg(F.count(F.lit(1)).alias("kills"))


def grade_distribution(graded: DataFrame) -> DataFrame:
    return graded.groupBy("play_type", "grade").agg(F.count(F.lit(1)).alias("touches"))


def sessions(games: DataFrame) -> DataFrame:
    return games.groupBy("played_on").agg(F.count(F.lit(1)).alias("games"))


def serving_runs(plays: DataFrame, winners: DataFrame, identities: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive rallies with one server whose team won them: game_id, server, first_rally, points."""
    serves = plays.where("play_type = 'serve' and cluster_id is not null").groupBy("rally_id").agg(F.min_by("cluster_id", F.struct("t", "play_id")).alias("server"))
    teams = identities.select("game_id", F.col("cluster_id").alias("server"), F.col("team").alias("server_team"))
    w = Window.partitionBy("game_id").orderBy("played_on", "rally_id")
    rows = winners.join(serves, "rally_id", "left").join(teams, ["game_id", "server"], "left").withColumn("won", F.coalesce(F.col("server_team") == F.col("winner"), F.lit(False)))
    go_on = F.col("won") & F.coalesce(F.lag("won").over(w), F.lit(False)) & F.coalesce(F.lag("server").over(w) == F.col("server"), F.lit(False))
    runs = rows.withColumn("_new", F.when(go_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("won")
    return runs.groupBy("game_id", "_run").agg(F.min("server").alias("server"), F.min_by("rally_id", F.struct("played_on", "rally_id")).alias("first_rally"), F.count(F.lit(1)).alias("points")).where(F.col("points") >= least).drop("_run")


def traffic_by_hour(views: DataFrame, zone: str = "UTC") -> DataFrame:
    """Views and exact unique visitors by local day, hour and page."""
    local = F.from_utc_timestamp("created_at", zone)
    return views.groupBy(F.to_date(local).alias("day"), F.hour(local).cast("long").alias("hour"), "path").agg(F.count(F.lit(1)).alias("views"), F.countDistinct("visitor").alias("visitors"))
