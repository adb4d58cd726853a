"""What a night's post is made of: labels, leaders, runs, connections, shout-outs, game lines and the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.functions import names as n
from courtlake.operators.grades import scores, winner
from courtlake.operators.stats import player_key

LEAST_RUN = 3
POINTS, EFFICIENCY = "kill + ace + stuff", "(kill - atk_err - blocked) / attack"
#: Award: (value, who qualifies).
LEADERS = {
    "top_scorer": (POINTS, f"{POINTS} >= 1"), "most_efficient": (EFFICIENCY, "attack >= attack_floor and attack > 0"), "setter": ("assist", "assist >= 1"),
    "aces": ("ace", "ace >= 2"), "digs": ("dig_ok", "dig_ok >= 1"),
}
#: In order of priority.
SHOUTOUTS = {
    "Old Reliable": ("-atk_err / attack", "attack >= attack_floor and attack > 0"), "The Spark": ("sparks / (receive + dig)", "receive + dig >= defence_floor and sparks > 0"),
    "The Wall": ("stuff", "stuff >= 2"), "The Postman": ("serve", "srv_err = 0 and serve >= 8"), "Triple Threat": (POINTS, "kill >= 1 and ace >= 1 and stuff >= 1"),
}


def labels(identities: DataFrame, games: DataFrame) -> DataFrame:
    """played_on, name, label: the first name, with an initial where the night has it twice."""
    named = identities.join(games.select("game_id", "played_on"), "game_id").select("played_on", "name").where("name is not null").distinct()
    first = n.public_name(F.col("name"))
    rest = F.regexp_extract(F.trim("name"), r"^\S+\s+(.)", 1)
    twice = F.count(F.lit(1)).over(Window.partitionBy("played_on", "_first")) > 1
    return named.withColumn("_first", first).select("played_on", "name", F.when(twice & (rest != ""), F.concat("_first", F.lit(" "), F.upper(rest), F.lit("."))).otherwise(F.col("_first")).alias("label"))


def with_floors(stats: DataFrame) -> DataFrame:
    """Named players of each night, with the attempts that a rate asks for: 0.3 of the busiest, 8 at least."""
    w = Window.partitionBy("played_on")
    floor = lambda volume: F.greatest(F.lit(8), F.ceil(F.lit(0.3) * F.max(F.expr(volume)).over(w))).cast("long")
    return stats.where(~n.is_placeholder(F.col("name"))).withColumn("attack_floor", floor("attack")).withColumn("defence_floor", floor("receive + dig"))


def leading(stats: DataFrame, label: DataFrame) -> DataFrame:
    """played_on, award, key, label, value: who leads each award of a night, ties kept."""
    of = F.array(*(F.struct(F.lit(a).alias("award"), F.when(F.expr(q), F.expr(v).cast("double")).alias("value")) for a, (v, q) in LEADERS.items()))
    rows = with_floors(stats).join(label, ["played_on", "name"]).select("played_on", "key", "label", F.explode(of).alias("_m")).select("played_on", "key", "label", "_m.*").where("value is not null")
    return rows.withColumn("_r", F.rank().over(Window.partitionBy("played_on", "award").orderBy(F.desc("value")))).where("_r = 1").drop("_r")


def leaders(stats: DataFrame, label: DataFrame) -> DataFrame:
    """played_on, award, value, names: the leaders of each night, ties kept, names by label in order."""
    return leading(stats, label).groupBy("played_on", "award").agg(F.max("value").alias("value"), n.join_names(F.sort_array(F.collect_list("label"))).alias("names"))


def serves(plays: DataFrame) -> DataFrame:
    """rally_id, server: the first serve of a rally that has a player."""
    return plays.where("play_type = 'serve' and cluster_id is not null").groupBy("rally_id").agg(F.min_by("cluster_id", F.struct("t", "play_id")).alias("server"))


def longest_runs(plays: DataFrame, rallies: DataFrame, identities: DataFrame) -> DataFrame:
    """played_on, game_id, name, points, first_rally: the longest run of points on one player's serve in each night.

    Rallies without a server or an attributable winner, and points lost, end a run. The earliest of equal runs counts;
    the night has none if its longest is below three or its server is unnamed.
    """
    teams = identities.select("game_id", F.col("cluster_id").alias("server"), F.col("team").alias("server_team"), F.col("name").alias("server_name"))
    out = identities.select("game_id", F.col("cluster_id").alias("outcome_cluster"), "team")
    rows = rallies.join(serves(plays), "rally_id", "left").join(teams, ["game_id", "server"], "left").join(out, ["game_id", "outcome_cluster"], "left")
    won = F.coalesce((winner(F.col("outcome_type"), F.col("team")) == F.col("server_team")), F.lit(False))
    w = Window.partitionBy("game_id").orderBy("start_s", "rally_id")
    rows = rows.withColumn("_won", won)
    go_on = F.col("_won") & F.coalesce(F.lag("_won").over(w) & (F.lag("server").over(w) == F.col("server")), F.lit(False))
    rows = rows.withColumn("_run", F.sum(F.when(go_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_won")
    runs = rows.groupBy("played_on", "game_id", "_run").agg(F.count(F.lit(1)).alias("points"), F.min("server_name").alias("name"), F.min_by("rally_id", F.struct("start_s", "rally_id")).alias("first_rally"))
    top = Window.partitionBy("played_on").orderBy(F.desc("points"), "game_id", "_run")
    best = runs.withColumn("_r", F.row_number().over(top)).where("_r = 1")
    return best.where((F.col("points") >= LEAST_RUN) & F.col("name").isNotNull() & ~n.is_placeholder(F.col("name"))).select("played_on", "game_id", "name", "points", "first_rally")


def kill_chains(graded: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(played_on, setter, hitter, kills) and (played_on, key, sparks) from rallies that ended in a kill of someone.

    The setter is the first assist, the hitter the outcome's player; the spark is the pass or dig just before the assist.
    """
    w = Window.partitionBy("rally_id").orderBy("t", "play_id")
    kills = graded.where("outcome_type = 'kill' and outcome_cluster is not null")
    at = kills.withColumn("_before", F.lag(F.struct("cluster_id", "play_type", player_key().alias("key"), "name")).over(w)).where("grade = 'assist'")
    first = at.groupBy("rally_id", "game_id", "played_on", "outcome_cluster").agg(F.min_by(F.struct(player_key().alias("setter"), "_before"), F.struct("t", "play_id")).alias("_a")).select("*", "_a.*").drop("_a")
    hitters = identities.where(~n.is_placeholder(F.col("name"))).select("game_id", F.col("cluster_id").alias("outcome_cluster"), F.col("name").alias("hitter"))
    conns = first.where("setter is not null").join(hitters, ["game_id", "outcome_cluster"]).groupBy("played_on", "setter", "hitter").agg(F.count(F.lit(1)).alias("kills"))
    sparks = first.where(F.col("_before.play_type").isin("receive", "dig") & F.col("_before.name").isNotNull() & ~n.is_placeholder(F.col("_before.name")))
    return conns, sparks.groupBy("played_on", F.col("_before.key").alias("key")).agg(F.count(F.lit(1)).alias("sparks"))


def favourites(conns: DataFrame) -> DataFrame:
    """played_on, setter, hitter, kills: whom each setter fed most, two kills at least, first by name on ties."""
    w = Window.partitionBy("played_on", "setter").orderBy(F.desc("kills"), "hitter")
    return conns.withColumn("_r", F.row_number().over(w)).where("_r = 1 and kills >= 2").drop("_r")


def setter_targets(led: DataFrame, conns: DataFrame, label: DataFrame) -> DataFrame:
    """played_on, label, kills: whom the night's setter, if there is a single one, fed most."""
    w = Window.partitionBy("played_on")
    alone = led.where("award = 'setter'").withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").select("played_on", F.col("key").alias("setter"))
    return favourites(conns).join(alone, ["played_on", "setter"]).withColumnRenamed("hitter", "name").join(label, ["played_on", "name"]).select("played_on", "label", "kills")


def spent_names(led: DataFrame, conns: DataFrame, runs: DataFrame, label: DataFrame) -> DataFrame:
    """played_on, label of everyone the night's headlines name: leaders of all awards, the setter's target, the serving run."""
    run = runs.select("played_on", "name").join(label, ["played_on", "name"]).select("played_on", "label")
    return led.select("played_on", "label").unionByName(setter_targets(led, conns, label).select("played_on", "label")).unionByName(run).distinct()


def shoutouts(stats: DataFrame, sparks: DataFrame, label: DataFrame, used: DataFrame) -> DataFrame:
    """played_on, award, names: each award to the best qualifying players whom nobody has named yet (used: played_on, label).

    A night's players, a few dozen, are gathered once with what each would bring to every award; the awards are then
    dealt one after another by array functions.
    """
    rows = with_floors(stats).join(label, ["played_on", "name"]).join(sparks, ["played_on", "key"], "left").na.fill(0, ["sparks"])
    values = [F.when(F.expr(who), F.expr(value).cast("double")).alias(f"v{i}") for i, (value, who) in enumerate(SHOUTOUTS.values())]
    nights = rows.groupBy("played_on").agg(F.collect_list(F.struct("label", *values)).alias("_all"))
    named = used.groupBy("played_on").agg(F.collect_set("label").alias("_used"))
    nights = nights.join(named, "played_on", "left").withColumn("_used", F.coalesce("_used", F.expr("cast(array() as array<string>)")))
    for i in range(len(SHOUTOUTS)):
        v = f"v{i}"
        free = F.filter("_all", lambda x: x[v].isNotNull() & ~F.array_contains("_used", x["label"]))  # noqa: B023
        nights = nights.withColumn("_free", free).withColumn("_best", F.array_max(F.transform("_free", lambda x: x[v])))  # noqa: B023
        won = F.array_sort(F.array_distinct(F.transform(F.filter("_free", lambda x: x[v] == F.col("_best")), lambda x: x["label"])))  # noqa: B023
        nights = nights.withColumn(f"_w{i}", won).withColumn("_used", F.concat("_used", f"_w{i}"))
    awards = F.array(*(F.struct(F.lit(a).alias("award"), n.join_names(F.col(f"_w{i}")).alias("names")) for i, a in enumerate(SHOUTOUTS)))
    return nights.select("played_on", F.explode(awards).alias("_a")).select("played_on", "_a.*").where("names <> ''")


def game_lines(games: DataFrame, rallies: DataFrame, identities: DataFrame, label: DataFrame, slots: DataFrame) -> DataFrame:
    """game_id, played_on, label, a, b, winner, roster, unnamed: the score of each game and who won it."""
    score = scores(rallies, identities)
    side = identities.join(games.select("game_id", "played_on"), "game_id").join(label, ["played_on", "name"], "left")
    named = ~n.is_placeholder(F.col("name"))
    rosters = side.groupBy("game_id", F.col("team").alias("winner")).agg(F.array_join(F.sort_array(F.collect_list(F.when(named, F.col("label")))), ", ").alias("roster"), F.count_if(~named).alias("unnamed"))
    rows = games.select("game_id", "played_on").join(slots.select("game_id", "slot"), "game_id").join(score, "game_id", "left")
    rows = rows.withColumn("winner", F.when(F.col("a") > F.col("b"), "A").when(F.col("b") > F.col("a"), "B")).join(rosters, ["game_id", "winner"], "left")
    return rows.select("game_id", "played_on", n.game_number(F.col("slot")).alias("label"), "a", "b", "approx", "winner", "roster", "unnamed")


def longest_rallies(rallies: DataFrame, plays: DataFrame) -> DataFrame:
    """played_on, rally_id, seconds, touches: the longest rally of each night in rounded seconds, the first of equal ones."""
    seconds = F.floor(F.col("end_s") - F.col("start_s") + 0.5).cast("long")
    w = Window.partitionBy("played_on").orderBy(F.desc("seconds"), "game_id", "start_s", "rally_id")
    best = rallies.withColumn("seconds", seconds).withColumn("_r", F.row_number().over(w)).where("_r = 1 and seconds > 0")
    touches = plays.groupBy("rally_id").agg(F.count(F.lit(1)).alias("touches"))
    return best.join(touches, "rally_id", "left").select("played_on", "rally_id", "seconds", F.coalesce("touches", F.lit(0)).alias("touches"))


def summary_text(lines: DataFrame, led: DataFrame, runs: DataFrame, longest: DataFrame) -> DataFrame:
    """played_on and the night's post: its games, leaders, serving run and longest rally, empty lines dropped."""
    game = F.concat(F.col("label"), F.when(F.col("winner").isNotNull(), F.concat(F.lit(": "), "roster", F.lit(" "), F.greatest("a", "b").cast("string"), F.lit("-"), F.least("a", "b").cast("string"))).otherwise(""))
    games = lines.groupBy("played_on").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", game.alias("text")))), lambda x: x["text"]), "\n").alias("_games"))
    titles = {"top_scorer": "Top scorer", "setter": "Setter of the night", "aces": "Aces", "digs": "Most digs"}
    said = [F.max(F.when(F.col("award") == a, F.concat(F.lit(f"{t}: "), "names", F.lit(" "), F.col("value").cast("long").cast("string")))).alias(f"_{a}") for a, t in titles.items()]
    wide = games.join(led.groupBy("played_on").agg(*said), "played_on", "left")
    wide = wide.join(runs.select("played_on", F.concat(F.lit("Serving run: "), "name", F.lit(", "), F.col("points").cast("string"), F.lit(" straight")).alias("_run")), "played_on", "left")
    wide = wide.join(longest.select("played_on", F.concat(F.lit("Longest rally: "), F.col("seconds").cast("string"), F.lit("s, "), n.plural(F.col("touches"), "touch", "touches")).alias("_long")), "played_on", "left")
    return wide.select("played_on", F.concat_ws("\n", n.day_label(F.col("played_on")), "_games", *(f"_{a}" for a in titles), "_run", "_long").alias("text"))


def recap_mail(stats: DataFrame, recipients: DataFrame, origin: str, brand: str) -> DataFrame:
    """played_on, email, subject, text: each recipient's mail with what they did that night, counts of zero left out.

    stats: played_on, key (pid:<player>), name and counters; recipients: played_on, player_id, email.
    """
    who = recipients.withColumn("key", F.concat(F.lit("pid:"), F.col("player_id").cast("string")))
    rows = who.join(stats, ["played_on", "key"], "left")
    kinds = {"kill": ("kill", None), "ace": ("ace", None), "stuff": ("block", None), "dig_ok": ("dig", None), "assist": ("assist", None)}
    bits = F.array_compact(F.array(*(F.when(F.col(c) > 0, n.plural(F.col(c), one, many)) for c, (one, many) in kinds.items())))
    when = n.day_label(F.col("played_on"))
    said = F.when(F.size(bits) > 0, F.concat(when, F.lit(": "), F.array_join(bits, ", "), F.lit("."))).otherwise(F.concat(F.lit("Your clips and stats from "), when, F.lit(" are up.")))
    first = F.coalesce(n.public_name(F.col("name")), F.lit("there"))
    url = F.concat(F.lit(origin + "/p/"), n.player_slug(F.col("name"), F.col("player_id")), F.lit("/"), F.col("played_on").cast("string"))
    text = F.concat(F.lit("Hey "), first, F.lit(",\n\n"), said, F.lit("\n\nYour plays and stats: "), url, F.lit(f"\n\nShare it with whoever you like — the link works for anyone.\n\n— {brand}"))
    return rows.select("played_on", "email", F.concat(F.lit(f"Your night at {brand} — "), when).alias("subject"), text.alias("text"))


def night_summary(lines: DataFrame, led: DataFrame, runs: DataFrame, longest: DataFrame, shouts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each night: games, decided, approx, lines (label, a, b, winner, roster, unnamed), the leaders of each award,
    the setter's target, the serving run, the longest rally and the shout-outs (award, names) in order of priority.
    """
    line = F.struct("label", "a", "b", "winner", "roster", "unnamed")
    games = lines.groupBy("played_on").agg(F.count(F.lit(1)).alias("games"), F.count("winner").alias("decided"), F.coalesce(F.max("approx"), F.lit(False)).alias("approx"), F.sort_array(F.collect_list(line)).alias("lines"))
    tops = led.groupBy("played_on").agg(*(F.max(F.when(F.col("award") == a, F.col("names"))).alias(a) for a in LEADERS))
    place = F.array_position(F.array(*(F.lit(a) for a in SHOUTOUTS)), F.col("award"))
    shout = shouts.groupBy("played_on").agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("_p"), "award", "names"))), lambda x: F.struct(x["award"].alias("award"), x["names"].alias("names"))).alias("shoutouts"))
    out = games.join(tops, "played_on", "left").join(targets.select("played_on", F.col("label").alias("setter_target"), F.col("kills").alias("setter_target_kills")), "played_on", "left")
    out = out.join(runs.select("played_on", F.col("name").alias("run_name"), F.col("points").alias("run_points")), "played_on", "left")
    out = out.join(longest.select("played_on", F.col("rally_id").alias("longest_rally"), F.col("seconds").alias("longest_seconds"), F.col("touches").alias("longest_touches")), "played_on", "left")
    return out.join(shout, "played_on", "left").withColumn("shoutouts", F.coalesce("shoutouts", F.expr("cast(array() as array<struct<award: string, names: string>>)")))
