"""Clips: search, windows, moments, reels and chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.operators.grades import winner

PAD_BEFORE, PAD_AFTER = 3.0, 2.0
#: What each stat key means, (touch, grade) or an outcome, in the order of the chips; and the keys that are faults.
TOUCH_STATS = {
    "serve": ("serve", None), "receive": ("receive", None), "dig": ("dig", None), "set": ("set", None), "attack": ("attack", None), "block": ("block", None),
    "assist": ("set", "assist"), "set_error": ("set", "error"), "dig_kept": ("dig", "success"), "dig_error": ("dig", "error"), "rec_pos": ("receive", "positive"), "rec_error": ("receive", "error"), "blocked": ("attack", "blocked"),
}
OUTCOME_STATS = {"kill": "kill", "ace": "ace", "stuff": "block", "attack_error": "attack_error", "service_error": "service_error"}
FAULTS = ["attack_error", "service_error", "set_error", "dig_error", "rec_error", "blocked"]


def clip_window(start: Column, end: Column, at: Column | None = None, at_end: bool = False) -> tuple[Column, Column]:
    """(from, to) in game time: from the padded start, or shortly before a touch or the end; never before 0."""
    opened = start - PAD_BEFORE
    begin = F.greatest(opened, end - 6) if at_end else opened if at is None else F.greatest(opened, F.coalesce(at - 3, opened))
    return F.greatest(F.lit(0.0), begin), end + PAD_AFTER


def find_clips(rallies: DataFrame, graded: DataFrame, identities: DataFrame, stat: str, name: str | None = None) -> DataFrame:
    """game_id, rally_id, num, matched, from_s, to_s of the rallies that show a stat (of one player).

    Numbers are those of the unfiltered order. Outcome stats match the rally and cue its end, touch stats its first match.
    """
    num = F.row_number().over(Window.partitionBy("game_id").orderBy("start_s", "rally_id")).cast("long")
    rows = rallies.withColumn("num", num)
    who = F.lit(True) if name is None else F.col("name") == name
    if stat in OUTCOME_STATS:
        people = identities.select("game_id", F.col("cluster_id").alias("outcome_cluster"), "name")
        found = rows.where(F.col("outcome_type") == OUTCOME_STATS[stat]).join(people, ["game_id", "outcome_cluster"], "left").where(who)
        begin, end = clip_window(F.col("start_s"), F.col("end_s"), at_end=True)
        return found.select("game_id", "rally_id", "num", F.lit(0).cast("long").alias("matched"), begin.alias("from_s"), end.alias("to_s"))
    kind, grade = TOUCH_STATS[stat]
    hits = graded.where((F.col("play_type") == kind) & (F.col("grade") == grade if grade else F.lit(True)) & who).groupBy("rally_id").agg(F.count(F.lit(1)).alias("matched"), F.min("t").alias("_at"))
    begin, end = clip_window(F.col("start_s"), F.col("end_s"), F.col("_at"))
    return rows.join(hits, "rally_id").select("game_id", "rally_id", "num", "matched", begin.alias("from_s"), end.alias("to_s"))


def moments(graded: DataFrame, stat: str) -> DataFrame:
    """rally_id, play_id, caption: up to four touches that match a stat, else the rally's last touch."""
    kind, grade = TOUCH_STATS[stat]
    hit = F.coalesce((F.col("play_type") == kind) & (F.col("grade") == grade if grade else F.lit(True)), F.lit(False))
    touch = F.struct("t", "play_id", "play_type", "grade", "name", hit.alias("hit"))
    rows = graded.groupBy("rally_id").agg(F.sort_array(F.collect_list(touch)).alias("_all"))
    hits = F.filter("_all", lambda x: x["hit"])
    rows = rows.select("rally_id", F.explode(F.when(F.size(hits) > 0, F.slice(hits, 1, 4)).otherwise(F.slice("_all", -1, 1))).alias("m"))
    word = F.upper(F.when(F.col("m.grade") == "kill", "kill").otherwise(F.coalesce("m.play_type", F.lit("highlight"))))
    return rows.select("rally_id", "m.play_id", F.concat(word, F.coalesce(F.concat(F.lit(" - "), "m.name"), F.lit(""))).alias("caption"))


def moment_window(graded: DataFrame, rallies: DataFrame, lead: int = 4, tail: float = 2.5, head: float = 1.0, least: float = 3.0) -> DataFrame:
    """play_id, t0, t1: from `lead` touches before each attack to `tail` seconds after it, within the rally, `least` seconds at least."""
    w = Window.partitionBy("rally_id").orderBy("t", "play_id")
    back = F.coalesce(F.lag("t", lead).over(w), F.first("t").over(w))
    rows = graded.select("rally_id", "play_id", "t", "play_type", "start_s", "end_s", back.alias("_from")).where("play_type = 'attack'")
    t0 = F.greatest(F.col("_from") - head, F.col("start_s"))
    t1 = F.greatest(F.least(F.col("t") + tail, F.col("end_s")), t0 + least)
    return rows.select("play_id", t0.alias("t0"), t1.alias("t1"))


def player_reel(graded: DataFrame, rallies: DataFrame, identities: DataFrame) -> DataFrame:
    """player_id, rally_id, key, num, us, them: a clip for each rally that a linked player's kill, ace or stuff ended.

    The score is the game's up to and with that rally, from the player's side.
    """
    teams = identities.select("game_id", F.col("cluster_id").alias("outcome_cluster"), "team", "player_id")
    w = Window.partitionBy("game_id").orderBy("start_s", "rally_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rallies.join(teams, ["game_id", "outcome_cluster"], "left").withColumn("_won", winner(F.col("outcome_type"), F.col("team")))
    won = lambda t: F.sum(F.when(F.col("_won") == t, 1).otherwise(0)).over(run).cast("long")
    rows = rows.withColumn("num", F.row_number().over(w).cast("long")).withColumn("_a", won("A")).withColumn("_b", won("B"))
    key = F.create_map(*(F.lit(x) for k, o in OUTCOME_STATS.items() if k in ("kill", "ace", "stuff") for x in (o, k)))[F.col("outcome_type")]
    us, them = (F.when(F.col("team") == "A", F.col(p)).when(F.col("team") == "B", F.col(q)) for p, q in (("_a", "_b"), ("_b", "_a")))
    return rows.where(F.col("player_id").isNotNull() & key.isNotNull()).select("player_id", "rally_id", key.alias("key"), "num", us.alias("us"), them.alias("them"))


def stat_chips(stats: DataFrame) -> DataFrame:
    """key, place, stat, n, fault: the counters above 0 of each player, in the order of the chips."""
    column = {"stuff": "stuff", "attack_error": "atk_err", "service_error": "srv_err", "set_error": "set_err", "dig_kept": "dig_ok", "dig_error": "dig_err", "rec_error": "rec_err"}
    order = [*OUTCOME_STATS, *TOUCH_STATS]
    chips = F.array(*(F.struct(F.lit(i).cast("long").alias("place"), F.lit(s).alias("stat"), F.col(column.get(s, s)).cast("long").alias("n"), F.lit(s in FAULTS).alias("fault")) for i, s in enumerate(order)))
    return stats.select("key", F.explode(F.filter(chips, lambda x: x["n"] > 0)).alias("_c")).select("key", "_c.*")
