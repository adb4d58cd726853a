"""Queries on the league's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.functions import names as n
from courtlake.operators import changes, clips, evaluation, matching, night, rosters, scope, sequences
from courtlake.operators import detections as d
from courtlake.operators import grades as g
from courtlake.operators import stats as s
from courtlake.sources.league import all_tables, touch_tasks
from courtlake.sources.store import shared_path
from courtlake.streaming import traffic


class Tables(dict):
    """Stored tables under `all`, scoped ones by name, and what several queries derive from them; `tasks` deal out touches."""

    tasks: int

    def graded(self) -> DataFrame:
        return g.derive_grades(self["plays"], self["rallies"], self["identities"])

    def stats(self, by: list[str] | None = None) -> DataFrame:
        return s.player_stats(self.graded(), self["rallies"], self["identities"], by)

    def labels(self) -> DataFrame:
        return night.labels(self["identities"], self["games"])

    def boxes(self) -> DataFrame:
        rows = self["all"]["tracklets"].join(self["all"]["rallies"].select("rally_id", "game_id"), "rally_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")))
        return rows.selectExpr("game_id", "rally_id", "tracklet_id", "cluster_id", "t0 + k / 2 AS t", "cast((p * 7 + 40 * k) % 1800 AS double) AS x", "cast((p * 13 + 25 * k) % 900 AS double) AS y", "60.0D AS w", "cast(20 + (p + k) % 90 AS double) AS h")

    def ball(self, by: str | None = None, tasks: int | None = None) -> DataFrame:
        """Twelve ball points for each touch; touches are dealt `by` a column (over `tasks`) before, so that points needn't be."""
        touches = self["all"]["plays"].select("rally_id", "play_id", "t", "x", "y").join(self["all"]["rallies"].select("rally_id", "game_id"), "rally_id")
        dealt = touches.repartition(tasks, by) if tasks else touches.repartition(by) if by else touches
        rows = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")))
        return rows.selectExpr("game_id", "rally_id", "t + k * 0.08D AS t", "if(play_id % 4 = 0, 1000.0D, x + 30 * least(k, 12 - k) * (play_id % 3 - 1)) AS x", "if(play_id % 4 = 0, 500.0D, y + 10 * k) AS y", "cast((play_id + k) % 10 AS double) / 10 AS conf")

    def metrics(self) -> DataFrame:
        boxes = self.boxes()
        bounds = d.tracklet_bounds(boxes).join(boxes.select("tracklet_id", "game_id").distinct(), "tracklet_id")
        return d.camera_metrics(boxes, bounds).withColumn("value", F.round("value", 6))

    def probes(self) -> DataFrame:
        return self["plays"].select(F.col("play_id").alias("probe_id"), "rally_id", "t", "x", "y", "cluster_id", "play_type")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    stored = all_tables(spark, sf_dir)
    t = Tables(scope.scope(stored) | {"all": stored})
    t.tasks = touch_tasks(spark, sf_dir)
    return t


def _merges(t: Tables) -> DataFrame:
    r = scope.resolve_merges(t["all"]["identities"])
    return r.where("survivor <> cluster_id").select("game_id", "cluster_id", F.col("survivor").alias("target"))


def _plays_of_games(t: Tables) -> DataFrame:
    return t["plays"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id").select("game_id", "rally_id", "play_id", "cluster_id", "t", "tracklet_id")


def _wristed(t: Tables) -> DataFrame:
    k = F.col("probe_id")
    wrists = F.when(k % 5 == 0, None).when(k % 5 == 1, F.expr("cast(array() as array<struct<dist: double, cluster: bigint>>)")).otherwise(F.array(F.struct((k % 300).cast("double").alias("dist"), (k % 11 + 1).alias("cluster"))))
    return t.probes().drop("cluster_id").withColumn("wrists", wrists)


def _users(t: Tables) -> DataFrame:
    return t["all"]["identities"].where("player_id is not null").groupBy("player_id").agg(F.min("name").alias("name")).where("player_id % 2 = 0").selectExpr("player_id", "concat('u', player_id, '@example.org') AS email", "name")


def _jobs(t: Tables) -> DataFrame:
    return t["views"].selectExpr("view_id AS job_id", "visitor AS batch", "element_at(array('pending', 'staging', 'done', 'failed'), cast(view_id % 4 + 1 AS int)) AS status", "created_at AS updated_at")


def _shouts(t: Tables) -> DataFrame:
    stats, label = t.stats(["played_on"]), t.labels()
    conns, sparks = night.kill_chains(t.graded(), t["identities"])
    return night.shoutouts(stats, sparks, label, night.spent_names(night.leading(stats, label), conns, _runs(t), label))


def _summary(t: Tables) -> DataFrame:
    stats, label = t.stats(["played_on"]), t.labels()
    targets = night.setter_targets(night.leading(stats, label), night.kill_chains(t.graded(), t["identities"])[0], label)
    rows = night.night_summary(_lines(t), night.leaders(stats, label), _runs(t), night.longest_rallies(t["rallies"], t["plays"]), _shouts(t), targets)
    said = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    line = lambda x: F.concat(x["label"], F.lit(" "), said(x["a"]), F.lit("-"), said(x["b"]), F.lit(" "), said(x["roster"]))
    return rows.withColumn("lines", F.array_join(F.transform("lines", line), "; ")).withColumn("shoutouts", F.array_join(F.transform("shoutouts", lambda x: F.concat(x["award"], F.lit(": "), x["names"])), "; "))


def _lines(t: Tables) -> DataFrame:
    return night.game_lines(t["games"], t["rallies"], t["identities"], t.labels(), scope.resequence(t["all"]["games"]))


def _runs(t: Tables) -> DataFrame:
    return night.longest_runs(t["plays"], t["rallies"], t["identities"])


def _tracklets_of_games(t: Tables) -> DataFrame:
    return t["all"]["tracklets"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id")


def _named_games(t: Tables) -> DataFrame:
    slots = scope.resequence(t["all"]["games"])
    day, slot = F.col("played_on"), F.col("slot")
    facts = (F.col("label"), day, slot, F.col("name"), F.col("game_id"))
    return t["all"]["games"].join(slots.select("game_id", "slot"), "game_id", "left").select("game_id", n.display_name(*facts).alias("display"), n.channel_title(*facts).alias("title"), n.game_slug(day, slot, F.col("game_id")).alias("slug"))


def _found_rallies(t: Tables) -> DataFrame:
    return t["all"]["rallies"].selectExpr("game_id", "rally_id AS found_id", "start_s + rally_id % 9 - 4 AS start_s", "end_s + rally_id % 5 - 2 AS end_s").where("found_id % 8 <> 0")


def _pairs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    of = t["all"]["rallies"].select("rally_id", "game_id")
    truth = t["plays"].join(of, "rally_id").select(F.col("play_id").alias("true_id"), "rally_id", "game_id", "t", "play_type", "cluster_id")
    predicted = truth.where("true_id % 6 <> 0").selectExpr("true_id AS pred_id", "rally_id", "game_id", "t + (true_id % 7 - 3) / 4 AS t", "if(true_id % 3 = 0, 'set', play_type) AS play", "if(true_id % 4 = 0, null, cluster_id) AS cluster")
    return sequences.match_touches(predicted, truth), predicted, truth


def _judged(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, predicted, truth = _pairs(t)
    mapping = evaluation.map_rallies(t["rallies"], _found_rallies(t))
    return evaluation.judge_touches(predicted.withColumnRenamed("rally_id", "found_id"), truth.drop("game_id"), mapping, scope.resolve_merges(t["all"]["identities"])), mapping, truth


def _mispaired_probes(t: Tables) -> DataFrame:
    """Wrongly linked touches, dealt by rally as boxes are."""
    bad = scope.mispaired(t["all"]["plays"], t["all"]["tracklets"], t["all"]["identities"], t["all"]["rallies"], ("rally_id", "t", "x", "y"))
    return bad.select(F.col("play_id").alias("probe_id"), "credited", "rally_id", "t", "x", "y").repartition(t.tasks, "rally_id")


def _sided(t: Tables) -> DataFrame:
    return t.probes().withColumn("side", d.side(F.col("x"), F.col("y"))).withColumn("cluster", F.when(F.col("probe_id") % 4 != 0, F.col("cluster_id")))


QUERIES = {
    "live_identities": lambda t: t["identities"].select("identity_id", "game_id", "cluster_id", "name", "player_id", "team"),
    "scoped_touches": lambda t: t["plays"].join(t["rallies"].select("rally_id", "game_id", "played_on"), "rally_id").groupBy("game_id", "played_on").agg(F.count(F.lit(1)).alias("touches"), F.countDistinct("rally_id").alias("rallies")),
    "resolve_merges": lambda t: scope.resolve_merges(t["all"]["identities"]),
    "tracklet_identity": lambda t: scope.tracklet_identity(t["all"]["tracklets"], t["all"]["rallies"], t["all"]["identities"]),
    "mispaired": lambda t: scope.mispaired(t["all"]["plays"], t["all"]["tracklets"], t["all"]["identities"], t["all"]["rallies"]),
    "review_state": lambda t: scope.review_state(t["all"]),
    "export_stats": lambda t: scope.export_stats(scope.export_corrections(t["all"]), t["all"]["identities"]),
    "export_corrections": lambda t: scope.export_corrections(t["all"]).select("game_id", "rally_id", F.size("plays").cast("long").alias("kept"), F.size("removed").cast("long").alias("removed"), F.array_join(F.transform("plays", lambda x: x["play_id"].cast("string")), ",").alias("ids")),
    "resequence": lambda t: scope.resequence(t["all"]["games"]),
    "backfill_players": lambda t: scope.backfill_players(t["all"]["identities"]),
    "game_names": _named_games,
    "league_grades": lambda t: t.graded().select("play_id", "grade"),
    "league_stats": lambda t: t.stats(),
    "night_stats": lambda t: t.stats(["played_on"]),
    "player_ratios": lambda t: s.ratios(t.stats()),
    "compare_players": lambda t: s.compare_players(t.stats(["played_on"]), ["played_on"]),
    "night_labels": lambda t: t.labels(),
    "night_leaders": lambda t: night.leaders(t.stats(["played_on"]), t.labels()),
    "longest_runs": _runs,
    "night_connections": lambda t: night.kill_chains(t.graded(), t["identities"])[0],
    "night_sparks": lambda t: night.kill_chains(t.graded(), t["identities"])[1],
    "night_favourites": lambda t: night.favourites(night.kill_chains(t.graded(), t["identities"])[0]),
    "night_shoutouts": _shouts,
    "game_lines": _lines,
    "night_longest_rallies": lambda t: night.longest_rallies(t["rallies"], t["plays"]),
    "night_summary": _summary,
    "night_text": lambda t: night.summary_text(_lines(t), night.leaders(t.stats(["played_on"]), t.labels()), _runs(t), night.longest_rallies(t["rallies"], t["plays"])),
    "find_assists": lambda t: clips.find_clips(t["rallies"], t.graded(), t["identities"], "assist"),
    "find_aces": lambda t: clips.find_clips(t["rallies"], t.graded(), t["identities"], "ace"),
    "dig_moments": lambda t: clips.moments(t.graded(), "dig_kept"),
    "moment_windows": lambda t: clips.moment_window(t.graded(), t["rallies"]),
    "player_reel": lambda t: clips.player_reel(t.graded(), t["rallies"], t["identities"]),
    "stat_chips": lambda t: clips.stat_chips(t.stats()),
    "filter_boxes": lambda t: d.filter_boxes(t.boxes()).groupBy("game_id").agg(F.count(F.lit(1)).alias("boxes")),
    "tracklet_bounds": lambda t: d.tracklet_bounds(t.boxes().where("h >= 45")),
    "gate_phase": lambda t: d.gate_phase(t["all"]["rallies"], t["all"]["rallies"].groupBy("game_id").agg((F.min("start_s") + 9000).alias("game_start"))).groupBy("game_id", "phase").agg(F.count(F.lit(1)).alias("rallies")),
    "court_sides": lambda t: t.probes().select("probe_id", d.side(F.col("x"), F.col("y")).cast("long").alias("side"), F.round(d.dist_to_net(F.col("x"), F.col("y")), 3).alias("net")),
    "confident_points": lambda t: d.confident(t.ball(), 0.4).groupBy("rally_id").agg(F.count(F.lit(1)).alias("points")),
    "reject_wristless": lambda t: d.reject_wristless(_wristed(t)).select("probe_id"),
    "attribute_by_wrist": lambda t: d.attribute_by_wrist(_wristed(t)).select("probe_id", "cluster", "dist_px"),
    "boxes_at": lambda t: d.boxes_at(t.probes().drop("cluster_id"), t.boxes(), 0.3),
    "attribute": lambda t: d.attribute(t.probes().drop("cluster_id"), t.boxes(), 300.0, 600.0),
    "relink_tracklets": lambda t: d.relink(_mispaired_probes(t), t.boxes(), 0.3),
    "outside_boxes": lambda t: d.outside_boxes(t.probes(), t.boxes()),
    "wrist_clusters": lambda t: d.wrist_clusters(t.probes().drop("cluster_id"), t.boxes(), 0.3),
    "link_contacts": lambda t: d.link_contacts(t["plays"], t.probes().withColumn("t", F.col("t") + (F.col("probe_id") % 9 - 4) / 64)),
    "static_cells": lambda t: d.global_static_cells(t.ball("game_id"), rallies=2, least=5),
    "pick_moving": lambda t: d.pick_moving(t.ball(), share=0.3),
    "camera_metrics": lambda t: t.metrics(),
    "compare_cameras": lambda t: d.compare_cameras(t.metrics(), 1).withColumn("ratio", F.round("ratio", 6)),
    "action_band": lambda t: d.action_band(t.boxes()).select("rally_id", F.round("middle", 4).alias("middle"), F.round("low", 4).alias("low")),
    "player_envelope": lambda t: d.player_envelope(t.boxes()),
    "apply_merges": lambda t: changes.apply_merges(_plays_of_games(t), _merges(t)).select("play_id", "cluster_id"),
    "apply_dismissals": lambda t: changes.apply_dismissals(_plays_of_games(t), t["all"]["identities"].where("dismissed"))[1].select("game_id", "cluster_id", F.size("dismissed_plays").cast("long").alias("plays"), F.element_at("dismissed_plays", 1).alias("first_play")),
    "undo_dismissals": lambda t: (lambda pair: changes.undo_dismissals(*pair).select("play_id", "cluster_id"))(changes.apply_dismissals(_plays_of_games(t), t["all"]["identities"].where("dismissed"))),
    "apply_reassign": lambda t: changes.apply_reassign(_tracklets_of_games(t), _plays_of_games(t), t["all"]["tracklets"].where("tracklet_id % 40 = 3"))[1].select("play_id", "cluster_id"),
    "apply_splits": lambda t: changes.apply_splits(t["all"]["rallies"], t["all"]["plays"], t["all"]["rallies"].where("rally_id % 10 = 0").selectExpr("rally_id", "start_s + rally_id % 13 AS at"))[0].select("rally_id", "half", "start_s", "end_s", "outcome_type", "outcome_cluster"),
    "split_touches": lambda t: changes.apply_splits(t["all"]["rallies"], t["all"]["plays"], t["all"]["rallies"].where("rally_id % 10 = 0").selectExpr("rally_id", "start_s + rally_id % 13 AS at"))[1].select("play_id", "half"),
    "player_changes": lambda t: changes.apply_player_changes(t["all"]["identities"], t["all"]["identities"].where("player_id % 10 = 1").selectExpr("player_id", "player_id + 1 AS into").distinct(), t["all"]["identities"].where("player_id % 10 = 2").selectExpr("player_id", "concat('Renamed ', player_id) AS new_name").distinct()).select("identity_id", "player_id", "name"),
    "roster_links": lambda t: changes.apply_roster_links(_users(t), t["all"]["identities"].where("player_id % 3 = 1").groupBy("player_id").agg(F.min("name").alias("name")).selectExpr("concat('U', player_id, '@example.org') AS email", "player_id", "name")),
    "delete_games": lambda t: changes.delete_games({k: t["all"][k] for k in ("games", "rallies", "plays")}, t["all"]["games"].where("game_id % 4 = 1").select("game_id"))["slots"],
    "duplicate_players": lambda t: matching.duplicate_players(_users(t).withColumn("name", F.concat("name", F.lit(" "), F.col("player_id").cast("string"))).withColumn("name", F.when(F.col("player_id") % 4 == 0, F.concat(F.substring("name", 1, 3), F.col("player_id").cast("string"), F.lit("x"))).otherwise(F.concat(F.substring("name", 1, 3), F.lit(" "), (F.col("player_id") % 20).cast("string"))))),
    "match_roster": lambda t: matching.match_roster(_users(t).select("email", "name"), t["all"]["identities"].where("player_id is not null").groupBy("player_id").agg(F.min("name").alias("name")), _users(t).where("player_id % 8 = 0").select("email", "player_id")).withColumn("candidates", F.size("candidates").cast("long")),
    "recipients": lambda t: matching.recipients(_users(t), t["identities"], t["rallies"], t["plays"], t["identities"].join(t["games"], "game_id").where("player_id % 7 = 0").select("player_id", "played_on")),
    "reap_stale": lambda t: matching.reap_stale(_jobs(t), F.lit("2024-01-03 00:00:00").cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("jobs")),
    "queue_rollup": lambda t: matching.queue_rollup(_jobs(t)),
    "map_rallies": lambda t: evaluation.map_rallies(t["rallies"], _found_rallies(t)),
    "match_touches": lambda t: _pairs(t)[0],
    "evaluation_funnel": lambda t: evaluation.funnel(*_judged(t)),
    "type_confusions": lambda t: evaluation.confusions(_judged(t)[0]),
    "find_contacts": lambda t: sequences.find_contacts(t.ball().dropDuplicates(["rally_id", "t"])),
    "classify_contacts": lambda t: sequences.classify(t.probes().withColumn("side", d.side(F.col("x"), F.col("y")))).drop("config"),
    "sweep_typing": lambda t: sequences.sweep_typing(_sided(t), t["plays"].select(F.col("play_id").alias("probe_id"), "play_type", "cluster_id")),
    "thin_points": lambda t: sequences.thin(t.ball()),
    "link_nearest": lambda t: sequences.link_nearest(t.ball()),
    "local_days": lambda t: t["views"].groupBy(n.played_on(F.col("created_at"), "America/New_York").alias("day")).agg(F.count(F.lit(1)).alias("views"), F.countDistinct("visitor").alias("visitors")).orderBy(F.desc("day")).limit(90),
    "hour_labels": lambda t: t["views"].groupBy(n.hour_label(F.hour("created_at")).alias("hour")).agg(F.count(F.lit(1)).alias("views")),
    "top_referrers": lambda t: rosters.referrers(t["views"]),
    "traffic_total": lambda t: t["views"].agg(F.count(F.lit(1)).alias("views"), F.countDistinct("visitor").alias("visitors")),
    "visitor_hashes": lambda t: t["views"].select("view_id", n.visitor_hash("salt", F.to_date("created_at"), F.concat(F.lit("10.0.0."), F.col("visitor").cast("string"), F.lit(", 10.9.9.9"))).alias("hash")),
    "norm_names": lambda t: t["identities"].select("identity_id", n.norm_name(F.concat(F.lit("  "), "name", F.lit("  2"))).alias("norm"), n.public_name(F.col("name")).alias("first"), n.player_slug(F.col("name"), F.col("identity_id")).alias("slug"), n.parse_player_slug(n.player_slug(F.col("name"), F.col("identity_id"))).alias("parsed"), n.public_caption(F.concat(F.lit("KILL - "), "name")).alias("caption")),
    "outcome_tones": lambda t: t["rallies"].groupBy(n.outcome_tone(F.col("outcome_type")).alias("tone")).agg(F.count(F.lit(1)).alias("rallies")),
    "participants_by_night": lambda t: t["plays"].join(t["rallies"].select("rally_id", "game_id", "played_on"), "rally_id").select("played_on", "game_id", "cluster_id").distinct().join(t["identities"].select("game_id", "cluster_id", "name"), ["game_id", "cluster_id"]).groupBy("played_on").agg(F.countDistinct("name").alias("players")),
}


def queries() -> dict:
    def on_tables(f):
        return lambda spark, sf_dir: f(tables(spark, sf_dir))

    def traffic_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = traffic.view_stream(spark, sf_dir, "events.parquet")
        return traffic.latest(traffic.hourly(views), shared_path(spark, "traffic"), shared_path(spark, "traffic-log"))

    return {k: on_tables(f) for k, f in QUERIES.items()} | {"traffic_stream": traffic_stream}


def oracle_sql() -> dict:
    from courtlake.plans.league_sql import SQL

    return SQL
