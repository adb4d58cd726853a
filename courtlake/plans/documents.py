"""Queries on documents, lists, files and streams that the league's tables are turned into, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.functions import names as n
from courtlake.operators import detections as d
from courtlake.operators import changes, matching, night, people, scope
from courtlake.plans.league import Tables, tables
from courtlake.plans.league_sql import NIGHT, SLOTS
from courtlake.sources import bundles
from courtlake.sources.league import ALL_SQL, SCOPE_SQL
from courtlake.sources.store import shared_path
from courtlake.streaming import traffic

_STAMP = "named_struct('vbpipe_version', if(game_id % 3 = 0, null, '1.1'), 'stages', map('track', named_struct('at', '2024-03-01T10:00:00Z', 'vbpipe_version', if(game_id % 2 = 0, '1.2', null), 'config', map('fps', cast(game_id % 4 * 5 + 15 AS string)), 'params', map('conf', '0.25'), 'env', map('gpu', 'none'))))"


def _bundles(t: Tables) -> DataFrame:
    """Each game as the document that a pipeline would have written: rallies with contacts, tracklets, clusters, its stamp."""
    of = t["all"]["rallies"].select("rally_id", "game_id")
    plays = t["all"]["plays"].groupBy("rally_id").agg(F.sort_array(F.collect_list(F.struct("t", "play_id", "x", "y", F.col("play_type").alias("play"), F.col("cluster_id").alias("cluster"), F.col("tracklet_id").alias("tracklet")))).alias("contacts"))
    r = t["all"]["rallies"].join(plays, "rally_id", "left").groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start_s").alias("start"), "rally_id", F.col("end_s").alias("end"), F.when(F.col("phase") == "warmup", "warmup").alias("phase"), "contacts"))).alias("rallies"))
    crops = F.transform(F.sequence(F.lit(1), (F.col("p") % 6 + 1).cast("int")), lambda i: F.concat(F.lit("c"), i.cast("string")))
    k = t["all"]["tracklets"].join(of, "rally_id").groupBy("game_id").agg(F.collect_list(F.struct(F.col("tracklet_id").alias("id"), "t0", "t1", F.col("cluster_id").alias("cluster"), crops.alias("crops"))).alias("tracklets"))
    c = t["all"]["identities"].groupBy("game_id").agg(F.collect_list(F.struct(F.col("cluster_id").alias("cluster"))).alias("clusters"))
    stamp = F.when(F.col("game_id") % 5 != 0, F.expr(_STAMP)).alias("pipeline")
    docs = t["all"]["games"].select("game_id", "name", F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at"), stamp).join(r, "game_id").join(k, "game_id", "left").join(c, "game_id", "left")
    text = docs.select(F.concat(F.lit("game-"), F.col("game_id").cast("string"), F.lit(".json")).alias("file"), F.to_json(F.struct("name", "recorded_at", "rallies", "tracklets", "clusters", "pipeline")).alias("json"))
    return text.select("file", F.from_json("json", bundles.BUNDLE).alias("d")).select("file", "d.*")


def _flat(t: Tables) -> DataFrame:
    flat = bundles.flatten_bundles(_bundles(t))
    games = flat["games"].select("game_id", "name", "recorded_at", F.size("stages").cast("long").alias("stages"))
    count = lambda name, *more: flat[name].groupBy("game_id").agg(F.count(F.lit(1)).alias(name), *more)
    out = games.join(count("rallies", F.count_if(F.col("phase") == "warmup").alias("warmups"), F.max("idx").cast("long").alias("last_idx")), "game_id", "left")
    out = out.join(count("plays", F.count("play_type").alias("typed"), F.round(F.sum("t"), 3).alias("times"), F.count("tracklet_id").alias("linked")), "game_id", "left")
    bodies = flat["plays"].join(flat["tracklets"].select("tracklet_id"), "tracklet_id", "left_semi").groupBy("game_id").agg(F.count(F.lit(1)).alias("found"))
    out = out.join(count("tracklets", F.sum(F.size("crops")).alias("crops")), "game_id", "left").join(count("identities"), "game_id", "left").join(bodies, "game_id", "left")
    return out.drop("game_id").na.fill(0)


def _lists(t: Tables) -> DataFrame:
    """Pasted member lists: commas with a header in lists of even number, tabs without one in the others; some lines without an address, some twice."""
    rows = t["all"]["identities"].where("name is not null").selectExpr("game_id AS list_id", "cluster_id AS line", "if(cluster_id % 6 = 0, 'nobody', concat('p', coalesce(player_id, 0), '@Example.org')) AS mail", "name")
    data = rows.select("list_id", "line", F.when(F.col("list_id") % 2 == 0, F.concat(F.lit('"'), "name", F.lit(', Jr.",'), "mail")).otherwise(F.concat("mail", F.lit("\t"), "name")).alias("text"))
    head = rows.where("list_id % 2 = 0").select("list_id").distinct().select("list_id", F.lit(0).cast("long").alias("line"), F.lit("Name,E-Mail").alias("text"))
    return data.unionByName(head)


def _snapshot(t: Tables) -> dict[str, DataFrame]:
    users = t["all"]["identities"].where("player_id is not null").groupBy("player_id").agg(F.min("name").alias("name")).selectExpr("player_id AS user_id", "concat('u', player_id, '@example.org') AS email", "player_id")
    recaps = t["all"]["identities"].where("player_id is not null").selectExpr("player_id", "concat('u', player_id, '@example.org') AS email", "if(cluster_id = 3, 'bounced', null) AS error")
    return {"users": users, "recaps": recaps, "views": t["all"]["views"], "sessions": t["all"]["views"].select("visitor"), "identities": t["all"]["identities"]}


def _leaks(t: Tables) -> DataFrame:
    before = scope.leak_counts(_snapshot(t)).withColumnRenamed("rows", "before")
    return before.join(scope.leak_counts(scope.scrub(_snapshot(t))).withColumnRenamed("rows", "after"), "check")


def _shorts(t: Tables) -> DataFrame:
    return t["all"]["plays"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id").selectExpr(
        "play_id AS short_id", "game_id", "element_at(array('published', 'queued', 'rendering', 'published'), cast(play_id % 4 + 1 AS int)) AS status", "if(play_id % 7 = 0, null, concat('v', play_id)) AS video_id",
        "if(play_id % 3 = 0, null, timestamp_seconds(1700000000 + play_id % 5000)) AS published_at", "concat('KILL - ', coalesce(play_type, 'Play'), ' Surname') AS caption",
    )


SHORTS = """, shorts AS (SELECT play_id AS short_id, game_id, ['published', 'queued', 'rendering', 'published'][CAST(play_id % 4 + 1 AS INT)] AS status, CASE WHEN play_id % 7 <> 0 THEN 'v' || CAST(play_id AS VARCHAR) END AS video_id,
  CASE WHEN play_id % 3 <> 0 THEN 1700000000 + play_id % 5000 END AS published_at, 'KILL - ' || coalesce(play_type, 'Play') AS caption FROM all_plays JOIN all_rallies USING (rally_id))
"""


def _posts(t: Tables) -> DataFrame:
    return _shorts(t).where("short_id % 2 = 1").selectExpr("short_id", "element_at(array('queued', 'posting', 'posted'), cast(short_id % 3 + 1 AS int)) AS status")


def _files(t: Tables) -> DataFrame:
    """A bundle for most games: exact by other punctuation, longer, or with a part of the name alone."""
    return t["all"]["games"].where("game_id % 4 <> 3").selectExpr("CASE game_id % 4 WHEN 0 THEN concat('game_bundle_', replace(lower(name), '#', '-'), '.zip') WHEN 1 THEN concat('uploads/', replace(name, '#', ' '), ' final.zip') ELSE concat(substr(name, 10), '.zip') END AS file")


def _courts(t: Tables) -> DataFrame:
    point = "array(array(0.1D, 0.2D), array(cast(game_id % 10 AS double) / 10, 0.9D))"
    none = "cast(null AS array<array<double>>)"
    cal = t["all"]["games"].where("game_id % 3 = 0").selectExpr("name AS video", f"if(game_id % 2 = 0, {point}, {none}) AS playing_area", f"if(game_id % 2 = 1, {point}, {none}) AS court_poly", f"if(game_id % 9 = 0, {none}, {point}) AS net_base")
    default = t["all"]["games"].limit(1).selectExpr("'_default' AS video", f"{none} AS playing_area", "array(array(0.5D, 0.5D)) AS court_poly", f"{none} AS net_base")
    got = bundles.court_for(t["all"]["games"], cal.unionByName(default))
    show = lambda c: F.array_join(F.transform(c, lambda p: F.concat(F.round(F.get(p, F.lit(0)), 3).cast("string"), F.lit(" "), F.round(F.get(p, F.lit(1)), 3).cast("string"))), ", ")
    return got.select("game_id", show("court").alias("court"), show("net").alias("net"), "source")


def _appearance(t: Tables) -> DataFrame:
    v = t["vectors"].selectExpr("vec_id AS tracklet_id", "vec_id % 7 AS game_id", "label AS cluster_id", "if(vec_id % 11 = 0, null, transform(embedding, x -> cast(x AS double))) AS embedding")
    return bundles.typicality(v, bundles.cluster_embeddings(v)).select("tracklet_id", F.round("typicality", 6).alias("typicality"))


def _audio(t: Tables) -> DataFrame:
    """A sample of sound for each touch, eight a second, and a second of motion for each rally's touch."""
    rows = t["all"]["plays"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")))
    return rows.selectExpr("concat('g', game_id % 20) AS video", "(play_id * 8 + k) % 40000 AS i", "cast((play_id * 13 + k * 7) % 200 - 100 AS double) AS v").groupBy("video", "i").agg(F.max("v").alias("v"))


AUDIO = """, au AS (SELECT 'g' || CAST(game_id % 20 AS VARCHAR) AS video, (play_id * 8 + k) % 40000 AS i, max(CAST((play_id * 13 + k * 7) % 200 - 100 AS DOUBLE)) AS v FROM all_plays JOIN all_rallies USING (rally_id), (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY 1, 2),
pk AS (SELECT video, i // 2 AS q, max(abs(v)) AS peak FROM au GROUP BY 1, 2 HAVING count(*) = 2)
"""
MOTION = ", mo AS (SELECT 'g' || CAST(game_id % 20 AS VARCHAR) AS video, CAST(t AS BIGINT) % 600 AS sec, CAST(count(*) AS DOUBLE) AS v FROM all_plays JOIN all_rallies USING (rally_id) GROUP BY 1, 2)\n"


def _motion(t: Tables) -> DataFrame:
    rows = t["all"]["plays"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id")
    return rows.groupBy(F.concat(F.lit("g"), (F.col("game_id") % 20).cast("string")).alias("video"), (F.col("t").cast("long") % 600).alias("sec")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def _ledger(t: Tables) -> DataFrame:
    return t["identities"].join(t["games"], "game_id").where("player_id % 7 = 0").select("player_id", "played_on")


def _members(t: Tables) -> DataFrame:
    return t["all"]["identities"].where("player_id is not null").groupBy("player_id").agg(F.min("name").alias("name")).selectExpr("player_id", "concat('u', player_id, '@example.org') AS email", "name")


def _undone(t: Tables) -> DataFrame:
    """Dismissals without a list, of which the touches have lost their cluster, taken back through the tracklets."""
    bodies = t["all"]["tracklets"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id")
    plays = t["plays"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id").select("game_id", "play_id", "cluster_id", "tracklet_id")
    lost = plays.withColumn("cluster_id", F.when(F.col("play_id") % 3 != 0, F.col("cluster_id")))
    blank = t["all"]["identities"].where("dismissed").select("game_id", "cluster_id", F.lit(None).cast("array<bigint>").alias("dismissed_plays"))
    return changes.undo_dismissals(lost, blank, bodies).select("play_id", "cluster_id")


def _documents(t: Tables) -> DataFrame:
    docs = scope.game_documents(t["all"])
    kept = F.aggregate(F.transform("rallies", lambda r: F.size(r["plays"])), F.lit(0), lambda a, b: a + b).cast("long")
    gone = F.aggregate(F.transform("rallies", lambda r: F.size(r["removed"])), F.lit(0), lambda a, b: a + b).cast("long")
    merged = F.size(F.filter("identities", lambda i: i["merged_into"].isNotNull())).cast("long")
    order = F.array_join(F.transform("rallies", lambda r: r["rally_id"].cast("string")), ",")
    return docs.select("game_id", "name", "slug", "played_on", "video_stem", "review_stats.*", kept.alias("kept"), gone.alias("removed"), merged.alias("merged"), order.alias("rallies"))


QUERIES = {
    "flatten_bundle": _flat,
    "pipeline_stages": lambda t: bundles.parse_pipeline(_bundles(t)).select("file", "stage", "version", F.col("config")["fps"].alias("fps"), F.col("env")["gpu"].alias("gpu"), "training"),
    "game_documents": _documents,
    "court_for": _courts,
    "parse_roster": lambda t: matching.parse_roster(_lists(t)),
    "scrubbed_leaks": _leaks,
    "scope_of_game": lambda t: scope.scope(t["all"], game_id=2, day="2024-01-02")["rallies"].select("game_id", "rally_id", "played_on"),
    "scope_of_day": lambda t: scope.scope(t["all"], day="2024-01-03")["rallies"].select("game_id", "rally_id", "played_on"),
    "public_reel": lambda t: matching.reel(_shorts(t), t["all"]["games"]),
    "pending_work": lambda t: matching.pending_work(_shorts(t), _posts(t)),
    "match_bundles": lambda t: matching.match_bundles(t["all"]["games"], _files(t)),
    "typicality": _appearance,
    "audio_peaks": lambda t: d.audio_peaks(_audio(t), rate=8),
    "segments": lambda t: d.segment(_motion(t), d.audio_peaks(_audio(t), rate=8)),
    "sweep_segments": lambda t: d.sweep_segments(_motion(t)),
    "recap_nights": lambda t: matching.recap_nights(t["all"]["games"], _ledger(t)),
    "games_newest_first": lambda t: matching.newest_first(t["all"]["games"].join(scope.resequence(t["all"]["games"]).select("game_id", "slot"), "game_id", "left")).select("game_id", "played_on", "slot"),
    "review_order": lambda t: matching.review_order(t["all"]["tracklets"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id").withColumn("typicality", F.when(F.col("p") % 5 != 0, F.col("p") % 17 / 16))),
    "pooled_labels": lambda t: matching.pool({"kept": t["all"]["plays"].where("not deleted").select("play_id", "grade"), "removed": t["all"]["plays"].where("deleted").select("play_id")}).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count("grade").alias("graded")),
    "unprocessed_videos": lambda t: matching.unprocessed(t["all"]["games"].select(F.concat(F.lit("videos/"), "name", F.lit(".mp4")).alias("file")), t["all"]["games"].where("game_id % 3 <> 0").select(F.concat(F.lit("game_bundle_"), "name", F.lit(".zip")).alias("file"))),
    "recap_mails": lambda t: night.recap_mail(t.stats(["played_on"]), matching.recipients(_members(t), t["identities"], t["rallies"], t["plays"], _ledger(t)), "https://example.invalid", "Court night").select("played_on", "email", "subject", F.md5("text").alias("text")),
    "undo_old_dismissals": lambda t: _undone(t),
    "cluster_summary": lambda t: people.cluster_summary(t["all"]["tracklets"].join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id").select("game_id", "tracklet_id", F.col("cluster_id").alias("cluster")), t["all"]["tracklets"].selectExpr("tracklet_id", "p % 9 + 1 AS n_boxes", "transform(sequence(1, cast(p % 4 + 1 AS int)), i -> concat(tracklet_id, '-', i)) AS crops")).withColumn("rep_crops", F.array_join("rep_crops", ",")),
    "text_columns": lambda t: t["all"]["games"].select(
        "game_id", n.file_stem(F.concat(F.lit("a/b/"), "name", F.lit(".cut.mp4"))).alias("stem"), n.played_on(F.col("recorded_at"), "America/New_York").alias("local_day"),
        n.range_start("week", F.col("recorded_at"), "America/New_York").alias("week"), F.size(n.json_array(F.when(F.col("game_id") % 3 == 0, "[1, 2, oops").otherwise(F.concat(F.lit("["), F.col("game_id").cast("string"), F.lit(", 7]"))), "bigint")).cast("long").alias("items"),
    ),
}


def queries() -> dict:
    def on_tables(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = tables(spark, sf_dir)
            t["vectors"] = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
            return f(t)

        return run

    def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = spark.read.option("pathGlobFilter", "events.parquet").parquet(sf_dir).schema
        return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))

    def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
        """One row for each user and kind of event within the watermark, which is longer than the table."""
        rows = stream(spark, sf_dir).select("user_id", "event_type", "ts")
        return traffic.drain(traffic.dedupe(rows, ["user_id", "event_type"], "ts", "400 days"), shared_path(spark, "ledger"), shared_path(spark, "ledger-log")).select("user_id", "event_type")

    def reaped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Jobs that end by themselves; those that are staging wait for three minutes of silence, which the stream's end isn't."""
        jobs = stream(spark, sf_dir).selectExpr("event_id AS job_id", "element_at(array('done', 'failed', 'staging'), cast(event_id % 3 + 1 AS int)) AS status", "ts AS updated_at")
        return traffic.drain(traffic.reap(jobs), shared_path(spark, "reaped"), shared_path(spark, "reaped-log")).where("job_id % 3 <> 2")

    return {k: on_tables(f) for k, f in QUERIES.items()} | {"ledger_stream": ledger_stream, "reaped_stream": reaped_stream}


_FIXED = lambda at: ", ".join(f"{round(x, 3)} {round(y, 3)}" for x, y in at)
_POINTS = "'0.1 0.2, ' || CAST(round(CAST(game_id % 10 AS DOUBLE) / 10, 3) AS VARCHAR) || ' 0.9'"
_NORM = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
_WEEK = "(CAST(l AS DATE) - CAST(dayofweek(l) AS INTEGER))"
SQL = {
    "flatten_bundle": ALL_SQL + """, r AS (SELECT game_id, count(*) AS rallies, count(*) FILTER (WHERE phase = 'warmup') AS warmups, count(*) - 1 AS last_idx FROM all_rallies GROUP BY 1),
p AS (SELECT game_id, count(*) AS plays, count(play_type) AS typed, round(sum(t), 3) AS times, count(tracklet_id) AS linked, count(*) FILTER (WHERE tracklet_id IN (SELECT tracklet_id FROM tracklets)) AS found FROM all_plays JOIN all_rallies USING (rally_id) GROUP BY 1),
k AS (SELECT game_id, count(*) AS tracklets, CAST(sum(least(p % 6 + 1, 4)) AS BIGINT) AS crops FROM tracklets JOIN all_rallies USING (rally_id) GROUP BY 1), i AS (SELECT game_id, count(*) AS identities FROM all_identities GROUP BY 1)
SELECT name, recorded_at, CASE WHEN game_id % 5 <> 0 THEN 1 END AS stages, rallies, warmups, last_idx, coalesce(plays, 0) AS plays, coalesce(typed, 0) AS typed, coalesce(times, 0) AS times, coalesce(linked, 0) AS linked, coalesce(tracklets, 0) AS tracklets, coalesce(crops, 0) AS crops, coalesce(identities, 0) AS identities, coalesce(found, 0) AS found
FROM all_games JOIN r USING (game_id) LEFT JOIN p USING (game_id) LEFT JOIN k USING (game_id) LEFT JOIN i USING (game_id)""".replace("CASE WHEN game_id % 5 <> 0 THEN 1 END", "CASE WHEN game_id % 5 <> 0 THEN 1 ELSE 0 END"),
    "pipeline_stages": ALL_SQL + """SELECT 'game-' || CAST(game_id AS VARCHAR) || '.json' AS file, CASE WHEN s THEN 'track' END AS stage, CASE WHEN s THEN v END AS version, CASE WHEN s THEN CAST(game_id % 4 * 5 + 15 AS VARCHAR) END AS fps, CASE WHEN s THEN 'none' END AS gpu, s AND v IS NOT NULL AS training
FROM (SELECT game_id, game_id % 5 <> 0 AS s, CASE WHEN game_id % 2 = 0 THEN '1.2' WHEN game_id % 3 <> 0 THEN '1.1' END AS v FROM all_games) WHERE game_id IN (SELECT game_id FROM all_rallies)""",
    "game_documents": ALL_SQL + SLOTS + """, x AS (SELECT g.*, slot, strftime(g.played_on, '%a, %b ') || CAST(day(g.played_on) AS VARCHAR) || strftime(g.played_on, ' %Y') AS dl, CAST(g.played_on AS VARCHAR) AS iso, CASE WHEN slot > 0 THEN 'Game ' || CAST(slot AS VARCHAR) END AS no FROM all_games g LEFT JOIN slots USING (game_id)),
r AS (SELECT game_id, count(outcome_type) AS outcomes_set, count(*) FILTER (WHERE touches_complete AND phase = 'game') AS complete_rallies, string_agg(CAST(rally_id AS VARCHAR), ',' ORDER BY start_s, rally_id) AS rallies FROM all_rallies GROUP BY 1),
p AS (SELECT game_id, count(*) FILTER (WHERE corrected OR deleted) AS c, count(*) FILTER (WHERE NOT deleted) AS kept, count(*) FILTER (WHERE deleted) AS removed FROM all_plays JOIN all_rallies USING (rally_id) GROUP BY 1), i AS (SELECT game_id, count(name) AS nm, count(merged_into) AS merged FROM all_identities GROUP BY 1)
SELECT game_id, CASE WHEN label IS NOT NULL THEN label WHEN played_on IS NULL THEN name ELSE concat_ws(' · ', dl, no) END AS name, CASE WHEN played_on IS NULL THEN 'vban-game-' || CAST(game_id AS VARCHAR) ELSE 'vban-' || iso || CASE WHEN slot > 0 THEN '-g' || CAST(slot AS VARCHAR) ELSE '' END END AS slug, played_on,
  trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS video_stem, coalesce(c, 0) AS corrected_or_removed, coalesce(outcomes_set, 0) AS outcomes_set, coalesce(complete_rallies, 0) AS complete_rallies, coalesce(nm, 0) AS named_identities,
  CASE WHEN rallies IS NOT NULL THEN coalesce(kept, 0) END AS kept, CASE WHEN rallies IS NOT NULL THEN coalesce(removed, 0) END AS removed, merged, rallies FROM x LEFT JOIN r USING (game_id) LEFT JOIN p USING (game_id) LEFT JOIN i USING (game_id)""",
    "court_for": ALL_SQL + f"""SELECT game_id, CASE WHEN game_id % 3 = 0 THEN {_POINTS} ELSE '0.5 0.5' END AS court, CASE WHEN game_id % 3 = 0 AND game_id % 9 <> 0 THEN {_POINTS} ELSE '{_FIXED(bundles.DEFAULT_NET)}' END AS net, CASE WHEN game_id % 3 = 0 THEN 'video' ELSE 'default' END AS source FROM all_games""",
    "parse_roster": ALL_SQL + """SELECT list_id, line, name, email, NOT has OR row_number() OVER (PARTITION BY list_id, email ORDER BY line) > 1 AS skipped FROM (SELECT game_id AS list_id, cluster_id AS line, name || CASE WHEN game_id % 2 = 0 THEN ', Jr.' ELSE '' END AS name, cluster_id % 6 <> 0 AS has, CASE WHEN cluster_id % 6 = 0 THEN 'nobody' ELSE 'p' || CAST(coalesce(player_id, 0) AS VARCHAR) || '@example.org' END AS email FROM all_identities WHERE name IS NOT NULL)""",
    "scrubbed_leaks": ALL_SQL + """SELECT 'users' AS "check", count(DISTINCT player_id) AS before, 0 AS after FROM all_identities UNION ALL SELECT 'recaps', count(player_id), 0 FROM all_identities UNION ALL SELECT unnest(['views', 'sessions']), (SELECT count(*) FROM views), 0""",
    "scope_of_game": ALL_SQL + "SELECT game_id, rally_id, played_on FROM all_rallies JOIN all_games USING (game_id) WHERE game_id = 2 AND published AND played_on IS NOT NULL AND phase = 'game'",
    "scope_of_day": ALL_SQL + "SELECT game_id, rally_id, played_on FROM all_rallies JOIN all_games USING (game_id) WHERE played_on = DATE '2024-01-03' AND published AND phase = 'game'",
    "public_reel": ALL_SQL + SHORTS + "SELECT short_id, video_id, caption FROM shorts JOIN all_games USING (game_id) WHERE status = 'published' AND video_id IS NOT NULL AND published ORDER BY published_at DESC NULLS LAST, short_id DESC LIMIT 12",
    "pending_work": ALL_SQL + SHORTS + """, ps AS (SELECT game_id, count(*) AS posts FROM shorts WHERE short_id % 2 = 1 AND short_id % 3 < 2 GROUP BY 1)
SELECT game_id, count(*) FILTER (WHERE status IN ('queued', 'rendering')) AS renders, any_value(coalesce(posts, 0)) AS posts, count(*) FILTER (WHERE status IN ('queued', 'rendering')) + any_value(coalesce(posts, 0)) > 0 AS busy FROM shorts LEFT JOIN ps USING (game_id) GROUP BY 1""",
    "match_bundles": ALL_SQL + f""", f AS (SELECT CASE game_id % 4 WHEN 0 THEN 'game_bundle_' || replace(lower(name), '#', '-') || '.zip' WHEN 1 THEN 'uploads/' || replace(name, '#', ' ') || ' final.zip' ELSE substr(name, 10) || '.zip' END AS file FROM all_games WHERE game_id % 4 <> 3),
g AS (SELECT game_id, {_NORM("name")} AS g FROM all_games), h AS (SELECT file, {_NORM("regexp_replace(regexp_replace(lower(file), '^.*[/]', ''), '^game_bundle[-_ ]?|[.][^.]*$', '', 'g')")} AS h FROM f),
e AS (SELECT game_id, min(file) AS file FROM g JOIN h ON g = h GROUP BY 1) SELECT * FROM e UNION ALL SELECT game_id, min(file) FROM g JOIN h ON contains(h, g) OR contains(g, h) WHERE game_id NOT IN (SELECT game_id FROM e) GROUP BY 1""",
    "typicality": """WITH v AS (SELECT vec_id, vec_id % 7 AS g, label, CASE WHEN vec_id % 11 <> 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM embeddings),
u AS (SELECT g, label, i, avg(x) AS m FROM (SELECT g, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v WHERE e IS NOT NULL) GROUP BY 1, 2, 3),
c AS (SELECT g, label, list(CASE WHEN n > 0 THEN round(m / n, 5) ELSE round(m, 5) END ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY g, label)) AS n FROM u) GROUP BY 1, 2)
SELECT vec_id AS tracklet_id, round(CASE WHEN e IS NULL OR c IS NULL THEN -1.0::DOUBLE ELSE list_cosine_similarity(e, c) END, 6) AS typicality FROM v LEFT JOIN c USING (g, label)""",
    "audio_peaks": ALL_SQL + AUDIO + "SELECT * FROM pk",
    "segments": ALL_SQL + AUDIO + MOTION + """, sm AS (SELECT video, sec, (coalesce(lag(v) OVER w, 0) + v + coalesce(lead(v) OVER w, 0)) / 3 AS m FROM mo WINDOW w AS (PARTITION BY video ORDER BY sec)),
lv AS (SELECT video, quantile_cont(m, 0.2) AS lo, quantile_cont(m, 0.9) AS hi FROM sm GROUP BY 1), ac AS (SELECT video, sec FROM sm JOIN lv USING (video) WHERE m > lo + 0.35::DOUBLE * (hi - lo)),
nw AS (SELECT *, CASE WHEN sec - lag(sec) OVER w - 1 < 4 THEN 0 ELSE 1 END AS new FROM ac WINDOW w AS (PARTITION BY video ORDER BY sec)), rn AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY sec) AS g FROM nw),
sg AS (SELECT video, min(sec) AS start_s, max(sec) + 1 AS end_s FROM rn GROUP BY video, g HAVING max(sec) + 1 - min(sec) >= 4), br AS (SELECT video, quantile_cont(peak, 0.92) AS bar FROM pk GROUP BY 1), ld AS (SELECT video, q // 4 AS sec FROM pk JOIN br USING (video) WHERE peak > bar)
SELECT video, start_s, end_s, round((SELECT count(*) FROM ld WHERE ld.video = sg.video AND ld.sec >= start_s AND ld.sec < end_s) / (end_s - start_s) * 10, 1) AS contacts_per_10s FROM sg""",
    "sweep_segments": ALL_SQL + MOTION + """, sm AS (SELECT video, sec, (coalesce(lag(v) OVER w, 0) + v + coalesce(lead(v) OVER w, 0)) / 3 AS m FROM mo WINDOW w AS (PARTITION BY video ORDER BY sec)),
lv AS (SELECT video, quantile_cont(m, 0.2) AS lo, quantile_cont(m, 0.9) AS hi FROM sm GROUP BY 1),
cf AS (SELECT s AS share, l AS least, 4 AS max_gap FROM (SELECT unnest([0.15::DOUBLE, 0.2, 0.25, 0.3, 0.35, 0.45]) AS s), (SELECT unnest([2, 3, 4, 6]) AS l) UNION SELECT 0.35::DOUBLE, 4, unnest([1, 2, 3, 4, 6])),
ac AS (SELECT video, share, least, max_gap, sec FROM sm JOIN lv USING (video), cf WHERE m > lo + share * (hi - lo)),
nw AS (SELECT *, CASE WHEN sec - lag(sec) OVER w - 1 < max_gap THEN 0 ELSE 1 END AS new FROM ac WINDOW w AS (PARTITION BY video, share, least, max_gap ORDER BY sec)), rn AS (SELECT *, sum(new) OVER (PARTITION BY video, share, least, max_gap ORDER BY sec) AS g FROM nw),
sg AS (SELECT video, share, least, max_gap FROM rn GROUP BY video, share, least, max_gap, g HAVING max(sec) + 1 - min(sec) >= least), cn AS (SELECT video, share, least, max_gap, count(*) AS n FROM sg GROUP BY ALL)
SELECT v.video, cf.share, CAST(cf.least AS BIGINT) AS least, CAST(cf.max_gap AS BIGINT) AS max_gap, coalesce(n, 0) AS rallies FROM (SELECT DISTINCT video FROM mo) v CROSS JOIN cf LEFT JOIN cn ON cn.video = v.video AND cn.share = cf.share AND cn.least = cf.least AND cn.max_gap = cf.max_gap""",
    "recap_nights": SCOPE_SQL + "SELECT played_on, count(*) AS games, (SELECT count(*) FROM identities i JOIN games h USING (game_id) WHERE h.played_on = g.played_on AND player_id % 7 = 0) AS sent FROM games g GROUP BY 1",
    "games_newest_first": ALL_SQL + SLOTS + "SELECT game_id, g.played_on, slot FROM all_games g LEFT JOIN slots USING (game_id) WHERE published ORDER BY g.played_on DESC NULLS LAST, slot DESC NULLS LAST, game_id DESC",
    "review_order": ALL_SQL + "SELECT game_id, tracklet_id, row_number() OVER (PARTITION BY game_id ORDER BY CASE WHEN p % 5 <> 0 THEN p % 17 / 16 ELSE -1.0::DOUBLE END DESC, t0, tracklet_id) AS place FROM tracklets JOIN all_rallies USING (rally_id)",
    "pooled_labels": ALL_SQL + "SELECT 'kept' AS source, count(*) AS rows, count(grade) AS graded FROM all_plays WHERE NOT deleted UNION ALL SELECT 'removed', count(*), 0 FROM all_plays WHERE deleted",
    "unprocessed_videos": ALL_SQL + "SELECT 'videos/' || name || '.mp4' AS file FROM all_games WHERE game_id % 3 = 0",
    "recap_mails": NIGHT + """, us AS (SELECT player_id, 'u' || CAST(player_id AS VARCHAR) || '@example.org' AS email FROM all_identities WHERE player_id IS NOT NULL GROUP BY 1),
tc AS (SELECT DISTINCT r.played_on, player_id FROM plays p JOIN rallies r USING (rally_id) JOIN identities i ON i.game_id = r.game_id AND i.cluster_id = p.cluster_id WHERE player_id IS NOT NULL),
x AS (SELECT tc.played_on, email, tc.player_id, split_part(s.name, ' ', 1) AS f, strftime(tc.played_on, '%a, %b ') || CAST(day(tc.played_on) AS VARCHAR) || strftime(tc.played_on, ' %Y') AS d,
  array_to_string(list_filter([CASE WHEN kill > 0 THEN kill || CASE WHEN kill = 1 THEN ' kill' ELSE ' kills' END END, CASE WHEN ace > 0 THEN ace || CASE WHEN ace = 1 THEN ' ace' ELSE ' aces' END END, CASE WHEN stuff > 0 THEN stuff || CASE WHEN stuff = 1 THEN ' block' ELSE ' blocks' END END, CASE WHEN dig_ok > 0 THEN dig_ok || CASE WHEN dig_ok = 1 THEN ' dig' ELSE ' digs' END END, CASE WHEN assist > 0 THEN assist || CASE WHEN assist = 1 THEN ' assist' ELSE ' assists' END END], lambda v: v IS NOT NULL), ', ') AS b
  FROM tc JOIN us USING (player_id) LEFT JOIN stats s ON s.played_on = tc.played_on AND s.key = 'pid:' || CAST(tc.player_id AS VARCHAR))
SELECT played_on, email, 'Your night at Court night — ' || d AS subject, md5('Hey ' || coalesce(f, 'there') || ',' || chr(10) || chr(10) || CASE WHEN b <> '' THEN d || ': ' || b || '.' ELSE 'Your clips and stats from ' || d || ' are up.' END || chr(10) || chr(10) || 'Your plays and stats: https://example.invalid/p/' || coalesce(lower(f) || '-', '') || CAST(player_id AS VARCHAR) || '/' || CAST(played_on AS VARCHAR) || chr(10) || chr(10) || 'Share it with whoever you like — the link works for anyone.' || chr(10) || chr(10) || '— Court night') AS text FROM x""",
    "undo_old_dismissals": SCOPE_SQL + """, b AS (SELECT tracklet_id, t.cluster_id FROM tracklets t JOIN all_rallies r USING (rally_id) JOIN all_identities i ON i.game_id = r.game_id AND i.cluster_id = t.cluster_id WHERE dismissed),
l AS (SELECT play_id, tracklet_id, CASE WHEN play_id % 3 <> 0 THEN p.cluster_id END AS cluster_id FROM plays p JOIN all_rallies USING (rally_id)) SELECT play_id, coalesce(l.cluster_id, b.cluster_id) AS cluster_id FROM l LEFT JOIN b USING (tracklet_id)""",
    "cluster_summary": ALL_SQL + """, m AS (SELECT game_id, t.cluster_id AS cluster, tracklet_id, p % 9 + 1 AS n, p % 4 + 1 AS k, row_number() OVER (PARTITION BY game_id, t.cluster_id ORDER BY p % 9 + 1 DESC, tracklet_id) AS r FROM tracklets t JOIN all_rallies USING (rally_id)),
c AS (SELECT game_id, cluster, string_agg(CAST(tracklet_id AS VARCHAR) || '-1' || CASE WHEN k > 1 THEN ',' || CAST(tracklet_id AS VARCHAR) || '-2' ELSE '' END, ',' ORDER BY r) AS rep_crops FROM m WHERE r <= 3 GROUP BY 1, 2)
SELECT game_id, cluster, CAST(sum(n) AS BIGINT) AS n_boxes, any_value(rep_crops) AS rep_crops FROM m JOIN c USING (game_id, cluster) GROUP BY 1, 2""",
    "text_columns": ALL_SQL + f"""SELECT game_id, name || '.cut' AS stem, CAST(l AS DATE) AS local_day, CASE WHEN l IS NOT NULL THEN (CAST({_WEEK} AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' END AS week, CASE WHEN game_id % 3 = 0 THEN 0 ELSE 2 END AS items FROM (SELECT *, recorded_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS l FROM all_games)""",
    "ledger_stream": "SELECT DISTINCT user_id, event_type FROM events",
    "reaped_stream": "SELECT event_id AS job_id, CASE event_id % 3 WHEN 0 THEN 'done' ELSE 'failed' END AS status FROM events WHERE event_id % 3 < 2",
}


def oracle_sql() -> dict:
    return SQL
