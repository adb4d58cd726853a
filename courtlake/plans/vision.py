"""Queries on boxes, ball points and appearance, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.operators import ball, camera, people, sequences, training
from courtlake.operators import detections as d
from courtlake.plans.league import Tables, tables
from courtlake.plans.league_sql import BALL, BOXES, PROBES, margin_sql
from courtlake.sources.league import ALL_SQL, SCOPE_SQL


def _arcs(t: Tables) -> DataFrame:
    """Each touch's ball points as one track."""
    rows = t["all"]["plays"].select("play_id", "rally_id", "t", "x", "y").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")))
    return rows.selectExpr("rally_id", "play_id AS track", "t + k * 0.08D AS t", "x + if(play_id % 3 = 0, 40 * k, if(k < 6, 30 * k, 30 * (12 - k))) AS x", "y + (play_id % 5) * 4 * k * k - 30 * k AS y")


ARCS = """, arcs AS (SELECT rally_id, play_id AS track, t + k * 0.08::DOUBLE AS t, x + CASE WHEN play_id % 3 = 0 THEN 40 * k WHEN k < 6 THEN 30 * k ELSE 30 * (12 - k) END AS x, y + (play_id % 5) * 4 * k * k - 30 * k AS y
  FROM all_plays, (SELECT unnest(generate_series(0, 11)) AS k))
"""


CROWD = BOXES.replace("generate_series(0, 4)", "generate_series(0, 7)")


def _crowd(t: Tables) -> DataFrame:
    """Boxes of tracklets that last long enough to be seen together, with their rally's span. Tracklets are dealt by game before, so that boxes needn't be."""
    rows = t["all"]["tracklets"].join(t["all"]["rallies"].select("rally_id", "game_id", "start_s", "end_s"), "rally_id").repartition(t.tasks, "game_id")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")))
    return rows.selectExpr("game_id", "rally_id", "tracklet_id", "cluster_id", "t0 + k / 2 AS t", "cast((p * 7 + 40 * k) % 1800 AS double) AS x", "cast((p * 13 + 25 * k) % 900 AS double) AS y", "60.0D AS w", "cast(20 + (p + k) % 90 AS double) AS h", "start_s", "end_s")


def _people(t: Tables) -> DataFrame:
    return t["vectors"].selectExpr("vec_id AS identity_id", "vec_id % 12 AS game_id", "if(vec_id % 3 = 0, null, concat('Player ', label)) AS name", "vec_id % 50 AS player_id", "transform(embedding, x -> cast(x AS double)) AS embedding")


def _bundles(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A game's ball as its bundle, and pairs of each bundle with its own game and the next one."""
    points = t.ball("game_id", t.tasks).withColumnRenamed("game_id", "bundle_id")
    own = t["all"]["games"].select(F.col("game_id").alias("bundle_id"), F.explode(F.array("game_id", F.col("game_id") + 1)).alias("game_id"))
    return own, points


def _bodies(t: Tables) -> DataFrame:
    v = t["vectors"].where("vec_id < 100").select(F.col("vec_id").alias("_v"), "embedding")
    return t["all"]["tracklets"].withColumn("_v", F.col("tracklet_id") % 100).join(v, "_v", "left")


def _report(t: Tables, metrics: list[str] | None = None) -> DataFrame:
    of = t["all"]["rallies"]
    contacts = t["plays"].join(of.select("rally_id", "game_id"), "rally_id").repartition(t.tasks, "game_id").select("game_id", "rally_id", F.col("play_id").alias("probe_id"), "t", "x", "y", F.when(F.col("play_id") % 5 != 0, (F.col("play_id") % 300).cast("double")).alias("wrist_px"))
    return camera.camera_report(_crowd(t), t["all"]["tracklets"], of, contacts, t.ball("game_id", t.tasks), bodies=_bodies(t), metrics=metrics)


def _spacing(t: Tables) -> DataFrame:
    px = camera.player_distances(_crowd(t), t["all"]["rallies"]).groupBy("game_id").agg(camera.ranked("px").alias("v"))
    return px.select("game_id", F.size("v").cast("long").alias("pairs"), F.round(camera.middle("v"), 6).alias("spacing_med"), F.round(camera.at_rank("v", 10), 6).alias("spacing_p10"))


def _compared(t: Tables) -> DataFrame:
    body = d.attribute(t.probes().drop("cluster_id"), t.boxes(), 300.0, 600.0).select("probe_id", F.col("cluster").alias("body"))
    k = F.col("probe_id")
    return t.probes().select("probe_id", F.when(k % 5 != 0, (k % 300).cast("double")).alias("wrist_px")).withColumn("wrist", F.when(F.col("wrist_px") < 140, k % 11 + 1)).join(body, "probe_id")


def _clips(t: Tables) -> DataFrame:
    return t["all"]["rallies"].selectExpr("rally_id AS clip_id", "game_id", "start_s AS t0", "least(end_s, start_s + 12) AS t1")


def _with_game(t: Tables, df: DataFrame) -> DataFrame:
    return df.join(t["all"]["rallies"].select("rally_id", "game_id"), "rally_id")


def _truth(t: Tables) -> DataFrame:
    return _with_game(t, t["plays"].where("play_type is not null").select("rally_id", "t"))


QUERIES = {
    "parked_spots": lambda t: ball.parked_spots(t.ball("game_id")).select("game_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
    "link_predicted": lambda t: ball.link_predicted(t.ball()),
    "verify_arcs": lambda t: ball.verified_tracks(_arcs(t), flight=ball.FLIGHT | {"speed": 100.0, "floor": 2000.0}),
    "verified_points": lambda t: ball.verified_points(t.ball()),
    "game_ball": lambda t: ball.select_game_track(_arcs(t)).withColumn("score", F.round("score", 9)),
    "game_ball_of_links": lambda t: ball.select_game_track(sequences.link_nearest(t.ball())),
    "ball_path": lambda t: ball.ball_path(t.ball("game_id", t.tasks), _clips(t).repartition(t.tasks, "game_id")),
    "name_suggestions": lambda t: people.suggest_names(_people(t), 0.3),
    "tracklet_vectors": lambda t: people.tracklet_vectors(t["vectors"].selectExpr("vec_id % 50 AS tracklet_id", "embedding")).select("tracklet_id", F.size("embedding").cast("long").alias("n"), F.round(F.get("embedding", F.lit(0)), 9).alias("first"), F.round(F.element_at("embedding", -1), 9).alias("last")),
    "bundle_evidence": lambda t: (lambda pairs, points: training.bundle_evidence(pairs, points, t["all"]["rallies"], _with_game(t, t["plays"]), tasks=t.tasks).withColumns({"median_px": F.round("median_px", 6), "close_share": F.round("close_share", 9)}))(*_bundles(t)),
    "contact_f1": lambda t: training.contact_f1(t.ball(), t["rallies"], _truth(t)),
    "training_frames": lambda t: training.frames_of_points(t.ball()),
    "player_spacing": _spacing,
    "concurrency": lambda t: camera.concurrency(t["all"]["tracklets"], t["all"]["rallies"]),
    "sampling_rate": lambda t: camera.sampling_rate(t.ball("game_id", t.tasks)),
    "ball_speed": lambda t: camera.ball_motion(t.ball()).groupBy("rally_id").agg(F.count(F.lit(1)).alias("samples"), F.count("change").alias("changes"), F.round(F.max("speed"), 3).alias("fastest"), F.round(F.max("change"), 3).alias("sharpest"), F.round(F.min("cos"), 6).alias("turn")),
    "camera_report": lambda t: _report(t).withColumn("value", F.round("value", 6)),
    "rescaled_constants": lambda t: camera.rescaled_constants(_report(t, camera.RESCALING), 1).withColumns({c: F.round(c, 6) for c in ("suggested", "half_spacing")}),
    "body_or_wrist": lambda t: ball.body_or_wrist(_compared(t)),
    "known_different": lambda t: d.known_different(_bodies(t)).withColumn("distance", F.round("distance", 9)),
    "cluster_identities": lambda t: sequences.cluster_identities(_with_game(t, _bodies(t).where("embedding is not null")), 0.6),
}


def queries() -> dict:
    def on_tables(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = tables(spark, sf_dir)
            t["vectors"] = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
            return f(t)

        return run

    return {k: on_tables(f) for k, f in QUERIES.items()}


def _levels(splits: int = 3) -> str:
    """Fits and cuts of arcs, one level after another, from sums of powers of time."""
    out = ""
    for i in range(splits + 1):
        out += f""", m{i} AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY rally_id, track, part ORDER BY t, x, y) - 1 AS i, t - avg(t) OVER w AS u, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM l{i} WINDOW w AS (PARTITION BY rally_id, track, part)),
s{i} AS (SELECT *, sum(u * u) OVER w AS s2, sum(u * u * u) OVER w AS s3, sum(u * u * u * u) OVER w AS s4, sum(u * dx) OVER w AS ux, sum(u * dy) OVER w AS uy, sum(u * u * dy) OVER w AS uuy FROM m{i} WHERE n >= 5 WINDOW w AS (PARTITION BY rally_id, track, part)),
c{i} AS (SELECT *, (uuy - s3 * uy / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS c FROM s{i}),
r{i} AS (SELECT *, pow(dy - (uy - s3 * c) / s2 * u - c * (u * u - s2 / n), 2) + pow(dx - ux / s2 * u, 2) AS r FROM c{i}),
f{i} AS (SELECT *, done OR sqrt(avg(r) OVER w) <= 14 AS fits, greatest(1, first_value(i) OVER (PARTITION BY rally_id, track, part ORDER BY r DESC, i)) AS worst FROM r{i} WINDOW w AS (PARTITION BY rally_id, track, part)),
l{i + 1} AS (SELECT rally_id, track, t, x, y, CASE WHEN fits THEN part WHEN i >= worst THEN part * 2 + 1 ELSE part * 2 END AS part, fits AS done FROM f{i})"""
    return out


FLYING = """, st AS (SELECT *, sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2)) AS step FROM arcs WINDOW o AS (PARTITION BY rally_id, track ORDER BY t)),
fl AS (SELECT rally_id, track FROM st GROUP BY 1, 2 HAVING max(t) - min(t) >= 0.25::DOUBLE AND sum(step) / (max(t) - min(t)) >= 100 AND min(y) <= 2000 AND greatest(max(x) - min(x), max(y) - min(y)) >= 50),
l0 AS (SELECT rally_id, track, t, x, y, CAST(1 AS BIGINT) AS part, false AS done FROM arcs JOIN fl USING (rally_id, track))
"""
_RANK = lambda v, p: f"list_sort(list({v}) FILTER (WHERE {v} IS NOT NULL))[CAST(greatest(1, least(count({v}), round_even({p / 100!r}::DOUBLE * count({v}), 0))) AS INTEGER)]"
_ANCHOR = "b.x + w / 2", "b.y + h * 0.35::DOUBLE"
DISTANCES = f""", fr AS (SELECT game_id, rally_id, k, start_s + k * 2 AS t FROM (SELECT game_id, rally_id, start_s, unnest(generate_series(0, CAST(floor((end_s - start_s) / 2) AS BIGINT))) AS k FROM all_rallies WHERE end_s >= start_s)),
sn AS (SELECT fr.game_id, fr.rally_id, k, tracklet_id, arg_min(struct_pack(x := {_ANCHOR[0]}, y := {_ANCHOR[1]}), (abs(b.t - fr.t), b.t)) AS p FROM fr JOIN boxes b ON b.rally_id = fr.rally_id AND abs(b.t - fr.t) < 0.2::DOUBLE GROUP BY 1, 2, 3, 4),
px AS (SELECT a.game_id, sqrt(pow(a.p.x - b.p.x, 2) + pow(a.p.y - b.p.y, 2)) AS px FROM sn a JOIN sn b ON a.rally_id = b.rally_id AND a.k = b.k AND a.tracklet_id < b.tracklet_id)
"""
MOTION = """, us AS (SELECT game_id, rally_id, x, y, CAST(round(t * 1000000) AS BIGINT) AS us FROM ball),
fb AS (SELECT *, min(struct_pack(us := us, x := x, y := y)) OVER (PARTITION BY rally_id ORDER BY us RANGE BETWEEN 100000 FOLLOWING AND 300000 FOLLOWING) AS f, max(struct_pack(us := us, x := x, y := y)) OVER (PARTITION BY rally_id ORDER BY us RANGE BETWEEN 300000 PRECEDING AND 100000 PRECEDING) AS b FROM us),
vl AS (SELECT game_id, rally_id, (f.x - x) / ((f.us - us) / 1000000) AS fx, (f.y - y) / ((f.us - us) / 1000000) AS fy, (x - b.x) / ((us - b.us) / 1000000) AS px, (y - b.y) / ((us - b.us) / 1000000) AS py FROM fb WHERE f IS NOT NULL),
motion AS (SELECT game_id, rally_id, sqrt(fx * fx + fy * fy) AS speed, abs(sqrt(fx * fx + fy * fy) - sqrt(px * px + py * py)) AS change,
  CASE WHEN sqrt(px * px + py * py) > 1 AND sqrt(fx * fx + fy * fy) > 1 THEN (px * fx + py * fy) / (sqrt(px * px + py * py) * sqrt(fx * fx + fy * fy)) END AS cos FROM vl)
"""
RATE = f""", gp AS (SELECT game_id, round(lead(t) OVER (PARTITION BY rally_id ORDER BY t) - t, 9) AS gap FROM ball), gq AS (SELECT * FROM gp WHERE gap > 0 AND gap < 1), gr AS (SELECT game_id, {_RANK("gap", 75)} AS p FROM gq GROUP BY 1),
fp AS (SELECT gq.game_id, round_even(1 / round(avg(gap), 9), 0) AS fps FROM gq JOIN gr USING (game_id) WHERE gap <= p GROUP BY 1), rate AS (SELECT DISTINCT ball.game_id, coalesce(fps, 20.0::DOUBLE) AS fps FROM ball LEFT JOIN fp USING (game_id))
"""
SEEN = """, cn AS (SELECT game_id, rally_id, start_s, end_s, t0, t1 FROM tracklets JOIN all_rallies USING (rally_id)), tk AS (SELECT rally_id, start_s + 0.5::DOUBLE * unnest(generate_series(0, CAST(floor((end_s - start_s) * 2) AS BIGINT))) AS t FROM all_rallies WHERE end_s >= start_s),
ct AS (SELECT rally_id, tk.t, count(*) AS n FROM tk JOIN cn USING (rally_id) WHERE tk.t BETWEEN t0 AND t1 GROUP BY 1, 2), seen AS (SELECT DISTINCT cn.game_id, cn.rally_id, coalesce(most, 0) AS most FROM cn LEFT JOIN (SELECT rally_id, max(n) AS most FROM ct GROUP BY 1) USING (rally_id))
"""
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"
APART = f""", bd AS (SELECT t.*, e.embedding AS e FROM tracklets t LEFT JOIN (SELECT * FROM embeddings WHERE vec_id < 100) e ON e.vec_id = t.tracklet_id % 100),
apart AS (SELECT a.rally_id, a.tracklet_id AS a, b.tracklet_id AS b, 1 - {_DOT("a.e", "b.e")} / (sqrt({_DOT("a.e", "a.e")}) * sqrt({_DOT("b.e", "b.e")}) + 1e-9::DOUBLE) AS distance
  FROM bd a JOIN bd b ON a.rally_id = b.rally_id AND a.tracklet_id < b.tracklet_id WHERE a.t0 <= b.t1 + 0.2::DOUBLE AND b.t0 <= a.t1 + 0.2::DOUBLE)
"""
_PCT = lambda c: f"100 * avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_FIGURES = {
    "boxes": {"box_h_med": "median(h)", "box_h_near_med": "median(h) FILTER (WHERE y + h > 690)", "box_h_far_med": "median(h) FILTER (WHERE y + h <= 690)", "box_below_gate_pct": _PCT("h < 45"), "box_h_p05": _RANK("h", 5)},
    "seen": {"concurrent_med": "median(most)"},
    "(SELECT game_id, t1 - t0 AS d, count(*) OVER (PARTITION BY game_id) / al AS per FROM cn JOIN nr USING (game_id))": {"tracklet_dur_med": "median(d)", "tracklets_per_rally": "max(per)"},
    "px": {"spacing_med": "median(px)", "spacing_p10": _RANK("px", 10)},
    "met": {"contact_d_med": "median(d)", "contact_dx_med": "median(dx)", "contact_dy_med": "median(dy)", "n_contacts": "count(*)", "contact_d_p75": _RANK("d", 75), "contact_d_p95": _RANK("d", 95)},
    "(SELECT * FROM con WHERE wrist IS NOT NULL)": {"wrist_med": "median(wrist)", "n_wrist_contacts": "count(*)", "wrist_p75": _RANK("wrist", 75)},
    "(SELECT game_id, count(*) / max(CASE WHEN ga > 0 THEN ga ELSE al END) AS c FROM con JOIN nr USING (game_id) GROUP BY 1)": {"contacts_per_rally": "max(c)"},
    "(SELECT ball.game_id, count(*) AS n, max(fps) AS fps, max(s) AS s FROM ball JOIN (SELECT rally_id FROM all_rallies WHERE phase <> 'warmup') USING (rally_id) JOIN rate ON rate.game_id = ball.game_id JOIN nr ON nr.game_id = ball.game_id GROUP BY 1)": {"ball_fps": "max(fps)", "ball_coverage_pct": "max(100 * n / (s * fps))"},
    "motion": {"ball_static_pct": _PCT("speed < 20")},
    "(SELECT * FROM motion WHERE speed >= 20)": {"ball_speed_med": "median(speed)", "ball_speed_p90": _RANK("speed", 90), "ball_dspeed_med": "median(change)", "ball_dspeed_p90": _RANK("change", 90), "trip_dv_pct": "100 * avg(CAST(change > 260 AS INTEGER))", "trip_cos_pct": "100 * avg(CAST(cos < 0.55::DOUBLE AS INTEGER))"},
    "(SELECT game_id, distance FROM apart JOIN all_rallies USING (rally_id) WHERE distance IS NOT NULL)": {"neg_dist_med": "median(distance)", "neg_under_thresh_pct": _PCT("distance < 0.12::DOUBLE"), "n_neg_pairs": "count(*)", "neg_dist_p05": _RANK("distance", 5)},
}
_LONG = " UNION ALL ".join(f"SELECT game_id, unnest([{', '.join(repr(k) for k in f)}]) AS metric, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in f.values())}]) AS value FROM {src} GROUP BY game_id" for src, f in _FIGURES.items())
REPORT = SCOPE_SQL + CROWD + BALL + DISTANCES + MOTION + RATE + SEEN + APART + f""", nr AS (SELECT game_id, count(*) AS al, count(*) FILTER (WHERE phase <> 'warmup') AS ga, sum(end_s - start_s) FILTER (WHERE phase <> 'warmup') AS s FROM all_rallies GROUP BY 1),
con AS (SELECT r.game_id, p.rally_id, play_id, t, x, y, CASE WHEN play_id % 5 <> 0 THEN CAST(play_id % 300 AS DOUBLE) END AS wrist FROM plays p JOIN all_rallies r USING (rally_id)),
mq AS (SELECT con.game_id, play_id, tracklet_id, b.t AS bt, abs({_ANCHOR[0]} - con.x) AS dx, abs({_ANCHOR[1]} - con.y) AS dy, sqrt(pow({_ANCHOR[0]} - con.x, 2) + pow(({_ANCHOR[1]} - con.y) * 0.6::DOUBLE, 2)) AS d FROM con JOIN boxes b ON b.rally_id = con.rally_id AND abs(b.t - con.t) <= 0.3::DOUBLE),
met AS (SELECT * FROM mq QUALIFY row_number() OVER (PARTITION BY play_id ORDER BY d, tracklet_id, bt) = 1), report AS (SELECT * FROM ({_LONG}) WHERE value IS NOT NULL)
"""
_SCALED = ", ".join(repr(c) for c in camera.SCALED)
_VALUES = ", ".join(f"{camera.CONSTANTS[c]!r}::DOUBLE" for c in camera.SCALED)

SQL = {
    "parked_spots": ALL_SQL + BALL + """, nd AS (SELECT game_id, greatest(12.0::DOUBLE, 0.06::DOUBLE * count(*)) AS need FROM ball GROUP BY 1 HAVING count(*) >= 50),
cl AS (SELECT game_id, g, CAST(floor((x + g * 20) / 40) AS BIGINT) AS cx, CAST(floor((y + g * 20) / 40) AS BIGINT) AS cy, avg(x) AS mx, avg(y) AS my, count(*) AS k FROM ball, (SELECT unnest([0, 1]) AS g) GROUP BY 1, 2, 3, 4),
bs AS (SELECT cl.*, need FROM cl JOIN nd USING (game_id) WHERE k >= need),
ok AS (SELECT bs.game_id, g, cx, cy, mx, my FROM bs JOIN ball ON ball.game_id = bs.game_id AND abs(x - mx) < 30 AND abs(y - my) < 30 GROUP BY ALL HAVING count(*) >= any_value(need) AND stddev_pop(x) < 4 AND stddev_pop(y) < 4),
ls AS (SELECT game_id, list([struct_pack(x := mx, y := my)] ORDER BY g, cx, cy) AS l FROM ok GROUP BY 1),
kp AS (SELECT game_id, unnest(list_reduce(l, lambda a, s: CASE WHEN len(list_filter(a, lambda o: abs(o.x - s[1].x) < 30 AND abs(o.y - s[1].y) < 30)) > 0 THEN a ELSE list_concat(a, s) END)) AS s FROM ls)
SELECT game_id, round(s.x, 6) AS x, round(s.y, 6) AS y FROM kp""",
    "verify_arcs": ALL_SQL + ARCS + FLYING + _levels() + " SELECT rally_id, track, part, t, x, y FROM l4 WHERE done",
    "game_ball": ALL_SQL + ARCS + f""", sc AS (SELECT rally_id, track, min(t) AS t0, (max(t) - min(t)) * (0.3::DOUBLE + avg(CASE WHEN {margin_sql("x", "least(y + 80, 1079.0::DOUBLE)")} >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) * (0.3::DOUBLE + least(1.0::DOUBLE, (max(x) - min(x)) / 350)) AS score FROM arcs GROUP BY 1, 2)
SELECT rally_id, track, round(score, 9) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY rally_id ORDER BY score DESC, t0, track) = 1""",
    "name_suggestions": f"""WITH p AS (SELECT vec_id AS identity_id, vec_id % 12 AS game_id, CASE WHEN vec_id % 3 <> 0 THEN 'Player ' || CAST(label AS VARCHAR) END AS name, vec_id % 50 AS player_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.identity_id, b.identity_id AS other, b.name, b.player_id, {_DOT("a.e", "b.e")} AS sim FROM p a JOIN p b ON a.name IS NULL AND b.name IS NOT NULL AND a.game_id <> b.game_id)
SELECT identity_id, name, player_id, CAST(floor(sim * 100 + 0.5::DOUBLE) AS BIGINT) AS sim FROM s WHERE sim > 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY identity_id ORDER BY sim DESC, other) = 1""",
    "tracklet_vectors": f"""WITH v AS (SELECT vec_id % 50 AS tracklet_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT tracklet_id, unnest(list_transform(e, lambda x: x / (sqrt({_DOT("e", "e")}) + 1e-9::DOUBLE))) AS x, generate_subscripts(e, 1) AS i FROM v),
m AS (SELECT tracklet_id, i, avg(x) AS x FROM u GROUP BY 1, 2), l AS (SELECT tracklet_id, list(x ORDER BY i) AS v, sqrt(sum(x * x)) + 1e-9::DOUBLE AS n FROM m GROUP BY 1) SELECT tracklet_id, len(v) AS n, round(v[1] / l.n, 9) AS first, round(v[-1] / l.n, 9) AS last FROM l""",
    "bundle_evidence": SCOPE_SQL + BALL + """, pr AS (SELECT game_id AS bundle_id, unnest([game_id, game_id + 1]) AS game_id FROM all_games),
rr AS (SELECT bundle_id, pr.game_id, count(*) AS rallies, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ball b WHERE b.game_id = bundle_id AND b.t BETWEEN start_s AND end_s)) AS covered FROM pr JOIN all_rallies r ON r.game_id = pr.game_id GROUP BY 1, 2),
nr AS (SELECT bundle_id, pr.game_id, p.play_id, min(sqrt(pow(b.x - p.x, 2) + pow(b.y - p.y, 2))) AS d FROM pr JOIN all_rallies r ON r.game_id = pr.game_id JOIN plays p ON p.rally_id = r.rally_id JOIN ball b ON b.game_id = bundle_id AND abs(b.t - p.t) <= 0.15::DOUBLE GROUP BY 1, 2, 3),
tc AS (SELECT bundle_id, game_id, count(*) AS touches, list_sort(list(d))[count(*) // 2 + 1] AS m, avg(CASE WHEN d < 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c FROM nr GROUP BY 1, 2),
al AS (SELECT pr.*, coalesce(rallies, 0) AS rallies, coalesce(covered, 0) AS covered, coalesce(touches, 0) AS touches, m, c, pr.bundle_id IN (SELECT game_id FROM ball) AS has FROM pr LEFT JOIN rr ON rr.bundle_id = pr.bundle_id AND rr.game_id = pr.game_id LEFT JOIN tc ON tc.bundle_id = pr.bundle_id AND tc.game_id = pr.game_id)
SELECT bundle_id, game_id, rallies, covered, touches, round(m, 6) AS median_px, round(c, 9) AS close_share, CASE WHEN NOT has THEN 'no ball' WHEN rallies = 0 THEN 'no rallies' WHEN covered < 0.2::DOUBLE * rallies THEN 'rejected' WHEN m > 200 THEN 'suspicious' WHEN m IS NULL THEN 'unchecked' ELSE 'fits' END AS verdict FROM al""",
    "player_spacing": ALL_SQL + CROWD + DISTANCES + f"SELECT game_id, count(*) AS pairs, round(median(px), 6) AS spacing_med, round({_RANK('px', 10)}, 6) AS spacing_p10 FROM px GROUP BY 1",
    "concurrency": ALL_SQL + SEEN + "SELECT * FROM seen",
    "sampling_rate": ALL_SQL + BALL + RATE + "SELECT * FROM rate",
    "ball_speed": ALL_SQL + BALL + MOTION + "SELECT rally_id, count(*) AS samples, count(change) AS changes, round(max(speed), 3) AS fastest, round(max(change), 3) AS sharpest, round(min(cos), 6) AS turn FROM motion GROUP BY 1",
    "camera_report": REPORT + "SELECT game_id, metric, round(value, 6) AS value FROM report",
    "rescaled_constants": REPORT + f""", wd AS (SELECT game_id, max(value) FILTER (WHERE metric = 'box_h_med') AS h, max(value) FILTER (WHERE metric = 'spacing_med') AS s, max(value) FILTER (WHERE metric = 'contact_dy_med') / max(value) FILTER (WHERE metric = 'contact_dx_med') AS r FROM report GROUP BY 1),
x AS (SELECT w.game_id, unnest([{_SCALED}, 'y_weight']) AS constant, unnest([{_VALUES}, 0.6::DOUBLE]) AS value, unnest([{", ".join(f"{camera.CONSTANTS[c]!r}::DOUBLE * w.h / f.h" for c in camera.SCALED)}, 0.6::DOUBLE * f.r / w.r]) AS suggested, w.s FROM wd w, wd f WHERE f.game_id = 1)
SELECT game_id, constant, value, round(suggested, 6) AS suggested, CASE WHEN constant = 'gate' THEN round(s / 2, 6) END AS half_spacing, CASE WHEN constant = 'gate' THEN suggested < s / 2 END AS fits FROM x WHERE suggested IS NOT NULL""",
    "body_or_wrist": SCOPE_SQL + BOXES + PROBES + f""", c AS (SELECT probe_id, tracklet_id, cluster_id, b.t AS bt, sqrt(pow({_ANCHOR[0]} - p.x, 2) + pow(({_ANCHOR[1]} - p.y) * 0.25::DOUBLE, 2)) AS dd FROM probes p JOIN boxes b ON b.rally_id = p.rally_id AND abs(b.t - p.t) <= 0.3::DOUBLE),
f AS (SELECT probe_id, CASE WHEN dd < 300 THEN cluster_id END AS body, CASE WHEN probe_id % 5 <> 0 THEN CAST(probe_id % 300 AS DOUBLE) END AS px FROM c WHERE true QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY dd, tracklet_id, bt) = 1 AND dd <= 600)
SELECT count(*) AS contacts, count(*) FILTER (WHERE px <= 140) AS near_wrist, count(*) FILTER (WHERE px < 140 AND body <> probe_id % 11 + 1) AS differ FROM f""",
    "known_different": ALL_SQL + APART + "SELECT rally_id, a, b, round(distance, 9) AS distance FROM apart",
}


def oracle_sql() -> dict:
    return SQL
