"""What a camera's set-up does to the figures that thresholds in pixels and seconds rest on, and constants rescaled for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.operators.detections import known_different, near_in_time
from courtlake.sources.store import written

#: The thresholds in use, and which of them grow with the size of players in the picture.
CONSTANTS = {"min_box_h_px": 45.0, "court_margin_px": 90.0, "gate": 220.0, "drop": 340.0, "y_weight": 0.6, "dv_thr": 260.0, "wrist_max": 180.0, "ball_max_dim": 70.0, "max_speed": 900.0, "cluster_thresh": 0.12}
SCALED = ["min_box_h_px", "gate", "drop", "dv_thr", "wrist_max", "ball_max_dim", "max_speed", "court_margin_px"]
#: The figures that constants are rescaled by.
RESCALING = ["box_h_med", "spacing_med", "contact_dx_med", "contact_dy_med"]
#: Windows of speeds in microseconds, and the speed below which a ball stands still.
BASE_US, STILL = 100_000, 20.0


def ranked(value: Column | str) -> Column:
    """An aggregate: the values of a group in order, without nulls."""
    return F.sort_array(F.collect_list(value))


def middle(values: Column | str) -> Column:
    """The median of ordered values, null without any."""
    v = F.col(values) if isinstance(values, str) else values
    half = F.size(v) / 2
    return F.when(F.size(v) > 0, (F.get(v, F.ceil(half).cast("int") - 1) + F.get(v, F.floor(half).cast("int"))) / 2)


def at_rank(values: Column | str, p: int) -> Column:
    """Of ordered values the one at rank round(p / 100 * n), halves to even, within 1 and n; null without any."""
    v = F.col(values) if isinstance(values, str) else values
    n = F.size(v)
    return F.get(v, F.least(n, F.greatest(F.lit(1), F.bround(F.lit(p / 100) * n, 0).cast("int"))) - 1)


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, int], by: str = "game_id") -> DataFrame:
    """For each `by` and name: the value at rank round(p / 100 * n), halves to even, within 1 and n."""
    kept = rows.where(F.col(value).isNotNull()).groupBy(by).agg(ranked(value).alias("_v"))
    return kept.select(by, *(at_rank("_v", p).alias(name) for name, p in shares.items()))


def body(prefix: str = "b") -> tuple[Column, Column]:
    """Where a player's body is measured: the middle of the box, 35 % down."""
    return F.col(f"{prefix}x") + F.col("w") / 2, F.col(f"{prefix}y") + F.col("h") * 0.35


def concurrency(tracklets: DataFrame, rallies: DataFrame, step: float = 0.5) -> DataFrame:
    """game_id, rally_id, most: the largest number of tracklets seen at once on a grid of `step` seconds from the rally's start; rallies without tracklets are left out."""
    rows = tracklets.select("rally_id", "t0", "t1").join(rallies.select("game_id", "rally_id", "start_s", "end_s"), "rally_id")
    a = F.greatest(F.lit(0), F.ceil((F.col("t0") - F.col("start_s")) / step))
    b = F.floor((F.least("t1", "end_s") - F.col("start_s")) / step)
    # a tracklet adds one at its first tick and takes it back after its last; at a tick, those that are gone count first
    rows = rows.select("game_id", "rally_id", F.when(a <= b, F.array(F.struct(a.alias("tick"), F.lit(1).alias("more")), F.struct((b + 1).alias("tick"), F.lit(-1).alias("more")))).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("tick"), F.lit(0).alias("more")))).alias("_c"))
    steps = rows.select("game_id", "rally_id", F.explode("_c").alias("_c")).select("game_id", "rally_id", "_c.*")
    w = Window.partitionBy("game_id", "rally_id").orderBy("tick", "more").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("n", F.sum("more").over(w)).groupBy("game_id", "rally_id").agg(F.max("n").alias("most"))


def player_distances(boxes: DataFrame, rallies: DataFrame, step: float = 2.0, tol: float = 0.2) -> DataFrame:
    """game_id, rally_id, tick, px: distances between all pairs of players on a grid of `step` seconds from each rally's start.

    Each tracklet stands at its box nearest in time, less than `tol` seconds away, the earlier of equal ones. The few
    players of a frame are gathered and paired there. A box finds the ticks it is near by its rally's start, so no frames
    are made. Boxes that carry start_s and end_s of their rally aren't joined with it, and aren't shuffled if they lie by
    game or rally.
    """
    if not {"start_s", "end_s"} <= set(boxes.columns):
        boxes = boxes.drop("game_id", "start_s", "end_s").join(rallies.select("game_id", "rally_id", "start_s", "end_s"), "rally_id")
    since = F.col("t") - F.col("start_s")
    reach = 1.01 * tol  # a little more than `tol`, so that no tick is lost to rounding
    if 2 * reach < step:
        boxes = boxes.withColumn("tick", F.floor(since / step + 0.5))
    else:
        boxes = boxes.where(since.isNotNull()).withColumn("tick", F.explode(F.sequence(F.floor((since - reach) / step), F.floor((since + reach) / step))))
    off = F.abs(F.col("t") - (F.col("start_s") + F.col("tick") * step))
    near = boxes.where((F.col("end_s") >= F.col("start_s")) & F.col("tick").between(0, F.floor((F.col("end_s") - F.col("start_s")) / step)) & (off < tol))
    x, y = body("")
    stands = near.groupBy("game_id", "rally_id", "tick", "tracklet_id").agg(F.min_by(F.struct(x.alias("x"), y.alias("y")), F.struct(off, "t")).alias("p"))
    frames = stands.groupBy("game_id", "rally_id", "tick").agg(F.collect_list("p").alias("p")).where(F.size("p") > 1)
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))))
    return frames.select("game_id", "rally_id", "tick", F.explode(pairs).alias("px"))


def contact_geometry(contacts: DataFrame, boxes: DataFrame, y_weight: float = CONSTANTS["y_weight"]) -> DataFrame:
    """game_id, probe_id, d, dx, dy: from each contact to the nearest body within 0.3 s, heights weighed by `y_weight` in d alone."""
    x, y = body()
    pairs = near_in_time(contacts, boxes, 0.3, by=("game_id", "rally_id")).withColumns({"dx": F.abs(x - F.col("x")), "dy": F.abs(y - F.col("y"))})
    pairs = pairs.withColumn("d", F.hypot("dx", F.col("dy") * y_weight))
    best = pairs.groupBy("game_id", "probe_id").agg(F.min_by(F.struct("d", "dx", "dy"), F.struct("d", "tracklet_id", "box_t")).alias("b"))
    return best.select("game_id", "probe_id", "b.d", "b.dx", "b.dy")


def ball_motion(points: DataFrame, base_us: int = BASE_US) -> DataFrame:
    """game_id, rally_id, t, speed, change, cos of each ball point that has another one `base_us` to three times that ahead.

    Speed reaches to the first such point, so that a frame's jitter isn't speed; change and turn compare it with the
    stretch from the last such point behind, and are null without one (cos also where either is at most 1 px/s). Times
    count in whole microseconds. Frames are bounded, so a point costs the same in a long rally.
    """
    w = Window.partitionBy("game_id", "rally_id").orderBy("us")
    rows = points.select("game_id", "rally_id", "t", "x", "y", F.round(F.col("t") * 1_000_000).cast("long").alias("us"))
    p = F.struct("us", "x", "y")
    rows = rows.withColumn("f", F.min(p).over(w.rangeBetween(base_us, 3 * base_us))).withColumn("b", F.max(p).over(w.rangeBetween(-3 * base_us, -base_us))).where("f is not null")
    speed = lambda c, a, b: (F.col(f"{b}{c}") - F.col(f"{a}{c}")) / ((F.col(f"{b}us") - F.col(f"{a}us")) / 1_000_000)
    rows = rows.withColumns({"fx": speed("x", "", "f."), "fy": speed("y", "", "f."), "bx": speed("x", "b.", ""), "by": speed("y", "b.", "")})
    s1, s2 = F.hypot("bx", "by"), F.hypot("fx", "fy")
    turn = F.when((s1 > 1) & (s2 > 1), (F.col("bx") * F.col("fx") + F.col("by") * F.col("fy")) / (s1 * s2))
    return rows.select("game_id", "rally_id", "t", s2.alias("speed"), F.abs(s2 - s1).alias("change"), turn.alias("cos"))


def sampling_rate(points: DataFrame, default: float = 20.0) -> DataFrame:
    """game_id, fps: rounded reciprocal of the mean gap between a rally's points, gaps of a second and more and those above the 75th percentile left out."""
    # gaps are whole nanoseconds, so their sum is exact in any order
    w = Window.partitionBy("game_id", "rally_id").orderBy("t")
    gaps = points.select("game_id", "rally_id", "t").withColumn("gap", F.round((F.lead("t").over(w) - F.col("t")) * 1e9).cast("long"))
    of_game = gaps.groupBy("game_id").agg(ranked(F.when((F.col("gap") > 0) & (F.col("gap") < 1_000_000_000), F.col("gap"))).alias("_g")).withColumn("_p", at_rank("_g", 75))
    kept = of_game.select("game_id", F.filter("_g", lambda g: g <= F.col("_p")).alias("_g"))
    mean = F.round(F.try_divide(F.aggregate("_g", F.lit(0).cast("long"), lambda s, g: s + g), F.size("_g")))
    return kept.select("game_id", F.coalesce(F.bround(1 / F.nullif(mean / 1e9, F.lit(0.0)), 0), F.lit(default)).alias("fps"))


def _share(condition: Column) -> Column:
    return 100 * F.avg(F.when(condition, 1.0).otherwise(0.0))


def camera_report(boxes: DataFrame, tracklets: DataFrame, rallies: DataFrame, contacts: DataFrame, ball: DataFrame, near_y: float = 690.0, constants: dict[str, float] = CONSTANTS, bodies: DataFrame | None = None, metrics: list[str] | None = None) -> DataFrame:
    """game_id, metric, value: player heights, tracking, spacing, contact geometry, wrists, ball speeds, rule rates, identity distances.

    rallies: game_id, rally_id, phase, start_s, end_s; contacts: game_id, rally_id, probe_id, t, x, y, wrist_px;
    tracklets: tracklet_id, rally_id, t0, t1, embedding (that may be in `bodies`, the same ones, alone). Percentiles are by
    nearest rank, medians the mean of the middle two. Figures without rows are left out, and so are those that aren't in
    `metrics` if it is given; nothing is made for them.

    Boxes, contacts and ball points that are dealt by game over as many tasks aren't shuffled: a game's values are gathered and
    put in order once for all their figures. What is made by rally (tracklets, pairs of them) moves to its game as bare values.
    """
    g = rallies.select("rally_id", "game_id")
    of_games = lambda df, *columns: df.select("game_id", *columns).repartition("game_id").groupBy("game_id")
    count = F.count(F.lit(1))
    foot = F.col("y") + F.col("h")
    tall = boxes.groupBy("game_id").agg(ranked("h").alias("_h"), ranked(F.when(foot > near_y, F.col("h"))).alias("_near"), ranked(F.when(foot <= near_y, F.col("h"))).alias("_far"), _share(F.col("h") < constants["min_box_h_px"]).alias("box_below_gate_pct"))
    tall = tall.select("game_id", middle("_h").alias("box_h_med"), middle("_near").alias("box_h_near_med"), middle("_far").alias("box_h_far_med"), "box_below_gate_pct", at_rank("_h", 5).alias("box_h_p05"))
    seen = of_games(concurrency(tracklets, rallies), "most").agg(ranked("most").alias("_v")).select("game_id", middle("_v").alias("concurrent_med"))
    n_rallies = rallies.groupBy("game_id").agg(count.alias("_all"), F.count_if(F.col("phase") != "warmup").alias("_game"), F.sum(F.when(F.col("phase") != "warmup", F.col("end_s") - F.col("start_s"))).alias("_s"))
    lasting = of_games(tracklets.select("rally_id", (F.col("t1") - F.col("t0")).alias("_d")).join(g, "rally_id"), "_d").agg(count.alias("_n"), ranked("_d").alias("_v"))
    lasting = lasting.select("game_id", "_n", middle("_v").alias("tracklet_dur_med")).join(n_rallies, "game_id").select("game_id", "tracklet_dur_med", (F.col("_n") / F.col("_all")).alias("tracklets_per_rally"))
    space = player_distances(boxes, rallies).groupBy("game_id").agg(ranked("px").alias("_v")).select("game_id", middle("_v").alias("spacing_med"), at_rank("_v", 10).alias("spacing_p10"))
    met = contact_geometry(contacts.select("game_id", "probe_id", "rally_id", "t", "x", "y"), boxes, constants["y_weight"])
    reach = met.groupBy("game_id").agg(ranked("d").alias("_d"), ranked("dx").alias("_dx"), ranked("dy").alias("_dy"), count.cast("double").alias("n_contacts"))
    reach = reach.select("game_id", middle("_d").alias("contact_d_med"), middle("_dx").alias("contact_dx_med"), middle("_dy").alias("contact_dy_med"), "n_contacts", at_rank("_d", 75).alias("contact_d_p75"), at_rank("_d", 95).alias("contact_d_p95"))
    touched = contacts.groupBy("game_id").agg(count.alias("_n"), ranked("wrist_px").alias("_v")).select("game_id", "_n", middle("_v").alias("wrist_med"), F.nullif(F.size("_v"), F.lit(0)).alias("n_wrist_contacts"), at_rank("_v", 75).alias("wrist_p75"))
    hands = touched.join(n_rallies, "game_id", "left").select("game_id", "wrist_med", "n_wrist_contacts", "wrist_p75", (F.col("_n") / F.when(F.col("_game") > 0, F.col("_game")).otherwise(F.col("_all"))).alias("contacts_per_rally"))
    played = ball.groupBy("game_id", "rally_id").agg(count.alias("_n")).join(rallies.where("phase != 'warmup'").select("rally_id"), "rally_id", "left_semi").groupBy("game_id").agg(F.sum("_n").alias("_n"))
    cover = played.join(n_rallies, "game_id").join(sampling_rate(ball), "game_id").select("game_id", F.col("fps").alias("ball_fps"), (100 * F.col("_n") / F.nullif(F.col("_s") * F.col("fps"), F.lit(0.0))).alias("ball_coverage_pct"))
    moving = lambda c: F.when(F.col("speed") >= STILL, c)
    fast = ball_motion(ball).groupBy("game_id").agg(
        _share(F.col("speed") < STILL).alias("ball_static_pct"), ranked(moving(F.col("speed"))).alias("_s"), ranked(moving(F.col("change"))).alias("_c"),
        (100 * F.avg(moving((F.col("change") > constants["dv_thr"]).cast("double")))).alias("trip_dv_pct"), (100 * F.avg(moving((F.col("cos") < 0.55).cast("double")))).alias("trip_cos_pct"),
    ).select("game_id", "ball_static_pct", middle("_s").alias("ball_speed_med"), at_rank("_s", 90).alias("ball_speed_p90"), middle("_c").alias("ball_dspeed_med"), at_rank("_c", 90).alias("ball_dspeed_p90"), "trip_dv_pct", "trip_cos_pct")
    apart = known_different(tracklets if bodies is None else bodies).where("distance is not null").join(g, "rally_id")
    unlike = of_games(apart, "distance").agg(ranked("distance").alias("_v"), _share(F.col("distance") < constants["cluster_thresh"]).alias("neg_under_thresh_pct"))
    unlike = unlike.select("game_id", middle("_v").alias("neg_dist_med"), "neg_under_thresh_pct", F.size("_v").alias("n_neg_pairs"), at_rank("_v", 5).alias("neg_dist_p05"))
    parts = [tall, seen, lasting, space, reach, hands, cover, fast, unlike]
    asked = [(p, [c for c in p.columns if c != "game_id" and (metrics is None or c in metrics)]) for p in parts]
    long = [p.unpivot(["game_id"], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value") for p, columns in asked if columns]
    out = long[0]
    for more in long[1:]:
        out = out.unionByName(more)
    return out.where("value is not null")


def rescaled_constants(report: DataFrame, reference: int, constants: dict[str, float] = CONSTANTS) -> DataFrame:
    """game_id, constant, value, suggested, half_spacing, fits: thresholds in pixels times the ratio of median heights to the reference game's.

    The weight of heights keeps what dy brings to a contact's distance as it was in the reference. For the gate,
    half_spacing is half the median distance between players and `fits` says whether the new gate stays below it.
    """
    wide = report.where(F.col("metric").isin(RESCALING)).groupBy("game_id").pivot("metric", RESCALING).agg(F.first("value"))
    wide = written(wide, "cameras")  # a row for each game, read twice, and dear
    ref = wide.where(F.col("game_id") == reference).select(F.col("box_h_med").alias("_h"), F.try_divide("contact_dy_med", "contact_dx_med").alias("_r"))
    both = wide.crossJoin(F.broadcast(ref))  # one row
    scale, flat = F.try_divide("box_h_med", "_h"), F.try_divide(F.col("_r"), F.try_divide("contact_dy_med", "contact_dx_med"))
    rows = [F.struct(F.lit(k).alias("constant"), F.lit(constants[k]).alias("value"), (F.lit(constants[k]) * scale).alias("suggested")) for k in SCALED]
    rows.append(F.struct(F.lit("y_weight").alias("constant"), F.lit(constants["y_weight"]).alias("value"), (F.lit(constants["y_weight"]) * flat).alias("suggested")))
    half = F.when(F.col("c.constant") == "gate", F.col("spacing_med") / 2)
    return both.withColumn("c", F.explode(F.array(*rows))).where("c.suggested is not null").select("game_id", "c.*", half.alias("half_spacing")).withColumn("fits", F.col("suggested") < F.col("half_spacing"))
