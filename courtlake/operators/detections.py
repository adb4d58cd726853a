"""Boxes, points and contacts: filters, nearest boxes in time, attribution, static clutter, camera figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH, HEIGHT = 1920.0, 1080.0
#: A court's corners and its net line in shares of the picture.
POLYGON = [(0.1, 0.2), (0.9, 0.2), (0.97, 0.95), (0.03, 0.95)]
NET = ((0.5, 0.2), (0.5, 0.95))


def _segment_distance(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    (ax, ay), (bx, by) = ((px * WIDTH, py * HEIGHT) for px, py in (a, b))
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def side(x: Column, y: Column, net: tuple = NET) -> Column:
    """1 or -1: the side of the net line on which a point lies."""
    (x1, y1), (x2, y2) = net
    return F.when((x2 - x1) * (y / HEIGHT - y1) - (y2 - y1) * (x / WIDTH - x1) > 0, 1).otherwise(-1)


def dist_to_net(x: Column, y: Column, net: tuple = NET) -> Column:
    return _segment_distance(x, y, *net)


def court_margin(x: Column, y: Column, polygon: list = POLYGON) -> Column:
    """Distance to the polygon's border in pixels, negative outside; column arithmetic over its few edges."""
    edges = list(zip(polygon, [*polygon[1:], polygon[0]], strict=True))
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in edges:
        if ay == by:
            continue
        at = (F.lit(ax) + (y / HEIGHT - ay) / (by - ay) * (bx - ax)) * WIDTH
        crossings = crossings + F.when(((F.lit(ay) > y / HEIGHT) != (F.lit(by) > y / HEIGHT)) & (x < at), 1).otherwise(0)
    near = F.least(*(_segment_distance(x, y, a, b) for a, b in edges))
    return F.when(crossings % 2 == 1, near).otherwise(-near)


def filter_boxes(boxes: DataFrame, least_height: float = 45.0, margin: float = 90.0) -> DataFrame:
    """Boxes of people: high enough, feet on the court or within `margin` of it."""
    return boxes.where((F.col("h") >= least_height) & (court_margin(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h")) >= -margin))


def tracklet_bounds(boxes: DataFrame, least: int = 3) -> DataFrame:
    """tracklet_id, t0, t1, boxes of tracklets with at least `least` boxes."""
    return boxes.groupBy("tracklet_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("boxes")).where(F.col("boxes") >= least)


def gate_phase(rallies: DataFrame, starts: DataFrame) -> DataFrame:
    """Rallies before their game's start are warm-up; others keep their phase, game by default."""
    return rallies.join(starts, "game_id", "left").withColumn("phase", F.when(F.col("start_s") < F.col("game_start"), "warmup").otherwise(F.coalesce("phase", F.lit("game")))).drop("game_start")


def confident(points: DataFrame, least: float) -> DataFrame:
    return points.where(F.coalesce(F.col("conf"), F.lit(1.0)) >= least)


def reject_wristless(contacts: DataFrame, most: float = 180.0) -> DataFrame:
    """Contacts stay whose nearest wrist is within `most` pixels or that have no pose; an empty list goes."""
    near = F.array_min(F.transform("wrists", lambda w: w["dist"]))
    return contacts.where(F.col("wrists").isNull() | F.coalesce(near <= most, F.lit(False)))


def attribute_by_wrist(contacts: DataFrame, gate: float = 140.0, drop: float = 260.0) -> DataFrame:
    """Contacts beyond `drop` go; within `gate` of a wrist they get its cluster, else none."""
    nearest = F.array_min(F.transform("wrists", lambda w: F.struct(w["dist"].alias("dist"), w["cluster"].alias("cluster"))))
    rows = contacts.withColumn("_n", nearest).where(F.col("_n.dist") <= drop)
    return rows.withColumn("cluster", F.when(F.col("_n.dist") < gate, F.col("_n.cluster"))).withColumn("dist_px", F.col("_n.dist")).drop("_n")


def near_in_time(probes: DataFrame, boxes: DataFrame, tol: float, keep: bool = False, by: tuple[str, ...] = ("rally_id",)) -> DataFrame:
    """Pairs of a probe and the boxes of its rally within `tol` seconds; with `keep`, probes without any stay, maybe twice, with nulls.

    Both are gathered by rally and time bucket, a box in one and a probe in those it reaches into, so neither side grows
    with the other, and sides that are dealt by rally over as many tasks aren't shuffled (a join by both keys would). `by`
    may name the game beside the rally, for sides that are dealt by game.
    """
    wide, reach = 4 * tol, 1.01 * tol  # a little more than `tol`, so that no bucket is lost to rounding
    box = F.struct("tracklet_id", F.col("t").alias("box_t"), F.col("x").alias("bx"), F.col("y").alias("by"), "w", "h", "cluster_id")
    b = boxes.where("rally_id is not null and t is not null").select(*by, F.floor(F.col("t") / wide).alias("_bucket"), box.alias("_box"))
    at = F.sequence(F.floor((F.col("t") - reach) / wide), F.floor((F.col("t") + reach) / wide))
    p = probes.select(*by, F.struct(*(c for c in probes.columns if c not in by)).alias("_probe"), F.explode_outer(at).alias("_bucket"))
    met = p.unionByName(b, allowMissingColumns=True).groupBy(*by, "_bucket").agg(F.collect_list("_probe").alias("_probes"), F.collect_list("_box").alias("_boxes"))
    each = met.select(*by, F.explode("_probes").alias("_probe"), "_boxes")
    near = F.filter("_boxes", lambda x: F.abs(x["box_t"] - F.col("_probe.t")) <= tol)
    return each.select(*by, "_probe", (F.explode_outer if keep else F.explode)(near).alias("_box")).select(*by, "_probe.*", "_box.*")


def boxes_at(probes: DataFrame, boxes: DataFrame, tol: float = 0.12) -> DataFrame:
    """probe_id, tracklet_id, box_t: of each tracklet the box nearest in time, the earlier of equal ones."""
    pairs = near_in_time(probes, boxes, tol)
    return pairs.groupBy("probe_id", "tracklet_id").agg(F.min_by("box_t", F.struct(F.abs(F.col("box_t") - F.col("t")), "box_t")).alias("box_t"))


def attribute(contacts: DataFrame, boxes: DataFrame, gate: float = 90.0, drop: float = 150.0, y_weight: float = 0.25) -> DataFrame:
    """probe_id, tracklet_id, cluster, dist_px, side: the nearest player of each contact within 0.3 s.

    A player's anchor is the middle of the box, 35 % down, and heights count by `y_weight`. Contacts with nobody within
    `drop` are dropped; the player is named below `gate`; the side is that of the feet.
    """
    pairs = near_in_time(contacts, boxes, 0.3)
    dx, dy = F.col("bx") + F.col("w") / 2 - F.col("x"), (F.col("by") + F.col("h") * 0.35 - F.col("y")) * y_weight
    d = F.sqrt(dx * dx + dy * dy)
    body = F.struct("tracklet_id", "cluster_id", d.alias("d"), side(F.col("bx") + F.col("w") / 2, F.col("by") + F.col("h")).alias("side"))
    best = pairs.groupBy("probe_id").agg(F.min_by(body, F.struct(d, "tracklet_id", "box_t")).alias("b")).where(F.col("b.d") <= drop)
    return best.select("probe_id", "b.tracklet_id", F.when(F.col("b.d") < gate, F.col("b.cluster_id")).alias("cluster"), (F.round(F.col("b.d") * 10) / 10).alias("dist_px"), F.col("b.side").cast("long").alias("side"))


def relink(mispaired: DataFrame, boxes: DataFrame, tol: float = 0.12, y_weight: float = 0.6) -> DataFrame:
    """probe_id, tracklet_id: for each wrongly linked touch the nearest body of the credited player at its time, else null."""
    pairs = near_in_time(mispaired, boxes, tol, keep=True)
    d = F.hypot(F.col("bx") + F.col("w") / 2 - F.col("x"), (F.col("by") + F.col("h") * 0.35 - F.col("y")) * y_weight)
    near = F.when(F.col("cluster_id") == F.col("credited"), F.struct(d, "tracklet_id", "box_t"))
    return pairs.groupBy("rally_id", "probe_id").agg(F.min_by("tracklet_id", near).alias("tracklet_id")).drop("rally_id")


def outside_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """probe_id of the points that no widened box of the same tenth of a second (or its neighbours) holds."""
    pairs = points.withColumn("_tick", F.round(F.col("t") * 10)).withColumn("_tick", F.explode(F.array(F.col("_tick") - 1, F.col("_tick"), F.col("_tick") + 1)))
    b = boxes.select("rally_id", F.round(F.col("t") * 10).alias("_tick"), F.col("x").alias("bx"), F.col("y").alias("by"), "w", "h")
    inside = F.col("x").between(F.col("bx") - 12, F.col("bx") + F.col("w") + 12) & F.col("y").between(F.col("by") - 14, F.col("by") + F.col("h") + 8)
    held = pairs.join(b, ["rally_id", "_tick"]).where(inside).select("probe_id").distinct()
    return points.join(held, "probe_id", "left_anti").select("probe_id")


def wrist_clusters(wrists: DataFrame, boxes: DataFrame, tol: float = 0.15) -> DataFrame:
    """probe_id, cluster: of the single box that holds the wrist, else of the box with the nearest middle."""
    pairs = near_in_time(wrists, boxes, tol)
    inside = F.col("x").between(F.col("bx"), F.col("bx") + F.col("w")) & F.col("y").between(F.col("by"), F.col("by") + F.col("h"))
    d = F.hypot(F.col("bx") + F.col("w") / 2 - F.col("x"), F.col("by") + F.col("h") / 2 - F.col("y"))
    near = F.struct(d, "tracklet_id", "box_t")
    one = pairs.groupBy("probe_id").agg(F.count_if(inside).alias("_in"), F.min_by(F.when(inside, F.col("cluster_id")), F.when(inside, near)).alias("_inner"), F.min_by("cluster_id", near).alias("_near"))
    return one.select("probe_id", F.when(F.col("_in") == 1, F.col("_inner")).otherwise(F.col("_near")).alias("cluster"))


def known_different(tracklets: DataFrame, slack: float = 0.2) -> DataFrame:
    """rally_id, a, b, distance: tracklets of a rally that overlap in time, so that they are different people.

    distance is one less the cosine of their embeddings, null where either has none.
    """
    facts = [F.col("tracklet_id"), F.col("t0"), F.col("t1"), F.col("embedding").alias("e") if "embedding" in tracklets.columns else F.lit(None).cast("array<double>").alias("e")]
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    rows = tracklets.select("rally_id", *(x.alias(n) for x, n in zip(facts, ("id", "0", "1", "e"), strict=True))).withColumn("n", F.sqrt(dot("e", "e")))
    a, b = (rows.select("rally_id", *(F.col(n).alias(f"{side}_{n}") for n in ("id", "0", "1", "e", "n"))) for side in "ab")
    pairs = a.join(b, "rally_id").where((F.col("a_id") < F.col("b_id")) & (F.col("a_0") <= F.col("b_1") + slack) & (F.col("b_0") <= F.col("a_1") + slack))
    apart = 1 - dot("a_e", "b_e") / (F.col("a_n") * F.col("b_n") + 1e-9)
    return pairs.select("rally_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"), apart.alias("distance"))


def link_contacts(plays: DataFrame, contacts: DataFrame, tol: float = 0.05) -> DataFrame:
    """play_id, contact_id: the first contact of the rally less than `tol` seconds from each touch."""
    at = F.floor(F.col("t") / tol)
    p = plays.select("rally_id", "play_id", "t", F.explode(F.array(at - 1, at, at + 1)).alias("_b"))
    c = contacts.select("rally_id", F.col("probe_id").alias("contact_id"), F.col("t").alias("ct"), F.floor(F.col("t") / tol).alias("_b"))
    pairs = p.join(c, ["rally_id", "_b"]).where(F.abs(F.col("ct") - F.col("t")) < tol)
    return pairs.groupBy("play_id").agg(F.min_by("contact_id", F.struct("ct", "contact_id")).alias("contact_id"))


def global_static_cells(points: DataFrame, cell: int = 40, rallies: int = 3, least: int = 12, spread: float = 2.5) -> DataFrame:
    """game_id, cx, cy of cells that hold a fixed object: `least` points in `rallies` rallies, hardly moving."""
    sums = points.groupBy("game_id", "rally_id", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(a) for a, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") ** 2), ("syy", F.col("y") ** 2)))
    )
    cells = sums.groupBy("game_id", "cx", "cy").agg(F.count_if(F.col("n") >= least).alias("hit"), *(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy")))
    std = lambda s, ss: F.sqrt(F.greatest(F.lit(0.0), F.col(ss) / F.col("n") - (F.col(s) / F.col("n")) ** 2))
    return cells.where((F.col("hit") >= rallies) & (std("sx", "sxx") < spread) & (std("sy", "syy") < spread)).select("game_id", "cx", "cy")


def pick_moving(points: DataFrame, cell: int = 40, share: float = 0.15) -> DataFrame:
    """rally_id, t, x, y, conf: the most confident moving point of each frame.

    Cells that are lit in more than `share` of a rally's frames, and their neighbours, are clutter. All of it happens where
    a rally lies; points aren't shuffled if they lie by rally already.
    """
    from courtlake.operators.sequences import Columns, group_of, per_groups

    def some(rows: Columns, edges: np.ndarray) -> Columns:
        g, n = group_of(edges), len(rows["t"])
        # rows come by time, so frames do
        new = np.append(True, (np.diff(g) != 0) | (np.diff(rows["frame"]) != 0))[:n]
        frame = np.cumsum(new)
        # numbers of the columns and rows of cells, their neighbours included, and cells as one number
        seen = [np.unique(np.concatenate([rows[c] + k for k in (-1, 0, 1)])) for c in ("cx", "cy")]
        place = lambda g, cx, cy: (g * len(seen[0]) + np.searchsorted(seen[0], cx)) * len(seen[1]) + np.searchsorted(seen[1], cy)
        here = place(g, rows["cx"], rows["cy"])
        order = np.lexsort((frame, here))
        lit = order[np.append(True, (np.diff(here[order]) != 0) | (np.diff(frame[order]) != 0))[:n]]
        _, at, times = np.unique(here[lit], return_index=True, return_counts=True)
        frames = np.bincount(g[new], minlength=len(edges) - 1)
        still = lit[at[times > share * frames[g[lit[at]]]]]
        clutter = np.concatenate([place(g[still], rows["cx"][still] + i, rows["cy"][still] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        moving = np.nonzero(~np.isin(here, clutter))[0]
        best = moving[np.lexsort((rows["y"][moving], rows["x"][moving], -rows["conf"][moving], frame[moving]))]
        best = best[np.append(True, np.diff(frame[best]) != 0)[: len(best)]]
        return {"rally_id": rows["rally_id"][best], "t": rows["frame"][best], **{c: rows[c][best] for c in ("x", "y", "conf")}}

    rows = points.select("rally_id", "t", "x", "y", F.col("conf").cast("double").alias("conf"), F.round("t", 3).alias("frame"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    return per_groups(rows, ["rally_id"], ["t"], some, "rally_id long, t double, x double, y double, conf double")


def camera_metrics(boxes: DataFrame, bounds: DataFrame, gate: float = 45.0) -> DataFrame:
    """game_id, metric, value: height median and 5th percentile, share below the gate, median tracklet duration."""
    heights = boxes.groupBy("game_id").agg(F.percentile("h", 0.5).alias("height_median"), F.percentile("h", 0.05).alias("height_p05"), F.avg(F.when(F.col("h") < gate, 1.0).otherwise(0.0)).alias("below_gate"))
    lasting = bounds.groupBy("game_id").agg(F.percentile(F.col("t1") - F.col("t0"), 0.5).alias("duration_median"))
    return heights.join(lasting, "game_id").unpivot(["game_id"], ["height_median", "height_p05", "below_gate", "duration_median"], "metric", "value")


def compare_cameras(metrics: DataFrame, reference: int) -> DataFrame:
    """game_id, metric, value, ref, ratio against one game's camera; null where the reference is 0."""
    ref = metrics.where(F.col("game_id") == reference).select("metric", F.col("value").alias("ref"))
    return metrics.join(ref, "metric").select("game_id", "metric", "value", "ref", F.when(F.col("ref") != 0, F.col("value") / F.col("ref")).alias("ratio"))


def action_band(boxes: DataFrame, least: int = 20, fallback: tuple[float, float] = (540.0, 800.0)) -> DataFrame:
    """rally_id, middle, low: median and 90th percentile of the boxes' middles; a fallback below `least` boxes."""
    y = F.col("y") + F.col("h") / 2
    rows = boxes.groupBy("rally_id").agg(F.count(F.lit(1)).alias("n"), F.percentile(y, 0.5).alias("m"), F.percentile(y, 0.9).alias("p"))
    few = F.col("n") < least
    return rows.select("rally_id", F.when(few, fallback[0]).otherwise(F.col("m")).alias("middle"), F.when(few, fallback[1]).otherwise(F.col("p")).alias("low"))


def player_envelope(boxes: DataFrame, step: float = 0.5, pad: float = 90.0) -> DataFrame:
    """rally_id, frame, left, right: the players' extent on a time grid, gaps carried forward and then back."""
    seen = boxes.groupBy("rally_id", F.floor(F.col("t") / step).alias("frame")).agg(F.min("x").alias("l"), F.max(F.col("x") + F.col("w")).alias("r"))
    span = seen.groupBy("rally_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    grid = span.select("rally_id", F.explode(F.sequence("a", "b")).alias("frame"))
    w = Window.partitionBy("rally_id").orderBy("frame")
    past, next_ = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    full = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(next_))
    return grid.join(seen, ["rally_id", "frame"], "left").select("rally_id", "frame", (full("l") - pad).alias("left"), (full("r") + pad).alias("right"))


def audio_peaks(samples: DataFrame, rate: int = 16000) -> DataFrame:
    """video, q, peak: the largest absolute sample of each quarter second; an incomplete last one is left out."""
    size = rate // 4
    return samples.groupBy("video", F.floor(F.col("i") / size).alias("q")).agg(F.max(F.abs("v")).alias("peak"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).drop("_n")


def smoothed(motion: DataFrame) -> DataFrame:
    """motion with `m`, its mean over three seconds (zeros at the ends), and the 20th and 90th percentiles of that, lo and hi, by video."""
    w = Window.partitionBy("video").orderBy("sec")
    smooth = motion.withColumn("m", (F.coalesce(F.lag("v").over(w), F.lit(0.0)) + F.col("v") + F.coalesce(F.lead("v").over(w), F.lit(0.0))) / 3)
    level = smooth.groupBy("video").agg(F.percentile("m", 0.2).alias("lo"), F.percentile("m", 0.9).alias("hi"))
    return smooth.join(level, "video")


def segment(motion: DataFrame, audio: DataFrame, share: float = 0.35, max_gap: int = 4, least: int = 4) -> DataFrame:
    """video, start_s, end_s, contacts_per_10s: runs of motion, joined over short gaps, with the audio peaks in them.

    Motion is smoothed over three seconds with zeros at the ends and compared with a level between its 20th and 90th percentiles.
    """
    w = Window.partitionBy("video").orderBy("sec")
    active = smoothed(motion).where(F.col("m") > F.col("lo") + share * (F.col("hi") - F.col("lo"))).select("video", "sec")
    # a new segment starts where max_gap seconds or more lie between active ones
    new = F.coalesce(F.col("sec") - F.lag("sec").over(w) - 1 >= max_gap, F.lit(True))
    runs = active.withColumn("_g", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("video", "_g").agg(F.min("sec").alias("start_s"), (F.max("sec") + 1).alias("end_s")).where(F.col("end_s") - F.col("start_s") >= least)
    bar = audio.groupBy("video").agg(F.percentile("peak", 0.92).alias("_bar"))
    loud = audio.join(bar, "video").where("peak > _bar").select("video", F.floor(F.col("q") / 4).alias("sec")).groupBy("video", "sec").agg(F.count(F.lit(1)).alias("_k"))
    inside = runs.withColumn("sec", F.explode(F.sequence(F.col("start_s"), F.col("end_s") - 1))).join(loud, ["video", "sec"], "left")
    return inside.groupBy("video", "start_s", "end_s").agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("_t")).select("video", "start_s", "end_s", F.round(F.col("_t") / (F.col("end_s") - F.col("start_s")) * 10, 1).alias("contacts_per_10s"))


def sweep_segments(motion: DataFrame, shares: tuple = (0.15, 0.2, 0.25, 0.3, 0.35, 0.45), leasts: tuple = (2, 3, 4, 6), gaps: tuple = (1, 2, 3, 4, 6), share: float = 0.35, least: int = 4, gap: int = 4) -> DataFrame:
    """video, share, least, max_gap, rallies: how many segments each setting finds: all shares with all shortest lengths, and all gaps at the default.

    Motion is smoothed once. Runs depend on share and gap alone, so each is found once and counted for every length.
    """
    settings = sorted({(s, gap) for s in shares} | {(share, g) for g in gaps})
    pair = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(g).alias("max_gap")) for s, g in settings)))
    base = smoothed(motion).select("video", "sec", "m", "lo", "hi", pair.alias("c")).select("video", "sec", "m", "lo", "hi", "c.*")
    keys = ["video", "share", "max_gap"]
    w = Window.partitionBy(*keys).orderBy("sec")
    active = base.where(F.col("m") > F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo")))
    new = F.coalesce(F.col("sec") - F.lag("sec").over(w) - 1 >= F.col("max_gap"), F.lit(True)).cast("int")
    runs = active.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_g").agg((F.max("sec") + 1 - F.min("sec")).alias("_s"))
    counts = runs.groupBy(*keys).agg(*(F.count_if(F.col("_s") >= m).alias(str(m)) for m in sorted({*leasts, least})))
    all_ = base.select(*keys).distinct().join(counts, keys, "left").na.fill(0)
    long = all_.unpivot(keys, [str(m) for m in sorted({*leasts, least})], "least", "rallies").withColumn("least", F.col("least").cast("long"))
    asked = ((F.col("max_gap") == gap) & F.col("share").isin(*map(float, shares)) & F.col("least").isin(*leasts)) | ((F.col("share") == share) & (F.col("least") == least))
    return long.where(asked).select("video", "share", "least", F.col("max_gap").cast("long").alias("max_gap"), "rallies")
