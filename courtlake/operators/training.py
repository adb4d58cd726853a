"""Does a bundle belong to a game, how good are contacts at each threshold, and which frames teach a ball detector."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.operators.ball import verified_rows
from courtlake.operators.detections import HEIGHT
from courtlake.operators.sequences import Columns, breaks, group_of, per_group, per_groups, strongest, take_together


def bundle_evidence(pairs: DataFrame, ball: DataFrame, rallies: DataFrame, plays: DataFrame, tol: float = 0.15, close: float = 80.0, least_share: float = 0.2, far: float = 200.0, tasks: int | None = None) -> DataFrame:
    """bundle_id, game_id, rallies, covered, touches, median_px, close_share, verdict for pairs of a bundle and a game.

    covered: rallies (game_id, rally_id, start_s, end_s) during which the bundle's ball (bundle_id, t, x, y) was seen;
    median_px: over kept touches with a place (game_id, play_id, t, x, y) that have ball points within `tol` seconds, of
    the distance to the nearest of those (the upper of two middle ones). A pair is rejected below `least_share` of its
    rallies, suspicious beyond `far` pixels, else it fits; without ball points or rallies it can't be judged.

    Ball points are many, so all else comes to where they lie: if they are dealt by bundle over `tasks` tasks, so are rallies
    and touches, and points aren't shuffled. Touches meet them by time bucket, rallies in one pass over time.
    """
    deal = lambda df: df.repartition(tasks, "bundle_id") if tasks else df
    r = deal(pairs.join(rallies.select("game_id", "rally_id", "start_s", "end_s"), "game_id"))
    both = pairs.select("bundle_id", "game_id").distinct()
    rows = ball.select("bundle_id", "t", F.lit(0).alias("_kind"), F.col("t").alias("_ball"))
    rows = rows.unionByName(r.select("bundle_id", F.col("start_s").alias("t"), F.lit(1).alias("_kind"), "game_id", "rally_id", "end_s"), allowMissingColumns=True)
    rows = rows.unionByName(deal(both).select("bundle_id", F.lit(None).cast("double").alias("t"), F.lit(2).alias("_kind"), "game_id"), allowMissingColumns=True)
    # from the end back, so that the least time of the ball so far is the next one; a pair comes after all points of its bundle
    rows = rows.where("bundle_id is not null")
    later = Window.partitionBy("bundle_id").orderBy(F.col("t").desc_nulls_last(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_next": F.min("_ball").over(later), "_any": F.min("_kind").over(later) == 0}).where("_kind > 0")
    met = (F.col("_kind") == 1) & F.col("t").isNotNull() & (F.col("_next") <= F.col("end_s"))
    seen = rows.groupBy(F.col("bundle_id").alias("_bundle"), F.col("game_id").alias("_game")).agg(F.count_if(F.col("_kind") == 1).alias("rallies"), F.countDistinct(F.when(met, F.col("rally_id"))).alias("covered"), F.bool_or((F.col("_kind") == 2) & F.col("_any")).alias("_has"))

    wide, reach = 4 * tol, 1.01 * tol  # a little more than `tol`, so that no bucket is lost to rounding
    placed = plays.where("x is not null").select("game_id", "play_id", F.col("t").alias("pt"), F.col("x").alias("px"), F.col("y").alias("py"))
    at = F.sequence(F.floor((F.col("pt") - reach) / wide), F.floor((F.col("pt") + reach) / wide))
    asked = deal(pairs.select("bundle_id", "game_id").join(placed, "game_id")).select("bundle_id", F.explode(at).alias("_b"), F.struct("game_id", "play_id", "pt", "px", "py").alias("_touch"))
    points = ball.where("t is not null").select("bundle_id", F.floor(F.col("t") / wide).alias("_b"), F.struct("t", "x", "y").alias("_point"))
    meet = points.unionByName(asked, allowMissingColumns=True).groupBy("bundle_id", "_b").agg(F.collect_list("_touch").alias("_touches"), F.collect_list("_point").alias("_points")).where("bundle_id is not null")
    each = meet.where(F.size("_points") > 0).select("bundle_id", F.explode("_touches").alias("_touch"), "_points").select("bundle_id", "_touch.*", "_points")
    each = each.withColumn("_points", F.filter("_points", lambda p: F.abs(p["t"] - F.col("pt")) <= tol)).where(F.size("_points") > 0)
    d = F.array_min(F.transform("_points", lambda p: F.hypot(p["x"] - F.col("px"), p["y"] - F.col("py"))))
    near = each.select("bundle_id", "game_id", "play_id", d.alias("d")).groupBy("bundle_id", "game_id", "play_id").agg(F.min("d").alias("d"))
    w = Window.partitionBy("bundle_id", "game_id")
    ranked = near.withColumn("_i", F.row_number().over(w.orderBy("d")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    touches = ranked.groupBy("bundle_id", "game_id").agg(F.count(F.lit(1)).alias("touches"), F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("d"))).alias("median_px"), F.avg(F.when(F.col("d") < close, 1.0).otherwise(0.0)).alias("close_share"))
    own = (F.col("bundle_id") == F.col("_bundle")) & F.col("game_id").eqNullSafe(F.col("_game"))  # a pair without a game has a ball or none, too
    out = pairs.select("bundle_id", "game_id").join(seen, own, "left").drop("_bundle", "_game").join(touches, ["bundle_id", "game_id"], "left").na.fill(0, ["rallies", "covered", "touches"])
    verdict = (
        F.when(~F.coalesce("_has", F.lit(False)), "no ball").when(F.col("rallies") == 0, "no rallies").when(F.col("covered") < least_share * F.col("rallies"), "rejected")
        .when(F.col("median_px") > far, "suspicious").when(F.col("median_px").isNull(), "unchecked").otherwise("fits")
    )
    return out.withColumn("verdict", verdict).drop("_has")


def contact_f1(ball: DataFrame, rallies: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.15, 0.25, 0.35, 0.5), gap: float = 0.35, tol: float = 0.5) -> DataFrame:
    """game_id (null: all games), threshold, tp, fp, fn, precision, recall, f1, density: contacts found from points of each confidence.

    rallies: game_id, rally_id, start_s, end_s of reviewed game rallies; truth: game_id, rally_id, t of their touches; ball:
    game_id, rally_id, t, x, y, conf, where no confidence passes. Density is in points a second of those rallies. Points
    and touches meet once, by rally; contacts are found and matched there for each threshold, and only counts leave.
    """
    number = F.explode(F.array(*(F.struct(F.lit(i).alias("config"), F.lit(float(c)).alias("threshold")) for i, c in enumerate(thresholds))))
    keys = ["game_id", "rally_id"]
    reviewed = rallies.select(*keys)
    points = ball.join(reviewed, keys, "left_semi").select(*keys, F.lit(0).alias("own"), "t", "x", "y", F.coalesce("conf", F.lit(1.0)).alias("conf"))
    asked = truth.join(reviewed, keys, "left_semi").select(*keys, F.lit(1).alias("own"), "t", *(F.lit(0.0).alias(c) for c in ("x", "y", "conf")))

    def some(rows: Columns, edges: np.ndarray) -> Columns:
        g, groups = group_of(edges), np.arange(len(edges))
        ball, true = (np.nonzero(rows["own"] == k)[0] for k in (0, 1))
        touches, out = np.searchsorted(g[true], groups), []
        for i, least in enumerate(thresholds):
            on = ball[rows["conf"][ball] >= least]
            shown = np.searchsorted(g[on], groups)
            some_on = np.nonzero(np.diff(shown))[0]
            at, mag = breaks({c: rows[c][on] for c in ("t", "x", "y")}, np.append(shown[some_on], len(on)))
            at = on[at]
            at = at[strongest(rows["t"][at], mag, gap, g[at])]
            found = np.searchsorted(g[at], groups)
            met = take_together(np.round(rows["t"][at], 2), found, rows["t"][true], touches, tol) >= 0
            tp = np.bincount(g[at][met], minlength=len(edges) - 1)
            out.append({"game_id": rows["game_id"][edges[:-1]], "config": np.full(len(tp), i), "tp": tp, "fp": np.diff(found) - tp, "fn": np.diff(touches) - tp, "n": np.diff(shown)})
        return {c: np.concatenate([o[c] for o in out]) for c in out[0]}

    counts = per_groups(points.unionByName(asked), keys, ["own", "t", "x", "y"], some, "game_id long, config int, tp long, fp long, fn long, n long")
    spans = rallies.groupBy("game_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_s"))
    base = spans.select("game_id", "_s", number.alias("c")).select("game_id", "_s", "c.*")
    sums = base.join(counts.groupBy("game_id", "config").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.sum("n").alias("_p")), ["game_id", "config"], "left").na.fill(0)
    out = sums.rollup("threshold", "game_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "_p")), F.sum("_s").alias("_s"), F.grouping("threshold").alias("_g")).where("_g = 0")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn")), "density": F.col("_p") / F.greatest(F.col("_s"), F.lit(1.0))})
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("_p", "_s", "_g")


#: The kinds of frames.
KINDS = ["positive", "negative", "hard"]
#: What a rally brings to its game: verified points (own 0), and frames that fooled the detector (own 1).
_SHOWN = "game_id long, rally_id long, own int, t double, x double, y double"


def _fooled(t: np.ndarray, g: np.ndarray, seen: np.ndarray, of: np.ndarray, every: int) -> np.ndarray:
    """Places of every `every`th distinct time (t of rally g, in order) without one of `seen` (of rally `of`) in the same tenth of a second."""
    tenth = lambda t: np.floor(t * 10 + 0.5)
    at = np.nonzero(np.append(True, (np.diff(g) != 0) | (np.diff(t) != 0))[: len(t)])[0]
    both = np.concatenate([tenth(t[at]), tenth(seen)])
    low = both.min(initial=0)
    place = np.concatenate([g[at], of]) * (both.max(initial=0) - low + 1) + both - low
    at = at[~np.isin(place[: len(at)], place[len(at) :])]
    rally = g[at]
    nth = np.arange(len(at)) - np.searchsorted(rally, rally)
    return at[nth % every == 0]


def _shown(rows: Columns, arcs: np.ndarray, t: np.ndarray, hard: np.ndarray) -> Columns:
    both = np.concatenate([arcs, hard])
    out = {c: rows[c][both] for c in ("game_id", "rally_id", "x", "y")}
    return out | {"own": np.repeat([0, 1], [len(arcs), len(hard)]), "t": np.concatenate([t, rows["t"][hard]])}


def training_frames(arcs: DataFrame, fired: DataFrame, share: float = 0.3, hard_share: float = 0.4, every: int = 7, away: float = 0.5, gap: float = 0.45, seed: int = 0) -> DataFrame:
    """game_id, t, kind, box: frames that show the ball (positive), random ones that don't (negative), and ones that fooled the detector (hard).

    arcs: game_id, rally_id, t, x, y of verified points; fired: game_id, rally_id, t of frames with any candidate.
    Positives are `gap` seconds apart; their box is smaller in the upper six tenths of the picture. There are `share` as many
    random times, by a hash of seed, game and number, so that they don't depend on how rows are dealt; those closer than
    `away` to every fifth positive go. Hard ones are every `every`th of a rally's frames without a verified point in the
    same tenth of a second, in order, `hard_share` of the positives at most, one at least.
    """

    def some(rows: Columns, edges: np.ndarray) -> Columns:
        g = group_of(edges)
        arcs, fired = (np.nonzero(rows["own"] == k)[0] for k in (0, 1))
        return _shown(rows, arcs, rows["t"][arcs], fired[_fooled(rows["t"][fired], g[fired], rows["t"][arcs], g[arcs], every)])

    keys = ["game_id", "rally_id"]
    none = F.lit(None).cast("double")
    both = arcs.select(*keys, F.lit(0).alias("own"), "t", "x", "y").unionByName(fired.select(*keys, F.lit(1).alias("own"), "t", none.alias("x"), none.alias("y")))
    return _chosen(per_groups(both.where("game_id is not null"), keys, ["own", "t", "x", "y"], some, _SHOWN), share, hard_share, away, gap, seed)


def frames_of_points(points: DataFrame, share: float = 0.3, hard_share: float = 0.4, every: int = 7, away: float = 0.5, gap: float = 0.45, seed: int = 0) -> DataFrame:
    """`training_frames` of candidates (game_id, rally_id, t, x, y) and of the points that `verified_points` leaves of them, in one pass where a rally lies.

    What reaches a game is its verified points and its hard frames; candidates aren't moved.
    """

    def some(rows: Columns, edges: np.ndarray) -> Columns:
        g, at = group_of(edges), verified_rows(rows, edges)
        t = np.round(rows["t"][at], 3)
        return _shown(rows, at, t, _fooled(rows["t"], g, t, g[at], every))

    rows = points.where("game_id is not null").select("game_id", "rally_id", "t", "x", "y")
    return _chosen(per_groups(rows, ["game_id", "rally_id"], ["t", "x", "y"], some, _SHOWN), share, hard_share, away, gap, seed)


def _chosen(shown: DataFrame, share: float, hard_share: float, away: float, gap: float, seed: int) -> DataFrame:
    """A game's frames from what its rallies bring; a task holds a game's."""

    def one(rows: Columns) -> Columns:
        game, arcs, fooled = rows["game_id"][:1], rows["own"] == 0, np.nonzero(rows["own"] == 1)[0]
        t, y = rows["t"][arcs], rows["y"][arcs]
        last, picked = -np.inf, []
        for i, now in enumerate(t.tolist()):
            if now - last >= gap:
                picked.append(i)
                last = now
        many = int(np.floor(len(picked) * share))
        drawn = np.array([int(hashlib.md5(f"{seed}-{int(game[0])}-{k}".encode()).hexdigest()[:12], 16) / float(1 << 48) for k in range(many)]) * (t[-1] if len(t) else 0.0)
        taken = np.concatenate([[-np.inf], t[picked[::5]], [np.inf]])
        after = np.searchsorted(taken, drawn)
        clear = drawn[np.minimum(np.abs(drawn - taken[after - 1]), np.abs(taken[after] - drawn)) >= away]
        hard = fooled[np.lexsort((rows["t"][fooled], rows["rally_id"][fooled]))][: max(1, int(np.floor(len(picked) * hard_share))) if picked else 0]
        times = [t[picked], clear, rows["t"][hard]]
        size = [len(x) for x in times]
        box = np.concatenate([np.where(y[picked] < HEIGHT * 0.6, 26.0, 40.0), np.full(size[1] + size[2], np.nan)])
        return {"game_id": np.repeat(game, sum(size)), "t": np.concatenate(times), "kind": np.repeat(np.array(KINDS, object), size), "box": box}

    return per_group(shown, ["game_id"], ["own", "t", "x", "y"], one, "game_id long, t double, kind string, box double").withColumn("box", F.col("box").cast("int"))
