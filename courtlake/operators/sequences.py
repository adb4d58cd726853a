"""Steps that depend on what was kept before: one rally, video or game at a time, rallies spread over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.operators.detections import dist_to_net

Columns = dict[str, np.ndarray]


#: Rows that a task gathers before it works on the groups among them.
GATHER = 32_768


def per_groups(rows: DataFrame, keys: list[str], order: list[str], fn: Callable[[Columns, np.ndarray], Columns], schema: str) -> DataFrame:
    """fn on the columns of many whole groups, one after another and each in order, and where each starts (with the end of the last).

    A window by key brings the rows together, so rows that are dealt by a part of the key already aren't shuffled again.
    A task holds `GATHER` rows, or one group if that is longer. A call gets groups of like lengths, within a factor of
    four, so that a matrix of groups by places has at most four times as many cells as there are rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_first", F.row_number().over(w) == 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(df: pd.DataFrame) -> pd.DataFrame:
            starts = np.nonzero(df["_first"].to_numpy())[0]
            size = np.diff(np.append(starts, len(df)))
            cols, out = {c: df[c].to_numpy() for c in df.columns if c != "_first"}, []
            kind = np.ceil(np.log2(size) / 2)
            for k in np.unique(kind):
                mine = kind == k
                edges = np.concatenate([[0], np.cumsum(size[mine])])
                at = np.repeat(starts[mine] - edges[:-1], size[mine]) + np.arange(edges[-1])
                out.append(fn({c: v[at] for c, v in cols.items()}, edges))
            return pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})

        held, n = [], 0
        for df in batches:
            if df.empty:
                continue
            starts = np.nonzero(df["_first"].to_numpy())[0]
            if n + len(df) < GATHER or not len(starts):
                held.append(df)
                n += len(df)
                continue
            last = int(starts[-1])
            whole = pd.concat([*held, df.iloc[:last]], ignore_index=True) if held else df.iloc[:last]
            if len(whole):
                yield of(whole)
            held, n = [df.iloc[last:]], len(df) - last
        if held:
            yield of(pd.concat(held, ignore_index=True))

    return marked.mapInPandas(run, schema)


def per_group(rows: DataFrame, keys: list[str], order: list[str], fn: Callable[[Columns], Columns], schema: str) -> DataFrame:
    """fn on the columns of each key's rows in order."""

    def each(cols: Columns, edges: np.ndarray) -> Columns:
        got = [fn({c: v[s:e] for c, v in cols.items()}) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        return {c: np.concatenate([g[c] for g in got]) for c in got[0]}

    return per_groups(rows, keys, order, each, schema)


def by_length(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rows and lengths of groups, the longest first, and for each place how many groups reach it: groups then advance together, place by place."""
    size = np.diff(edges)
    longest = np.argsort(-size, kind="stable")
    size = size[longest]
    return edges[:-1][longest], size, np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")


def group_of(edges: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges))


def long_enough(edges: np.ndarray, of: np.ndarray, least: int) -> np.ndarray:
    """Which rows lie on a track (numbered within its group) of at least `least` rows."""
    track = group_of(edges) * (of.max(initial=0) + 1) + of
    return np.bincount(track)[track] >= least


CONTACTS = "game_id long, rally_id long, t double, x double, y double"


def breaks(rows: Columns, edges: np.ndarray, cos_thr: float = 0.55, dv_thr: float = 260.0, window: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Rows at which the speed or direction of a group's path breaks, and the change of speed there.

    Velocities reach over two points and `window` seconds on each side, 1.2 s at most. Groups are set apart on one axis of
    time, so that all points look for their neighbours at once.
    """
    t, x, y = rows["t"], rows["x"], rows["y"]
    g, i = group_of(edges), np.arange(len(t))
    us = np.floor(t * 1_000_000 + 0.5).astype(np.int64)
    span, far = round((window - 1e-6) * 1_000_000), 1_200_000
    at = us - us[edges[:-1]][g]
    ends = at[edges[1:] - 1] + 2 * far
    at = at + np.concatenate([[0], np.cumsum(ends)[:-1]])[g]
    b, f = np.searchsorted(at, at - span, side="right") - 1, np.searchsorted(at, at + span, side="left")
    ok = (i - 2 >= edges[:-1][g]) & (i + 2 < edges[1:][g]) & (b >= 0) & (f < len(t))
    i, b, f = i[ok], b[ok], f[ok]
    ok = (at[b] >= at[i] - far) & (at[f] <= at[i] + far)
    i, b, f = i[ok], np.minimum(b[ok], i[ok] - 2), np.maximum(f[ok], i[ok] + 2)
    ok = t[f] - t[b] <= 1.2
    i, b, f = i[ok], b[ok], f[ok]
    dt1, dt2 = t[i] - t[b], t[f] - t[i]
    v1x, v1y, v2x, v2y = (x[i] - x[b]) / dt1, (y[i] - y[b]) / dt1, (x[f] - x[i]) / dt2, (y[f] - y[i]) / dt2
    s1, s2 = np.hypot(v1x, v1y), np.hypot(v2x, v2y)
    cos, mag = (v1x * v2x + v1y * v2y) / (s1 * s2 + 1e-6), np.abs(s2 - s1)
    fires = ((s1 >= 60) | (s2 >= 60)) & ((cos < cos_thr) | ((v1y > 40) & (v2y < -40)) | (mag > dv_thr))
    return i[fires], mag[fires]


def strongest(t: np.ndarray, mag: np.ndarray, gap: float, group: np.ndarray | None = None) -> list[int]:
    """Indices of the candidates that stay (of each group): of those less than `gap` seconds after the kept one the stronger takes its place."""
    kept: list[int] = []
    shown, mags = np.round(t, 2).tolist(), mag.tolist()
    of = [0] * len(mags) if group is None else group.tolist()
    for i, now in enumerate(t.tolist()):
        if kept and of[kept[-1]] == of[i] and now - shown[kept[-1]] < gap:
            if mags[i] > mags[kept[-1]]:
                kept[-1] = i
            continue
        kept.append(i)
    return kept


def find_contacts(points: DataFrame, gap: float = 0.35, **kw) -> DataFrame:
    """game_id, rally_id, t, x, y of the ball's contacts: where its path breaks (see `breaks`), the strongest of those within `gap` seconds."""

    def some(rows: Columns, edges: np.ndarray) -> Columns:
        at, mag = breaks(rows, edges, **kw)
        kept = at[strongest(rows["t"][at], mag, gap, group_of(edges)[at])]
        out = {c: rows[c][kept] for c in ("game_id", "rally_id", "t", "x", "y")}
        return out | {"t": np.round(out["t"], 2)}

    return per_groups(points.select("game_id", "rally_id", "t", "x", "y"), ["game_id", "rally_id"], ["t", "x", "y"], some, CONTACTS)


def play_types(side: list, t: list, net: list, serve_gate: bool, resync_at: float, max_gap: float) -> list[str]:
    """Types of a rally's contacts in order; a `resync_at` or `max_gap` of 0 is off."""
    own, touches, attack, plays = None, 0, None, []
    for i, (s, now, d) in enumerate(zip(side, t, net, strict=True)):
        if i == 0 and (not serve_gate or len(side) == 1 or side[1] != s):
            kind, own, touches = "serve", s, 1
        elif attack is not None and now - attack < 0.45 and d < 90:
            kind, own, touches = "block", s, 0
        else:
            again = s != own or (max_gap and i and now - t[i - 1] > max_gap) or (resync_at and touches >= resync_at)
            own, touches = s, 1 if again else touches + 1
            kind = ("dig" if attack and now - attack < 2.0 else "receive") if touches <= 1 else "set" if touches == 2 else "attack"
        if kind == "attack":
            attack = now
        plays.append(kind)
    return plays


def classify(contacts: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Add `play` to contacts (probe_id, rally_id, t, x, y, side): their types by possession and touch number.

    The first contact is a serve if the next is on the other side; right after an attack and near the net a contact is
    a block. `configs` (config, serve_gate, resync_at, gap), a few rows, asks for the types under each of its settings.
    """
    rows = contacts.select("probe_id", "rally_id", "t", F.col("side").cast("int").alias("side"), dist_to_net(F.col("x"), F.col("y")).alias("net"))
    if configs is None:
        rows = rows.withColumns({"config": F.lit(0), "serve_gate": F.lit(True), "resync_at": F.lit(0), "gap": F.lit(0.0)})
    else:
        rows = rows.crossJoin(F.broadcast(configs))

    def one(rows: Columns) -> Columns:
        plays = play_types(rows["side"].tolist(), rows["t"].tolist(), rows["net"].tolist(), bool(rows["serve_gate"][0]), rows["resync_at"][0], rows["gap"][0])
        return {c: rows[c] for c in ("config", "probe_id", "rally_id", "t")} | {"play": np.array(plays, object)}

    return per_group(rows, ["config", "rally_id"], ["t", "probe_id"], one, "config int, probe_id long, rally_id long, t double, play string")


#: The types that contacts can have.
TYPES = ["serve", "receive", "set", "attack", "block", "dig"]


def typed_together(side: np.ndarray, t: np.ndarray, net: np.ndarray, edges: np.ndarray, serve_gate: bool, resync_at: float, max_gap: float) -> np.ndarray:
    """`play_types` of many rallies as places in TYPES: the first contacts of all rallies, then the second ones, and so on."""
    serve, receive, set_, attack, block, dig = range(len(TYPES))
    first, size, reach = by_length(edges)
    own, touches, last = np.zeros(len(first), int), np.zeros(len(first), int), np.full(len(first), np.nan)
    out = np.zeros(len(t), int)
    for i, n in enumerate(reach.tolist()):
        at = first[:n] + i
        s, now = side[at], t[at]
        since = now - last[:n]
        blocks = (since < 0.45) & (net[at] < 90)
        again = s != own[:n]
        if i == 0:
            again[:] = True
        elif max_gap:
            again |= now - t[at - 1] > max_gap
        if resync_at:
            again |= touches[:n] >= resync_at
        count = np.where(blocks, 0, np.where(again, 1, touches[:n] + 1))
        kind = np.where(count <= 1, np.where((since < 2.0) & (last[:n] != 0), dig, receive), np.where(count == 2, set_, attack))
        kind[blocks] = block
        if i == 0:
            after = side[np.minimum(at + 1, len(t) - 1)]
            kind[(size[:n] == 1) | (after != s) | (not serve_gate)] = serve
        own[:n], touches[:n] = s, count
        last[:n] = np.where(kind == attack, now, last[:n])
        out[at] = kind
    return out


#: Touches that count as the same family.
FAMILY = {"receive": "defense", "dig": "defense"}


def sweep_typing(contacts: DataFrame, truth: DataFrame) -> DataFrame:
    """serve_gate, resync_at, gap, exact, family, joint: of 18 settings how many contacts each types like the truth, best first.

    contacts: probe_id, rally_id, t, x, y, side, cluster; truth: probe_id, play_type, cluster_id. family takes digs and
    receives for one, joint asks for the right player too where the truth names one. A rally is sent once and typed under all
    settings where it lies; 18 rows of counts leave it.
    """
    grid = [(g, r, x) for g in (True, False) for r in (0, 3, 4) for x in (0.0, 2.2, 3.5)]
    rows = contacts.select("probe_id", "rally_id", "t", F.col("side").cast("int").alias("side"), dist_to_net(F.col("x"), F.col("y")).alias("net"), "cluster")
    rows = rows.join(truth.select("probe_id", "play_type", "cluster_id"), "probe_id", "left")
    judged = F.col("cluster_id").isNull() | F.coalesce(F.col("cluster") == F.col("cluster_id"), F.lit(False))
    rows = rows.select("probe_id", "rally_id", "t", "side", "net", "play_type", judged.alias("right"))

    def some(rows: Columns, edges: np.ndarray) -> Columns:
        # codes of types: their places in TYPES; a type beyond them equals none
        true = np.array([-1 if x is None else code.get(x, len(TYPES)) for x in rows["play_type"].tolist()])
        kin, right = np.append(kind_of, [len(TYPES), -1])[true], rows["right"].astype(bool)
        counts = []
        for setting in grid:
            play = typed_together(rows["side"], rows["t"], rows["net"], edges, *setting)
            alike = kin == kind_of[play]
            counts.append(((play == true).sum(), alike.sum(), (alike & right).sum()))
        return {"config": np.arange(len(grid))} | {c: np.array([x[i] for x in counts]) for i, c in enumerate(("exact", "family", "joint"))}

    code = {k: i for i, k in enumerate(TYPES)}
    kind_of = np.array([code["dig"] if k in FAMILY else code[k] for k in TYPES])
    sums = per_groups(rows, ["rally_id"], ["t", "probe_id"], some, "config int, exact long, family long, joint long").groupBy("config").agg(*(F.sum(c).alias(c) for c in ("exact", "family", "joint")))
    configs = contacts.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(grid)], "config int, serve_gate boolean, resync_at int, gap double")
    return sums.join(F.broadcast(configs), "config").select("serve_gate", "resync_at", "gap", "exact", "family", "joint").orderBy(F.desc("exact"), F.desc("family"), F.desc("joint"), F.desc("serve_gate"), "resync_at", "gap")


def take_nearest(pt: np.ndarray, qt: np.ndarray, tol: float) -> np.ndarray:
    """For each prediction in turn the index of the nearest free touch less than `tol` away, or -1."""
    free, took = np.ones(len(qt), bool), np.full(len(pt), -1)
    for i, t in enumerate(pt):
        d = np.where(free, np.abs(qt - t), np.inf)
        if len(d) and d.min() < tol:
            took[i] = d.argmin()
            free[took[i]] = False
    return took


def take_together(pt: np.ndarray, pe: np.ndarray, qt: np.ndarray, qe: np.ndarray, tol: float) -> np.ndarray:
    """`take_nearest` of many rallies, of which the predictions start at `pe` and the touches at `qe`."""
    took = np.full(len(pt), -1)
    if not len(qt) or not len(pt):
        return took
    order = np.argsort(-np.diff(pe), kind="stable")
    first, _, reach = by_length(pe)
    place = qe[:-1][order][:, None] + np.arange(np.diff(qe).max())
    free = place < qe[1:][order][:, None]
    times = qt[np.minimum(place, len(qt) - 1)]
    for i, n in enumerate(reach.tolist()):
        at = first[:n] + i
        d = np.where(free[:n], np.abs(times[:n] - pt[at][:, None]), np.inf)
        j = d.argmin(axis=1)
        met = np.nonzero(d[np.arange(n), j] < tol)[0]
        took[at[met]], free[met, j[met]] = place[met, j[met]], False
    return took


def match_touches(predicted: DataFrame, truth: DataFrame, tol: float = 0.5) -> DataFrame:
    """rally_id, pred_id, true_id: each prediction in time order takes the nearest free touch less than `tol` away; the unmatched have a null."""

    def one(rows: Columns) -> Columns:
        own = rows["own"]
        (pid, pt), (qid, qt) = ((rows["id"][own == k], rows["t"][own == k]) for k in (0, 1))
        took = take_nearest(pt, qt, tol)
        found = [(a, qid[j] if j >= 0 else None) for a, j in zip(pid, took, strict=True)] + [(None, b) for b in np.delete(qid, took[took >= 0])]
        return {"rally_id": np.full(len(found), rows["rally_id"][0]), "pred_id": np.array([a for a, _ in found], object), "true_id": np.array([b for _, b in found], object)}

    both = predicted.select("rally_id", F.lit(0).alias("own"), F.col("pred_id").alias("id"), "t").unionByName(truth.select("rally_id", F.lit(1).alias("own"), F.col("true_id").alias("id"), "t"))
    return per_group(both, ["rally_id"], ["own", "t", "id"], one, "rally_id long, pred_id long, true_id long")


def thin(points: DataFrame, gap: float = 0.45, key: str = "rally_id") -> DataFrame:
    """rally_id (or another `key`), t of the points that are `gap` seconds or more after the last kept one."""

    def one(rows: Columns) -> Columns:
        last, kept = -np.inf, []
        for t in rows["t"].tolist():
            if t - last >= gap:
                kept.append(t)
                last = t
        return {key: rows[key][: len(kept)], "t": np.array(kept)}

    return per_group(points.select(key, "t"), [key], ["t"], one, f"{key} long, t double")


def link_nearest(points: DataFrame, max_gap: float = 0.45, max_speed: float = 900.0, least: int = 5) -> DataFrame:
    """rally_id, track, t, x, y: points joined to the nearest track's end that time and speed allow; short tracks go."""

    def some(rows: Columns, edges: np.ndarray) -> Columns:
        first, _, reach = by_length(edges)
        # the last point of each group's tracks, and how many tracks it has
        ends, made, of = np.zeros((3, len(first), 1)), np.zeros(len(first), int), np.zeros(len(rows["t"]), int)
        ends[0] = -np.inf
        for i, n in enumerate(reach.tolist()):
            at = first[:n] + i
            now = np.stack([rows["t"][at], rows["x"][at], rows["y"][at]])
            dt, d = now[0][:, None] - ends[0, :n], np.hypot(ends[1, :n] - now[1][:, None], ends[2, :n] - now[2][:, None])
            near = np.where((dt > 0) & (dt <= max_gap) & (d <= max_speed * dt), d, np.inf)
            k = near.argmin(axis=1)
            k = np.where(np.isfinite(near[np.arange(n), k]), k, made[:n])
            made[:n] += k == made[:n]
            if k.max() >= ends.shape[2]:
                blank = np.zeros_like(ends)
                blank[0] = -np.inf
                ends = np.concatenate([ends, blank], axis=2)[:, :n]
            ends[:, np.arange(n), k], of[at] = now, k
        keep = long_enough(edges, of, least)
        return {"rally_id": rows["rally_id"][keep], "track": of[keep], "t": rows["t"][keep], "x": rows["x"][keep], "y": rows["y"][keep]}

    return per_groups(points.select("rally_id", "t", "x", "y"), ["rally_id"], ["t", "x", "y"], some, "rally_id long, track long, t double, x double, y double")


def cluster_identities(tracklets: DataFrame, thresh: float = 0.10) -> DataFrame:
    """game_id, tracklet_id, cluster: greedy agglomeration by cosine of group means; tracklets that overlap in time never meet.

    One game is one group: some hundreds of tracklets. Clusters are numbered by their smallest tracklet.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tracklet_id")
        e = np.stack(rows["embedding"].to_numpy()).astype(float)
        e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
        a, b = rows["t0"].to_numpy(), rows["t1"].to_numpy()
        apart = (a[:, None] < b[None] + 0.2) & (a[None] < b[:, None] + 0.2)
        np.fill_diagonal(apart, False)
        sums, of, live = e.copy(), np.arange(len(e)), np.ones(len(e), bool)
        dist = lambda i: 1 - (sums @ sums[i]) / np.maximum(np.linalg.norm(sums, axis=1) * np.linalg.norm(sums[i]), 1e-12)
        order = np.arange(len(e))
        d = np.stack([dist(i) for i in order])
        d[apart | (order[:, None] >= order[None])] = np.inf
        # the nearest one after each, kept up to date: a merge changes few of them
        near = d.argmin(axis=1)
        least = d[order, near]
        while True:
            i = int(least.argmin())
            j = int(near[i])
            if not least[i] < thresh:
                break
            sums[i] += sums[j]
            apart[i] |= apart[j]
            apart[:, i] |= apart[:, j]
            live[j] = False
            of[of == j] = i
            d[j], d[:, j] = np.inf, np.inf
            fresh = np.where(apart[i] | ~live, np.inf, dist(i))
            d[i, i + 1 :], d[:i, i] = fresh[i + 1 :], fresh[:i]
            stale = np.nonzero((near == i) | (near == j) | (d[:, i] <= least) | (order == i) | (order == j))[0]
            near[stale] = d[stale].argmin(axis=1)
            least[stale] = d[stale, near[stale]]
        number = {k: c for c, k in enumerate(dict.fromkeys(of.tolist()))}
        return rows[["game_id", "tracklet_id"]].assign(cluster=[number[k] for k in of.tolist()])

    return tracklets.select("game_id", "tracklet_id", "t0", "t1", "embedding").groupBy("game_id").applyInPandas(one, "game_id long, tracklet_id long, cluster long")
