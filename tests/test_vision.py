"""Ball, camera, appearance and training queries against their SQL, and what SQL can't say against plain Python."""

import math
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from courtlake.plans import league, vision

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(vision.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df, q = vision.queries()[name](spark, DATA), con.sql(vision.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(q.columns)
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([shown(r[q.columns.index(c)]) for c in names]) for r in q.fetchall())
    assert sorted(repr([shown(r[c]) for c in names]) for r in df.collect()) == want and want


def plain_link(points, wait=0.3):
    frames = defaultdict(list)
    for t, x, y in sorted(points):
        frames[t].append((x, y))
    tracks = []
    for t, found in sorted(frames.items()):
        used = set()
        for track in tracks:
            last = track[-1]
            if t - last[0] > wait:
                continue
            dt = t - last[0]
            vx, vy = ((last[k] - track[-2][k]) / (last[0] - track[-2][0] + 1e-6) for k in (1, 2)) if len(track) > 1 else (0.0, 0.0)
            at = (last[1] + vx * dt, last[2] + vy * dt + 450 * dt * dt)
            near = [(math.hypot(p[0] - at[0], p[1] - at[1]), i) for i, p in enumerate(found) if i not in used]
            if near and min(near)[0] < (55 if len(track) > 1 else 90):
                used.add(min(near)[1])
                track.append((t, *found[min(near)[1]]))
        tracks += [[(t, *p)] for i, p in enumerate(found) if i not in used]
    return sorted(sorted(t) for t in tracks if len(t) >= 5)


def test_link_predicted(spark):
    from courtlake.operators.ball import link_predicted

    rng, rows = random.Random(3), []
    for r in range(30):
        for _ in range(3):  # parallel tracks, gaps of 0.3 s and of a frame more, and noise
            t, x, y, vx, vy = rng.randint(0, 4) / 10, rng.randint(0, 600), rng.randint(0, 300), rng.randint(-300, 300), rng.randint(-300, 0)
            for _ in range(rng.randint(3, 14)):
                rows.append((r, round(t, 2), float(round(x)), float(round(y))))
                dt = rng.choice((0.1, 0.1, 0.1, 0.3, 0.35))
                t, x, y, vy = t + dt, x + vx * dt, y + vy * dt + 450 * dt * dt, vy + 900 * dt
        rows += [(r, round(rng.randint(0, 20) / 10, 2), float(rng.randint(0, 600)), float(rng.randint(0, 400))) for _ in range(15)]
    rows += [(99, k / 10, x, 5.0) for k in range(8) for x in (100.0, 140.0)]  # equally far from both
    got = defaultdict(lambda: defaultdict(list))
    for r in link_predicted(spark.createDataFrame(rows, "rally_id long, t double, x double, y double")).collect():
        got[r["rally_id"]][r["track"]].append((r["t"], r["x"], r["y"]))
    want = {r: plain_link([p[1:] for p in rows if p[0] == r]) for r in {p[0] for p in rows}}
    assert {r: sorted(sorted(t) for t in tracks.values()) for r, tracks in got.items()} == {r: w for r, w in want.items() if w}
    assert sum(map(len, want.values())) > 30


def plain_split(track, depth=0):
    if len(track) < 5:
        return []
    p = np.array(track)
    t = p[:, 0] - p[0, 0]
    off = np.hypot(p[:, 1] - np.polyval(np.polyfit(t, p[:, 1], 1), t), p[:, 2] - np.polyval(np.polyfit(t, p[:, 2], 2), t))
    if np.sqrt((off**2).mean()) <= 14:
        return [track]
    if depth == 3:
        return []
    at = max(int(off.argmax()), 1)
    return plain_split(track[:at], depth + 1) + plain_split(track[at:], depth + 1)


def test_verified_tracks(spark):
    from courtlake.operators.ball import verified_tracks

    rng, tracks = random.Random(8), {}
    for k in range(500):
        t, x, y, vx, vy, points = 0.0, 300.0, 300.0, rng.uniform(-400, 400), rng.uniform(-500, 0), []
        for _ in range(rng.choice((3, 4, 5, 8, 20, 40))):
            points.append((round(t, 3), x + rng.gauss(0, 3), y + rng.gauss(0, 3)))
            if rng.random() < 0.08:  # a touch
                vx, vy = rng.uniform(-400, 400), rng.uniform(-500, 0)
            dt = rng.choice((0.033, 0.05, 0.1))
            t, x, y, vy = t + dt, x + vx * dt, y + vy * dt + 450 * dt * dt, vy + 900 * dt
        tracks[k % 40, k] = points
    rows = [(r, k, *p) for (r, k), points in tracks.items() for p in points]
    got = defaultdict(list)
    for r in verified_tracks(spark.createDataFrame(rows, "rally_id long, track long, t double, x double, y double").repartition(5)).collect():
        got[r["rally_id"], r["track"], r["part"]].append((r["t"], r["x"], r["y"]))
    want = sorted((r, k, sorted(part)) for (r, k), points in tracks.items() for part in plain_split(points))
    assert sorted((r, k, sorted(points)) for (r, k, _), points in got.items()) == want
    assert len({(r, k) for r, k, _ in want}) < len(want)


def plain_spots(points):
    if len(points) < 50:
        return []
    p, need, spots = np.array(points), max(12, 0.06 * len(points)), []
    for off in (0.0, 20.0):
        cells = defaultdict(list)
        for x, y in points:
            cells[(x + off) // 40, (y + off) // 40].append((x, y))
        for _, own in sorted(cells.items()):
            if len(own) < need:
                continue
            mid = np.mean(own, axis=0)
            near = p[(np.abs(p - mid) < 30).all(1)]
            if len(near) >= need and (near.std(0) < 4).all() and not any((np.abs(mid - s) < 30).all() for s in spots):
                spots.append(mid)
    return spots


def test_parked_spots(spark):
    from courtlake.operators.ball import drop_parked, parked_spots

    rng, rows = random.Random(6), []
    for g in range(25):
        for _ in range(rng.randint(0, 3)):  # lights, some on a cell's border
            x, y = rng.choice((40.0, 80.0, 43.0, rng.uniform(0, 900))), rng.uniform(0, 500)
            rows += [(g, x + rng.gauss(0, 1), y + rng.gauss(0, 1)) for _ in range(rng.choice((8, 30, 60)))]
        rows += [(g, rng.uniform(0, 1000), rng.uniform(0, 600)) for _ in range(rng.choice((10, 60, 200)))]
    rows += [(77, 40.0 + rng.gauss(0, 1.5), 60.0 + rng.gauss(0, 1.5)) for _ in range(60)]
    df = spark.createDataFrame(rows, "game_id long, x double, y double")
    want = sorted((g, round(float(x), 6), round(float(y), 6)) for g in {r[0] for r in rows} for x, y in plain_spots([r[1:] for r in rows if r[0] == g]))
    spots = parked_spots(df)
    assert sorted((r["game_id"], round(r["x"], 6), round(r["y"], 6)) for r in spots.collect()) == want
    assert len(want) > 10 and sum(g == 77 for g, _, _ in want) == 1
    assert drop_parked(df.where("game_id = 77"), spots).count() == 0


def plain_path(points, t0, t1, spots, axis, fps=30.0):
    n = max(1, int(round((t1 - t0) * fps)))
    p = sorted(q for q in points if t0 <= q[0] <= t1 and q[3] >= 0.25 and not any(abs(s[0] - q[1]) < 30 and abs(s[1] - q[2]) < 30 for s in spots))
    if len(p) < 2:
        return [(960.0, 540.0)[axis - 1]] * n
    v = [q[axis] for q in p]
    if len(v) >= 5:
        pad = [v[0]] * 2 + v + [v[-1]] * 2
        v = [sorted(pad[i : i + 5])[2] for i in range(len(v))]
    xs = np.interp(t0 + np.arange(n) / fps, [q[0] for q in p], v)
    w = max(1, int(round(0.75 * fps)) | 1)
    if n > w:
        pad = [xs[0]] * (w // 2) + list(xs) + [xs[-1]] * (w // 2)
        xs = [sum(pad[i : i + w]) / w for i in range(n)]
    return list(xs)


def test_ball_path(spark):
    from courtlake.operators.ball import ball_path, parked_spots

    rng = random.Random(4)
    points = [(g, round(rng.uniform(0, 60), 3), rng.uniform(0, 1900), rng.uniform(0, 1000), rng.random()) for g in (1, 2) for _ in range(300)]
    points += [(1, round(rng.uniform(0, 60), 3), 43.0, 100.0, 0.9) for _ in range(200)]
    clips = [(1, 1, 0.0, 4.0), (2, 1, 8.5, 12.3), (3, 2, 30.0, 30.4), (4, 2, 90.0, 91.0), (5, 1, 59.0, 75.0), (6, 3, 0.0, 0.5), (7, 2, 3.0, 3.0)]
    df = spark.createDataFrame(points, "game_id long, t double, x double, y double, conf double")
    spots = {g: [(r["x"], r["y"]) for r in parked_spots(df).where(f"game_id = {g}").collect()] for g in (1, 2, 3)}
    assert spots[1]
    got = defaultdict(list)
    for r in ball_path(df, spark.createDataFrame(clips, "clip_id long, game_id long, t0 double, t1 double")).orderBy("clip_id", "frame").collect():
        got[r["clip_id"]].append((r["x"], r["y"]))
    assert sorted(got) == [c[0] for c in clips]
    for k, g, t0, t1 in clips:
        own = [p[1:] for p in points if p[0] == g]
        want = list(zip(*(plain_path(own, t0, t1, spots[g], axis) for axis in (1, 2)), strict=True))
        assert np.allclose(got[k], want), k


def test_suggested_names(spark, monkeypatch):
    from courtlake.operators.people import suggest_names

    unit = lambda c: [c, math.sqrt(1 - c * c), 0.0]
    rows = [(1, 1, None, None, [1.0, 0.0, 0.0]), (2, 2, "Ann", 7, unit(0.82)), (3, 1, "Same game", 8, [1.0, 0.0, 0.0]), (4, 3, "", None, [1.0, 0.0, 0.0]), (5, 4, "Bo", 9, unit(0.83)), (6, 5, "Bo too", 6, unit(0.83)), (7, 6, None, None, None), (8, 7, None, 1, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "identity_id long, game_id long, name string, player_id long, embedding array<double>")
    for block in (2048, 1):
        assert sorted(map(tuple, suggest_names(df, block=block).collect())) == [(1, "Bo", 9, 83), (4, "Same game", 8, 100)]
    assert suggest_names(df.where("identity_id in (1, 2)")).count() == 0  # 0.82 isn't more than 0.82


def test_long_chains_and_cycles_of_merges(spark):
    from courtlake.operators.scope import resolve_merges

    rows = [(k, 1, k, k + 1 if k < 40 else None) for k in range(41)] + [(100 + k, 2, k, 100 + (k + 1) % 3) for k in range(3)] + [(110, 2, 10, 101), (111, 2, 11, 110), (120, 3, 0, 999), (121, 3, 1, 120), (130, 4, 0, 130)]
    got = {(r["game_id"], r["cluster_id"]): r["survivor"] for r in resolve_merges(spark.createDataFrame(rows, "identity_id long, game_id long, cluster_id long, merged_into long")).collect()}
    want = {}
    by = {r[0]: r for r in rows}
    for i, g, c, _ in rows:
        at, seen = by[i], set()
        while at and at[3] is not None and at[0] not in seen:
            seen.add(at[0])
            at = by.get(at[3])
        want[g, c] = at[2] if at else c
    assert got == want and got[1, 0] == 40


def test_exact_stream(spark, tmp_path):
    from courtlake.streaming.traffic import hourly, latest

    views = [[("/a", 1, "10:05"), ("/a", 1, "10:50"), ("/b", 2, "10:59")], [("/a", 2, "11:10"), ("/a", 1, "10:55")], [("/a", 3, "12:30"), ("/b", None, "12:59")], [("/a", 9, "10:01"), ("/a", 3, "12:45")]]
    for k, part in enumerate(views):
        spark.createDataFrame([(p, v, f"2024-01-01 {t}:00") for p, v, t in part], "path string, visitor long, at string").selectExpr("path", "visitor", "cast(at AS timestamp) AS created_at").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    got = None
    for k in range(len(views)):  # one run for each file, the last row of 10:01 comes after its hour has gone
        os.makedirs(tmp_path / "all", exist_ok=True)
        for f in os.listdir(tmp_path / f"in{k}"):
            if f.endswith(".parquet"):
                os.rename(tmp_path / f"in{k}" / f, tmp_path / "all" / f"{k}-{f}")
        stream = spark.readStream.schema("path string, visitor long, created_at timestamp").parquet(str(tmp_path / "all"))
        got = latest(hourly(stream), str(tmp_path / "out"), str(tmp_path / "log"))
    assert sorted((str(r["hour"])[11:16], r["path"], r["views"], r["visitors"]) for r in got.collect()) == [("10:00", "/a", 3, 1), ("10:00", "/b", 1, 1), ("11:00", "/a", 1, 1), ("12:00", "/a", 2, 1), ("12:00", "/b", 1, 0)]


def test_bucketed_grades_need_no_exchange(spark, tmp_path):
    from courtlake.operators.grades import derive_grades
    from courtlake.sources.store import save_bucketed

    t = league.tables(spark, DATA)
    plays = save_bucketed(t["plays"], "plays_by_rally", str(tmp_path / "plays"), "rally_id", ["t", "play_id"], 4)
    rallies = save_bucketed(t["rallies"], "rallies_by_rally", str(tmp_path / "rallies"), "rally_id", [], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graded = derive_grades(plays, rallies, t["identities"])
        plan = graded._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("SortMergeJoin")]
        side = plan[plan.index("plays_by_rally") - 400 : plan.index("plays_by_rally")]
        assert "Window" in above and "Exchange" not in above and "Exchange" not in side
        assert sorted(graded.select("play_id", "grade").collect()) == sorted(league.QUERIES["league_grades"](t).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE plays_by_rally")
        spark.sql("DROP TABLE rallies_by_rally")


def test_training_frames_dont_depend_on_partitions(spark):
    from courtlake.operators.training import training_frames

    rng = random.Random(2)
    arcs = sorted({(g, r, round(300 * r + rng.uniform(0, 60), 3), rng.uniform(0, 1900), rng.uniform(0, 1000)) for g in (1, 2) for r in range(4) for _ in range(80)})
    fired = [(g, r, round(t + rng.choice((0, 0.05, 2.0)), 3)) for g, r, t, *_ in arcs]
    a, f = spark.createDataFrame(arcs, "game_id long, rally_id long, t double, x double, y double"), spark.createDataFrame(fired, "game_id long, rally_id long, t double")
    one, many = (sorted(map(repr, training_frames(a.repartition(n), f.repartition(n)).collect())) for n in (1, 200))
    assert one == many
    rows = training_frames(a, f).collect()
    for g in (1, 2):
        kept, last = [], -math.inf
        for t in sorted(p[2] for p in arcs if p[0] == g):
            if t - last >= 0.45:
                kept.append(last := t)
        assert sorted(r["t"] for r in rows if r["game_id"] == g and r["kind"] == "positive") == kept
        low = [r["t"] for r in rows if r["game_id"] == g and r["kind"] == "negative"]
        assert 0 < len(low) <= int(len(kept) * 0.3) and all(abs(t - s) >= 0.5 for t in low for s in kept[::5])
        verified = {(r, math.floor(t * 10 + 0.5)) for gg, r, t, *_ in arcs if gg == g}
        hard = [t for r in range(4) for t in [t for t in sorted({t for gg, rr, t in fired if gg == g and rr == r}) if (r, math.floor(t * 10 + 0.5)) not in verified][::7]]
        assert [r["t"] for r in sorted(rows, key=lambda r: r["t"]) if r["game_id"] == g and r["kind"] == "hard"] == hard[: max(1, int(len(kept) * 0.4))]
    assert {r["box"] for r in rows if r["kind"] == "positive"} == {26, 40}


def test_contact_scores(spark):
    from courtlake.operators.sequences import find_contacts
    from courtlake.operators.training import contact_f1

    rng, points = random.Random(9), []
    for g in (1, 2):
        for r in range(6):
            x, y, vx = 100.0, 300.0, 300.0
            for k in range(80):
                points.append((g, 10 * g + r, round(k / 20, 2), x, y, round(rng.random(), 2)))
                vx = -vx if rng.random() < 0.1 else vx
                x, y = x + vx / 20, y + rng.uniform(-2, 2)
    truth = [(g, 10 * g + r, round(rng.uniform(0, 4), 2)) for g in (1, 2) for r in range(6) for _ in range(rng.randint(0, 6))]
    rallies = [(g, 10 * g + r, 0.0, 4.0) for g in (1, 2) for r in range(5)]
    schema = "game_id long, rally_id long, t double, x double, y double, conf double"
    ball = spark.createDataFrame(points, schema)
    got = {(r["game_id"], r["threshold"]): r for r in contact_f1(ball, spark.createDataFrame(rallies, "game_id long, rally_id long, start_s double, end_s double"), spark.createDataFrame(truth, "game_id long, rally_id long, t double"), (0.1, 0.4)).collect()}
    assert len(got) == 6
    for c in (0.1, 0.4):
        found = defaultdict(list)
        for r in find_contacts(ball.where(f"conf >= {c}")).collect():
            found[r["game_id"], r["rally_id"]].append(r["t"])
        total = [0, 0, 0]
        for g in (1, 2):
            tp = fp = fn = 0
            for _, r, *_ in [x for x in rallies if x[0] == g]:
                free, pred = sorted(t for gg, rr, t in truth if (gg, rr) == (g, r)), sorted(found[g, r])
                n = len(free)
                for p in pred:
                    near = min(free, key=lambda q: abs(q - p), default=None)
                    if near is not None and abs(near - p) < 0.5:
                        free.remove(near)
                        tp += 1
                fp, fn = fp + len(pred), fn + n
            row = got[g, c]
            own = sum(1 for p in points if p[0] == g and p[5] >= c and p[1] < 10 * g + 5)
            assert (row["tp"], row["fp"], row["fn"]) == (tp, fp - tp, fn - tp) and math.isclose(row["density"], own / 20)
            total = [a + b for a, b in zip(total, (tp, fp - tp, fn - tp), strict=True)]
        assert [got[None, c][k] for k in ("tp", "fp", "fn")] == total and math.isclose(got[None, c]["f1"], 2 * total[0] / (2 * total[0] + total[1] + total[2]))


def test_evaluation(spark):
    from courtlake.operators.evaluation import confusions, funnel, judge_touches, map_rallies

    reviewed = spark.createDataFrame([(1, 10, 0.0, 10.0, 0), (1, 11, 20.0, 30.0, 1), (1, 12, None, None, 2), (1, 13, 90.0, 99.0, -1)], "game_id long, rally_id long, start_s double, end_s double, idx int")
    found = spark.createDataFrame([(1, 50, 1.0, 9.0, 0), (1, 51, 21.0, 40.0, 1), (1, 52, 60.0, 70.0, 2)], "game_id long, found_id long, start_s double, end_s double, idx int")
    mapping = map_rallies(reviewed, found)
    assert {r["rally_id"]: r["found_id"] for r in mapping.collect()} == {10: 50, 11: 51, 12: 52, 13: None}
    truth = spark.createDataFrame([(10, 1, 2.0, "serve", 5), (10, 2, 4.0, "dig", 6), (10, 3, 6.0, None, 6), (11, 4, 22.0, "set", None), (12, 5, 61.0, "attack", 7), (13, 6, 91.0, "serve", 5)], "rally_id long, true_id long, t double, play_type string, cluster_id long")
    pred = spark.createDataFrame([(1, 50, 1, 2.1, "serve", 4), (1, 50, 2, 4.2, "receive", None), (1, 50, 3, 6.1, "set", 6), (1, 51, 4, 22.3, "attack", 6), (1, 51, 5, 25.0, "dig", 6), (1, 52, 6, 61.4, "attack", 8)], "game_id long, found_id long, pred_id long, t double, play string, cluster long")
    judged = judge_touches(pred, truth, mapping, spark.createDataFrame([(1, 4, 5), (1, 5, 5)], "game_id long, cluster_id long, survivor long"))
    for r in funnel(judged, mapping, truth).collect():
        assert (r["labelled"], r["captured"], r["family_ok"], r["joint"], r["matched"], r["fp"], r["fn"]) == (5, 4, 3, 1, 5, 1, 0)
        assert (r["attr_ok"], r["attr_total"], r["attr_none"], r["missed_rallies"], r["missed_touches"]) == (1, 2, 1, 1, 1) and math.isclose(r["precision"], 5 / 6)
    assert {r["play_type"]: (r["touches"], r["exact"], r["confused"]) for r in confusions(judged).collect()} == {"serve": (1, 1, ""), "dig": (1, 0, "receivex1"), "set": (1, 0, "attackx1"), "attack": (1, 1, "")}


def test_bundles_by_name_and_snapshot(spark):
    from courtlake.operators.matching import match_bundles, pending_work
    from courtlake.operators.people import cluster_summary
    from courtlake.operators.scope import leak_counts, scrub

    games = spark.createDataFrame([(1, "CCA One"), (2, "Night 12"), (3, "ab"), (4, "zz")], "game_id long, name string")
    files = spark.createDataFrame([(f,) for f in ("game_bundle_cca-one.zip", "cca-one-more.zip", "big night 12 cut.zip", "xaby.zip", "a.zip")], "file string")
    assert {r["game_id"]: r["file"] for r in match_bundles(games, files).collect()} == {1: "game_bundle_cca-one.zip", 2: "big night 12 cut.zip", 3: "a.zip"}
    tables = {
        "users": spark.createDataFrame([(1, "a@x.org"), (2, None)], "user_id long, email string"), "recaps": spark.createDataFrame([(3, "b@x.org", "bounced b@x.org")], "player_id long, email string, error string"),
        "sessions": spark.createDataFrame([("s",)], "token string"), "auth_tokens": spark.createDataFrame([("t",)], "token string"), "views": spark.createDataFrame([(1,)], "view_id long"), "identities": spark.createDataFrame([(1, [1.0])], "identity_id long, embedding array<double>"),
    }
    assert {r["check"]: r["rows"] for r in leak_counts(tables).collect()} == {"users": 1, "recaps": 1, "sessions": 1, "auth_tokens": 1, "views": 1}
    clean = scrub(tables)
    assert all(r["rows"] == 0 for r in leak_counts(clean).collect()) and clean["recaps"].first()["error"] is None and clean["identities"].columns == ["identity_id"]
    shorts = spark.createDataFrame([(1, 1, "queued"), (2, 1, "done"), (3, 2, "done")], "short_id long, game_id long, status string")
    posts = spark.createDataFrame([(2, "posting"), (3, "posted")], "short_id long, status string")
    assert sorted(map(tuple, pending_work(shorts, posts).collect())) == [(1, 1, 1, True), (2, 0, 0, False)]
    clusters = spark.createDataFrame([(1, t, 0) for t in range(4)], "game_id long, tracklet_id long, cluster long")
    bodies = spark.createDataFrame([(t, 10 - t, [f"{t}{c}" for c in "abc"]) for t in range(4)], "tracklet_id long, n_boxes int, crops array<string>")
    assert tuple(cluster_summary(clusters, bodies).first()) == (1, 0, 34, ["0a", "0b", "1a", "1b", "2a", "2b"])


def test_arcs_are_not_shuffled(spark):
    plan = vision.queries()["verify_arcs"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]
