"""The league's queries against their SQL, and what SQL can't say against plain Python."""

import json
import os
import random

import duckdb
import pytest

from courtlake.plans import league

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    return league.tables(spark, DATA)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def compare(df, q):
    names = sorted(df.columns)
    assert names == sorted(q.columns)
    shown = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(repr([shown(r[q.columns.index(c)]) for c in names]) for r in q.fetchall())
    assert sorted(repr([shown(r[c]) for c in names]) for r in df.collect()) == want
    return len(want)


@pytest.mark.parametrize("name", sorted(set(league.oracle_sql()) & set(league.QUERIES)))
def test_same_as_sql(stored, con, name):
    assert compare(league.QUERIES[name](stored), con.sql(league.oracle_sql()[name])) > 0


def test_traffic_stream(spark, con):
    assert compare(league.queries()["traffic_stream"](spark, DATA), con.sql(league.oracle_sql()["traffic_stream"])) > 0


def plain_match(pred, true):
    used, out = set(), []
    for i, t in sorted(pred, key=lambda x: (x[1], x[0])):
        near = [(abs(q - t), k, j) for k, (j, q) in enumerate(sorted(true, key=lambda x: (x[1], x[0]))) if j not in used and abs(q - t) < 0.5]
        j = min(near)[2] if near else None
        used.add(j)
        out.append((i, j))
    return out + [(None, j) for j, _ in true if j not in used]


def test_match_touches(spark):
    from courtlake.operators.sequences import match_touches

    rng = random.Random(5)
    pred = [(r, r * 100 + i, rng.randint(0, 60) / 8) for r in range(40) for i in range(rng.randint(0, 9))]
    true = [(r, r * 100 + i, rng.randint(0, 60) / 8) for r in range(40) for i in range(rng.randint(0, 9))]
    got = match_touches(spark.createDataFrame(pred, "rally_id long, pred_id long, t double"), spark.createDataFrame(true, "rally_id long, true_id long, t double")).collect()
    want = [(r, *x) for r in range(40) for x in plain_match([p[1:] for p in pred if p[0] == r], [q[1:] for q in true if q[0] == r])]
    assert sorted(map(repr, ((x.rally_id, x.pred_id, x.true_id) for x in got))) == sorted(map(repr, want))


def test_find_contacts(spark):
    from courtlake.operators.sequences import find_contacts

    # along a line, back at t = 1.0, and up again at t = 2.0
    path = [(1, 7, k / 20, 100 + 20 * k if k <= 20 else 900 - 20 * k, 300.0 if k <= 40 else 300 - 15.0 * (k - 40)) for k in range(60)]
    df = spark.createDataFrame([(g, r, t, float(x), float(y)) for g, r, t, x, y in path], "game_id long, rally_id long, t double, x double, y double")
    got = sorted(r["t"] for r in find_contacts(df).collect())
    assert got and abs(got[0] - 1.0) <= 0.11 and all(b - a >= 0.35 for a, b in zip(got, got[1:]))


def test_play_types():
    from courtlake.operators.sequences import play_types

    far = [500.0] * 4
    assert play_types([1, -1, -1, -1, 1, 1], [0, 1, 2, 3, 4, 6], far + far[:2], True, 0, 0) == ["serve", "receive", "set", "attack", "dig", "set"]
    assert play_types([1, 1, 1], [0, 1, 2], far[:3], True, 0, 0) == ["receive", "set", "attack"]
    assert play_types([1, -1, -1, -1, 1], [0, 1, 2, 3, 3.2], [*far, 10.0], True, 0, 0)[-1] == "block"
    assert play_types([1, 1, 1, 1], [0, 1, 2, 3], far, False, 2, 0) == ["serve", "set", "receive", "set"]


def test_thin_link_path_cluster(spark):
    from courtlake.operators.sequences import cluster_identities, link_nearest, thin

    pts = [(r, k / 10, float(10 * k + 500 * (k % 2)), 5.0, 0.9) for r in (1, 2) for k in range(30)]
    df = spark.createDataFrame(pts, "rally_id long, t double, x double, y double, conf double")
    assert [r["t"] for r in thin(df.where("rally_id = 1")).orderBy("t").collect()] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
    tracks = link_nearest(df).groupBy("rally_id", "track").count().collect()
    assert sorted((r["rally_id"], r["count"]) for r in tracks) == [(1, 15), (1, 15), (2, 15), (2, 15)]
    people = [(1, 1, 0.0, 1.0, [1.0, 0.0]), (1, 2, 2.0, 3.0, [1.0, 0.01]), (1, 3, 2.5, 3.5, [1.0, 0.0]), (1, 4, 9.0, 9.5, [0.0, 1.0])]
    got = {r["tracklet_id"]: r["cluster"] for r in cluster_identities(spark.createDataFrame(people, "game_id long, tracklet_id long, t0 double, t1 double, embedding array<double>")).collect()}
    assert got[1] == got[3] and len({got[1], got[2], got[4]}) == 3


def test_segment(spark):
    from courtlake.operators.detections import audio_peaks, segment

    motion = [("v", s, 1.0 if 5 <= s < 12 or 14 <= s < 20 or s in (40, 41) else 0.0) for s in range(60)]
    audio = [("v", q, 9.0 if q in (30, 31, 40) else 0.1) for q in range(240)]
    got = segment(spark.createDataFrame(motion, "video string, sec long, v double"), spark.createDataFrame(audio, "video string, q long, peak double")).collect()
    # zeros at the ends and means of three seconds: active from second 5 to 19 at the level of 0.35
    assert [(r["start_s"], r["end_s"]) for r in got if r["start_s"] < 30] == [(5, 20)]
    assert got[0]["contacts_per_10s"] > 0
    samples = spark.createDataFrame([("v", i, float(-i % 7)) for i in range(9000)], "video string, i long, v double")
    assert audio_peaks(samples).orderBy("q").count() == 2


def test_bundles(spark, tmp_path):
    from courtlake.sources.bundles import cluster_embeddings, court_for, flatten_bundles, load_pairs, read_bundles, typicality

    doc = {
        "name": "Night one", "recorded_at": "2024-03-01T20:00:00Z", "pipeline": {"vbpipe_version": "1.2", "stages": {"track": {"fps": "15"}}},
        "rallies": [{"start": 1.0, "end": 9.0, "ball": [[1.0, 2.0, 3.0, 0.5]], "contacts": [{"t": 2.0, "x": 1.0, "y": 1.0, "play": "serve", "cluster": 3, "tracklet": 7}]}, {"start": 20.0, "end": 30.0, "phase": "warmup"}],
        "tracklets": [{"id": 7, "rally": 0, "t0": 1.0, "t1": 3.0, "cluster": 3, "crops": list("abcdef"), "emb": [3.0, 4.0], "boxes": [[1.0, 2, 3, 4, 5], [1.5, 2, 3, 4, 5]]}], "clusters": [{"cluster": 3, "size": 1}],
    }
    (tmp_path / "one.json").write_text(json.dumps(doc))
    t = flatten_bundles(read_bundles(spark, str(tmp_path)))
    assert {k: df.count() for k, df in t.items()} == {"games": 1, "rallies": 2, "plays": 1, "identities": 1, "tracklets": 1, "boxes": 2, "ball": 1}
    assert sorted(r["phase"] for r in t["rallies"].collect()) == ["game", "warmup"] and t["games"].first()["stages"] == ["track"]
    assert t["plays"].join(t["tracklets"], ["tracklet_id", "rally_id"]).count() == 1 and t["tracklets"].first()["crops"] == list("abcd")
    emb = cluster_embeddings(t["tracklets"])
    assert emb.first()["embedding"] == [0.6, 0.8] and abs(typicality(t["tracklets"], emb).first()["typicality"] - 1) < 1e-9
    cal = spark.createDataFrame([("_default", [[0.5, 0.25]]), ("x", [[0.1, 0.1]])], "video string, court_poly array<array<double>>")
    assert court_for(t["games"], cal).first()["court"] == [[0.5, 0.25]]
    assert load_pairs(spark.createDataFrame([("a/Night 1.json",)], "file string"), spark.createDataFrame([("b/night-1.json",), ("z.json",)], "file string")).count() == 1


def test_parse_roster(spark):
    from courtlake.operators.matching import parse_roster

    lists = {1: ["Name,Email", '"Smith, Jr.",a@x.org', "Bo,A@x.org", "Cy,none", "", "Di,d@x.org"], 2: ["kim@x.org\tKim Lee", "lo@x.org\tLo"], 3: ["First name,Last name,E-mail", "Ann,Bell,ab@x.org"], 4: ["nothing here"]}
    df = spark.createDataFrame([(i, k, t) for i, ls in lists.items() for k, t in enumerate(ls)], "list_id long, line long, text string")
    got = {(r["list_id"], r["name"], r["email"]) for r in parse_roster(df).where("not skipped").collect()}
    assert got == {(1, "Smith, Jr.", "a@x.org"), (1, "Di", "d@x.org"), (2, "Kim Lee", "kim@x.org"), (2, "Lo", "lo@x.org"), (3, "Ann Bell", "ab@x.org")}


def test_texts(spark):
    from pyspark.sql import functions as F

    from courtlake.functions import names as n

    at = F.lit("2024-03-12 03:30:00").cast("timestamp")
    row = spark.range(1).select(
        n.efficiency_text(F.lit(0.4211)).alias("a"), n.efficiency_text(F.lit(-0.0833)).alias("b"), n.join_names(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("c"), n.join_names(F.array(F.lit("A"))).alias("d"),
        n.player_slug(F.lit("Zoë Q"), F.lit(4)).alias("e"), n.parse_player_slug(F.lit("zoe-4")).alias("f"), n.plural(F.lit(1), "touch", "touches").alias("g"), n.json_array(F.lit("[1,2]"), "bigint").alias("h"), n.json_array(F.lit("{x"), "bigint").alias("i"),
        n.range_start("today", at, "America/New_York").cast("string").alias("j"), n.range_start("week", at, "America/New_York").cast("string").alias("k"), n.range_start("month", at, "America/New_York").cast("string").alias("l"),
        n.norm_name(F.lit("  Julio   M  2 ")).alias("m"), n.file_stem(F.lit("a/b.c.mp4")).alias("o"), n.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("p"),
    ).first()
    assert list(row) == [".421", "-.083", "A, B & C", "A", "zoe-4", 4, "1 touch", [1, 2], [], "2024-03-11 04:00:00", "2024-03-10 05:00:00", "2024-03-01 05:00:00", "julio m", "b.c", 1.0]


def test_ledger_and_reaper(spark, tmp_path):
    from courtlake.streaming.traffic import dedupe, drain, reap

    src = tmp_path / "src"
    jobs = [(1, "staging", "2024-01-01 00:00:00"), (2, "done", "2024-01-01 00:00:10"), (3, "staging", "2024-01-01 00:30:00"), (1, "staging", "2024-01-01 00:00:30")]
    for k, part in enumerate((jobs[:2], jobs[3:], jobs[2:3], [(4, "done", "2024-01-01 01:30:00")])):
        spark.createDataFrame(part, "job_id long, status string, at string").selectExpr("job_id", "status", "cast(at AS timestamp) AS updated_at").coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema("job_id long, status string, updated_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {(r["job_id"], r["status"]) for r in drain(reap(stream()), str(tmp_path / "o1"), str(tmp_path / "c1")).collect()}
    assert {(1, "failed"), (2, "done")} <= got
    assert drain(dedupe(stream(), ["job_id"], "updated_at"), str(tmp_path / "o2"), str(tmp_path / "c2")).count() == 4
