"""Match queries list all there is, on tables larger than the reports' old limits."""


def test_leaderboards_list_every_player(spark):
    from courtlake.operators.stats import OUTCOME, TOUCH, leaderboards

    counters = [*TOUCH, *OUTCOME]
    players = [(f"pid:{i:02}", 2, *((i if c in ("kill", "assist") else 0) for c in counters)) for i in range(25)]
    stats = spark.createDataFrame(players, "key string, games long, " + ", ".join(f"`{c}` long" for c in counters))
    got = sorted(map(tuple, leaderboards(stats).collect()))
    by_rank = [(f"pid:{i:02}", i, i / 2) for i in range(24, -1, -1)]
    want = [(b, k, *x) for b, n in (("attackers", 24), ("scorers", 25), ("setters", 24)) for k, x in enumerate(by_rank[:n], 1)]
    assert got == want
    assert sorted(map(tuple, leaderboards(stats, top=3).collect())) == [x for x in want if x[1] <= 3]


def test_traffic_lists_every_page(spark):
    from courtlake.operators.rosters import page_views, referrers

    views = spark.createDataFrame([(f"/{p:02}", v % 3, None if v == 0 else "" if v == 1 else f"r{p:02}") for p in range(14) for v in range(p + 1)], "path string, visitor int, referrer string")
    assert [tuple(r) for r in page_views(views).collect()] == [(f"/{p:02}", p + 1, min(p + 1, 3)) for p in range(13, -1, -1)]
    assert [tuple(r) for r in referrers(views).collect()] == [(f"r{p:02}", p - 1) for p in range(13, 3, -1)]
