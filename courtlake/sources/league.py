"""A league's tables with all their columns, as projections of the star-schema test tables, and the same in SQL.

Five customers make a game, an order is a rally and a line item a touch. Unlike in `adapters`, games have nights, a
game has twelve clusters of which some are unnamed, dismissed or merged, servers stay for several rallies, and touches
can be deleted, overridden by a reviewer or without a type or player.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
#: Touches of a task. Steps above make up to twelve rows of each, which a task sorts in memory.
TOUCHES = 100_000
FIRST, LAST = ["Ana", "Ben", "Cleo", "Dev", "Elsa", "Finn", "Gus", "Hana"], ["Kim", "Lopez", "Moss", "Novak", "Ortiz"]
_P = "((game_id % 60) * 40 + (game_id * 5 + cluster_id * 7) % 40)"


def touch_tasks(spark: SparkSession, sf_dir: str) -> int:
    """The tasks over which touches are dealt, by their number."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // TOUCHES))


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """games, rallies, plays, identities, tracklets and views as stored, before any scope.

    All but views are joined by sort and merge. The planner takes them for as small as their files' columns are, also where
    each row has become many since, and would send millions of rows through the driver to broadcast them. For the same
    reason touches are dealt over as many tasks as their number asks for, not as the bytes of their exchange do.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem")
    tasks = touch_tasks(spark, sf_dir)
    games = read("customer").where("c_custkey % 5 = 0").selectExpr(
        "c_custkey div 5 AS game_id", "c_name AS name", "c_nationkey <> 3 AS published",
        "if(c_nationkey = 7, null, date_add(DATE'2024-01-01', cast((c_custkey div 5) % 60 AS int))) AS played_on",
        "if(c_nationkey % 4 = 0, null, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(c_custkey div 5 AS int), 0, 0)) AS recorded_at",
        "if(c_nationkey = 11, c_mktsegment, null) AS label",
    )
    rallies = read("orders").selectExpr(
        "o_orderkey AS rally_id", "o_custkey div 5 AS game_id", "if(o_orderstatus = 'P', 'warmup', 'game') AS phase",
        "cast(o_orderkey * 30 AS double) AS start_s", "o_orderkey * 30 + cast(cast(floor(o_totalprice) AS bigint) % 400 AS double) / 10 AS end_s",
        "CASE WHEN o_orderkey % 7 = 0 THEN null WHEN o_orderkey % 11 = 0 THEN 'other_error' WHEN o_orderpriority = '1-URGENT' THEN 'kill' WHEN o_orderpriority = '2-HIGH' THEN 'ace' "
        "WHEN o_orderpriority = '3-MEDIUM' THEN 'block' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'attack_error' ELSE 'service_error' END AS outcome_type",
        "if(o_orderkey % 13 <> 0, o_orderkey % 10 + 1, null) AS outcome_cluster", "o_orderkey % 3 = 0 AS touches_complete",
    )
    numbered = lines.repartition(tasks, "l_orderkey").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).cast("long"))
    kinds = "element_at(array('serve', 'receive', 'set', 'attack', 'block', 'dig'), cast(l_partkey % 6 + 1 AS int))"
    typed = numbered.withColumn("kind", F.expr(f"CASE WHEN n % 3 = 2 AND l_suppkey % 4 < 3 THEN 'set' WHEN n % 3 = 0 AND l_suppkey % 4 < 3 THEN 'attack' ELSE {kinds} END"))
    plays = typed.selectExpr(
        "l_orderkey AS rally_id", "l_orderkey * 100 + n AS play_id", "cast(l_orderkey * 30 + n * 2 AS double) AS t", "if(l_partkey % 37 = 0, null, kind) AS play_type",
        "CASE WHEN l_suppkey % 15 = 0 THEN null WHEN kind = 'serve' THEN (l_orderkey div 4000) % 3 + 1 WHEN kind = 'set' THEN l_orderkey % 10 div 5 * 5 + l_suppkey % 2 + 1 "
        "WHEN kind = 'attack' THEN l_orderkey % 10 + 1 ELSE l_suppkey % 11 + 1 END AS cluster_id",
        "if(l_partkey % 41 = 0, 'in_play', null) AS grade", "l_quantity = 1 AS deleted", "l_tax >= 0.06 AS corrected",
        "if(l_linenumber <= 5, l_orderkey * 10 + l_linenumber, null) AS tracklet_id", "cast(l_partkey * 31 % 1920 AS double) AS x", "cast(l_suppkey * 17 % 1080 AS double) AS y",
    )
    tracklets = lines.where("l_linenumber <= 5").select("l_orderkey", "l_linenumber", "l_partkey").repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).selectExpr(
        "l_orderkey * 10 + l_linenumber AS tracklet_id", "l_orderkey AS rally_id", "(l_orderkey + l_linenumber) % 11 + 1 AS cluster_id",
        "cast(l_orderkey * 30 + l_linenumber * 2 - 1 AS double) AS t0", "l_orderkey * 30 + l_linenumber * 2 + cast(p % 20 AS double) / 10 AS t1", "p",
    )
    clusters = games.select("game_id").withColumn("cluster_id", F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<bigint>")))
    name = f"concat(element_at(array({', '.join(map(repr, FIRST))}), cast({_P} % 8 + 1 AS int)), ' ', element_at(array({', '.join(map(repr, LAST))}), cast({_P} div 8 % 5 + 1 AS int)))"
    identities = clusters.selectExpr(
        "game_id * 100 + cluster_id AS identity_id", "game_id", "cluster_id", f"if(cluster_id = 11, null, {name}) AS name", f"if({_P} % 3 = 0, null, {_P}) AS player_id",
        "CASE WHEN cluster_id <= 5 THEN 'A' WHEN cluster_id <= 10 THEN 'B' END AS team", "(game_id + cluster_id) % 17 = 0 AS dismissed",
        "if((game_id + cluster_id) % 19 IN (0, 1) AND cluster_id > 2, game_id * 100 + cluster_id - 1, null) AS merged_into",
    )
    views = read("events").selectExpr("event_id AS view_id", "event_type AS path", "user_id AS visitor", "if(event_id % 4 = 0, null, concat('ref', user_id % 30)) AS referrer", "ts AS created_at")
    return {k: t.hint("merge") for k, t in {"games": games, "rallies": rallies, "plays": plays, "identities": identities, "tracklets": tracklets}.items()} | {"views": views}


def _names_sql() -> str:
    return f"[{', '.join(map(repr, FIRST))}][CAST({_P} % 8 + 1 AS INT)] || ' ' || [{', '.join(map(repr, LAST))}][CAST({_P} // 8 % 5 + 1 AS INT)]"


ALL_SQL = f"""
WITH all_games AS (SELECT c_custkey // 5 AS game_id, c_name AS name, c_nationkey <> 3 AS published,
    CASE WHEN c_nationkey <> 7 THEN DATE '2024-01-01' + CAST((c_custkey // 5) % 60 AS INT) END AS played_on,
    CASE WHEN c_nationkey % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey // 5 AS INT)) END AS recorded_at,
    CASE WHEN c_nationkey = 11 THEN c_mktsegment END AS label FROM customer WHERE c_custkey % 5 = 0),
all_rallies AS (SELECT o_orderkey AS rally_id, o_custkey // 5 AS game_id, CASE o_orderstatus WHEN 'P' THEN 'warmup' ELSE 'game' END AS phase,
    CAST(o_orderkey * 30 AS DOUBLE) AS start_s, o_orderkey * 30 + CAST(CAST(floor(o_totalprice) AS BIGINT) % 400 AS DOUBLE) / 10 AS end_s,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'other_error' WHEN o_orderpriority = '1-URGENT' THEN 'kill' WHEN o_orderpriority = '2-HIGH' THEN 'ace'
      WHEN o_orderpriority = '3-MEDIUM' THEN 'block' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'attack_error' ELSE 'service_error' END AS outcome_type,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 10 + 1 END AS outcome_cluster, o_orderkey % 3 = 0 AS touches_complete FROM orders),
all_plays AS (SELECT l_orderkey AS rally_id, l_orderkey * 100 + n AS play_id, CAST(l_orderkey * 30 + n * 2 AS DOUBLE) AS t,
    CASE WHEN l_partkey % 37 <> 0 THEN kind END AS play_type,
    CASE WHEN l_suppkey % 15 = 0 THEN NULL WHEN kind = 'serve' THEN (l_orderkey // 4000) % 3 + 1 WHEN kind = 'set' THEN l_orderkey % 10 // 5 * 5 + l_suppkey % 2 + 1
      WHEN kind = 'attack' THEN l_orderkey % 10 + 1 ELSE l_suppkey % 11 + 1 END AS cluster_id,
    CASE WHEN l_partkey % 41 = 0 THEN 'in_play' END AS grade, l_quantity = 1 AS deleted, l_tax >= 0.06::DOUBLE AS corrected,
    CASE WHEN l_linenumber <= 5 THEN l_orderkey * 10 + l_linenumber END AS tracklet_id, CAST(l_partkey * 31 % 1920 AS DOUBLE) AS x, CAST(l_suppkey * 17 % 1080 AS DOUBLE) AS y
  FROM (SELECT *, CASE WHEN n % 3 = 2 AND l_suppkey % 4 < 3 THEN 'set' WHEN n % 3 = 0 AND l_suppkey % 4 < 3 THEN 'attack' ELSE ['serve','receive','set','attack','block','dig'][CAST(l_partkey % 6 + 1 AS INT)] END AS kind
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS n FROM lineitem))),
tracklets AS (SELECT l_orderkey * 10 + l_linenumber AS tracklet_id, l_orderkey AS rally_id, (l_orderkey + l_linenumber) % 11 + 1 AS cluster_id,
    CAST(l_orderkey * 30 + l_linenumber * 2 - 1 AS DOUBLE) AS t0, l_orderkey * 30 + l_linenumber * 2 + CAST(p % 20 AS DOUBLE) / 10 AS t1, p
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2)),
all_identities AS (SELECT game_id * 100 + cluster_id AS identity_id, game_id, cluster_id, CASE WHEN cluster_id <> 11 THEN {_names_sql()} END AS name,
    CASE WHEN {_P} % 3 <> 0 THEN {_P} END AS player_id, CASE WHEN cluster_id <= 5 THEN 'A' WHEN cluster_id <= 10 THEN 'B' END AS team,
    (game_id + cluster_id) % 17 = 0 AS dismissed, CASE WHEN (game_id + cluster_id) % 19 IN (0, 1) AND cluster_id > 2 THEN game_id * 100 + cluster_id - 1 END AS merged_into
  FROM (SELECT game_id, CAST(unnest(generate_series(1, 12)) AS BIGINT) AS cluster_id FROM all_games)),
views AS (SELECT event_id AS view_id, event_type AS path, user_id AS visitor, CASE WHEN event_id % 4 <> 0 THEN 'ref' || CAST(user_id % 30 AS VARCHAR) END AS referrer, ts AS created_at FROM events)
"""

#: The public scope: published games with a night, rallies of the game phase, touches that aren't deleted, live identities.
SCOPE_SQL = ALL_SQL + """,
games AS (SELECT * FROM all_games WHERE published AND played_on IS NOT NULL),
rallies AS (SELECT r.*, g.played_on, end_s - start_s AS duration FROM all_rallies r JOIN games g USING (game_id) WHERE phase = 'game'),
plays AS (SELECT p.* FROM all_plays p WHERE NOT deleted),
identities AS (SELECT game_id, cluster_id, coalesce(name, 'P' || CAST(cluster_id AS VARCHAR)) AS name, player_id, team, identity_id FROM all_identities WHERE NOT dismissed AND merged_into IS NULL)
"""
