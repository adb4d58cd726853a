"""Match tables as projections of the star-schema test tables, and the same projections in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.sources.store import save_bucketed, shared_path

#: Play types in the order of the six-way adapter, and outcomes by order priority.
PLAY_TYPES = ["serve", "receive", "set", "attack", "block", "dig"]
OUTCOMES = {"1-URGENT": "kill", "2-HIGH": "ace", "3-MEDIUM": "block", "4-NOT SPECIFIED": "attack_error", "5-LOW": "service_error"}
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def tables(spark: SparkSession, sf_dir: str, stored: bool = False) -> dict[str, DataFrame]:
    """games, rallies, plays, identities and players. Only columns that are used reach the scans.

    With `stored` the numbered plays are written once, bucketed by rally, for queries that read them several times.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # merged, not broadcast: the planner's sizes are those of files, and plans shouldn't change with them
    orders = read("orders").where("o_orderstatus <> 'P'").hint("merge")
    lines = read("lineitem").hint("merge")
    # numbered before anything is made of the columns, so that all who read plays share one exchange
    numbered = lines.withColumn("play_id", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).cast("long"))
    plays = numbered.select(
        F.col("l_orderkey").alias("rally_id"),
        "play_id",
        F.col("l_linenumber").cast("double").alias("t"),
        F.element_at(F.array(*map(F.lit, PLAY_TYPES)), (F.col("l_partkey") % 6 + 1).cast("int")).alias("play_type"),
        F.col("l_suppkey").alias("cluster_id"),
        F.lit(None).cast("string").alias("grade"),
        (F.col("l_quantity").cast("double") + F.when(F.col("l_suppkey") % 2 == 0, 0.0).otherwise(40.0)).alias("x"),
    )
    if stored:
        name = f"plays_{uuid.uuid4().hex}"
        plays = save_bucketed(plays, name, shared_path(spark, name), "rally_id", ["t", "play_id"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = plays.groupBy("rally_id").agg(F.max_by("cluster_id", "play_id").alias("outcome_cluster"))
    outcome = F.create_map(*(F.lit(x) for kv in OUTCOMES.items() for x in kv))
    rallies = orders.select(
        F.col("o_orderkey").alias("rally_id"), F.col("o_custkey").alias("game_id"), F.to_date("o_orderdate").alias("played_on"), outcome[F.col("o_orderpriority")].alias("outcome_type"),
        (F.floor("o_totalprice").cast("long") % 40).cast("double").alias("duration"),
    ).join(last, "rally_id", "left")
    s = read("supplier")
    people = s.select(
        F.col("s_suppkey").alias("cluster_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 10 == 0, None).when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("team"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("player_id"),
    )
    seen = plays.join(rallies.select("rally_id", "game_id"), "rally_id").select("game_id", "cluster_id").distinct()
    games = rallies.groupBy("game_id").agg(F.min("played_on").alias("played_on"))
    return {"games": games, "rallies": rallies, "plays": plays, "identities": seen.join(people, "cluster_id"), "players": people.where("player_id is not null").select("player_id")}


SQL = """
WITH plays AS (
  SELECT l_orderkey AS rally_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS play_id,
    CAST(l_linenumber AS DOUBLE) AS t, ['serve','receive','set','attack','block','dig'][CAST(l_partkey % 6 + 1 AS INT)] AS play_type, l_suppkey AS cluster_id,
    CAST(l_quantity AS DOUBLE) + CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 40 END AS x
  FROM lineitem),
lastc AS (SELECT rally_id, arg_max(cluster_id, play_id) AS outcome_cluster FROM plays GROUP BY 1),
rallies AS (
  SELECT o_orderkey AS rally_id, o_custkey AS game_id, CAST(o_orderdate AS DATE) AS played_on,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'kill' WHEN '2-HIGH' THEN 'ace' WHEN '3-MEDIUM' THEN 'block' WHEN '4-NOT SPECIFIED' THEN 'attack_error' WHEN '5-LOW' THEN 'service_error' END AS outcome_type,
    outcome_cluster, CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 AS DOUBLE) AS duration
  FROM orders LEFT JOIN lastc ON rally_id = o_orderkey WHERE o_orderstatus <> 'P'),
people AS (
  SELECT s_suppkey AS cluster_id, s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS team,
    CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS player_id FROM supplier),
games AS (SELECT game_id, min(played_on) AS played_on FROM rallies GROUP BY 1),
identities AS (SELECT DISTINCT game_id, cluster_id, name, team, player_id FROM plays JOIN rallies USING (rally_id) JOIN people USING (cluster_id))
"""
