"""All queries of the match-analytics part, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.operators import grades as g
from courtlake.operators import rosters as r
from courtlake.operators import stats as s
from courtlake.sources.adapters import SQL, tables


def _graded(t: dict[str, DataFrame]) -> DataFrame:
    return g.derive_grades(t["plays"], t["rallies"], t["identities"])


def _stats(t: dict[str, DataFrame]) -> DataFrame:
    return s.player_stats(_graded(t), t["rallies"], t["identities"])


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("path"), F.col("user_id").alias("visitor"), F.col("ts").alias("created_at"))


QUERIES = {
    "derive_grades": lambda t: _graded(t).select("rally_id", "play_id", "play_type", "grade"),
    "player_stats": _stats,
    "leaderboards": lambda t: s.leaderboards(_stats(t)),
    "leaderboards_all": lambda t: s.leaderboards(_stats(t)),
    "scores": lambda t: g.scores(t["rallies"], t["identities"]),
    "rally_positions": lambda t: g.rally_positions(t["rallies"], t["identities"]),
    "kill_connections": lambda t: s.kill_connections(_graded(t)),
    "grade_distribution": lambda t: s.grade_distribution(_graded(t)),
    "sessions": lambda t: s.sessions(t["games"]),
    "serving_runs": lambda t: s.serving_runs(t["plays"], g.rally_winners(t["rallies"], t["identities"]), t["identities"]),
    "touch_counts": lambda t: r.touch_counts(t["plays"], t["rallies"]),
    "careers": lambda t: r.careers(t["plays"], t["rallies"], t["identities"]),
    "player_games": lambda t: r.player_games(t["players"], t["identities"]),
    "participants": lambda t: r.participants(t["plays"], t["rallies"], t["identities"]),
    "game_rosters": lambda t: r.game_rosters(t["identities"]),
    "scope_header": lambda t: r.scope_header(t["rallies"]),
    "team_suggestions": lambda t: r.team_suggestions(t["plays"], t["rallies"]),
    "favourite_hitters": lambda t: r.favourite_hitters(s.kill_connections(_graded(t))),
    "predicted_types": lambda t: r.predicted_types(t["plays"]),
    "type_confusion": lambda t: r.confusion(r.predicted_types(t["plays"])),
    "board_checks": lambda t: r.board_checks(_graded(t), t["rallies"]),
    "highlights": lambda t: r.highlights(t["rallies"], t["plays"]),
    "longest_rallies": lambda t: r.longest_rallies(t["rallies"], t["plays"]),
    "volume_floors": lambda t: r.volume_floors(_stats(t)),
    "find_kills": lambda t: r.named_touches(_graded(t), "attack", "kill"),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["leaderboards_all"](tables(spark, sf_dir))


def queries() -> dict:
    def on_tables(f):
        return lambda spark, sf_dir: f(tables(spark, sf_dir))

    return {k: on_tables(f) for k, f in QUERIES.items()} | {
        "traffic_by_hour": lambda spark, sf_dir: s.traffic_by_hour(_views(spark, sf_dir)),
        "traffic_pages": lambda spark, sf_dir: r.page_views(_views(spark, sf_dir)),
    }


GRADED = SQL + """,
t AS (SELECT p.rally_id, play_id, t, play_type, p.cluster_id, r.game_id, outcome_type, outcome_cluster, team, player_id, name,
    (outcome_cluster IS NULL OR p.cluster_id = outcome_cluster) AS mine,
    row_number() OVER (PARTITION BY p.rally_id ORDER BY t, play_id) AS i, count(*) OVER (PARTITION BY p.rally_id) AS n,
    lead(team) OVER (PARTITION BY p.rally_id ORDER BY t, play_id) AS nteam, lead(play_type) OVER (PARTITION BY p.rally_id ORDER BY t, play_id) AS ntype
  FROM plays p JOIN rallies r USING (rally_id) LEFT JOIN identities d ON d.game_id = r.game_id AND d.cluster_id = p.cluster_id),
k AS (SELECT rally_id, max(CASE WHEN outcome_type = 'kill' AND play_type = 'attack' AND mine THEN i END) AS ki,
    max(CASE WHEN outcome_type = 'attack_error' AND play_type = 'attack' AND mine THEN i END) AS ai,
    max(CASE WHEN outcome_type = 'block' AND play_type = 'attack' THEN i END) AS bi,
    max(CASE WHEN outcome_type = 'block' AND play_type = 'block' AND mine THEN i END) AS si,
    max(CASE WHEN outcome_type = 'ace' AND play_type = 'receive' THEN i END) AS ri FROM t GROUP BY 1),
kt AS (SELECT k.*, t.team AS kteam FROM k LEFT JOIN t ON t.rally_id = k.rally_id AND t.i = k.ki),
graded AS (SELECT t.*, coalesce('pid:' || CAST(player_id AS VARCHAR), 'name:' || name) AS key,
  CASE play_type
    WHEN 'serve' THEN CASE WHEN outcome_type = 'ace' AND mine THEN 'ace' WHEN outcome_type = 'service_error' AND mine AND i = n THEN 'error' ELSE 'in_play' END
    WHEN 'attack' THEN CASE WHEN i = ki THEN 'kill' WHEN i = ai THEN 'error' WHEN i = bi THEN 'blocked' WHEN i = ki - 1 AND team <> kteam THEN 'error' ELSE 'in_play' END
    WHEN 'block' THEN CASE WHEN i = si THEN 'stuff' ELSE 'in_play' END
    WHEN 'set' THEN CASE WHEN i = ki - 1 AND coalesce(team = kteam, true) THEN 'assist' WHEN i = ki - 1 AND team <> kteam THEN 'error' ELSE 'in_play' END
    WHEN 'dig' THEN CASE WHEN i = ki - 1 AND team <> kteam THEN 'error' WHEN i < n AND coalesce(team = nteam, true) THEN 'success' ELSE 'in_play' END
    WHEN 'receive' THEN CASE WHEN i = ri THEN 'error' WHEN i = ki - 1 AND team <> kteam THEN 'error' WHEN ntype = 'set' AND coalesce(team = nteam, true) THEN 'positive' ELSE 'in_play' END
  END AS grade FROM t JOIN kt USING (rally_id))
"""
_TOUCH_SQL = ", ".join(f"count(*) FILTER (WHERE kind = 't' AND play_type = '{t}'" + (f" AND grade = '{gr}'" if gr else "") + f") AS \"{c}\"" for c, (t, gr) in s.TOUCH.items())
_OUT_SQL = ", ".join(f"count(*) FILTER (WHERE kind = 'r' AND play_type = '{o}') AS \"{c}\"" for c, o in s.OUTCOME.items())
STATS = GRADED + f""",
e AS (SELECT 't' AS kind, key, name, game_id, play_type, grade FROM graded WHERE name IS NOT NULL
  UNION ALL SELECT 'r', coalesce('pid:' || CAST(player_id AS VARCHAR), 'name:' || name), name, r.game_id, outcome_type, NULL
  FROM rallies r JOIN identities d ON d.game_id = r.game_id AND d.cluster_id = outcome_cluster WHERE outcome_type IS NOT NULL),
st AS (SELECT key, min(name) AS name, count(DISTINCT game_id) AS games, {_TOUCH_SQL}, {_OUT_SQL} FROM e GROUP BY 1),
stats AS (SELECT * FROM st WHERE serve + receive + dig + "set" + attack + block + kill + ace + stuff > 0)
"""
WON = SQL + """,
w AS (SELECT r.*, CASE WHEN outcome_type IN ('kill', 'ace', 'block') THEN team WHEN outcome_type IS NOT NULL THEN CASE team WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' END END AS winner
  FROM rallies r LEFT JOIN identities d ON d.game_id = r.game_id AND d.cluster_id = outcome_cluster)
"""


COUNTS = SQL + """,
tc AS (SELECT game_id, cluster_id, count(*) AS touches FROM plays JOIN rallies USING (rally_id) WHERE cluster_id IS NOT NULL GROUP BY 1, 2),
pc AS (SELECT game_id, outcome_cluster AS cluster_id, count(*) AS points FROM rallies WHERE outcome_type IN ('kill', 'ace', 'block') AND outcome_cluster IS NOT NULL GROUP BY 1, 2)
"""
PREDICTED = SQL + """,
b AS (SELECT rally_id, play_id, play_type, lag(play_type) OVER (PARTITION BY rally_id ORDER BY t, play_id) AS prev FROM plays),
predicted AS (SELECT rally_id, play_id, play_type, CASE WHEN prev IS NULL THEN 'serve' WHEN prev = 'serve' THEN 'receive' WHEN prev IN ('receive', 'dig') THEN 'set' WHEN prev IN ('attack', 'block') THEN 'dig' ELSE 'attack' END AS predicted FROM b)
"""


def _roster_sql() -> dict:
    return {
        "touch_counts": COUNTS + "SELECT * FROM tc",
        "careers": COUNTS + "SELECT player_id, count(DISTINCT game_id) AS games, CAST(coalesce(sum(touches), 0) AS BIGINT) AS touches, CAST(coalesce(sum(points), 0) AS BIGINT) AS points FROM identities LEFT JOIN tc USING (game_id, cluster_id) LEFT JOIN pc USING (game_id, cluster_id) WHERE player_id IS NOT NULL GROUP BY 1",
        "player_games": SQL + "SELECT p.player_id, count(DISTINCT game_id) AS games FROM people p LEFT JOIN identities i ON i.player_id = p.player_id WHERE p.player_id IS NOT NULL GROUP BY 1",
        "participants": SQL + "SELECT DISTINCT name FROM identities i WHERE name IS NOT NULL AND (EXISTS (SELECT 1 FROM plays JOIN rallies r USING (rally_id) WHERE r.game_id = i.game_id AND cluster_id = i.cluster_id) OR EXISTS (SELECT 1 FROM rallies r WHERE outcome_type IS NOT NULL AND r.game_id = i.game_id AND outcome_cluster = i.cluster_id))",
        "game_rosters": SQL + "SELECT game_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE team = 'A'), '') AS team_a, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE team = 'B'), '') AS team_b, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE team IS NULL), '') AS others FROM identities WHERE name IS NOT NULL GROUP BY 1",
        "scope_header": SQL + "SELECT count(DISTINCT game_id) AS games, count(outcome_type) AS scored FROM rallies",
        "team_suggestions": SQL + """, q AS (SELECT game_id, cluster_id, x FROM plays JOIN rallies USING (rally_id) WHERE x IS NOT NULL AND cluster_id IS NOT NULL),
n AS (SELECT game_id, quantile_cont(x, 0.5) AS net FROM q GROUP BY 1 HAVING count(*) >= 8),
s AS (SELECT game_id, cluster_id, count(*) FILTER (WHERE x < net) AS l, count(*) AS c FROM q JOIN n USING (game_id) GROUP BY 1, 2)
SELECT game_id, cluster_id, CASE WHEN l > c - l THEN 'A' ELSE 'B' END AS team, CAST(floor(greatest(l, c - l) / c * 100 + 0.5) AS BIGINT) AS conf FROM s WHERE c >= 2 AND greatest(l, c - l) / c >= 0.7""",
        "favourite_hitters": GRADED + """, p AS (SELECT rally_id, arg_min(key, play_id) FILTER (WHERE grade = 'assist') AS setter, arg_max(key, play_id) FILTER (WHERE grade = 'kill') AS hitter FROM graded WHERE name IS NOT NULL AND outcome_type = 'kill' GROUP BY 1),
c AS (SELECT setter, hitter, count(*) AS kills FROM p WHERE setter IS NOT NULL AND hitter IS NOT NULL GROUP BY 1, 2)
SELECT * FROM c WHERE kills >= 2 QUALIFY row_number() OVER (PARTITION BY setter ORDER BY kills DESC, hitter) = 1""",
        "predicted_types": PREDICTED + "SELECT * FROM predicted",
        "type_confusion": PREDICTED + """, c AS (SELECT play_type, predicted, count(*) AS n FROM predicted GROUP BY 1, 2),
d AS (SELECT play_type, predicted, n, round(n / sum(n) OVER (PARTITION BY play_type), 6) AS share, CASE WHEN play_type <> predicted THEN row_number() OVER (PARTITION BY play_type, play_type <> predicted ORDER BY n DESC, predicted) END AS rank FROM c)
SELECT * FROM d WHERE rank IS NULL OR rank <= 3""",
        "board_checks": GRADED + """, g AS (SELECT count(*) FILTER (WHERE play_type = 'attack' AND grade = 'kill') AS k, count(*) FILTER (WHERE play_type = 'block' AND grade = 'stuff') AS s, count(*) FILTER (WHERE play_type = 'set' AND grade = 'assist') AS a FROM graded),
o AS (SELECT count(*) FILTER (WHERE outcome_type = 'kill') AS ok, count(*) FILTER (WHERE outcome_type = 'block') AS ob FROM rallies),
z AS (SELECT 'kills' AS check_name, k AS smaller, ok AS larger FROM g, o UNION ALL SELECT 'stuffs', s, ob FROM g, o UNION ALL SELECT 'assists', a, ok FROM g, o)
SELECT *, smaller <= larger AS ok FROM z""",
        "highlights": SQL + """, c AS (SELECT rally_id, count(*) AS touches FROM plays WHERE play_type IS NOT NULL GROUP BY 1),
h AS (SELECT game_id, rally_id, coalesce(touches, 0) AS touches, round(CASE outcome_type WHEN 'kill' THEN 10 WHEN 'block' THEN 9 WHEN 'ace' THEN 7 WHEN 'attack_error' THEN 2 WHEN 'service_error' THEN 0 WHEN 'other_error' THEN 1 ELSE 3 END
  + least(duration, 25.0::DOUBLE) / 5 + least(coalesce(touches, 0), 14) / 3, 2) AS score FROM rallies LEFT JOIN c USING (rally_id) WHERE duration >= 4)
SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY score DESC, rally_id) AS rank, rally_id, score, touches FROM h QUALIFY rank <= 10""",
        "longest_rallies": SQL + """, c AS (SELECT rally_id, count(*) AS touches FROM plays GROUP BY 1)
SELECT played_on, rally_id, CAST(floor(duration + 0.5) AS BIGINT) AS seconds, coalesce(touches, 0) AS touches FROM rallies LEFT JOIN c USING (rally_id) WHERE duration IS NOT NULL QUALIFY row_number() OVER (PARTITION BY played_on ORDER BY duration DESC, rally_id) = 1""",
        "volume_floors": STATS + "SELECT CAST(greatest(8, ceil(0.3::DOUBLE * coalesce(max(attack), 0))) AS BIGINT) AS attack_floor, CAST(greatest(8, ceil(0.3::DOUBLE * coalesce(max(receive + dig), 0))) AS BIGINT) AS defence_floor FROM stats",
        "find_kills": GRADED + "SELECT rally_id, play_id, i AS ordinal, key FROM graded WHERE play_type = 'attack' AND grade = 'kill'",
        "traffic_pages": "SELECT event_type AS path, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1",
    }


def oracle_sql() -> dict:
    boards = {"scorers": "kill + ace + stuff", "attackers": "kill", "blockers": "stuff", "servers": "ace", "setters": "assist", "diggers": "dig_ok", "receivers": "rec_pos"}
    union = " UNION ALL ".join(f"SELECT '{b}' AS board, key, games, {e} AS metric FROM stats" for b, e in boards.items())
    return _roster_sql() | {
        "derive_grades": GRADED + "SELECT rally_id, play_id, play_type, grade FROM graded",
        "player_stats": STATS + "SELECT * FROM stats",
        "leaderboards": STATS + f", b AS ({union}) SELECT board, row_number() OVER (PARTITION BY board ORDER BY metric DESC, key) AS rank, key, metric, round(metric / games, 4) AS per_game FROM b WHERE metric > 0 OR board = 'scorers'",
        "leaderboards_all": STATS + f", b AS ({union}) SELECT board, row_number() OVER (PARTITION BY board ORDER BY metric DESC, key) AS rank, key, metric, round(metric / games, 4) AS per_game FROM b WHERE metric > 0 OR board = 'scorers'",
        "scores": WON + "SELECT game_id, count(*) FILTER (WHERE winner = 'A') AS a, count(*) FILTER (WHERE winner = 'B') AS b, bool_or(winner IS NULL) AS approx FROM w WHERE outcome_type IS NOT NULL GROUP BY 1 HAVING count(winner) > 0",
        "rally_positions": WON + "SELECT game_id, rally_id, row_number() OVER o AS ordinal, count(*) OVER (PARTITION BY game_id) AS total, lag(rally_id) OVER o AS prev_id, lead(rally_id) OVER o AS next_id, CAST(count(*) FILTER (WHERE winner = 'A') OVER o AS BIGINT) AS a, CAST(count(*) FILTER (WHERE winner = 'B') OVER o AS BIGINT) AS b FROM w WINDOW o AS (PARTITION BY game_id ORDER BY played_on, rally_id)",
        "kill_connections": GRADED + ", p AS (SELECT rally_id, arg_min(key, play_id) FILTER (WHERE grade = 'assist') AS setter, arg_max(key, play_id) FILTER (WHERE grade = 'kill') AS hitter FROM graded WHERE name IS NOT NULL AND outcome_type = 'kill' GROUP BY 1) SELECT setter, hitter, count(*) AS kills FROM p WHERE setter IS NOT NULL AND hitter IS NOT NULL GROUP BY 1, 2",
        "grade_distribution": GRADED + "SELECT play_type, grade, count(*) AS touches FROM graded GROUP BY 1, 2",
        "sessions": SQL + "SELECT played_on, count(*) AS games FROM games GROUP BY 1",
        "serving_runs": WON + """, sv AS (SELECT rally_id, arg_min(cluster_id, play_id) AS server FROM plays WHERE play_type = 'serve' GROUP BY 1),
x AS (SELECT w.*, server, coalesce(d.team = winner, false) AS won FROM w LEFT JOIN sv USING (rally_id) LEFT JOIN identities d ON d.game_id = w.game_id AND d.cluster_id = server),
y AS (SELECT *, CASE WHEN won AND coalesce(lag(won) OVER o, false) AND coalesce(lag(server) OVER o = server, false) THEN 0 ELSE 1 END AS new FROM x WINDOW o AS (PARTITION BY game_id ORDER BY played_on, rally_id)),
z AS (SELECT *, sum(new) OVER (PARTITION BY game_id ORDER BY played_on, rally_id) AS run FROM y)
SELECT game_id, min(server) AS server, arg_min(rally_id, (played_on, rally_id)) AS first_rally, count(*) AS points FROM z WHERE won GROUP BY game_id, run HAVING count(*) >= 3""",
        "traffic_by_hour": "SELECT CAST(ts AS DATE) AS day, extract(hour FROM ts) AS hour, event_type AS path, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1, 2, 3",
    }
