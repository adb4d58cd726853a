"""The SQL of the league's queries."""

from __future__ import annotations

from courtlake.operators import clips
from courtlake.operators import detections as d
from courtlake.operators import night
from courtlake.operators import stats as s
from courtlake.sources.league import ALL_SQL, SCOPE_SQL

GRADED = SCOPE_SQL + """,
tt AS (SELECT p.*, r.game_id, r.played_on, r.start_s, r.end_s, outcome_type, outcome_cluster, team, player_id, name,
    (outcome_cluster IS NULL OR coalesce(p.cluster_id = outcome_cluster, false)) AS mine, row_number() OVER o AS i, count(*) OVER (PARTITION BY p.rally_id) AS n,
    lead(team) OVER o AS nteam, lead(play_type) OVER o AS ntype
  FROM plays p JOIN rallies r ON r.rally_id = p.rally_id LEFT JOIN identities d ON d.game_id = r.game_id AND d.cluster_id = p.cluster_id WINDOW o AS (PARTITION BY p.rally_id ORDER BY t, play_id)),
k AS (SELECT rally_id, max(i) FILTER (WHERE outcome_type = 'kill' AND play_type = 'attack' AND mine) AS ki, max(i) FILTER (WHERE outcome_type = 'attack_error' AND play_type = 'attack' AND mine) AS ai,
    max(i) FILTER (WHERE outcome_type = 'block' AND play_type = 'attack') AS bi, max(i) FILTER (WHERE outcome_type = 'block' AND play_type = 'block' AND mine) AS si,
    max(i) FILTER (WHERE outcome_type = 'ace' AND play_type = 'receive') AS ri FROM tt GROUP BY 1),
kt AS (SELECT k.*, tt.team AS kteam FROM k LEFT JOIN tt ON tt.rally_id = k.rally_id AND tt.i = k.ki),
g0 AS (SELECT tt.*, ki, ai, bi, si, ri, kteam, coalesce(i = ki - 1, false) AS bk, coalesce(i = ki - 1 AND team <> kteam, false) AS ov, coalesce(outcome_type = 'other_error', false) AND i = n AND mine AS oe FROM tt JOIN kt ON kt.rally_id = tt.rally_id),
graded AS (SELECT rally_id, play_id, t, play_type, cluster_id, game_id, played_on, start_s, end_s, outcome_type, outcome_cluster, team, player_id, name, i, coalesce('pid:' || CAST(player_id AS VARCHAR), 'name:' || name) AS key,
  coalesce(nullif(grade, ''), CASE
    WHEN play_type = 'serve' AND outcome_type = 'ace' AND mine THEN 'ace' WHEN play_type = 'serve' AND outcome_type = 'service_error' AND mine AND i = n THEN 'error'
    WHEN play_type = 'attack' AND i = ki THEN 'kill' WHEN play_type = 'attack' AND i = ai THEN 'error' WHEN play_type = 'attack' AND i = bi THEN 'blocked' WHEN play_type = 'attack' AND ov THEN 'error'
    WHEN play_type = 'block' AND i = si THEN 'stuff' WHEN play_type = 'set' AND bk AND coalesce(team = kteam, true) THEN 'assist' WHEN play_type = 'receive' AND i = ri THEN 'error'
    WHEN play_type IN ('set', 'dig', 'receive') AND (ov OR oe) THEN 'error' WHEN play_type = 'dig' AND i < n AND coalesce(team = nteam, true) THEN 'success'
    WHEN play_type = 'receive' AND ntype = 'set' AND coalesce(team = nteam, true) THEN 'positive' ELSE 'in_play' END) AS grade FROM g0)
"""
_COUNT = ", ".join(f"count(*) FILTER (WHERE kind = 't' AND play_type = '{t}'" + (f" AND grade = '{gr}'" if gr else "") + f") AS \"{c}\"" for c, (t, gr) in s.TOUCH.items())
_COUNT += ", " + ", ".join(f"count(*) FILTER (WHERE kind = 'r' AND play_type = '{o}') AS \"{c}\"" for c, o in s.OUTCOME.items())
_ACTIVE = 'serve + receive + dig + "set" + attack + block + kill + ace + stuff > 0'
EVENTS = GRADED + """,
e AS (SELECT 't' AS kind, played_on, key, name, game_id, cluster_id, play_type, grade FROM graded WHERE name IS NOT NULL
  UNION ALL SELECT 'r', played_on, coalesce('pid:' || CAST(player_id AS VARCHAR), 'name:' || name), name, r.game_id, outcome_cluster, outcome_type, NULL
  FROM rallies r JOIN identities i ON i.game_id = r.game_id AND i.cluster_id = outcome_cluster WHERE outcome_type IS NOT NULL)
"""
_STAT = "arg_min(name, (game_id, cluster_id)) AS name, count(DISTINCT game_id) AS games, " + _COUNT
STATS = EVENTS + f", st AS (SELECT key, {_STAT} FROM e GROUP BY key), stats AS (SELECT * FROM st WHERE {_ACTIVE})"
NIGHT = EVENTS + f""", st AS (SELECT played_on, key, {_STAT} FROM e GROUP BY played_on, key), stats AS (SELECT * FROM st WHERE {_ACTIVE}),
nm AS (SELECT DISTINCT g.played_on, i.name FROM identities i JOIN games g USING (game_id)),
lb AS (SELECT played_on, name, split_part(name, ' ', 1) AS f, regexp_extract(name, '^\\S+\\s+(.)', 1) AS rest FROM nm),
labels AS (SELECT played_on, name, CASE WHEN count(*) OVER (PARTITION BY played_on, f) > 1 AND rest <> '' THEN f || ' ' || upper(rest) || '.' ELSE f END AS label FROM lb),
fl AS (SELECT *, greatest(8, CAST(ceil(0.3::DOUBLE * max(attack) OVER w) AS BIGINT)) AS attack_floor, greatest(8, CAST(ceil(0.3::DOUBLE * max(receive + dig) OVER w) AS BIGINT)) AS defence_floor
  FROM stats WHERE NOT regexp_matches(name, '^P\\d+$') WINDOW w AS (PARTITION BY played_on)),
fs AS (SELECT fl.*, label FROM fl JOIN labels USING (played_on, name))
"""
_JOINED = "CASE WHEN len(l) <= 1 THEN coalesce(l[1], '') ELSE array_to_string(l[:-2], ', ') || ' & ' || l[-1] END"
_AWARDS = " UNION ALL ".join(f"SELECT played_on, '{a}' AS award, label, CASE WHEN {q} THEN CAST({v} AS DOUBLE) END AS value FROM fs" for a, (v, q) in night.LEADERS.items())
LEADERS = NIGHT + f""", aw AS ({_AWARDS}), rk AS (SELECT *, rank() OVER (PARTITION BY played_on, award ORDER BY value DESC) AS r FROM aw WHERE value IS NOT NULL),
lg AS (SELECT played_on, award, max(value) AS value, list(label ORDER BY label) AS l FROM rk WHERE r = 1 GROUP BY 1, 2),
leaders AS (SELECT played_on, award, value, {_JOINED} AS names FROM lg)
"""
_WIN = "CASE WHEN outcome_type IN ('kill', 'ace', 'block') THEN team WHEN outcome_type IS NOT NULL THEN CASE team WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' END END"
WON = f""", won AS (SELECT r.*, i.team, i.player_id, {_WIN} AS winner FROM rallies r LEFT JOIN identities i ON i.game_id = r.game_id AND i.cluster_id = outcome_cluster)
"""
RUNS = WON + """, sv AS (SELECT rally_id, arg_min(cluster_id, (t, play_id)) AS server FROM plays WHERE play_type = 'serve' AND cluster_id IS NOT NULL GROUP BY 1),
rx AS (SELECT w.*, server, i.name AS server_name, coalesce(i.team = winner, false) AS ok FROM won w LEFT JOIN sv USING (rally_id) LEFT JOIN identities i ON i.game_id = w.game_id AND i.cluster_id = server),
ry AS (SELECT *, CASE WHEN ok AND coalesce(lag(ok) OVER o AND lag(server) OVER o = server, false) THEN 0 ELSE 1 END AS new FROM rx WINDOW o AS (PARTITION BY game_id ORDER BY start_s, rally_id)),
rz AS (SELECT *, sum(new) OVER (PARTITION BY game_id ORDER BY start_s, rally_id) AS run FROM ry),
rr AS (SELECT played_on, game_id, run, count(*) AS points, min(server_name) AS name, arg_min(rally_id, (start_s, rally_id)) AS first_rally FROM rz WHERE ok GROUP BY 1, 2, 3),
runs AS (SELECT played_on, game_id, name, points, first_rally FROM (SELECT *, row_number() OVER (PARTITION BY played_on ORDER BY points DESC, game_id, run) AS r FROM rr) WHERE r = 1 AND points >= 3 AND name IS NOT NULL AND NOT regexp_matches(name, '^P\\d+$'))
"""
CHAINS = GRADED + """, gb AS (SELECT *, lag(play_type) OVER o AS bt, lag(name) OVER o AS bname, lag(key) OVER o AS bkey FROM graded WHERE outcome_type = 'kill' AND outcome_cluster IS NOT NULL WINDOW o AS (PARTITION BY rally_id ORDER BY t, play_id)),
fa AS (SELECT * FROM gb WHERE grade = 'assist' QUALIFY row_number() OVER (PARTITION BY rally_id ORDER BY t, play_id) = 1),
conns AS (SELECT fa.played_on, fa.key AS setter, h.name AS hitter, count(*) AS kills FROM fa JOIN identities h ON h.game_id = fa.game_id AND h.cluster_id = fa.outcome_cluster WHERE fa.key IS NOT NULL AND NOT regexp_matches(h.name, '^P\\d+$') GROUP BY 1, 2, 3),
sparks AS (SELECT played_on, bkey AS key, count(*) AS sparks FROM fa WHERE bt IN ('receive', 'dig') AND bname IS NOT NULL AND NOT regexp_matches(bname, '^P\\d+$') GROUP BY 1, 2)
"""
SLOTS = ", slots AS (SELECT game_id, played_on, row_number() OVER (PARTITION BY played_on ORDER BY recorded_at ASC NULLS LAST, game_id) AS slot FROM all_games WHERE played_on IS NOT NULL)\n"
_LABELS_OF_SCOPE = NIGHT.split("nm AS")[1].split("\nfl AS")[0].rstrip(",\n")
LINES = WON + SLOTS + """, sc AS (SELECT game_id, count(*) FILTER (WHERE winner = 'A') AS a, count(*) FILTER (WHERE winner = 'B') AS b, bool_or(winner IS NULL) AS approx FROM won WHERE outcome_type IS NOT NULL GROUP BY 1 HAVING count(winner) > 0),
sd AS (SELECT i.game_id, i.team, array_to_string(list(l.label ORDER BY l.label) FILTER (WHERE NOT regexp_matches(i.name, '^P\\d+$')), ', ') AS roster, count(*) FILTER (WHERE regexp_matches(i.name, '^P\\d+$')) AS unnamed
  FROM identities i JOIN games g USING (game_id) LEFT JOIN labels l ON l.played_on = g.played_on AND l.name = i.name GROUP BY 1, 2),
gl AS (SELECT g.game_id, g.played_on, 'Game ' || CAST(slot AS VARCHAR) AS label, a, b, approx, CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' END AS winner FROM games g JOIN slots USING (game_id) LEFT JOIN sc USING (game_id)),
lines AS (SELECT gl.*, coalesce(roster, CASE WHEN sd.game_id IS NOT NULL THEN '' END) AS roster, unnamed FROM gl LEFT JOIN sd ON sd.game_id = gl.game_id AND sd.team = gl.winner)
"""
LONGEST = """, lr AS (SELECT played_on, rally_id, CAST(floor(end_s - start_s + 0.5::DOUBLE) AS BIGINT) AS seconds, game_id, start_s FROM rallies),
longest AS (SELECT l.played_on, l.rally_id, seconds, (SELECT count(*) FROM plays p WHERE p.rally_id = l.rally_id) AS touches FROM lr l WHERE seconds > 0 QUALIFY row_number() OVER (PARTITION BY played_on ORDER BY seconds DESC, game_id, start_s, rally_id) = 1)
"""


def _shouts() -> str:
    chain = CHAINS[len(GRADED):]
    heads = " UNION ALL ".join(f"SELECT played_on, '{a}' AS award, key, label, CASE WHEN {q} THEN CAST({v} AS DOUBLE) END AS value FROM fs" for a, (v, q) in night.LEADERS.items())
    out = NIGHT + chain + RUNS + """, sp AS (SELECT fs.*, coalesce(sparks, 0) AS sparks FROM fs LEFT JOIN sparks USING (played_on, key)),
hl AS (SELECT played_on, award, key, label FROM (SELECT *, rank() OVER (PARTITION BY played_on, award ORDER BY value DESC) AS r FROM ({heads}) WHERE value IS NOT NULL) WHERE r = 1),
ft AS (SELECT * FROM conns WHERE kills >= 2 QUALIFY row_number() OVER (PARTITION BY played_on, setter ORDER BY kills DESC, hitter) = 1),
targets AS (SELECT h.played_on, l.label, ft.kills FROM (SELECT played_on, min(key) AS key FROM hl WHERE award = 'setter' GROUP BY 1 HAVING count(*) = 1) h JOIN ft ON ft.played_on = h.played_on AND ft.setter = h.key JOIN labels l ON l.played_on = h.played_on AND l.name = ft.hitter),
u0 AS (SELECT played_on, label FROM hl UNION SELECT played_on, label FROM targets UNION SELECT r.played_on, l.label FROM runs r JOIN labels l ON l.played_on = r.played_on AND l.name = r.name)""".replace("{heads}", heads)
    for i, (award, (value, who)) in enumerate(night.SHOUTOUTS.items()):
        out += f""", f{i} AS (SELECT played_on, label, CAST({value} AS DOUBLE) AS v FROM sp WHERE {who} AND NOT EXISTS (SELECT 1 FROM u{i} WHERE u{i}.played_on = sp.played_on AND u{i}.label = sp.label)),
w{i} AS (SELECT DISTINCT played_on, '{award}' AS award, label FROM f{i} QUALIFY v = max(v) OVER (PARTITION BY played_on)), u{i + 1} AS (SELECT * FROM u{i} UNION ALL SELECT played_on, label FROM w{i})"""
    union = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(len(night.SHOUTOUTS)))
    return out + f", sl AS (SELECT played_on, award, list(label ORDER BY label) AS l FROM ({union}) GROUP BY 1, 2), shouts AS (SELECT played_on, award, {_JOINED} AS names FROM sl)"


SHOUTS = _shouts()
BOXES = """, boxes AS (SELECT r.game_id, t.rally_id, tracklet_id, cluster_id, t0 + k / 2 AS t, CAST((p * 7 + 40 * k) % 1800 AS DOUBLE) AS x, CAST((p * 13 + 25 * k) % 900 AS DOUBLE) AS y, 60.0::DOUBLE AS w, CAST(20 + (p + k) % 90 AS DOUBLE) AS h
  FROM tracklets t JOIN all_rallies r USING (rally_id), (SELECT unnest(generate_series(0, 4)) AS k))
"""
BALL = """, ball AS (SELECT r.game_id, p.rally_id, t + k * 0.08::DOUBLE AS t, CASE WHEN play_id % 4 = 0 THEN 1000.0::DOUBLE ELSE x + 30 * least(k, 12 - k) * (play_id % 3 - 1) END AS x, CASE WHEN play_id % 4 = 0 THEN 500.0::DOUBLE ELSE y + 10 * k END AS y, CAST((play_id + k) % 10 AS DOUBLE) / 10 AS conf
  FROM all_plays p JOIN all_rallies r USING (rally_id), (SELECT unnest(generate_series(0, 11)) AS k))
"""
PROBES = ", probes AS (SELECT play_id AS probe_id, rally_id, t, x, y FROM plays)\n"
MISPAIRED = """, bodies AS (SELECT tracklet_id, r.game_id, t.cluster_id AS body FROM tracklets t JOIN all_rallies r USING (rally_id) JOIN all_identities i ON i.game_id = r.game_id AND i.cluster_id = t.cluster_id),
bad AS (SELECT play_id, game_id, cluster_id AS credited, body FROM all_plays JOIN bodies USING (tracklet_id) WHERE NOT deleted AND cluster_id IS NOT NULL AND body <> cluster_id)
"""
RESOLVED = """, walk AS (SELECT identity_id AS id, identity_id AS pos, [identity_id] AS seen FROM all_identities
  UNION ALL SELECT id, merged_into, list_append(seen, merged_into) FROM walk JOIN all_identities i ON i.identity_id = walk.pos WHERE merged_into IS NOT NULL AND NOT list_contains(seen, merged_into)),
ends AS (SELECT id, arg_max(pos, len(seen)) AS pos FROM walk GROUP BY 1),
resolved AS (SELECT i.game_id, i.cluster_id, coalesce(s.cluster_id, i.cluster_id) AS survivor FROM all_identities i JOIN ends ON ends.id = i.identity_id LEFT JOIN all_identities s ON s.identity_id = ends.pos)
"""
PG = ", pg AS (SELECT r.game_id, p.rally_id, play_id, cluster_id, t, tracklet_id FROM plays p JOIN all_rallies r USING (rally_id))\n"
USERS = ", users AS (SELECT player_id, 'u' || CAST(player_id AS VARCHAR) || '@example.org' AS email, min(name) AS name FROM all_identities WHERE player_id IS NOT NULL AND player_id % 2 = 0 GROUP BY 1, 2)\n"
JOBS = ", jobs AS (SELECT view_id AS job_id, visitor AS batch, ['pending', 'staging', 'done', 'failed'][CAST(view_id % 4 + 1 AS INT)] AS status, created_at AS updated_at FROM views)\n"
SPLITS = """, lg AS (SELECT rally_id, start_s + rally_id % 13 AS moment FROM all_rallies WHERE rally_id % 10 = 0),
sf AS (SELECT r.*, CASE WHEN moment >= start_s + 1 AND moment <= end_s - 1 THEN moment END AS cut FROM all_rallies r LEFT JOIN lg USING (rally_id))
"""
NEAR = "FROM probes p JOIN boxes b ON b.rally_id = p.rally_id AND abs(b.t - p.t) <= 0.3::DOUBLE"
_SIDE = lambda x, y: f"CASE WHEN (0.5::DOUBLE - 0.5::DOUBLE) * ({y} / 1080 - 0.2::DOUBLE) - (0.95::DOUBLE - 0.2::DOUBLE) * ({x} / 1920 - 0.5::DOUBLE) > 0 THEN 1 ELSE -1 END"


def _distance(x: str, y: str, a: tuple, b: tuple) -> str:
    (ax, ay), (bx, by) = ((px * d.WIDTH, py * d.HEIGHT) for px, py in (a, b))
    dx, dy = bx - ax, by - ay
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x} - {ax!r}::DOUBLE) * {dx!r}::DOUBLE + ({y} - {ay!r}::DOUBLE) * {dy!r}::DOUBLE) / {dx * dx + dy * dy!r}::DOUBLE))"
    return f"sqrt(pow({x} - ({ax!r}::DOUBLE + {t} * {dx!r}::DOUBLE), 2) + pow({y} - ({ay!r}::DOUBLE + {t} * {dy!r}::DOUBLE), 2))"


def margin_sql(x: str, y: str) -> str:
    edges = list(zip(d.POLYGON, [*d.POLYGON[1:], d.POLYGON[0]]))
    cross = " + ".join(
        f"CASE WHEN ({ay!r}::DOUBLE > {y} / 1080) <> ({by!r}::DOUBLE > {y} / 1080) AND {x} < ({ax!r}::DOUBLE + ({y} / 1080 - {ay!r}::DOUBLE) / {by - ay!r}::DOUBLE * {bx - ax!r}::DOUBLE) * 1920 THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in edges if ay != by
    )
    near = f"least({', '.join(_distance(x, y, a, b) for a, b in edges)})"
    return f"CASE WHEN ({cross}) % 2 = 1 THEN {near} ELSE -{near} END"


_SHEET = " UNION ALL ".join(
    "SELECT played_on, key, '{m}' AS measure, {way} AS way, CASE WHEN {den} > 0 THEN floor(CAST({num} AS DOUBLE) / {den} * {p} + 0.5::DOUBLE) / {p} END AS shown FROM stats".format(m=m, way=way, num=f"({num})".replace("`", '"'), den=den.replace("`", '"'), p=10**digits)
    for m, (num, den, digits, way) in s.SHEET.items()
)
_CHIP = {"attack_error": "atk_err", "service_error": "srv_err", "set_error": "set_err", "dig_kept": "dig_ok", "dig_error": "dig_err", "rec_error": "rec_err"}
_CHIPS = " UNION ALL ".join(f"SELECT key, CAST({i} AS BIGINT) AS place, '{c}' AS stat, \"{_CHIP.get(c, c)}\" AS n, {str(c in clips.FAULTS).lower()} AS fault FROM stats" for i, c in enumerate([*clips.OUTCOME_STATS, *clips.TOUCH_STATS]))
_NUM = ", nr AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY start_s, rally_id) AS num FROM rallies)\n"
_RATE = lambda num, den, name: f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} END AS {name}"

METRICS = BOXES + """, td AS (SELECT game_id, tracklet_id, max(t) - min(t) AS d FROM boxes GROUP BY 1, 2 HAVING count(*) >= 3),
mh AS (SELECT game_id, quantile_cont(h, 0.5) AS m, quantile_cont(h, 0.05) AS p, avg(CASE WHEN h < 45 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS b FROM boxes GROUP BY 1), md AS (SELECT game_id, quantile_cont(d, 0.5) AS d FROM td GROUP BY 1),
metrics AS (SELECT game_id, unnest(['height_median', 'height_p05', 'below_gate', 'duration_median']) AS metric, round(unnest([m, p, b, d]), 6) AS value FROM mh JOIN md USING (game_id))
"""
TEXT = NIGHT + LEADERS[len(NIGHT):] + RUNS + LINES[len(WON):] + LONGEST + """, gt AS (SELECT played_on, label, label || CASE WHEN winner IS NOT NULL THEN ': ' || roster || ' ' || CAST(greatest(a, b) AS VARCHAR) || '-' || CAST(least(a, b) AS VARCHAR) ELSE '' END AS line FROM lines),
gj AS (SELECT played_on, array_to_string(list(line ORDER BY label, line), chr(10)) AS games FROM gt GROUP BY 1),
ld AS (SELECT played_on, award, names || ' ' || CAST(CAST(value AS BIGINT) AS VARCHAR) AS said FROM leaders),
lw AS (SELECT played_on, max('Top scorer: ' || said) FILTER (WHERE award = 'top_scorer') AS a, max('Setter of the night: ' || said) FILTER (WHERE award = 'setter') AS b, max('Aces: ' || said) FILTER (WHERE award = 'aces') AS c, max('Most digs: ' || said) FILTER (WHERE award = 'digs') AS d FROM ld GROUP BY 1)
SELECT gj.played_on, concat_ws(chr(10), strftime(gj.played_on, '%a, %b ') || CAST(day(gj.played_on) AS VARCHAR) || strftime(gj.played_on, ' %Y'), games, a, b, c, d, 'Serving run: ' || r.name || ', ' || CAST(r.points AS VARCHAR) || ' straight',
  'Longest rally: ' || CAST(seconds AS VARCHAR) || 's, ' || CAST(touches AS VARCHAR) || CASE WHEN touches = 1 THEN ' touch' ELSE ' touches' END) AS text
FROM gj LEFT JOIN lw USING (played_on) LEFT JOIN runs r USING (played_on) LEFT JOIN longest USING (played_on)"""
TWINS = USERS + """, nd AS (SELECT player_id, name || ' ' || CAST(player_id AS VARCHAR) AS name FROM users), nx AS (SELECT player_id, (CASE WHEN player_id % 4 = 0 THEN substr(name, 1, 3) || CAST(player_id AS VARCHAR) || 'x' ELSE substr(name, 1, 3) || ' ' || CAST(player_id % 20 AS VARCHAR) END) AS name FROM nd), ne AS (SELECT player_id, lower(name) AS l, regexp_replace(regexp_replace(trim(lower(name)), '\\s+\\d+$', ''), '\\s+', ' ', 'g') AS n FROM nx)
SELECT a.player_id AS a, b.player_id AS b, CASE WHEN a.n = b.n THEN 'same name' ELSE 'similar name' END AS reason FROM ne a JOIN ne b ON a.player_id < b.player_id AND (a.n = b.n OR (abs(length(a.l) - length(b.l)) <= 1 AND levenshtein(a.l, b.l) <= 1))"""
ROSTER = USERS + """, pl AS (SELECT player_id, lower(min(name)) AS n FROM all_identities WHERE player_id IS NOT NULL GROUP BY 1), li AS (SELECT email, player_id FROM users WHERE player_id % 8 = 0), rw AS (SELECT email, lower(name) AS n FROM users WHERE name IS NOT NULL UNION ALL SELECT email, NULL FROM users WHERE name IS NULL),
cd AS (SELECT email, player_id, 1 AS tier FROM li UNION SELECT email, player_id, 2 FROM rw JOIN pl USING (n) UNION SELECT email, player_id, 3 FROM rw JOIN pl ON abs(length(rw.n) - length(pl.n)) <= 1 AND levenshtein(rw.n, pl.n) <= 1
  UNION SELECT email, player_id, 4 FROM rw JOIN pl ON split_part(rw.n, ' ', 1) = split_part(pl.n, ' ', 1)),
bs AS (SELECT email, min(tier) AS tier, count(DISTINCT player_id) AS c, min(player_id) AS p FROM (SELECT * FROM cd QUALIFY tier = min(tier) OVER (PARTITION BY email)) GROUP BY 1),
rs AS (SELECT rw.email, c, p, CASE WHEN tier IS NULL THEN 'none' WHEN c > 1 THEN 'ambiguous' WHEN tier > 1 AND li.email <> rw.email THEN 'claimed' ELSE ['linked', 'exact', 'typo', 'first-name'][tier] END AS reason FROM rw LEFT JOIN bs USING (email) LEFT JOIN li ON c = 1 AND li.player_id = p)
SELECT email, CASE WHEN reason IN ('linked', 'exact', 'typo', 'first-name') THEN p END AS player_id, reason, coalesce(c, 0) AS candidates FROM rs"""

_RECURSIVE = SCOPE_SQL.replace("WITH", "WITH RECURSIVE", 1)
_PAIRS = """, q AS (SELECT play_id AS true_id, p.rally_id, t, play_type, p.cluster_id FROM plays p JOIN all_rallies USING (rally_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY rally_id ORDER BY t, pred_id) AS j FROM (SELECT true_id AS pred_id, rally_id, t + (true_id % 7 - 3) / 4 AS t FROM q WHERE true_id % 6 <> 0)),
w AS (SELECT DISTINCT rally_id, CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pred_id, CAST(NULL AS BIGINT) AS best FROM q
  UNION ALL SELECT rally_id, j, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, pred_id, best FROM (SELECT w.rally_id, p.j, any_value(w.used) AS used, any_value(p.pred_id) AS pred_id, arg_min(q.true_id, (abs(q.t - p.t), q.t, q.true_id)) FILTER (WHERE abs(q.t - p.t) < 0.5::DOUBLE AND NOT list_contains(w.used, q.true_id)) AS best
    FROM w JOIN p ON p.rally_id = w.rally_id AND p.j = w.j + 1 JOIN q ON q.rally_id = w.rally_id GROUP BY 1, 2))
"""
_JUDGED = RESOLVED + """, fr AS (SELECT game_id, rally_id AS found_id, start_s + rally_id % 9 - 4 AS s, end_s + rally_id % 5 - 2 AS e FROM all_rallies WHERE rally_id % 8 <> 0),
ov AS (SELECT r.rally_id, found_id, s, least(end_s, e) - greatest(start_s, s) AS o, end_s - start_s AS l FROM rallies r JOIN fr ON fr.game_id = r.game_id AND s < end_s AND e > start_s),
mp AS (SELECT r.game_id, r.rally_id, b.found_id FROM rallies r LEFT JOIN (SELECT rally_id, arg_max(found_id, (o, -s, -found_id)) AS found_id FROM ov WHERE o > 0 AND o > 0.2::DOUBLE * greatest(l, 0.1::DOUBLE) GROUP BY 1) b USING (rally_id)),
q AS (SELECT found_id AS key, m.game_id, play_id AS id, t, play_type, p.cluster_id FROM plays p JOIN mp m USING (rally_id) WHERE found_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS j FROM (SELECT p.rally_id AS key, r.game_id, play_id AS id, t + (play_id % 7 - 3) / 4 AS t, CASE WHEN play_id % 3 = 0 THEN 'set' ELSE play_type END AS play, CASE WHEN play_id % 4 <> 0 THEN coalesce(survivor, p.cluster_id) END AS named
  FROM plays p JOIN all_rallies r USING (rally_id) LEFT JOIN resolved v ON v.game_id = r.game_id AND v.cluster_id = p.cluster_id WHERE play_id % 6 <> 0 AND p.rally_id IN (SELECT found_id FROM mp))),
w AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS best FROM p
  UNION ALL SELECT key, j, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, id, best FROM (SELECT w.key, p.j, any_value(w.used) AS used, any_value(p.id) AS id, arg_min(q.id, (abs(q.t - p.t), q.t, q.id)) FILTER (WHERE abs(q.t - p.t) < 0.5::DOUBLE AND NOT list_contains(w.used, q.id)) AS best
    FROM w JOIN p ON p.key = w.key AND p.j = w.j + 1 LEFT JOIN q ON q.key = w.key GROUP BY 1, 2)),
judged AS (SELECT coalesce(p.game_id, q.game_id) AS game_id, CASE WHEN q.id IS NULL THEN 1 ELSE 3 END AS hit, p.play, p.named, q.play_type, q.cluster_id AS truly FROM w JOIN p ON p.id = w.id LEFT JOIN q ON q.id = w.best AND q.key = w.key WHERE w.j > 0
  UNION ALL SELECT game_id, 2, NULL, NULL, play_type, cluster_id FROM q WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.key = q.key AND w.best = q.id))
"""
#: Touches typed one after another under each setting: whose ball it is, touches of that side, time of the last attack.
_TYPED = """, cx AS (SELECT p.*, config, serve_gate, resync_at, gap, row_number() OVER o AS i, lead(side) OVER o AS next_side, lag(t) OVER o AS before FROM (SELECT play_id AS probe_id, rally_id, t, {side} AS side, {net} AS net FROM plays) p, configs
  WINDOW o AS (PARTITION BY config, rally_id ORDER BY t, probe_id)),
ty AS (SELECT config, rally_id, i, probe_id, t, side AS own, CAST(1 AS BIGINT) AS touches, CAST(NULL AS DOUBLE) AS attack, CASE WHEN NOT serve_gate OR next_side IS NULL OR next_side <> side THEN 'serve' ELSE 'receive' END AS play FROM cx WHERE i = 1
  UNION ALL SELECT config, rally_id, i, probe_id, t, own, touches, CASE WHEN play = 'attack' THEN t ELSE attack END, play FROM (
    SELECT *, CASE WHEN block THEN 'block' WHEN touches <= 1 THEN CASE WHEN t - attack < 2 THEN 'dig' ELSE 'receive' END WHEN touches = 2 THEN 'set' ELSE 'attack' END AS play FROM (
      SELECT *, CASE WHEN block THEN 0 WHEN side <> held OR (gap > 0 AND t - before > gap) OR (resync_at > 0 AND n >= resync_at) THEN 1 ELSE n + 1 END AS touches FROM (
        SELECT c.*, c.side AS own, ty.own AS held, ty.touches AS n, ty.attack, coalesce(c.t - ty.attack < 0.45::DOUBLE, false) AND c.net < 90 AS block FROM ty JOIN cx c ON c.config = ty.config AND c.rally_id = ty.rally_id AND c.i = ty.i + 1))))
""".replace("{side}", _SIDE("x", "y")).replace("{net}", _distance("x", "y", *d.NET))
_FAMILY = lambda c: f"CASE WHEN {c} IN ('receive', 'dig') THEN 'defense' ELSE {c} END"

_BOTH = "hit = 3 AND play_type IS NOT NULL"
_OK = f"{_BOTH} AND coalesce({_FAMILY('play')}, '') = {_FAMILY('play_type')}"
_COUNTS = {
    "labelled": "hit >= 2 AND play_type IS NOT NULL", "captured": _BOTH, "family_ok": _OK, "joint": f"{_OK} AND (truly IS NULL OR coalesce(named = truly, false))", "matched": "hit = 3", "fp": "hit = 1", "fn": "hit = 2",
    "attr_ok": f"{_BOTH} AND named = truly", "attr_total": f"{_BOTH} AND truly IS NOT NULL AND named IS NOT NULL", "attr_none": f"{_BOTH} AND truly IS NOT NULL AND named IS NULL",
}

SQL = {
    "evaluation_funnel": _RECURSIVE + _JUDGED + f""", sn AS (SELECT game_id, {", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _COUNTS.items())} FROM judged GROUP BY 1),
ms AS (SELECT game_id, count(*) AS missed_rallies, CAST(coalesce(sum((SELECT count(play_type) FROM plays p WHERE p.rally_id = mp.rally_id)), 0) AS BIGINT) AS missed_touches FROM mp WHERE found_id IS NULL GROUP BY 1),
al AS (SELECT coalesce(sn.game_id, ms.game_id) AS game_id, coalesce(labelled, 0) + coalesce(missed_touches, 0) AS labelled, {", ".join(f"coalesce({k}, 0) AS {k}" for k in [*list(_COUNTS)[1:], "missed_rallies", "missed_touches"])} FROM sn FULL JOIN ms ON ms.game_id = sn.game_id)
SELECT game_id, {", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in [*_COUNTS, "missed_rallies", "missed_touches"])}, CASE WHEN sum(matched) + sum(fp) > 0 THEN sum(matched) / (sum(matched) + sum(fp)) END AS precision, CASE WHEN sum(matched) + sum(fn) > 0 THEN sum(matched) / (sum(matched) + sum(fn)) END AS recall FROM al GROUP BY ROLLUP (game_id)""",
    "type_confusions": _RECURSIVE + _JUDGED + """, pr AS (SELECT play_type, play, count(*) AS n FROM judged WHERE hit = 3 AND play_type IS NOT NULL GROUP BY 1, 2),
wr AS (SELECT play_type, string_agg(coalesce(play, '?') || 'x' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, coalesce(play, '?')) AS confused FROM (SELECT * FROM pr WHERE play IS DISTINCT FROM play_type QUALIFY row_number() OVER (PARTITION BY play_type ORDER BY n DESC, coalesce(play, '?')) <= 3) GROUP BY 1)
SELECT play_type, CAST(sum(n) AS BIGINT) AS touches, CAST(coalesce(sum(n) FILTER (WHERE play = play_type), 0) AS BIGINT) AS exact, coalesce(any_value(confused), '') AS confused FROM pr LEFT JOIN wr USING (play_type) GROUP BY 1""",
    "thin_points": _RECURSIVE + BALL + ", k AS (SELECT rally_id, min(t) AS t FROM ball GROUP BY 1 UNION ALL SELECT rally_id, t FROM (SELECT k.rally_id, min(b.t) AS t FROM k JOIN ball b ON b.rally_id = k.rally_id AND b.t - k.t >= 0.45::DOUBLE GROUP BY k.rally_id)) SELECT rally_id, t FROM k",
    "match_touches": _RECURSIVE + _PAIRS + "SELECT rally_id, pred_id, best AS true_id FROM w WHERE j > 0 UNION ALL SELECT q.rally_id, NULL, true_id FROM q WHERE true_id NOT IN (SELECT best FROM w WHERE best IS NOT NULL)",
    "classify_contacts": _RECURSIVE + ", configs AS (SELECT 0 AS config, true AS serve_gate, 0 AS resync_at, 0.0::DOUBLE AS gap)" + _TYPED + "SELECT probe_id, rally_id, t, play FROM ty",
    "sweep_typing": _RECURSIVE + ", configs AS (SELECT row_number() OVER () AS config, * FROM (SELECT unnest([true, false]) AS serve_gate), (SELECT unnest([0, 3, 4]) AS resync_at), (SELECT unnest([0.0::DOUBLE, 2.2, 3.5]) AS gap))" + _TYPED + f"""SELECT any_value(serve_gate) AS serve_gate, any_value(resync_at) AS resync_at, any_value(gap) AS gap, count(*) FILTER (WHERE play = play_type) AS exact, count(*) FILTER (WHERE {_FAMILY('play')} = {_FAMILY('play_type')}) AS family,
  count(*) FILTER (WHERE {_FAMILY('play')} = {_FAMILY('play_type')} AND (cluster_id IS NULL OR probe_id % 4 <> 0)) AS joint FROM ty JOIN plays p ON p.play_id = probe_id JOIN configs USING (config) GROUP BY config""",
    "traffic_stream": "SELECT date_trunc('hour', ts) AS hour, event_type AS path, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1, 2",
    "live_identities": SCOPE_SQL + "SELECT identity_id, game_id, cluster_id, name, player_id, team FROM identities",
    "scoped_touches": SCOPE_SQL + "SELECT game_id, played_on, count(*) AS touches, count(DISTINCT rally_id) AS rallies FROM plays JOIN rallies USING (rally_id) GROUP BY 1, 2",
    "resolve_merges": ALL_SQL.replace("WITH", "WITH RECURSIVE", 1) + RESOLVED + "SELECT * FROM resolved",
    "tracklet_identity": ALL_SQL + "SELECT tracklet_id, t.rally_id, r.game_id, t.cluster_id, CASE WHEN NOT dismissed THEN identity_id END AS identity_id, CASE WHEN NOT dismissed THEN i.name END AS name FROM tracklets t JOIN all_rallies r USING (rally_id) LEFT JOIN all_identities i ON i.game_id = r.game_id AND i.cluster_id = t.cluster_id",
    "mispaired": ALL_SQL + MISPAIRED + "SELECT * FROM bad",
    "review_state": ALL_SQL + MISPAIRED + """, a AS (SELECT game_id, count(*) AS rallies, count(outcome_type) AS scored, count(*) FILTER (WHERE touches_complete) AS complete FROM all_rallies WHERE phase = 'game' GROUP BY 1),
b AS (SELECT game_id, count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE NOT deleted AND corrected) AS corrected, count(*) FILTER (WHERE NOT deleted AND cluster_id IS NULL) AS unattributed, count(*) FILTER (WHERE NOT deleted AND tracklet_id IS NOT NULL) AS linked, count(*) FILTER (WHERE deleted) AS removed FROM all_plays JOIN all_rallies USING (rally_id) GROUP BY 1),
c AS (SELECT game_id, count(*) AS identities, count(name) AS named FROM all_identities GROUP BY 1), m AS (SELECT game_id, count(*) AS mispaired FROM bad GROUP BY 1)
SELECT game_id, coalesce(rallies, 0) AS rallies, coalesce(scored, 0) AS scored, coalesce(complete, 0) AS complete, coalesce(live, 0) AS live, coalesce(corrected, 0) AS corrected, coalesce(unattributed, 0) AS unattributed, coalesce(linked, 0) AS linked, coalesce(removed, 0) AS removed, coalesce(identities, 0) AS identities, coalesce(named, 0) AS named, coalesce(mispaired, 0) AS mispaired
FROM all_games LEFT JOIN a USING (game_id) LEFT JOIN b USING (game_id) LEFT JOIN c USING (game_id) LEFT JOIN m USING (game_id)""",
    "export_stats": ALL_SQL + """, ch AS (SELECT rally_id, count(*) AS changed FROM all_plays WHERE corrected OR deleted GROUP BY 1),
x AS (SELECT game_id, CAST(sum(coalesce(changed, 0)) AS BIGINT) AS changed, count(outcome_type) AS outcomes, count(*) FILTER (WHERE touches_complete) AS complete FROM all_rallies LEFT JOIN ch USING (rally_id) WHERE phase = 'game' GROUP BY 1)
SELECT x.*, coalesce(named, 0) AS named FROM x LEFT JOIN (SELECT game_id, count(name) AS named FROM all_identities GROUP BY 1) USING (game_id)""",
    "export_corrections": ALL_SQL + """, x AS (SELECT rally_id, count(*) FILTER (WHERE NOT deleted) AS kept, count(*) FILTER (WHERE deleted) AS removed, string_agg(CAST(play_id AS VARCHAR), ',' ORDER BY t, play_id) FILTER (WHERE NOT deleted) AS ids FROM all_plays GROUP BY 1)
SELECT game_id, rally_id, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(ids, '') AS ids FROM all_rallies LEFT JOIN x USING (rally_id) WHERE phase = 'game'""",
    "resequence": ALL_SQL + SLOTS + "SELECT * FROM slots",
    "backfill_players": ALL_SQL + ", l AS (SELECT * FROM all_identities WHERE name IS NOT NULL AND NOT dismissed AND merged_into IS NULL), kn AS (SELECT name, min(player_id) AS known FROM l WHERE player_id IS NOT NULL GROUP BY 1) SELECT identity_id, l.name, known AS player_id, known IS NULL AS is_new FROM l LEFT JOIN kn ON kn.name = l.name WHERE player_id IS NULL",
    "game_names": ALL_SQL + SLOTS + """, x AS (SELECT g.*, slot, strftime(g.played_on, '%a, %b ') || CAST(day(g.played_on) AS VARCHAR) || strftime(g.played_on, ' %Y') AS dl, CAST(g.played_on AS VARCHAR) AS iso, CASE WHEN slot > 0 THEN 'Game ' || CAST(slot AS VARCHAR) END AS no FROM all_games g LEFT JOIN slots USING (game_id))
SELECT game_id, CASE WHEN label IS NOT NULL THEN label WHEN played_on IS NULL THEN name ELSE concat_ws(' · ', dl, no) END AS display, substr('VB at Night — ' || CASE WHEN label IS NOT NULL THEN concat_ws(' · ', iso, label) WHEN played_on IS NOT NULL THEN concat_ws(' · ', iso, no) ELSE name END, 1, 100) AS title,
CASE WHEN played_on IS NULL THEN 'vban-game-' || CAST(game_id AS VARCHAR) ELSE 'vban-' || iso || CASE WHEN slot > 0 THEN '-g' || CAST(slot AS VARCHAR) ELSE '' END END AS slug FROM x""",
    "league_grades": GRADED + "SELECT play_id, grade FROM graded",
    "league_stats": STATS + " SELECT * FROM stats",
    "night_stats": NIGHT + "SELECT * FROM stats",
    "player_ratios": STATS + f" SELECT key, {_RATE('kill - atk_err - blocked', 'attack', 'attack_efficiency')}, {_RATE('kill', 'attack', 'kill_share')}, {_RATE('ace', 'serve', 'ace_share')}, {_RATE('rec_pos - rec_err', 'receive', 'reception_efficiency')}, {_RATE('dig_ok', 'dig', 'dig_share')}, {_RATE('kill + ace + stuff', 'games', 'points_per_game')} FROM stats".replace("CAST(kill - atk_err - blocked AS", "CAST((kill - atk_err - blocked) AS"),
    "compare_players": NIGHT + f", sh AS ({_SHEET}), bs AS (SELECT *, CASE WHEN way > 0 THEN max(shown) OVER w ELSE min(shown) OVER w END AS best, count(shown) OVER w AS c FROM sh WINDOW w AS (PARTITION BY played_on, measure)) SELECT played_on, measure, key, shown, coalesce(way <> 0 AND c >= 2 AND NOT (best = 0 AND way > 0) AND shown = best, false) AS leads FROM bs",
    "night_labels": NIGHT + "SELECT * FROM labels",
    "night_leaders": LEADERS + "SELECT * FROM leaders",
    "longest_runs": SCOPE_SQL + RUNS + "SELECT * FROM runs",
    "night_connections": CHAINS + "SELECT * FROM conns",
    "night_sparks": CHAINS + "SELECT * FROM sparks",
    "night_favourites": CHAINS + "SELECT * FROM conns WHERE kills >= 2 QUALIFY row_number() OVER (PARTITION BY played_on, setter ORDER BY kills DESC, hitter) = 1",
    "night_shoutouts": SHOUTS + " SELECT * FROM shouts",
    "game_lines": NIGHT + LINES + "SELECT * FROM lines",
    "night_longest_rallies": SCOPE_SQL + LONGEST + "SELECT * FROM longest",
    "night_summary": SHOUTS + LEADERS[len(NIGHT):] + LINES[len(WON):] + LONGEST + ", ng AS (SELECT played_on, count(*) AS games, count(winner) AS decided, coalesce(bool_or(approx), false) AS approx, string_agg(label || ' ' || coalesce(CAST(a AS VARCHAR), '?') || '-' || coalesce(CAST(b AS VARCHAR), '?') || ' ' || coalesce(roster, '?'), '; ' ORDER BY label, a NULLS FIRST, b NULLS FIRST, winner NULLS FIRST, roster NULLS FIRST) AS lines FROM lines GROUP BY 1), nt AS (SELECT played_on, " + ", ".join(f"max(names) FILTER (WHERE award = '{a}') AS {a}" for a in night.LEADERS) + " FROM leaders GROUP BY 1), ns AS (SELECT played_on, string_agg(award || ': ' || names, '; ' ORDER BY list_position([" + ", ".join(f"'{a}'" for a in night.SHOUTOUTS) + "], award)) AS shoutouts FROM shouts GROUP BY 1) SELECT ng.*, nt.* EXCLUDE played_on, t.label AS setter_target, t.kills AS setter_target_kills, r.name AS run_name, r.points AS run_points, rally_id AS longest_rally, seconds AS longest_seconds, touches AS longest_touches, coalesce(shoutouts, '') AS shoutouts FROM ng LEFT JOIN nt USING (played_on) LEFT JOIN targets t USING (played_on) LEFT JOIN runs r USING (played_on) LEFT JOIN longest USING (played_on) LEFT JOIN ns USING (played_on)",
    "find_assists": GRADED + _NUM + ", h AS (SELECT rally_id, count(*) AS matched, min(t) AS cue FROM graded WHERE play_type = 'set' AND grade = 'assist' GROUP BY 1) SELECT game_id, rally_id, num, matched, greatest(0.0::DOUBLE, greatest(start_s - 3, cue - 3)) AS from_s, end_s + 2 AS to_s FROM nr JOIN h USING (rally_id)",
    "find_aces": SCOPE_SQL + _NUM + "SELECT game_id, rally_id, num, CAST(0 AS BIGINT) AS matched, greatest(0.0::DOUBLE, greatest(start_s - 3, end_s - 6)) AS from_s, end_s + 2 AS to_s FROM nr WHERE outcome_type = 'ace'",
    "dig_moments": GRADED + ", h AS (SELECT *, coalesce(play_type = 'dig' AND grade = 'success', false) AS hit FROM graded), j AS (SELECT *, row_number() OVER (PARTITION BY rally_id, hit ORDER BY t, play_id) AS a, row_number() OVER (PARTITION BY rally_id ORDER BY t DESC, play_id DESC) AS z, bool_or(hit) OVER (PARTITION BY rally_id) AS any_hit FROM h) SELECT rally_id, play_id, upper(CASE WHEN grade = 'kill' THEN 'kill' ELSE coalesce(play_type, 'highlight') END) || coalesce(' - ' || name, '') AS caption FROM j WHERE CASE WHEN any_hit THEN hit AND a <= 4 ELSE z = 1 END",
    "moment_windows": GRADED + ", j AS (SELECT *, coalesce(lag(t, 4) OVER o, first_value(t) OVER o) AS f FROM graded WINDOW o AS (PARTITION BY rally_id ORDER BY t, play_id)) SELECT play_id, greatest(f - 1, start_s) AS t0, greatest(least(t + 2.5::DOUBLE, end_s), greatest(f - 1, start_s) + 3) AS t1 FROM j WHERE play_type = 'attack'",
    "player_reel": SCOPE_SQL + WON + ", j AS (SELECT *, row_number() OVER o AS num, count(*) FILTER (WHERE winner = 'A') OVER o AS a, count(*) FILTER (WHERE winner = 'B') OVER o AS b FROM won WINDOW o AS (PARTITION BY game_id ORDER BY start_s, rally_id)) SELECT player_id, rally_id, CASE outcome_type WHEN 'block' THEN 'stuff' ELSE outcome_type END AS key, num, CASE team WHEN 'A' THEN a WHEN 'B' THEN b END AS us, CASE team WHEN 'A' THEN b WHEN 'B' THEN a END AS them FROM j WHERE player_id IS NOT NULL AND outcome_type IN ('kill', 'ace', 'block')",
    "stat_chips": STATS + f" SELECT * FROM ({_CHIPS}) WHERE n > 0",
    "filter_boxes": ALL_SQL + BOXES + f"SELECT game_id, count(*) AS boxes FROM boxes WHERE h >= 45 AND {margin_sql('(x + w / 2)', '(y + h)')} >= -90 GROUP BY 1",
    "tracklet_bounds": ALL_SQL + BOXES + "SELECT tracklet_id, min(t) AS t0, max(t) AS t1, count(*) AS boxes FROM boxes WHERE h >= 45 GROUP BY 1 HAVING count(*) >= 3",
    "gate_phase": ALL_SQL + "SELECT game_id, phase, count(*) AS rallies FROM (SELECT game_id, CASE WHEN start_s < min(start_s) OVER (PARTITION BY game_id) + 9000 THEN 'warmup' ELSE phase END AS phase FROM all_rallies) GROUP BY 1, 2",
    "court_sides": SCOPE_SQL + PROBES + f"SELECT probe_id, CAST({_SIDE('x', 'y')} AS BIGINT) AS side, round({_distance('x', 'y', *d.NET)}, 3) AS net FROM probes",
    "confident_points": ALL_SQL + BALL + "SELECT rally_id, count(*) AS points FROM ball WHERE conf >= 0.4::DOUBLE GROUP BY 1",
    "reject_wristless": SCOPE_SQL + PROBES + "SELECT probe_id FROM probes WHERE probe_id % 5 = 0 OR (probe_id % 5 > 1 AND probe_id % 300 <= 180)",
    "attribute_by_wrist": SCOPE_SQL + PROBES + "SELECT probe_id, CASE WHEN probe_id % 300 < 140 THEN probe_id % 11 + 1 END AS cluster, CAST(probe_id % 300 AS DOUBLE) AS dist_px FROM probes WHERE probe_id % 5 > 1 AND probe_id % 300 <= 260",
    "boxes_at": SCOPE_SQL + BOXES + PROBES + f"SELECT probe_id, tracklet_id, arg_min(b.t, (abs(b.t - p.t), b.t)) AS box_t {NEAR} GROUP BY 1, 2",
    "attribute": SCOPE_SQL + BOXES + PROBES + f", c AS (SELECT probe_id, tracklet_id, cluster_id, b.t AS bt, sqrt(pow(b.x + w / 2 - p.x, 2) + pow((b.y + h * 0.35::DOUBLE - p.y) * 0.25::DOUBLE, 2)) AS dd, {_SIDE('(b.x + w / 2)', '(b.y + h)')} AS side {NEAR}), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY dd, tracklet_id, bt) = 1) SELECT probe_id, tracklet_id, CASE WHEN dd < 300 THEN cluster_id END AS cluster, round(dd, 1) AS dist_px, CAST(side AS BIGINT) AS side FROM f WHERE dd <= 600",
    "relink_tracklets": SCOPE_SQL + MISPAIRED + BOXES + PROBES + f", q AS (SELECT bad.play_id AS probe_id, credited FROM bad JOIN probes ON probe_id = bad.play_id), c AS (SELECT p.probe_id, tracklet_id, b.t AS bt, sqrt(pow(b.x + w / 2 - p.x, 2) + pow((b.y + h * 0.35::DOUBLE - p.y) * 0.6::DOUBLE, 2)) AS dd {NEAR} JOIN q ON q.probe_id = p.probe_id AND b.cluster_id = credited), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY dd, tracklet_id, bt) = 1) SELECT q.probe_id, tracklet_id FROM q LEFT JOIN f USING (probe_id)",
    "outside_boxes": SCOPE_SQL + BOXES + PROBES + "SELECT probe_id FROM probes p WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.rally_id = p.rally_id AND abs(round(b.t * 10) - round(p.t * 10)) <= 1 AND p.x BETWEEN b.x - 12 AND b.x + w + 12 AND p.y BETWEEN b.y - 14 AND b.y + h + 8)",
    "wrist_clusters": SCOPE_SQL + BOXES + PROBES + f", c AS (SELECT probe_id, cluster_id, tracklet_id, b.t AS bt, p.x BETWEEN b.x AND b.x + w AND p.y BETWEEN b.y AND b.y + h AS inside, sqrt(pow(b.x + w / 2 - p.x, 2) + pow(b.y + h / 2 - p.y, 2)) AS dd {NEAR}) SELECT probe_id, CASE WHEN count(*) FILTER (WHERE inside) = 1 THEN min(cluster_id) FILTER (WHERE inside) ELSE arg_min(cluster_id, (dd, tracklet_id, bt)) END AS cluster FROM c GROUP BY 1",
    "link_contacts": SCOPE_SQL + PROBES + ", c AS (SELECT *, t + (probe_id % 9 - 4) / 64 AS ct FROM probes) SELECT play_id, arg_min(c.probe_id, (ct, c.probe_id)) AS contact_id FROM plays p JOIN c ON c.rally_id = p.rally_id AND abs(ct - p.t) < 0.05::DOUBLE GROUP BY 1",
    "static_cells": ALL_SQL + BALL + ", c AS (SELECT game_id, rally_id, CAST(floor(x / 40) AS BIGINT) AS cx, CAST(floor(y / 40) AS BIGINT) AS cy, x, y FROM ball), h AS (SELECT game_id, cx, cy FROM (SELECT game_id, rally_id, cx, cy FROM c GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL HAVING count(*) >= 2) SELECT game_id, cx, cy FROM c JOIN h USING (game_id, cx, cy) GROUP BY ALL HAVING stddev_pop(x) < 2.5 AND stddev_pop(y) < 2.5",
    "pick_moving": ALL_SQL + BALL + """, c AS (SELECT rally_id, round(t, 3) AS frame, CAST(floor(x / 40) AS BIGINT) AS cx, CAST(floor(y / 40) AS BIGINT) AS cy, x, y, conf FROM ball), fr AS (SELECT rally_id, count(DISTINCT frame) AS n FROM c GROUP BY 1),
st AS (SELECT rally_id, cx, cy FROM c JOIN fr USING (rally_id) GROUP BY rally_id, cx, cy, n HAVING count(DISTINCT frame) > 0.3::DOUBLE * n)
SELECT rally_id, frame AS t, x, y, conf FROM c WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.rally_id = c.rally_id AND abs(st.cx - c.cx) <= 1 AND abs(st.cy - c.cy) <= 1) QUALIFY row_number() OVER (PARTITION BY rally_id, frame ORDER BY conf DESC, x, y) = 1""",
    "camera_metrics": ALL_SQL + METRICS + "SELECT * FROM metrics",
    "compare_cameras": ALL_SQL + METRICS + "SELECT m.game_id, metric, m.value, r.value AS ref, CASE WHEN r.value <> 0 THEN round(m.value / r.value, 6) END AS ratio FROM metrics m JOIN (SELECT * FROM metrics WHERE game_id = 1) r USING (metric)",
    "night_text": TEXT,
    "duplicate_players": ALL_SQL + TWINS,
    "match_roster": ALL_SQL + ROSTER,
    "action_band": ALL_SQL + BOXES + "SELECT rally_id, round(CASE WHEN count(*) < 20 THEN 540.0::DOUBLE ELSE quantile_cont(y + h / 2, 0.5) END, 4) AS middle, round(CASE WHEN count(*) < 20 THEN 800.0::DOUBLE ELSE quantile_cont(y + h / 2, 0.9) END, 4) AS low FROM boxes GROUP BY 1",
    "player_envelope": ALL_SQL + BOXES + """, sn AS (SELECT rally_id, CAST(floor(t / 0.5::DOUBLE) AS BIGINT) AS frame, min(x) AS l, max(x + w) AS r FROM boxes GROUP BY 1, 2), gr AS (SELECT rally_id, unnest(generate_series(min(frame), max(frame))) AS frame FROM sn GROUP BY 1)
SELECT rally_id, frame, last_value(l IGNORE NULLS) OVER o - 90 AS "left", last_value(r IGNORE NULLS) OVER o + 90 AS "right" FROM gr LEFT JOIN sn USING (rally_id, frame) WINDOW o AS (PARTITION BY rally_id ORDER BY frame)""",
    "apply_merges": SCOPE_SQL.replace("WITH", "WITH RECURSIVE", 1) + RESOLVED + PG + "SELECT play_id, coalesce(survivor, pg.cluster_id) AS cluster_id FROM pg LEFT JOIN resolved r ON r.game_id = pg.game_id AND r.cluster_id = pg.cluster_id",
    "apply_dismissals": SCOPE_SQL + PG + "SELECT pg.game_id, pg.cluster_id, count(*) AS plays, min(play_id) AS first_play FROM pg JOIN all_identities i ON i.game_id = pg.game_id AND i.cluster_id = pg.cluster_id WHERE dismissed GROUP BY 1, 2",
    "undo_dismissals": SCOPE_SQL + PG + "SELECT play_id, cluster_id FROM pg",
    "apply_reassign": SCOPE_SQL + PG + ", tg AS (SELECT t.*, r.game_id FROM tracklets t JOIN all_rallies r USING (rally_id)), tm AS (SELECT game_id, max(cluster_id) AS top FROM tg GROUP BY 1), nw AS (SELECT tracklet_id, top + row_number() OVER (PARTITION BY game_id ORDER BY tracklet_id) AS new FROM tg JOIN tm USING (game_id) WHERE tracklet_id % 40 = 3) SELECT play_id, coalesce(new, cluster_id) AS cluster_id FROM pg LEFT JOIN nw USING (tracklet_id)",
    "apply_splits": ALL_SQL + SPLITS + "SELECT rally_id, CAST(2 AS BIGINT) AS half, coalesce(cut, start_s) AS start_s, end_s, outcome_type, outcome_cluster FROM sf UNION ALL SELECT rally_id, 1, start_s, cut, NULL, NULL FROM sf WHERE cut IS NOT NULL",
    "split_touches": ALL_SQL + SPLITS + "SELECT play_id, CAST(CASE WHEN cut IS NULL OR t >= cut THEN 2 ELSE 1 END AS BIGINT) AS half FROM all_plays JOIN sf USING (rally_id)",
    "player_changes": ALL_SQL + ", m AS (SELECT identity_id, CASE WHEN player_id % 10 = 1 THEN player_id + 1 ELSE player_id END AS player_id, name FROM all_identities) SELECT identity_id, player_id, CASE WHEN player_id % 10 = 2 AND EXISTS (SELECT 1 FROM all_identities a WHERE a.player_id = m.player_id) THEN 'Renamed ' || CAST(player_id AS VARCHAR) ELSE name END AS name FROM m",
    "roster_links": ALL_SQL + USERS + ", l AS (SELECT 'u' || CAST(player_id AS VARCHAR) || '@example.org' AS email, player_id, min(name) AS name FROM all_identities WHERE player_id % 3 = 1 GROUP BY 1, 2) SELECT coalesce(u.email, l.email) AS email, coalesce(l.player_id, u.player_id) AS player_id, CASE WHEN coalesce(u.name, '') = '' THEN l.name ELSE u.name END AS name FROM users u FULL JOIN l ON l.email = u.email",
    "delete_games": ALL_SQL + "SELECT game_id, played_on, row_number() OVER (PARTITION BY played_on ORDER BY recorded_at ASC NULLS LAST, game_id) AS slot FROM all_games WHERE played_on IS NOT NULL AND game_id % 4 <> 1",
    "recipients": SCOPE_SQL + USERS + ", tc AS (SELECT played_on, player_id, count(*) AS touches FROM plays p JOIN rallies r USING (rally_id) JOIN identities i ON i.game_id = r.game_id AND i.cluster_id = p.cluster_id WHERE player_id IS NOT NULL GROUP BY 1, 2) SELECT played_on, player_id, email, touches, player_id % 7 = 0 AS sent FROM tc JOIN users USING (player_id)",
    "reap_stale": ALL_SQL + JOBS + "SELECT CASE WHEN status = 'staging' AND updated_at < TIMESTAMP '2024-01-02 23:57:00' THEN 'failed' ELSE status END AS status, count(*) AS jobs FROM jobs GROUP BY 1",
    "queue_rollup": ALL_SQL + JOBS + "SELECT batch, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, bool_or(status = 'pending') AS open FROM jobs GROUP BY 1",
    "map_rallies": SCOPE_SQL + ", f AS (SELECT game_id, rally_id AS found_id, start_s + rally_id % 9 - 4 AS s, end_s + rally_id % 5 - 2 AS e FROM all_rallies WHERE rally_id % 8 <> 0), o AS (SELECT r.rally_id, found_id, s, least(end_s, e) - greatest(start_s, s) AS o, end_s - start_s AS l FROM rallies r JOIN f ON f.game_id = r.game_id AND s < end_s AND e > start_s), b AS (SELECT rally_id, arg_max(found_id, (o, -s, -found_id)) AS found_id FROM o WHERE o > 0 AND o > 0.2::DOUBLE * greatest(l, 0.1::DOUBLE) GROUP BY 1) SELECT game_id, rally_id, found_id FROM rallies LEFT JOIN b USING (rally_id)",
    "local_days": ALL_SQL + "SELECT CAST(created_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS day, count(*) AS views, count(DISTINCT visitor) AS visitors FROM views GROUP BY 1 ORDER BY 1 DESC LIMIT 90",
    "hour_labels": ALL_SQL + "SELECT CAST(CASE WHEN hour(created_at) % 12 = 0 THEN 12 ELSE hour(created_at) % 12 END AS VARCHAR) || CASE WHEN hour(created_at) < 12 THEN ' AM' ELSE ' PM' END AS hour, count(*) AS views FROM views GROUP BY 1",
    "top_referrers": ALL_SQL + "SELECT referrer, count(*) AS views FROM views WHERE referrer IS NOT NULL GROUP BY 1 ORDER BY views DESC, referrer LIMIT 10",
    "traffic_total": ALL_SQL + "SELECT count(*) AS views, count(DISTINCT visitor) AS visitors FROM views",
    "visitor_hashes": ALL_SQL + "SELECT view_id, substr(sha256('salt' || CAST(CAST(created_at AS DATE) AS VARCHAR) || '10.0.0.' || CAST(visitor AS VARCHAR)), 1, 12) AS hash FROM views",
    "norm_names": SCOPE_SQL + "SELECT identity_id, lower(name) AS norm, split_part(name, ' ', 1) AS first, lower(split_part(name, ' ', 1)) || '-' || CAST(identity_id AS VARCHAR) AS slug, identity_id AS parsed, 'KILL - ' || split_part(name, ' ', 1) AS caption FROM identities",
    "outcome_tones": SCOPE_SQL + "SELECT CASE WHEN outcome_type IN ('kill', 'ace', 'block') THEN 'good' WHEN outcome_type IS NOT NULL THEN 'bad' END AS tone, count(*) AS rallies FROM rallies GROUP BY 1",
    "participants_by_night": SCOPE_SQL + "SELECT played_on, count(DISTINCT i.name) AS players FROM plays p JOIN rallies r USING (rally_id) JOIN identities i ON i.game_id = r.game_id AND i.cluster_id = p.cluster_id GROUP BY 1",
}
