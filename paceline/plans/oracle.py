"""DuckDB SQL of the derived tables, as the beginning of a WITH clause that queries continue."""

from __future__ import annotations

GAMES = """
WITH items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
teams AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 <> 0 THEN 'fbs' ELSE 'fcs' END AS division, r_name AS conference,
    CASE WHEN s_suppkey % 17 <> 0 THEN 1500 + s_acctbal / 20 END AS pregame_elo
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
paired AS (SELECT h.l_orderkey AS game_id, h.l_suppkey AS hk, a.l_suppkey AS ak, h.l_quantity::INT AS home_points, a.l_quantity::INT AS away_points,
    h.l_returnflag = 'R' AS neutral_site, o_orderdate AS start_date, least(floor((dayofyear(o_orderdate) - 1) / 7) + 1, 52)::INT AS w
    FROM items h JOIN items a ON h.l_orderkey = a.l_orderkey AND h.rn = 1 AND a.rn = 2 JOIN orders ON o_orderkey = h.l_orderkey
    WHERE h.l_suppkey <> a.l_suppkey AND h.l_quantity <> a.l_quantity),
games AS (SELECT game_id, year(start_date)::INT AS season, (CASE WHEN w <= 48 THEN w ELSE w - 48 END)::INT AS week, (w > 48)::INT AS st_order,
    CASE WHEN w <= 48 THEN 'regular' ELSE 'postseason' END AS season_type, start_date, 'S' || hk AS home_team, 'S' || ak AS away_team, home_points, away_points, neutral_site,
    h.division AS home_division, a.division AS away_division, h.conference AS home_conference, a.conference AS away_conference,
    h.conference = a.conference AS conference_game, h.pregame_elo AS home_pregame_elo, a.pregame_elo AS away_pregame_elo,
    (home_points > away_points)::INT AS home_win, home_points - away_points AS margin
    FROM paired JOIN teams h ON hk = h.s_suppkey JOIN teams a ON ak = a.s_suppkey),
periods AS (SELECT season, st_order, week, (row_number() OVER (ORDER BY season, st_order, week) - 1)::INT AS period FROM (SELECT DISTINCT season, st_order, week FROM games))"""

ODDS = """,
odds AS (SELECT l_orderkey AS game_id, season, week, season_type, home_team, away_team,
    CASE WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS side,
    'B' || substr(CASE WHEN l_linenumber % 2 = 0 THEN home_team ELSE away_team END, 2) AS abbr,
    round((l_discount - 0.05) * 200 * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END), 2) AS lines,
    CASE WHEN l_returnflag <> 'N' THEN round((l_tax - 0.04) * 200, 2) END AS opening_lines,
    CASE WHEN l_linestatus = 'F' THEN -110 - l_quantity ELSE 100 + l_quantity END AS odds,
    CASE WHEN l_partkey % 2 = 0 THEN 'spread' ELSE 'money_line' END AS market_type
    FROM items JOIN games ON l_orderkey = game_id WHERE rn >= 3)"""

SIDES = """,
sides AS (SELECT game_id, season, st_order, week, start_date, 'home' AS side, home_team AS team, away_team AS opp, home_win AS win, margin FROM games
    UNION ALL SELECT game_id, season, st_order, week, start_date, 'away', away_team, home_team, 1 - home_win, -margin FROM games)"""

SPREADS = ODDS + """,
votes AS (SELECT abbr, name, count(*) AS n FROM (SELECT DISTINCT game_id, abbr, unnest([home_team, away_team]) AS name FROM odds WHERE market_type = 'spread') GROUP BY abbr, name),
voted AS (SELECT abbr, name AS team, n FROM (SELECT *, row_number() OVER (PARTITION BY abbr ORDER BY n DESC, name) AS r FROM votes) WHERE r = 1),
spreads AS (SELECT game_id, round(median(lines), 6) AS spread_home, round(median(opening_lines), 6) AS open_spread_home
    FROM odds JOIN voted USING (abbr) WHERE market_type = 'spread' AND team = home_team GROUP BY game_id)"""

PREDICTIONS = SPREADS + """,
lined AS (SELECT g.*, spread_home, open_spread_home FROM games g LEFT JOIN spreads USING (game_id)),
predictions AS (SELECT *, 'prior' AS model, 1 / (1 + pow(10, -(home_pregame_elo - away_pregame_elo + CASE WHEN neutral_site THEN 0 ELSE 55 END) / 400)) AS p FROM lined
    UNION ALL SELECT *, 'market', 1 / (1 + exp(spread_home / 7)) FROM lined
    UNION ALL SELECT *, 'opening', 1 / (1 + exp(open_spread_home / 7)) FROM lined)"""

_ROLES = "rush completion incompletion sack_taken interception_thrown fumble fumble_recovered sack interception pass_breakup fumble_forced reception".split()

PLAYS = """
WITH base AS (SELECT *, user_id + 1 - 2 * (user_id % 2) AS other, floor(value / 10)::BIGINT AS yards, value > 200 AS dropped FROM events),
plays AS (SELECT event_id, ((event_id // 1000) * 5 + (user_id % 10) // 2)::BIGINT AS game_id, (2014 + day(ts) // 6)::INT AS season, ((day(ts) % 6 * 24 + hour(ts)) // 3 + 1)::INT AS week,
    CASE WHEN event_type = 'purchase' THEN user_id END AS rush_player_id, CASE WHEN event_type = 'view' THEN user_id END AS completion_player_id, CASE WHEN event_type = 'click' THEN user_id END AS incompletion_player_id,
    CASE WHEN event_type = 'error' THEN user_id END AS sack_taken_player_id, CASE WHEN event_type = 'signup' THEN user_id END AS interception_thrown_player_id, CASE WHEN dropped THEN user_id + 10 END AS fumble_player_id,
    CASE WHEN dropped AND event_id % 3 = 1 THEN other WHEN dropped AND event_id % 3 = 2 THEN user_id END AS fumble_recovered_player_id, CASE WHEN event_type = 'error' THEN other END AS sack_player_id,
    CASE WHEN event_type = 'signup' THEN other END AS interception_player_id, CASE WHEN event_type = 'click' AND event_id % 5 = 0 THEN other END AS pass_breakup_player_id,
    CASE WHEN dropped AND event_id % 2 = 0 THEN other END AS fumble_forced_player_id, CASE WHEN event_type = 'view' THEN user_id + 10 END AS reception_player_id,
    CASE WHEN event_id % 10 = 0 AND event_type IN ('purchase', 'view') THEN user_id END AS touchdown_player_id,
    CASE WHEN event_type = 'purchase' THEN yards END AS rush_yds, CASE WHEN event_type = 'view' AND event_id % 7 <> 0 THEN yards END AS completion_yds, CASE WHEN event_type = 'view' THEN yards END AS reception_yds,
    CASE WHEN event_type = 'error' THEN yards END AS sack_taken_stat, CASE WHEN event_id % 9 <> 0 THEN event_id % 4 + 1 END AS down, CASE WHEN event_id % 8 <> 0 THEN 10 - event_id % 11 END AS distance FROM base),
rosters AS (SELECT season, athlete_id, (athlete_id % 10)::INT AS team FROM (SELECT DISTINCT user_id AS athlete_id FROM events), (SELECT DISTINCT season FROM plays) WHERE athlete_id % 7 <> season % 7),
prod AS (SELECT x.season, team, athlete_id, sum(off_yards)::BIGINT AS off_yards, sum(def_plays)::BIGINT AS def_plays FROM (
    SELECT season, rush_player_id AS athlete_id, coalesce(rush_yds, 0) AS off_yards, 0 AS def_plays FROM plays UNION ALL SELECT season, completion_player_id, coalesce(completion_yds, 0), 0 FROM plays
    UNION ALL SELECT season, reception_player_id, coalesce(reception_yds, 0), 0 FROM plays UNION ALL SELECT season, sack_player_id, 0, 1 FROM plays UNION ALL SELECT season, interception_player_id, 0, 1 FROM plays
    UNION ALL SELECT season, pass_breakup_player_id, 0, 1 FROM plays UNION ALL SELECT season, fumble_forced_player_id, 0, 1 FROM plays) x JOIN rosters USING (season, athlete_id) GROUP BY ALL)"""

BOX = PLAYS + """,
a AS (SELECT p.*, """ + ", ".join(f"r_{r}.team AS {r}_team" for r in _ROLES) + " FROM plays p " + " ".join(f"LEFT JOIN rosters r_{r} ON r_{r}.season = p.season AND r_{r}.athlete_id = p.{r}_player_id" for r in _ROLES) + """),
k AS (SELECT *, rush_player_id IS NOT NULL AS rush, completion_player_id IS NOT NULL OR incompletion_player_id IS NOT NULL OR interception_thrown_player_id IS NOT NULL AS thrown,
    coalesce(rush_team, completion_team, incompletion_team, sack_taken_team, interception_thrown_team, fumble_team) AS team FROM a),
g AS (SELECT *, CASE WHEN rush THEN coalesce(rush_yds, 0) WHEN completion_player_id IS NOT NULL THEN coalesce(completion_yds, 0) WHEN sack_taken_player_id IS NOT NULL AND NOT thrown THEN -coalesce(sack_taken_stat, 0) ELSE 0 END AS gain,
    rush OR thrown OR sack_taken_player_id IS NOT NULL AS play, coalesce(distance, 10) AS dist FROM k),
off AS (SELECT season, game_id, team, sum(play::INT)::BIGINT AS plays, sum(CASE WHEN play THEN gain ELSE 0 END)::BIGINT AS yards,
    sum((play AND dist > 0 AND gain >= (CASE coalesce(down, 1) WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 1.0 END) * dist)::INT)::BIGINT AS successes, sum((rush AND gain >= 12 OR thrown AND gain >= 20)::INT)::BIGINT AS explosives,
    sum(thrown::INT)::BIGINT AS passes, sum(rush::INT)::BIGINT AS rushes, count(sack_taken_player_id) AS sacks_taken, count(interception_thrown_player_id) AS picks_thrown,
    sum(CASE WHEN fumble_player_id IS NULL THEN 0.0 WHEN fumble_recovered_team IS NULL THEN 0.5 ELSE coalesce(fumble_recovered_team <> fumble_team, true)::INT END)::DOUBLE AS fumbles_lost, count(touchdown_player_id) AS touchdowns
    FROM g WHERE team IS NOT NULL GROUP BY season, game_id, team),
box AS (SELECT off.*, """ + ", ".join(f"coalesce({n}, 0) AS {n}" for n in ("sacks", "picks", "breakups", "forced")) + " FROM off " + " ".join(f"LEFT JOIN (SELECT season, game_id, {r}_team AS team, count(*) AS {n} FROM a WHERE {r}_team IS NOT NULL GROUP BY ALL) USING (season, game_id, team)" for n, r in (("sacks", "sack"), ("picks", "interception"), ("breakups", "pass_breakup"), ("forced", "fumble_forced"))) + ")"

CALENDAR = GAMES + """, t AS (SELECT g.*, period FROM games g JOIN periods USING (season, st_order, week)),
cal AS (SELECT * FROM (SELECT season, period, max(season) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_season FROM (SELECT DISTINCT season, period FROM t)) WHERE hist_season IS NOT NULL)"""

SNAPSHOT_SUMS = GAMES + """, t AS (SELECT g.*, period FROM games g JOIN periods USING (season, st_order, week) WHERE home_division = 'fbs' OR away_division = 'fbs'),
cal AS (SELECT * FROM (SELECT season, period, max(season) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_season FROM (SELECT DISTINCT season, period FROM t)) WHERE hist_season IS NOT NULL),
refs AS (SELECT period, max(d) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM (SELECT period, max(start_date) AS d FROM t GROUP BY period)),
w AS (SELECT c.period, c.hist_season, refs.ref, t.season, t.start_date, t.home_team, t.away_team, t.home_points, t.away_points, t.margin, pow(0.45, c.hist_season - t.season) AS wt
    FROM cal c JOIN refs ON refs.period = c.period JOIN t ON t.period < c.period AND t.season >= c.hist_season - 7),
sums AS (SELECT period, team, sum(wt) AS n, sum(wt * pf) AS pf, sum(wt * pa) AS pa, sum(wt * pf * pf) AS sq
    FROM (SELECT period, wt, home_team AS team, home_points AS pf, away_points AS pa FROM w UNION ALL SELECT period, wt, away_team, away_points, home_points FROM w) GROUP BY period, team)"""

TRIPS = GAMES + """, seasons AS (SELECT DISTINCT season FROM games),
venues AS (SELECT season, 'S' || s_suppkey AS team, CASE WHEN s_nationkey <> 7 THEN 25 + s_nationkey END AS lat, -70 - 2 * s_nationkey AS lon,
    [-5, -5, -5, -5, -6, -7, -7, -7, -8, -9, -10, -6, -6, -6, NULL][s_nationkey % 15 + 1] AS tz, 100 * s_nationkey + season - 1995 AS elev FROM supplier, seasons WHERE (s_suppkey + season) % 3 <> 0),
anyway AS (SELECT team, arg_min(lat, season) AS lat, arg_min(lon, season) AS lon, arg_min(tz, season) AS tz, arg_min(elev, season) AS elev, min(season) AS season FROM venues GROUP BY team),
placed AS (SELECT g.season, team, CASE WHEN v.season IS NOT NULL THEN v.lat ELSE a.lat END AS lat, CASE WHEN v.season IS NOT NULL THEN v.lon ELSE a.lon END AS lon, CASE WHEN v.season IS NOT NULL THEN v.tz ELSE a.tz END AS tz, CASE WHEN v.season IS NOT NULL THEN v.elev ELSE a.elev END AS elev
    FROM (SELECT DISTINCT season, home_team AS team FROM games UNION SELECT season, away_team FROM games) g LEFT JOIN (SELECT * FROM venues) v USING (season, team) LEFT JOIN (SELECT team, lat, lon, tz, elev FROM anyway) a USING (team))"""
