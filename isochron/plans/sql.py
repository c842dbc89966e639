"""DuckDB SQL of the feed's plans, for the oracle."""

ON_ICE = """
cand AS (SELECT e.game_id, e.event_id, s.team_id, s.player_id,
  bool_or((s.start_seconds < e.period_seconds OR (s.start_seconds <= e.period_seconds AND (e.period_seconds = 0 OR s.player_id = e.player_1_id))) AND s.end_seconds >= e.period_seconds) AS i0,
  bool_or((s.start_seconds < e.period_seconds + 1 OR (s.start_seconds <= e.period_seconds + 1 AND (e.period_seconds = 0 OR s.player_id = e.player_1_id))) AND s.end_seconds >= e.period_seconds - 1) AS i1,
  bool_or((s.start_seconds < e.period_seconds + 2 OR (s.start_seconds <= e.period_seconds + 2 AND (e.period_seconds = 0 OR s.player_id = e.player_1_id))) AND s.end_seconds >= e.period_seconds - 2) AS i2,
  bool_or(s.player_id = e.player_1_id) AS required, max(least(e.period_seconds - s.start_seconds, s.end_seconds - e.period_seconds)) AS margin
  FROM feed_events e JOIN feed_shifts s ON s.game_id = e.game_id AND s.period = e.period AND s.start_seconds <= e.period_seconds + 2 AND s.end_seconds >= e.period_seconds - 2
  GROUP BY 1, 2, 3, 4),
counted AS (SELECT *, count(*) FILTER (i0) OVER w AS n0, count(*) FILTER (i1) OVER w AS n1, count(*) FILTER (i2) OVER w AS n2,
  row_number() OVER (PARTITION BY game_id, event_id, team_id ORDER BY i2 DESC, required DESC, margin DESC, player_id) AS best FROM cand WINDOW w AS (PARTITION BY game_id, event_id, team_id)),
on_ice AS (SELECT game_id, event_id, team_id, player_id FROM counted WHERE CASE WHEN n0 BETWEEN 1 AND 6 THEN i0 WHEN n1 BETWEEN 1 AND 6 THEN i1 WHEN n2 BETWEEN 1 AND 6 THEN i2 ELSE i2 AND best <= 6 END)
"""

LINEUPS = ON_ICE + """,
sides AS (SELECT game_id, event_id, team_id, list_sort(list(player_id) FILTER (player_id % 100 <> 90)) AS skaters, count(*) FILTER (player_id % 100 = 90) AS goalies FROM on_ice GROUP BY 1, 2, 3),
lineups AS (SELECT e.*, g.season, g.home_team_id, g.away_team_id, coalesce(h.skaters, []) AS home_skaters, coalesce(a.skaters, []) AS away_skaters, coalesce(h.goalies, 0) AS home_goalies, coalesce(a.goalies, 0) AS away_goalies,
  sum(CASE WHEN event_type = 'GOAL' AND event_team_id = home_team_id THEN 1 ELSE 0 END) OVER score AS home_score, sum(CASE WHEN event_type = 'GOAL' AND event_team_id <> home_team_id THEN 1 ELSE 0 END) OVER score AS away_score
  FROM feed_events e JOIN feed_games g USING (game_id) LEFT JOIN sides h ON h.game_id = e.game_id AND h.event_id = e.event_id AND h.team_id = g.home_team_id LEFT JOIN sides a ON a.game_id = e.game_id AND a.event_id = e.event_id AND a.team_id = g.away_team_id
  WINDOW score AS (PARTITION BY e.game_id ORDER BY period, period_seconds, e.event_id ROWS UNBOUNDED PRECEDING))
"""

#: Each side's measures: a count or a sum over the side's events of a stint.
_COUNTS = {
    "corsi": "event_type IN ('SHOT', 'MISSED_SHOT', 'GOAL', 'BLOCKED_SHOT')", "goals": "event_type = 'GOAL'", "a1": "event_type = 'GOAL' AND player_2_id IS NOT NULL",
    "a2": "event_type = 'GOAL' AND player_3_id IS NOT NULL", "penalties": "event_type = 'PENALTY'",
}
_SUMS = {
    "xg": ("xg", "true"), "xg_a1": ("xg", "event_type = 'GOAL' AND player_2_id IS NOT NULL"), "xg_a2": ("xg", "event_type = 'GOAL' AND player_3_id IS NOT NULL"), "hd_xg": ("xg", "xg >= 0.2"),
    "takeaway_swing": ("swing", "event_type = 'TAKEAWAY'"), "giveaway_swing": ("swing", "event_type = 'GIVEAWAY'"), "turnover_swing": ("swing", "event_type IN ('TAKEAWAY', 'GIVEAWAY')"),
    "block_swing": ("swing", "event_type = 'BLOCKED_SHOT'"), "faceoff_swing": ("swing", "event_type = 'FACEOFF'"),
}


def _measures() -> str:
    own = {"home": "event_team_id = home_team_id", "away": "event_team_id <> home_team_id"}
    out = [f"count(*) FILTER ({test} AND {mine}) AS {side}_{k}" for k, test in _COUNTS.items() for side, mine in own.items()]
    out += [f"coalesce(sum({x}) FILTER ({test} AND {mine}), 0) AS {side}_{k}" for k, (x, test) in _SUMS.items() for side, mine in own.items()]
    return ", ".join(out)


def stints_sql(name: str, strength: str) -> str:
    """Common table expressions that end with `name`, the stints of lineups of one strength, and `name`_members."""
    p = f"{name}_"
    return f"""
{p}rows AS (SELECT *, CASE WHEN event_team_id = home_team_id THEN 1 ELSE -1 END * (coalesce(sum(xg) FILTER (event_team_id = home_team_id) OVER soon, 0) - coalesce(sum(xg) FILTER (event_team_id <> home_team_id) OVER soon, 0)) AS swing
  FROM lineups WHERE {strength} WINDOW soon AS (PARTITION BY game_id, period ORDER BY period_seconds RANGE BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
{p}marked AS (SELECT *, CASE WHEN lag({{'p': period, 'h': home_skaters, 'a': away_skaters}}) OVER o = {{'p': period, 'h': home_skaters, 'a': away_skaters}} THEN 0 ELSE 1 END AS changed
  FROM {p}rows WINDOW o AS (PARTITION BY game_id ORDER BY period, period_seconds, event_id)),
{p}numbered AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY game_id ORDER BY period, period_seconds, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stint_id, greatest(least(home_score - away_score, 2), -2) AS state FROM {p}marked),
{p}grouped AS (SELECT game_id, season, stint_id, period, home_team_id, away_team_id, home_skaters, away_skaters, min(period_seconds) AS start_seconds, count(*) AS n_events,
  coalesce(min_by(zone_code, (period_seconds, event_id)) FILTER (event_type = 'FACEOFF'), 'N') AS zone, {_measures()} FROM {p}numbered GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
{p}states AS (SELECT game_id, stint_id, CAST(state AS BIGINT) AS score_state FROM (SELECT game_id, stint_id, state, row_number() OVER (PARTITION BY game_id, stint_id ORDER BY count(*) DESC, state) AS n FROM {p}numbered GROUP BY 1, 2, 3) WHERE n = 1),
{name} AS (SELECT * FROM (SELECT g.*, s.score_state, coalesce(lead(start_seconds) OVER (PARTITION BY g.game_id, period ORDER BY g.stint_id), 1200) - start_seconds AS duration FROM {p}grouped g JOIN {p}states s ON s.game_id = g.game_id AND s.stint_id = g.stint_id) WHERE duration > 0),
{p}members AS (SELECT *, unnest(home_skaters) AS player_id, 1 AS sign FROM {name} UNION ALL SELECT *, unnest(away_skaters), -1 FROM {name})"""


EVEN = "len(home_skaters) = 5 AND len(away_skaters) = 5"
UNEVEN = "len(home_skaters) <> len(away_skaters) AND len(home_skaters) BETWEEN 3 AND 5 AND len(away_skaters) BETWEEN 3 AND 5 AND home_goalies > 0 AND away_goalies > 0"

STINTS = LINEUPS + "," + stints_sql("stints", EVEN) + """,
members AS (SELECT * FROM stints_members)
"""


def after(ctes: str, select: str) -> str:
    """A SELECT over the feed and the given common table expressions."""
    from isochron.plans.feed import with_feed

    body = f"{ctes.strip()} {select}"
    head = with_feed(body)
    return head[: len(head) - len(body)].rstrip() + ", " + body
