"""The event feed: games, events, shifts and metrics derived from the given tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isochron.sources.shared import stored

#: What a game's number says of it.
GAME_COLUMNS = {
    "season": "CASE game_id % 3 WHEN 0 THEN '20212022' WHEN 1 THEN '20222023' ELSE '20232024' END",
    "home_team_id": "1 + game_id % 8",
    "away_team_id": "1 + (game_id % 8 + 1 + game_id % 7) % 8",
}

GAMES = f"""
SELECT game_id, {", ".join(f"{x} AS {name}" for name, x in GAME_COLUMNS.items())}
FROM (SELECT DISTINCT CAST(FLOOR(event_id / 360) AS BIGINT) AS game_id FROM events) g
"""

#: A goal's assists come from the scorer's line; no join, as a game's teams follow from its number.
EVENTS = """
SELECT game_id, event_id, period, period_seconds, event_type, event_team_id, x_coord, y_coord, zone_code,
       event_team_id * 100 + line * 3 AS player_1_id, xg,
       CASE WHEN event_type = 'GOAL' AND event_id % 4 <> 0 THEN event_team_id * 100 + (line * 3 + 1 + 3 * (game_id % 4)) % 12 END AS player_2_id,
       CASE WHEN event_type = 'GOAL' AND event_id % 4 = 2 THEN event_team_id * 100 + (line * 3 + 2 + 6 * (game_id % 4)) % 12 END AS player_3_id
FROM (SELECT game_id, event_id, period, period_seconds, event_type,
             CASE WHEN user_id % 4 < 2 THEN 1 + game_id % 8 ELSE 1 + (game_id % 8 + 1 + game_id % 7) % 8 END AS event_team_id,
             CAST(event_id * 7 % 100 AS DOUBLE) AS x_coord, CAST(event_id * 11 % 43 - 21 AS DOUBLE) AS y_coord,
             CASE user_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'D' ELSE 'N' END AS zone_code,
             (CAST(FLOOR(period_seconds / 50) AS BIGINT) + game_id) % 4 AS line,
             CASE WHEN event_type IN ('SHOT', 'MISSED_SHOT', 'GOAL') THEN ROUND(value / 500, 6) END AS xg
      FROM (SELECT event_id, user_id, value, CAST(FLOOR(event_id / 360) AS BIGINT) AS game_id,
                   CAST(FLOOR(event_id % 360 / 120) AS BIGINT) + 1 AS period, event_id % 120 * 10 AS period_seconds,
                   CASE event_type WHEN 'click' THEN 'SHOT' WHEN 'view' THEN 'MISSED_SHOT' WHEN 'purchase' THEN 'GOAL'
                     WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'FACEOFF' ELSE 'BLOCKED_SHOT' END
                     ELSE CASE user_id % 3 WHEN 0 THEN 'TAKEAWAY' WHEN 1 THEN 'GIVEAWAY' ELSE 'PENALTY' END END AS event_type
            FROM events) raw) named
"""

SHIFTS = """
SELECT g.game_id, g.season, t.team_id, CAST(p.n_nationkey AS BIGINT) + 1 AS period,
       CASE WHEN s.r_regionkey < 3
            THEN t.team_id * 100 + ((b.n_nationkey + g.game_id) % 4 * 3 + s.r_regionkey + 3 * (g.game_id % 4) * s.r_regionkey) % 12
            ELSE t.team_id * 100 + 20 + (b.n_nationkey * 2 + g.game_id + CAST(FLOOR(b.n_nationkey / 3) AS BIGINT)) % 3 * 2 + s.r_regionkey - 3
       END AS player_id,
       CASE WHEN s.r_regionkey < 3 THEN 'F' ELSE 'D' END AS position,
       CAST(b.n_nationkey AS BIGINT) * 50 AS start_seconds, CAST(b.n_nationkey AS BIGINT) * 50 + 50 AS end_seconds
FROM feed_games g
JOIN (SELECT game_id, home_team_id AS team_id, 1 AS is_home FROM feed_games
      UNION ALL SELECT game_id, away_team_id, 0 FROM feed_games) t ON t.game_id = g.game_id
CROSS JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3) p
CROSS JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 24) b
CROSS JOIN region s
WHERE NOT (t.is_home = 0 AND s.r_regionkey = 4 AND (b.n_nationkey + g.game_id) % 6 = 0)
UNION ALL
SELECT g.game_id, g.season, t.team_id, CAST(p.n_nationkey AS BIGINT) + 1, t.team_id * 100 + 90, 'G', CAST(0 AS BIGINT), CAST(1200 AS BIGINT)
FROM feed_games g
JOIN (SELECT game_id, home_team_id AS team_id FROM feed_games
      UNION ALL SELECT game_id, away_team_id FROM feed_games) t ON t.game_id = g.game_id
CROSS JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3) p
"""

METRIC = """
SELECT CAST(YEAR(l_shipdate) AS BIGINT) AS season, l_returnflag || '_' || l_linestatus AS metric_name, l_suppkey AS player_id,
       CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * CAST(ROUND((1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 10000 AS value,
       CAST(ROUND(SUM(l_quantity)) AS BIGINT) * 60 AS toi_seconds
FROM lineitem GROUP BY 1, 2, 3
"""

_PARTS = {"feed_games": GAMES, "feed_events": EVENTS, "feed_shifts": SHIFTS, "feed_metric": METRIC}
_NEEDS = {"feed_games": (), "feed_events": (), "feed_shifts": ("feed_games",), "feed_metric": ()}


def with_feed(sql: str) -> str:
    """The SQL with those parts of the feed that it names, as common table expressions."""
    used: list[str] = []
    for name in _PARTS:
        if name in sql:
            used += [x for x in (*_NEEDS[name], name) if x not in used]
    return ("WITH " + ", ".join(f"{x} AS ({_PARTS[x]})" for x in used) + " " if used else "") + sql


class Feed:
    """The feed's tables over a folder of Parquet files, lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._metric: DataFrame | None = None

    def with_stored_metric(self) -> Feed:
        """The same feed with its metric aggregated once, for plans that read it in several places."""
        out = Feed(self.spark, self.sf_dir)
        out._metric = stored(self.metric)
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        for name in tables:
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
        return self.spark.sql(text, **tables)

    @property
    def games(self) -> DataFrame:
        return self._sql(GAMES, events=self.table("events"))

    @property
    def events(self) -> DataFrame:
        return self._sql(EVENTS, events=self.table("events"))

    @property
    def shifts(self) -> DataFrame:
        return self._sql(SHIFTS, nation=self.table("nation"), region=self.table("region"), feed_games=self.games)

    @property
    def metric(self) -> DataFrame:
        return self._sql(METRIC, lineitem=self.table("lineitem")) if self._metric is None else self._metric
