"""Profiles, rosters, timelines and reconciliations over the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isochron.operators import aggregates as A
from isochron.operators import profile as O
from isochron.operators import series as T
from isochron.plans import stints as P
from isochron.plans.feed import Feed, with_feed
from isochron.plans.registry import query
from isochron.plans.sql import LINEUPS, STINTS, after
from isochron.sources.shared import stored

_TIMES = """SELECT season, team_id, player_id, CAST(sum(end_seconds - start_seconds) AS BIGINT) AS toi_seconds
  FROM feed_shifts WHERE position <> 'G' GROUP BY 1, 2, 3"""


def _times(feed: Feed) -> DataFrame:
    rows = feed.shifts.filter("position <> 'G'").groupBy("season", "team_id", "player_id")
    return rows.agg(F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("toi_seconds"))


@query(with_feed(f"""SELECT season, team_id, count(*) AS members, CAST(sum(toi_seconds) AS BIGINT) AS toi_seconds, round(sum(toi_seconds * rating) / sum(toi_seconds), 6) AS strength
  FROM ({_TIMES}) t JOIN (SELECT player_1_id AS player_id, avg(xg) AS rating FROM feed_events WHERE xg IS NOT NULL GROUP BY 1) r USING (player_id)
  WHERE toi_seconds >= 3000 GROUP BY 1, 2"""))
def d23_roster_strength(feed: Feed) -> DataFrame:
    """Ratings here are the mean xG of an entity's shots; members need 3,000 seconds."""
    ratings = feed.events.filter("xg IS NOT NULL").groupBy(F.col("player_1_id").alias("player_id")).agg(F.avg("xg").alias("rating"))
    out = O.roster_strength(_times(feed), ratings, ["season", "team_id"], "player_id", 3000)
    return out.withColumn("strength", F.round("strength", 6))


def _rate(measure: str) -> str:
    return f"CAST(floor(CAST(sum({measure}) AS DOUBLE) * CAST(3600 AS DOUBLE) / sum(duration)) AS DOUBLE) / 1e6 AS {measure}_60"


@query(after(STINTS, f"""
SELECT season, team_id, round(sum(duration) / 3600, 6) AS hours, {_rate("corsi")}, {_rate("goals")}, {_rate("xg")}
FROM (SELECT season, unnest([home_team_id, away_team_id]) AS team_id, duration, unnest([1, -1]) * (home_corsi - away_corsi) * 1000000 AS corsi,
        unnest([1, -1]) * (home_goals - away_goals) * 1000000 AS goals, unnest([1, -1]) * CAST(round((home_xg - away_xg) * 1e6) AS BIGINT) AS xg FROM stints)
GROUP BY 1, 2"""))  # fmt: skip
def d25_team_efficiency(feed: Feed) -> DataFrame:
    rates = O.team_rates(P.stints(P.filter_strength(P.lineups(feed), "5v5")), ["corsi", "goals", "xg"])
    return rates.select("season", "team_id", F.round("hours", 6).alias("hours"), "corsi_60", "goals_60", "xg_60")


@query(with_feed("""SELECT event_type, count(*) AS n, count(*) FILTER (team_id IS NULL OR team_id <> event_team_id) AS mismatched,
  avg(CASE WHEN team_id IS NULL OR team_id <> event_team_id THEN 1.0 ELSE 0.0 END) <= 0.05 AS passed
  FROM feed_events e LEFT JOIN (SELECT DISTINCT game_id, player_id, team_id FROM feed_shifts) r ON r.game_id = e.game_id AND r.player_id = e.player_1_id
  WHERE event_type IN ('GOAL', 'BLOCKED_SHOT') GROUP BY 1"""))
def j7_j11_event_team(feed: Feed) -> DataFrame:
    """Goals and blocked shots whose team isn't their first player's in the game; over 5 % fails."""
    roster = feed.shifts.select("game_id", F.col("player_id").alias("player_1_id"), "team_id").distinct()
    rows = feed.events.filter(F.col("event_type").isin("GOAL", "BLOCKED_SHOT")).join(roster, ["game_id", "player_1_id"], "left")
    wrong = F.col("team_id").isNull() | (F.col("team_id") != F.col("event_team_id"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(wrong).alias("mismatched"), (F.avg(wrong.cast("double")) <= 0.05).alias("passed"))


@query(after(LINEUPS, """SELECT season, count(*) AS raw, count(*) FILTER (len(home_skaters) > 0 AND len(away_skaters) > 0) AS on_ice,
  count(*) FILTER (len(home_skaters) = 5 AND len(away_skaters) = 5) AS even FROM lineups GROUP BY 1"""))
def j33_loss_trace(feed: Feed) -> DataFrame:
    """Events of each season: all, those with both lineups, and those at five a side."""
    home, away = F.size("home_skaters"), F.size("away_skaters")
    return P.lineups(feed).groupBy("season").agg(F.count("*").alias("raw"), F.count_if((home > 0) & (away > 0)).alias("on_ice"), F.count_if((home == 5) & (away == 5)).alias("even"))


@query("""
WITH rows AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem), lost AS (SELECT l_orderkey, l_linenumber FROM rows WHERE l_orderkey % 3 = 0 ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1),
whole AS (SELECT l_suppkey, count(*) AS n FROM rows GROUP BY 1), less AS (SELECT l_suppkey, count(*) AS n FROM rows r WHERE NOT EXISTS (SELECT 1 FROM lost x WHERE x.l_orderkey = r.l_orderkey AND x.l_linenumber = r.l_linenumber) GROUP BY 1),
found AS (SELECT (SELECT count(*) FROM (SELECT * FROM whole EXCEPT SELECT * FROM less)) AS extra, (SELECT count(*) FROM (SELECT * FROM less EXCEPT SELECT * FROM whole)) AS missing)
SELECT 'all new rows' AS run, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS missing, count(*) > 0 AS passed FROM whole UNION ALL SELECT 'one lost', extra, missing, extra = 0 AND missing = 0 FROM found""")
def j26_incremental_equals_full(feed: Feed) -> DataFrame:
    """Counts of all rows against a stored table of the first orders' with the new rows' added; and again with one new row
    lost, which must fail."""
    keys = ["l_orderkey", "l_linenumber"]
    rows = feed.table("lineitem").select(*keys, "l_suppkey")
    counts = lambda df: df.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    first = rows.filter("l_orderkey % 3 <> 0")
    kept, new = stored(counts(first)), A.incremental(rows, first, keys)
    lost = new.groupBy().agg(F.max(F.struct(*keys)).alias("_m")).select("_m.*")
    out = None
    for name, more in (("all new rows", new), ("one lost", new.join(F.broadcast(lost), keys, "left_anti"))):  # one row
        both = kept.unionByName(counts(more)).groupBy("l_suppkey").agg(F.sum("n").alias("n"))
        row = O.same_rows(counts(rows), both).select(F.lit(name).alias("run"), "extra", "missing", "passed")
        out = row if out is None else out.unionByName(row)
    return out


_STEPS = """p AS (SELECT metric_name, player_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY metric_name, player_id) AS n
  FROM feed_metric WINDOW w AS (PARTITION BY metric_name, player_id ORDER BY season)),
k AS (SELECT metric_name, player_id, i, n, value AS m, 2.0::DOUBLE AS p FROM p WHERE i = 1 UNION ALL
  SELECT p.metric_name, p.player_id, p.i, p.n, k.m + (k.p + 0.5) / (k.p + 2.5) * (p.value - k.m), (1 - (k.p + 0.5) / (k.p + 2.5)) * (k.p + 0.5)
  FROM k JOIN p ON p.metric_name = k.metric_name AND p.player_id = k.player_id AND p.i = k.i + 1)"""


@query(after(_STEPS, """SELECT metric_name, player_id, i AS step, 'history' AS kind, round(value, 3) AS mean, round(value, 3) AS low, round(value, 3) AS high FROM p
  UNION ALL SELECT metric_name, player_id, n + h, 'forecast', round(m, 3), round(m - 1.96 * sqrt(p + h * 0.5), 3), round(m + 1.96 * sqrt(p + h * 0.5), 3)
  FROM k, (VALUES (1), (2), (3)) v(h) WHERE i = n""").replace("WITH ", "WITH RECURSIVE ", 1))
def g23_forecast_timeline(feed: Feed) -> DataFrame:
    """Each series, and three steps ahead of its local level (process noise 0.5, observation noise 2)."""
    keys = ["metric_name", "player_id"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("season")).cast("long")
    history = feed.metric.select(*keys, number.alias("step"), F.col("value").alias("mean"))
    level = T.noise_from_differences(feed.metric, keys, "season", "value").withColumn("s", T.local_level(F.col("points"), F.lit(0.5), F.lit(2.0)))
    ahead = level.withColumn("h", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    ahead = ahead.select(*keys, (F.col("n") + F.col("h")).cast("long").alias("step"), F.col("s.m").alias("mean"), (F.col("s.p") + F.col("h") * 0.5).alias("variance"))
    return O.timeline(history, ahead, keys).withColumns({c: F.round(c, 3) for c in ("mean", "low", "high")})


_CHANGE = """(SELECT *, lag(value) OVER w AS before, avg(value) OVER w AS career, row_number() OVER w AS years
  FROM feed_metric WINDOW w AS (PARTITION BY metric_name, player_id ORDER BY season))"""


@query(with_feed(f"""SELECT season, metric_name, player_id, concat_ws('; ', CASE WHEN value > 1.2 * career THEN 'above career level' END, CASE WHEN value < 0.8 * before THEN 'sharp drop' END,
  CASE WHEN toi_seconds < 6000 THEN 'little time' END) AS regression, concat_ws('; ', CASE WHEN value > 1.2 * before THEN 'strong rise' END, CASE WHEN years <= 3 AND value > career THEN 'early climb' END) AS breakout FROM {_CHANGE}"""))
def i14_rules(feed: Feed) -> DataFrame:
    """Reasons for regression and breakout, from a value, the season before, the mean so far, time and years."""
    w = Window.partitionBy("metric_name", "player_id").orderBy("season")
    rows = feed.metric.withColumns({"before": F.lag("value").over(w), "career": F.avg("value").over(w), "years": F.row_number().over(w)})
    value, before, career = F.col("value"), F.col("before"), F.col("career")
    down = {"above career level": value > 1.2 * career, "sharp drop": value < 0.8 * before, "little time": F.col("toi_seconds") < 6000}
    up = {"strong rise": value > 1.2 * before, "early climb": (F.col("years") <= 3) & (value > career)}
    return rows.select("season", "metric_name", "player_id", O.reasons(down).alias("regression"), O.reasons(up).alias("breakout"))


@query(with_feed("""SELECT season, player_id, round(avg(pct), 5) AS score, CASE WHEN round(avg(pct), 5) >= 80 THEN 'A' WHEN round(avg(pct), 5) >= 60 THEN 'B' WHEN round(avg(pct), 5) >= 40 THEN 'C' ELSE 'D' END AS grade
  FROM (SELECT *, 100 * percent_rank() OVER (PARTITION BY season, metric_name ORDER BY value) AS pct FROM feed_metric) GROUP BY 1, 2"""))
def i19_grades(feed: Feed) -> DataFrame:
    """Mean percentile over an entity's metrics of a season, and its grade."""
    pct = 100 * F.percent_rank().over(Window.partitionBy("season", "metric_name").orderBy("value"))
    rows = feed.metric.withColumn("pct", pct).groupBy("season", "player_id").agg(F.round(F.avg("pct"), 5).alias("score"))
    return rows.withColumn("grade", O.grade(F.col("score"), [(80, "A"), (60, "B"), (40, "C")], "D"))


@query(with_feed("""SELECT one, two, round(d, 4) AS difference, CASE WHEN abs(d) >= 0.02 THEN 'SIGNIFICANT' WHEN abs(d) >= 0.01 THEN 'MODERATE' ELSE 'Neutral' END AS chemistry FROM (
  SELECT p.one, p.two, round(together - (a.alone + b.alone) / 2, 6) AS d FROM (SELECT a.player_id AS one, b.player_id AS two, avg(a.x) AS together
    FROM (SELECT player_1_id AS player_id, game_id, period, avg(xg) AS x FROM feed_events WHERE xg IS NOT NULL GROUP BY 1, 2, 3) a
    JOIN (SELECT player_1_id AS player_id, game_id, period FROM feed_events WHERE xg IS NOT NULL GROUP BY 1, 2, 3) b ON a.game_id = b.game_id AND a.period = b.period AND b.player_id = a.player_id + 3 GROUP BY 1, 2) p
  JOIN (SELECT player_1_id AS player_id, avg(xg) AS alone FROM feed_events WHERE xg IS NOT NULL GROUP BY 1) a ON a.player_id = p.one
  JOIN (SELECT player_1_id AS player_id, avg(xg) AS alone FROM feed_events WHERE xg IS NOT NULL GROUP BY 1) b ON b.player_id = p.two)"""))
def i21_chemistry(feed: Feed) -> DataFrame:
    """Pairs of shooters of successive slots: the first's xG in periods that both shoot in, less what both have alone."""
    shots = feed.events.filter("xg IS NOT NULL").select(F.col("player_1_id").alias("one"), "game_id", "period", "xg")
    own = shots.groupBy("one", "game_id", "period").agg(F.avg("xg").alias("x"))
    mates = own.select((F.col("one") - 3).alias("one"), F.col("one").alias("two"), "game_id", "period")
    pairs = own.join(mates, ["one", "game_id", "period"]).groupBy("one", "two").agg(F.avg("x").alias("together"))
    alone = shots.groupBy("one").agg(F.avg("xg").alias("alone_one"))
    both = pairs.join(alone, "one").join(alone.select(F.col("one").alias("two"), F.col("alone_one").alias("alone_two")), "two")
    d = both.withColumn("d", F.round(F.col("together") - (F.col("alone_one") + F.col("alone_two")) / 2, 6))
    label = O.grade(F.abs("d"), [(0.02, "SIGNIFICANT"), (0.01, "MODERATE")], "Neutral")
    return d.select("one", "two", F.round("d", 4).alias("difference"), label.alias("chemistry"))
