"""Queries over the event feed: joins, stints, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isochron.functions import scalars as S
from isochron.operators import aggregates as A
from isochron.operators import joins as J
from isochron.plans import stints as P
from isochron.plans.feed import Feed, with_feed
from isochron.plans.registry import query
from isochron.plans.sql import LINEUPS, ON_ICE, STINTS, after

_ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(after(STINTS, """SELECT season, player_id, toi_seconds, net_xg, stints, net_xg_60, rank FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY net_xg_60 DESC, player_id) AS rank FROM (
  SELECT *, round(net_xg * 3600 / toi_seconds, 6) AS net_xg_60 FROM (SELECT season, player_id, CAST(sum(duration) AS BIGINT) AS toi_seconds, round(sum(sign * (home_xg - away_xg)), 6) AS net_xg, count(*) AS stints FROM members GROUP BY 1, 2) WHERE toi_seconds >= 200)) WHERE rank <= 10"""))
def top_net_xg(feed: Feed) -> DataFrame:
    return P.top_net_xg(P.stints(P.filter_strength(P.lineups(feed), "5v5")))


@query(after(ON_ICE, "SELECT game_id, event_id, team_id, count(*) AS n, array_to_string(list_sort(list(player_id)), ',') AS players FROM on_ice GROUP BY 1, 2, 3"))
def c7_on_ice_cascade(feed: Feed) -> DataFrame:
    return J.on_ice(feed.events, feed.shifts).groupBy("game_id", "event_id", "team_id").agg(F.count("*").alias("n"), _ids(F.array_sort(F.collect_list("player_id"))).alias("players"))


@query(with_feed("SELECT e.game_id, e.event_id, s.team_id, count(DISTINCT s.player_id) AS n FROM feed_events e JOIN feed_shifts s ON s.game_id = e.game_id AND s.period = e.period AND s.start_seconds <= e.period_seconds + 1 AND s.end_seconds >= e.period_seconds - 1 GROUP BY 1, 2, 3"))
def c8_within_tolerance(feed: Feed) -> DataFrame:
    return J.within_tolerance(feed.events, feed.shifts, 1).groupBy("game_id", "event_id", "team_id").agg(F.count("*").alias("n"))


@query(with_feed("""SELECT s.game_id, s.team_id, s.period, s.player_id, s.start_seconds, count(e.event_id) AS n_events, round(coalesce(sum(CASE WHEN e.event_team_id = s.team_id THEN e.xg END), 0), 6) AS xgf, round(coalesce(sum(CASE WHEN e.event_team_id <> s.team_id THEN e.xg END), 0), 6) AS xga,
  CAST(count(*) FILTER (e.event_team_id = s.team_id) AS BIGINT) AS cf, CAST(count(*) FILTER (e.event_team_id <> s.team_id) AS BIGINT) AS ca
  FROM feed_shifts s LEFT JOIN feed_events e ON e.game_id = s.game_id AND e.period = s.period AND e.period_seconds >= s.start_seconds AND e.period_seconds < s.end_seconds AND e.event_type IN ('SHOT', 'MISSED_SHOT', 'GOAL', 'BLOCKED_SHOT')
  WHERE s.end_seconds - s.start_seconds >= 30 GROUP BY 1, 2, 3, 4, 5"""))
def c3_i1_shift_stats(feed: Feed) -> DataFrame:
    return shift_stats(feed)


def shift_stats(feed: Feed) -> DataFrame:
    """Shots for and against within each shift of 30 seconds or more; shifts without events stay."""
    events = feed.events.filter(F.col("event_type").isin(*P.SHOTS)).select("game_id", "period", "event_id", "period_seconds", "event_team_id", "xg")
    shifts = feed.shifts.filter("end_seconds - start_seconds >= 30")
    rows = J.interval_event_join(shifts, events, ["game_id", "period"], "start_seconds", "end_seconds", "period_seconds")
    own, other = F.col("event_team_id") == F.col("team_id"), F.col("event_team_id") != F.col("team_id")
    total = lambda flag: F.round(F.coalesce(F.sum(F.when(flag, F.col("xg"))), F.lit(0.0)), 6)
    return rows.groupBy("game_id", "team_id", "period", "player_id", "start_seconds").agg(F.count("event_id").alias("n_events"), total(own).alias("xgf"), total(other).alias("xga"), F.count_if(own).alias("cf"), F.count_if(other).alias("ca"))


@query(with_feed("""SELECT a.game_id, a.team_id, a.player_id AS player_id_1, b.player_id AS player_id_2, CAST(sum(least(a.end_seconds, b.end_seconds) - greatest(a.start_seconds, b.start_seconds)) AS BIGINT) AS toi_seconds
  FROM feed_shifts a JOIN feed_shifts b ON a.game_id = b.game_id AND a.team_id = b.team_id AND a.period = b.period AND a.player_id < b.player_id AND greatest(a.start_seconds, b.start_seconds) < least(a.end_seconds, b.end_seconds)
  WHERE a.position = 'D' AND b.position = 'D' GROUP BY 1, 2, 3, 4"""))
def c4_overlap_pairs(feed: Feed) -> DataFrame:
    pairs = J.interval_overlap_join(feed.shifts.filter("position = 'D'"), ["game_id", "team_id", "period"], "player_id", "start_seconds", "end_seconds")
    return pairs.groupBy("game_id", "team_id", "player_id_1", "player_id_2").agg(F.sum(F.col("overlap_end") - F.col("overlap_start")).alias("toi_seconds"))


_PAIR_XGA = """pairs AS (SELECT a.game_id, a.season, a.team_id, a.period, a.player_id AS p1, b.player_id AS p2, greatest(a.start_seconds, b.start_seconds) AS s, least(a.end_seconds, b.end_seconds) AS e
  FROM feed_shifts a JOIN feed_shifts b ON a.game_id = b.game_id AND a.team_id = b.team_id AND a.period = b.period AND a.player_id < b.player_id AND greatest(a.start_seconds, b.start_seconds) < least(a.end_seconds, b.end_seconds) WHERE a.position = 'D' AND b.position = 'D'),
toi AS (SELECT season, team_id, p1, p2, CAST(sum(e - s) AS BIGINT) AS toi_seconds FROM pairs GROUP BY 1, 2, 3, 4),
xga AS (SELECT p.season, p.team_id, p1, p2, sum(v.xg) AS xga FROM pairs p JOIN feed_events v ON v.game_id = p.game_id AND v.period = p.period AND v.period_seconds BETWEEN p.s AND p.e AND v.event_team_id <> p.team_id AND v.xg IS NOT NULL GROUP BY 1, 2, 3, 4),
both_ AS (SELECT t.*, coalesce(x.xga, 0) AS xga, coalesce(x.xga, 0) * 3600 / toi_seconds AS xga_60 FROM toi t LEFT JOIN xga x USING (season, team_id, p1, p2) WHERE toi_seconds > 600)
"""


@query(after(_PAIR_XGA, "SELECT season, team_id, p1 AS player_id_1, p2 AS player_id_2, toi_seconds, round(xga, 6) AS xga, round(xga_60, 6) AS xga_60, round(xga_60 - avg(xga_60) OVER (PARTITION BY season), 5) AS delta FROM both_"))
def d19_pair_totals(feed: Feed) -> DataFrame:
    pairs = J.interval_overlap_join(feed.shifts.filter("position = 'D'"), ["game_id", "season", "team_id", "period"], "player_id", "start_seconds", "end_seconds")
    key = ["season", "team_id", "player_id_1", "player_id_2"]
    toi = pairs.groupBy(*key).agg(F.sum(F.col("overlap_end") - F.col("overlap_start")).alias("toi_seconds"))
    against = feed.events.filter("xg IS NOT NULL").select(F.col("game_id").alias("_g"), F.col("period").alias("_p"), "period_seconds", "event_team_id", "xg")
    on = (F.col("game_id") == F.col("_g")) & (F.col("period") == F.col("_p")) & F.col("period_seconds").between(F.col("overlap_start"), F.col("overlap_end")) & (F.col("event_team_id") != F.col("team_id"))
    xga = pairs.join(against, on).groupBy(*key).agg(F.sum("xg").alias("xga"))
    out = toi.filter("toi_seconds > 600").join(xga, key, "left").withColumn("xga", F.coalesce("xga", F.lit(0.0)))
    out = out.withColumn("xga_60", S.rate_per(F.col("xga"), F.col("toi_seconds")))
    delta = F.col("xga_60") - F.avg("xga_60").over(Window.partitionBy("season"))
    return out.select(*key, "toi_seconds", F.round("xga", 6).alias("xga"), F.round("xga_60", 6).alias("xga_60"), F.round(delta, 5).alias("delta"))


_SCORED = """scored AS (SELECT e.*, g.season, g.home_team_id, CAST(sum(CASE WHEN event_type = 'GOAL' AND event_team_id = home_team_id THEN 1 ELSE 0 END) OVER w AS BIGINT) AS home_score, CAST(sum(CASE WHEN event_type = 'GOAL' AND event_team_id <> home_team_id THEN 1 ELSE 0 END) OVER w AS BIGINT) AS away_score
  FROM feed_events e JOIN feed_games g USING (game_id) WINDOW w AS (PARTITION BY game_id ORDER BY period, period_seconds, event_id ROWS UNBOUNDED PRECEDING))"""


@query(after(_SCORED, "SELECT game_id, event_id, home_score, away_score FROM scored"))
def e1_running_score(feed: Feed) -> DataFrame:
    return P.running_score(feed.events.join(feed.games.select("game_id", "home_team_id"), "game_id")).select("game_id", "event_id", "home_score", "away_score")


@query(after(_SCORED, """SELECT game_id, team_id, period, player_id, start_seconds, asof_t, score_state FROM (SELECT s.game_id, s.team_id, s.period, s.player_id, s.start_seconds, c.t AS asof_t, c.score_state, row_number() OVER (PARTITION BY s.game_id, s.team_id, s.period, s.player_id, s.start_seconds ORDER BY c.t DESC, c.event_id DESC) AS n
  FROM (SELECT * FROM feed_shifts WHERE position <> 'G') s JOIN (SELECT game_id, event_id, (period - 1) * 1200 + period_seconds AS t, greatest(least(home_score - away_score, 2), -2) AS score_state FROM scored WHERE event_type = 'GOAL') c ON c.game_id = s.game_id AND c.t <= (s.period - 1) * 1200 + s.start_seconds) WHERE n = 1"""))
def c5_i3_score_at_start(feed: Feed) -> DataFrame:
    scored = P.running_score(feed.events.join(feed.games.select("game_id", "home_team_id"), "game_id")).filter("event_type = 'GOAL'")
    goals = scored.select("game_id", S.game_seconds(F.col("period"), F.col("period_seconds")).alias("t"), S.bucket_clamp(F.col("home_score") - F.col("away_score")).alias("score_state"))
    shifts = feed.shifts.filter("position <> 'G'").select("game_id", "team_id", "period", "player_id", "start_seconds", S.game_seconds(F.col("period"), F.col("start_seconds")).alias("_at"))
    return J.asof_join(shifts, goals, ["game_id"], "_at", "t", ["score_state"]).drop("_at")


@query(with_feed("SELECT game_id, team_id, period, tick, count(*) AS n FROM (SELECT game_id, team_id, period, unnest(generate_series(CAST(ceil(start_seconds / 20.0) AS BIGINT) * 20, end_seconds - 1, 20)) AS tick FROM feed_shifts WHERE position <> 'G') GROUP BY 1, 2, 3, 4"))
def c6_ticks(feed: Feed) -> DataFrame:
    return J.tick_bucketize(feed.shifts.filter("position <> 'G'"), "start_seconds", "end_seconds", 20).groupBy("game_id", "team_id", "period", "tick").agg(F.count("*").alias("n"))


@query(with_feed("""SELECT t.game_id, t.event_id, t.event_type, round(coalesce(sum(CASE WHEN v.event_team_id = t.event_team_id THEN v.xg END), 0) - coalesce(sum(CASE WHEN v.event_team_id <> t.event_team_id THEN v.xg END), 0), 6) AS swing
  FROM feed_events t LEFT JOIN feed_events v ON v.game_id = t.game_id AND v.period = t.period AND v.period_seconds > t.period_seconds AND v.period_seconds <= t.period_seconds + 60 AND v.xg IS NOT NULL
  WHERE t.event_type IN ('TAKEAWAY', 'GIVEAWAY', 'BLOCKED_SHOT', 'FACEOFF') GROUP BY 1, 2, 3"""))
def c9_lookahead_swing(feed: Feed) -> DataFrame:
    rows = feed.events.join(feed.games.select("game_id", "home_team_id"), "game_id")
    home = F.col("event_team_id") == F.col("home_team_id")
    keys = ["game_id", "period"]
    ahead = lambda flag: F.coalesce(J.lookahead_sum(rows, keys, "period_seconds", F.when(flag, F.col("xg")), 60), F.lit(0.0))
    rows = rows.withColumns({"h": ahead(home), "a": ahead(~home)})
    swing = F.when(home, F.col("h") - F.col("a")).otherwise(F.col("a") - F.col("h"))
    return rows.filter(F.col("event_type").isin("TAKEAWAY", "GIVEAWAY", "BLOCKED_SHOT", "FACEOFF")).select("game_id", "event_id", "event_type", F.round(swing, 6).alias("swing"))


@query(after(STINTS, """SELECT g.game_id, g.event_id, s.stint_id FROM (SELECT * FROM feed_events WHERE event_type = 'GOAL') g JOIN LATERAL (SELECT stint_id FROM stints s WHERE s.game_id = g.game_id AND s.period = g.period AND s.start_seconds < g.period_seconds AND s.start_seconds >= g.period_seconds - 60 ORDER BY start_seconds DESC, stint_id LIMIT 1) s ON true"""))
def c10_stint_before_goal(feed: Feed) -> DataFrame:
    s = P.stints(P.filter_strength(P.lineups(feed), "5v5")).select("game_id", "period", "start_seconds", "stint_id")
    goals = feed.events.filter("event_type = 'GOAL'").select("game_id", "event_id", "period", "period_seconds")
    return J.first_within(goals, s, ["game_id", "period"], "period_seconds", "start_seconds", 60, ["stint_id"]).select("game_id", "event_id", "stint_id")


_WIDE = ["game_id", "stint_id", "period", "start_seconds", "duration", "n_events", "score_state", "zone"]
_COUNTED = [f"{side}_{k}" for k in P.MEASURES[:5] for side in ("home", "away")]
_SUMMED = [f"{side}_{k}" for k in P.MEASURES[5:] for side in ("home", "away")]


@query(after(STINTS, f"""
SELECT {", ".join(_WIDE + _COUNTED)}, {", ".join(f"round({c}, 6) AS {c}" for c in _SUMMED)},
  {", ".join(f"home_{k} - away_{k} AS net_{k}" for k in P.MEASURES[:5])}, {", ".join(f"round(home_{k} - away_{k}, 6) AS net_{k}" for k in P.MEASURES[5:])},
  round(home_goals - away_goals - home_xg + away_xg, 6) AS net_finishing, array_to_string(home_skaters, ',') AS home, array_to_string(away_skaters, ',') AS away FROM stints"""))  # fmt: skip
def d14_d16_stints(feed: Feed) -> DataFrame:
    """All measures of both sides, and their differences."""
    s = P.stints(P.filter_strength(P.lineups(feed), "5v5"))
    net = [f"net_{k}" for k in P.MEASURES[5:]] + ["net_finishing"]
    return s.select(
        *[F.col(c).cast("long") if c == "score_state" else c for c in _WIDE], *_COUNTED, *[F.round(c, 6).alias(c) for c in _SUMMED + net],
        *[f"net_{k}" for k in P.MEASURES[:5]], _ids("home_skaters").alias("home"), _ids("away_skaters").alias("away"),
    )


@query(after(STINTS, "SELECT season, player_id, CAST(sum(duration) AS BIGINT) AS toi_seconds, count(DISTINCT game_id) AS games FROM members GROUP BY 1, 2"))
def d13_toi_from_lineups(feed: Feed) -> DataFrame:
    return P.player_stints(P.stints(P.filter_strength(P.lineups(feed), "5v5"))).groupBy("season", "player_id").agg(F.sum("duration").alias("toi_seconds"), F.count_distinct("game_id").alias("games"))


@query(after(LINEUPS, "SELECT len(home_skaters) || 'v' || len(away_skaters) AS strength, len(home_skaters) = 5 AND len(away_skaters) = 5 AS is_even, count(*) AS n FROM lineups GROUP BY 1, 2"))
def b10_j12_strength_distribution(feed: Feed) -> DataFrame:
    rows = P.lineups(feed)
    h, a = F.size("home_skaters"), F.size("away_skaters")
    return rows.groupBy(S.strength_label(h, a).alias("strength"), ((h == 5) & (a == 5)).alias("is_even")).agg(F.count("*").alias("n"))


@query(after(LINEUPS, "SELECT game_id, count(*) AS n FROM lineups WHERE len(home_skaters) <> len(away_skaters) AND len(home_skaters) BETWEEN 3 AND 5 AND len(away_skaters) BETWEEN 3 AND 5 AND home_goalies > 0 AND away_goalies > 0 GROUP BY 1"))
def b11_power_play_events(feed: Feed) -> DataFrame:
    return P.filter_strength(P.lineups(feed), "pp").groupBy("game_id").agg(F.count("*").alias("n"))




@query(after(STINTS, """SELECT p1 AS player_id_1, p2 AS player_id_2, CAST(sum(duration) AS BIGINT) AS toi_seconds, round(sum(net), 6) AS net_xg, count(*) AS stints
  FROM (SELECT duration, net, p1, unnest(l) AS p2 FROM (SELECT duration, home_xg - away_xg AS net, unnest(home_skaters) AS p1, home_skaters AS l FROM stints
    UNION ALL SELECT duration, away_xg - home_xg, unnest(away_skaters), away_skaters FROM stints)) WHERE p1 < p2 GROUP BY 1, 2"""))
def c13_teammate_pairs(feed: Feed) -> DataFrame:
    """Pairs of either side's skaters, with time and net xG as their own side sees it."""
    stints = P.stints(P.filter_strength(P.lineups(feed), "5v5"))
    sides = F.array(F.struct(F.col("home_skaters").alias("members"), F.col("net_xg").alias("net")), F.struct(F.col("away_skaters").alias("members"), (-F.col("net_xg")).alias("net")))
    s = stints.select("duration", F.explode(sides).alias("side")).select("duration", "side.net", "side.members", F.explode("side.members").alias("player_id_1"))
    pairs = s.select("duration", "net", "player_id_1", F.explode("members").alias("player_id_2")).filter("player_id_1 < player_id_2")
    return pairs.groupBy("player_id_1", "player_id_2").agg(F.sum("duration").alias("toi_seconds"), F.round(F.sum("net"), 6).alias("net_xg"), F.count("*").alias("stints"))


@query(after(STINTS, """SELECT player_id, partner_id, with_seconds, without_seconds, round(with_net * 3600 / with_seconds, 4) AS with_60, round(without_net * 3600 / without_seconds, 4) AS without_60 FROM (
  SELECT t.player_id, w.partner_id, w.d AS with_seconds, t.d - w.d AS without_seconds, round(w.n, 6) AS with_net, round(t.n - w.n, 6) AS without_net FROM (SELECT player_id, CAST(sum(duration) AS BIGINT) AS d, sum(sign * (home_xg - away_xg)) AS n FROM members GROUP BY 1) t
  JOIN (SELECT player_id, partner_id, CAST(sum(duration) AS BIGINT) AS d, sum(net) AS n FROM (SELECT player_id, duration, sign * (home_xg - away_xg) AS net, unnest(CASE WHEN sign = 1 THEN home_skaters ELSE away_skaters END) AS partner_id FROM members) WHERE partner_id <> player_id GROUP BY 1, 2) w USING (player_id)) WHERE with_seconds >= 300 AND without_seconds >= 300"""))
def c12_with_without(feed: Feed) -> DataFrame:
    m = P.player_stints(P.stints(P.filter_strength(P.lineups(feed), "5v5"))).withColumn("net", F.col("sign") * F.col("net_xg"))
    total = m.groupBy("player_id").agg(F.sum("duration").alias("d"), F.sum("net").alias("n"))
    mates = m.withColumn("partner_id", F.explode(F.when(F.col("sign") == 1, F.col("home_skaters")).otherwise(F.col("away_skaters")))).filter("partner_id <> player_id")
    both = mates.groupBy("player_id", "partner_id").agg(F.sum("duration").alias("with_seconds"), F.sum("net").alias("with_net"))
    out = both.join(total, "player_id").withColumn("without_seconds", F.col("d") - F.col("with_seconds")).filter("with_seconds >= 300 AND without_seconds >= 300")
    return out.select("player_id", "partner_id", "with_seconds", "without_seconds", F.round(S.rate_per(F.round("with_net", 6), F.col("with_seconds")), 4).alias("with_60"), F.round(S.rate_per(F.round(F.col("n") - F.col("with_net"), 6), F.col("without_seconds")), 4).alias("without_60"))


@query(after(STINTS, """SELECT season, trio, CAST(sum(duration) AS BIGINT) AS toi_seconds, round(sum(net), 6) AS net_xg, count(*) AS stints FROM (SELECT season, duration, home_xg - away_xg AS net, array_to_string(list_filter(home_skaters, lambda x: x % 100 < 20), ',') AS trio FROM stints UNION ALL SELECT season, duration, away_xg - home_xg, array_to_string(list_filter(away_skaters, lambda x: x % 100 < 20), ',') FROM stints) WHERE duration >= 30 GROUP BY 1, 2"""))
def d30_d31_line_combinations(feed: Feed) -> DataFrame:
    s = P.stints(P.filter_strength(P.lineups(feed), "5v5"))
    forwards = lambda side: _ids(F.filter(f"{side}_skaters", lambda p: p % 100 < 20))
    one = s.select("season", "duration", F.explode(F.array(F.struct(forwards("home").alias("trio"), F.col("net_xg").alias("net")), F.struct(forwards("away").alias("trio"), (-F.col("net_xg")).alias("net")))).alias("x"))
    return one.filter("duration >= 30").groupBy("season", "x.trio").agg(F.sum("duration").alias("toi_seconds"), F.round(F.sum("x.net"), 6).alias("net_xg"), F.count("*").alias("stints"))


@query(after(STINTS, "SELECT player_id, round(sum(duration / 5.0), 4) AS shared_seconds, round(sum(sign * (home_xg - away_xg) / 5.0), 6) AS shared_net FROM members GROUP BY 1"))
def d28_shared_possession(feed: Feed) -> DataFrame:
    m = P.player_stints(P.stints(P.filter_strength(P.lineups(feed), "5v5")))
    n = F.when(F.col("sign") == 1, F.size("home_skaters")).otherwise(F.size("away_skaters"))
    return m.groupBy("player_id").agg(F.round(F.sum(F.col("duration") / n), 4).alias("shared_seconds"), F.round(F.sum(F.col("sign") * F.col("net_xg") / n), 6).alias("shared_net"))


@query(after(LINEUPS, """SELECT player_id, CAST(sum(v) AS BIGINT) AS plus_minus, count(*) AS goals FROM (SELECT unnest(home_skaters) AS player_id, CASE WHEN event_team_id = home_team_id THEN 1 ELSE -1 END AS v FROM g UNION ALL SELECT unnest(away_skaters), CASE WHEN event_team_id = home_team_id THEN -1 ELSE 1 END FROM g) GROUP BY 1""").replace(" SELECT player_id, CAST(sum(v)", ", g AS (SELECT * FROM lineups WHERE event_type = 'GOAL' AND NOT (CASE WHEN event_team_id = home_team_id THEN len(home_skaters) > len(away_skaters) AND home_goalies > 0 ELSE len(away_skaters) > len(home_skaters) AND away_goalies > 0 END)) SELECT player_id, CAST(sum(v)"))
def d32_plus_minus(feed: Feed) -> DataFrame:
    home = F.col("event_team_id") == F.col("home_team_id")
    h, a = F.size("home_skaters"), F.size("away_skaters")
    advantage = F.when(home, (h > a) & (F.col("home_goalies") > 0)).otherwise((a > h) & (F.col("away_goalies") > 0))
    g = P.lineups(feed).filter("event_type = 'GOAL'").filter(~advantage)
    tag = lambda side, sign: F.transform(side, lambda p: F.struct(p.alias("player_id"), F.when(home, sign).otherwise(-sign).alias("v")))
    m = g.select(F.explode(F.concat(tag("home_skaters", 1), tag("away_skaters", -1))).alias("m"))
    return m.groupBy("m.player_id").agg(F.sum("m.v").alias("plus_minus"), F.count("*").alias("goals"))


@query(after(LINEUPS, "SELECT game_id, event_id, unnest(list_filter(CASE WHEN event_team_id = home_team_id THEN home_skaters ELSE away_skaters END, lambda x: x <> player_1_id)) AS player_id FROM lineups WHERE event_type = 'GOAL'"))
def d29_bystanders(feed: Feed) -> DataFrame:
    own = F.when(F.col("event_team_id") == F.col("home_team_id"), F.col("home_skaters")).otherwise(F.col("away_skaters"))
    return P.lineups(feed).filter("event_type = 'GOAL'").select("game_id", "event_id", F.explode(F.array_except(own, F.array("player_1_id"))).alias("player_id"))


@query(after(LINEUPS, "SELECT count(*) AS goals, count(*) FILTER (list_contains(CASE WHEN event_team_id = home_team_id THEN home_skaters ELSE away_skaters END, player_1_id)) AS scorer_on_ice FROM lineups WHERE event_type = 'GOAL'"))
def j3_j6_scorer_on_ice(feed: Feed) -> DataFrame:
    own = F.when(F.col("event_team_id") == F.col("home_team_id"), F.col("home_skaters")).otherwise(F.col("away_skaters"))
    return P.lineups(feed).filter("event_type = 'GOAL'").agg(F.count("*").alias("goals"), F.count_if(F.array_contains(own, F.col("player_1_id"))).alias("scorer_on_ice"))


@query(with_feed("""SELECT game_id, count(DISTINCT team_id) = 2 AS two_teams, min(n) >= 50 AND max(n) <= 600 AS shifts_in_range, CAST(min(n) AS BIGINT) AS fewest, CAST(max(n) AS BIGINT) AS most FROM (SELECT game_id, team_id, count(*) AS n FROM feed_shifts GROUP BY 1, 2) GROUP BY 1"""))
def j4_teams_and_shifts(feed: Feed) -> DataFrame:
    per_team = feed.shifts.groupBy("game_id", "team_id").agg(F.count("*").alias("n"))
    return per_team.groupBy("game_id").agg((F.count("*") == 2).alias("two_teams"), ((F.min("n") >= 50) & (F.max("n") <= 600)).alias("shifts_in_range"), F.min("n").alias("fewest"), F.max("n").alias("most"))


@query(with_feed("""SELECT player_id, game_id, period, start_seconds FROM (SELECT *, max(end_seconds) OVER (PARTITION BY game_id, period, player_id ORDER BY start_seconds, end_seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_end FROM feed_shifts) WHERE start_seconds < last_end - 2"""))
def e17_j2_overlapping_shifts(feed: Feed) -> DataFrame:
    w = Window.partitionBy("game_id", "period", "player_id").orderBy("start_seconds", "end_seconds").rowsBetween(Window.unboundedPreceding, -1)
    return feed.shifts.withColumn("_last", F.max("end_seconds").over(w)).filter("start_seconds < _last - 2").select("player_id", "game_id", "period", "start_seconds")


@query(with_feed("SELECT game_id, array_to_string(list_sort(list_filter(['FACEOFF', 'GOAL', 'HIT', 'PENALTY', 'SHOT'], lambda x: NOT list_contains(seen, x))), ',') AS missing FROM (SELECT game_id, list(DISTINCT event_type) AS seen FROM feed_events GROUP BY 1)"))
def j5_expected_types(feed: Feed) -> DataFrame:
    wanted = F.array(*map(F.lit, ("FACEOFF", "GOAL", "HIT", "PENALTY", "SHOT")))
    return feed.events.groupBy("game_id").agg(F.array_join(F.array_sort(F.array_except(wanted, F.collect_set("event_type"))), ",").alias("missing"))


@query(with_feed("SELECT team_id, period, CAST(sum(CASE WHEN n BETWEEN 3 AND 6 THEN 1 ELSE 0 END) AS BIGINT) AS good, count(*) AS seconds FROM (SELECT game_id, team_id, period, tick, count(*) AS n FROM (SELECT game_id, team_id, period, unnest(generate_series(start_seconds, end_seconds - 1)) AS tick FROM feed_shifts WHERE position <> 'G') GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"))
def j14_head_count(feed: Feed) -> DataFrame:
    n = J.tick_bucketize(feed.shifts.filter("position <> 'G'"), "start_seconds", "end_seconds", 1).groupBy("game_id", "team_id", "period", "tick").agg(F.count("*").alias("n"))
    return n.groupBy("team_id", "period").agg(F.sum(F.col("n").between(3, 6).cast("long")).alias("good"), F.count("*").alias("seconds"))


@query(after(STINTS, "SELECT game_id, count(*) AS stints, count(*) FILTER (duration < 2) AS short, count(*) FILTER (duration > 180) AS long, round(avg(CASE WHEN home_corsi + away_corsi = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_share, round(avg(duration), 6) AS mean_duration FROM stints GROUP BY 1"))
def j15_j16_stint_profile(feed: Feed) -> DataFrame:
    s = P.stints(P.filter_strength(P.lineups(feed), "5v5"))
    empty = F.when(F.col("home_corsi") + F.col("away_corsi") == 0, 1.0).otherwise(0.0)
    return s.groupBy("game_id").agg(F.count("*").alias("stints"), F.count_if(F.col("duration") < 2).alias("short"), F.count_if(F.col("duration") > 180).alias("long"), F.round(F.avg(empty), 6).alias("empty_share"), F.round(F.avg("duration"), 6).alias("mean_duration"))


@query(with_feed("""SELECT s.game_id, s.player_id, toi, seen, abs(toi - 60 * seen) <= 1200 AS close FROM (SELECT game_id, player_id, CAST(sum(end_seconds - start_seconds) AS BIGINT) AS toi FROM feed_shifts GROUP BY 1, 2) s JOIN (SELECT game_id, player_1_id AS player_id, count(*) AS seen FROM feed_events GROUP BY 1, 2) e USING (game_id, player_id)"""))
def j1_j23_toi_reconciliation(feed: Feed) -> DataFrame:
    toi = feed.shifts.groupBy("game_id", "player_id").agg(F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("toi"))
    seen = feed.events.groupBy("game_id", F.col("player_1_id").alias("player_id")).agg(F.count("*").alias("seen"))
    return toi.join(seen, ["game_id", "player_id"]).select("game_id", "player_id", "toi", "seen", (F.abs(F.col("toi") - 60 * F.col("seen")) <= 1200).alias("close"))


@query(with_feed("SELECT coalesce(e.game_id, s.game_id) AS game_id, coalesce(e.player_id, s.player_id) AS player_id, CASE WHEN e.player_id IS NOT NULL AND s.player_id IS NOT NULL THEN 'both' WHEN e.player_id IS NOT NULL THEN 'missing' ELSE 'extra' END AS status FROM (SELECT DISTINCT game_id, player_1_id AS player_id FROM feed_events) e FULL JOIN (SELECT DISTINCT game_id, player_id FROM feed_shifts) s ON e.game_id = s.game_id AND e.player_id = s.player_id"))
def c14_reconcile(feed: Feed) -> DataFrame:
    return J.reconcile(feed.events.select("game_id", F.col("player_1_id").alias("player_id")), feed.shifts, ["game_id", "player_id"])


@query(with_feed("SELECT player_id, max(position) AS position, min(game_id) AS first_game, max(game_id) AS last_game, count(DISTINCT game_id) AS games FROM feed_shifts GROUP BY 1"))
def d4_d37_player_dim(feed: Feed) -> DataFrame:
    return feed.shifts.groupBy("player_id").agg(F.max("position").alias("position"), F.min("game_id").alias("first_game"), F.max("game_id").alias("last_game"), F.count_distinct("game_id").alias("games"))


@query(with_feed("SELECT game_id, team_id, player_id FROM (SELECT game_id, team_id, player_id, sum(end_seconds - start_seconds) AS toi, count(*) AS n, count(DISTINCT period) AS p FROM feed_shifts GROUP BY 1, 2, 3) WHERE toi > 2400 AND n < 10 AND p >= 3"))
def d36_long_interval_role(feed: Feed) -> DataFrame:
    g = feed.shifts.groupBy("game_id", "team_id", "player_id").agg(F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("toi"), F.count("*").alias("n"), F.count_distinct("period").alias("p"))
    return g.filter("toi > 2400 AND n < 10 AND p >= 3").select("game_id", "team_id", "player_id")


@query(with_feed("SELECT g.season, e.player_1_id AS player_id, e.event_type, count(*) AS n FROM feed_events e JOIN feed_games g USING (game_id) GROUP BY 1, 2, 3"))
def d22_event_counts(feed: Feed) -> DataFrame:
    return feed.events.join(feed.games.select("game_id", "season"), "game_id").groupBy("season", F.col("player_1_id").alias("player_id"), "event_type").agg(F.count("*").alias("n"))


@query(with_feed("""SELECT season, team_id, count(*) AS games, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against, round(avg(CASE WHEN gf > ga THEN 1.0 ELSE 0.0 END), 6) AS win_share FROM (
  SELECT g.season, g.game_id, t.team_id, count(*) FILTER (e.event_type = 'GOAL' AND e.event_team_id = t.team_id) AS gf, count(*) FILTER (e.event_type = 'GOAL' AND e.event_team_id <> t.team_id) AS ga
  FROM feed_games g JOIN (SELECT game_id, home_team_id AS team_id FROM feed_games UNION ALL SELECT game_id, away_team_id FROM feed_games) t USING (game_id) JOIN feed_events e USING (game_id) GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def d24_f1_team_form(feed: Feed) -> DataFrame:
    goal, home = F.col("event_type") == "GOAL", F.col("event_team_id") == F.col("home_team_id")
    per_game = feed.events.join(feed.games, "game_id").groupBy("game_id", "season", "home_team_id", "away_team_id").agg(F.count_if(goal & home).alias("h"), F.count_if(goal & ~home).alias("a"))
    sides = F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("h").alias("gf"), F.col("a").alias("ga")), F.struct(F.col("away_team_id").alias("team_id"), F.col("a").alias("gf"), F.col("h").alias("ga")))
    one = per_game.select("season", F.explode(sides).alias("s")).select("season", "s.*")
    return one.groupBy("season", "team_id").agg(F.count("*").alias("games"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"), F.round(F.avg(F.when(F.col("gf") > F.col("ga"), 1.0).otherwise(0.0)), 6).alias("win_share"))


@query(with_feed("SELECT season, game_id, window_id FROM (SELECT season, game_id, unnest(generate_series(CAST(greatest(ceil((i - 5) / 2.0), 0) AS BIGINT), CAST(least(floor((i - 1) / 2.0), floor((n - 5) / 2.0)) AS BIGINT))) AS window_id FROM (SELECT season, game_id, row_number() OVER (PARTITION BY season ORDER BY game_id) AS i, count(*) OVER (PARTITION BY season) AS n FROM feed_games))"))
def e15_count_windows(feed: Feed) -> DataFrame:
    return A.count_windows(feed.games.select("season", "game_id"), ["season"], ["game_id"], 5, 2)


@query(with_feed("SELECT event_id, round(sqrt(dx * dx + y_coord * y_coord), 6) AS distance, round(CASE WHEN dx = 0 THEN pi() / 2 ELSE atan2(abs(y_coord), dx) END, 6) AS angle, CASE WHEN event_type = 'GOAL' THEN 1 ELSE 0 END::BIGINT AS type_goal, CASE WHEN event_type = 'SHOT' THEN 1 ELSE 0 END::BIGINT AS type_shot FROM (SELECT *, greatest(89 - abs(x_coord), 0) AS dx FROM feed_events WHERE xg IS NOT NULL)"))
def b8_b9_shot_features(feed: Feed) -> DataFrame:
    distance, angle = S.shot_geometry(F.col("x_coord"), F.col("y_coord"))
    return feed.events.filter("xg IS NOT NULL").select("event_id", F.round(distance, 6).alias("distance"), F.round(angle, 6).alias("angle"), *S.one_hot(F.col("event_type"), ["GOAL", "SHOT"], "type"))


_TICKS = """t AS (SELECT game_id, team_id, period, player_id, start_seconds, unnest(generate_series(CAST(ceil(start_seconds / 5.0) AS BIGINT) * 5, end_seconds - 1, 5)) AS tick FROM feed_shifts WHERE position <> 'G'),
sums AS (SELECT game_id, team_id, period, tick, sum(player_id % 17) AS s, count(*) AS n FROM t GROUP BY 1, 2, 3, 4)"""


@query(after(_TICKS, """SELECT a.game_id, a.team_id, a.period, a.player_id, a.start_seconds, round(avg(CASE WHEN o.n > 1 THEN (o.s - a.player_id % 17) / (o.n - 1) END), 6) AS mates, round(avg(x.s / x.n), 6) AS opponents
  FROM t a JOIN sums o USING (game_id, team_id, period, tick) LEFT JOIN sums x ON x.game_id = a.game_id AND x.period = a.period AND x.tick = a.tick AND x.team_id <> a.team_id GROUP BY 1, 2, 3, 4, 5"""))
def d17_d18_context(feed: Feed) -> DataFrame:
    """Ratings (here player_id % 17) of those around each shift: own side without oneself, and the other side."""
    ticks = J.tick_bucketize(feed.shifts.filter("position <> 'G'"), "start_seconds", "end_seconds", 5).withColumn("rating", F.col("player_id") % 17)
    sums = ticks.groupBy("game_id", "team_id", "period", "tick").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    other = sums.select("game_id", "period", "tick", F.col("team_id").alias("_t"), F.col("s").alias("os"), F.col("n").alias("on"))
    rows = ticks.join(sums, ["game_id", "team_id", "period", "tick"]).join(other, ["game_id", "period", "tick"], "left").filter("_t IS NULL OR _t <> team_id")
    mates = F.try_divide((F.col("s") - F.col("rating")).cast("double"), F.col("n") - 1)
    return rows.groupBy("game_id", "team_id", "period", "player_id", "start_seconds").agg(F.round(F.avg(mates), 6).alias("mates"), F.round(F.avg(F.col("os") / F.col("on")), 6).alias("opponents"))
