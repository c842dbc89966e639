"""Lineups, stints and their measures from the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isochron.functions.scalars import bucket_clamp, map_zone
from isochron.operators.joins import lookahead_sum, on_ice_candidates
from isochron.plans.feed import GAME_COLUMNS, Feed

SHOTS = ("SHOT", "MISSED_SHOT", "GOAL", "BLOCKED_SHOT")


def lineups(feed: Feed) -> DataFrame:
    """Each event with both sides' skaters (sorted arrays), goalie counts and the running score, its own goal included;
    the score counts goals at any strength, so it comes before any filter."""
    events = feed.events.withColumns({name: F.expr(x) for name, x in GAME_COLUMNS.items()})
    goalie = F.col("player_id") % 100 == 90
    sides = []
    for side in ("home", "away"):
        own = F.col("member") & (F.col("team_id") == F.expr(GAME_COLUMNS[f"{side}_team_id"]))
        sides += [F.array_sort(F.collect_set(F.when(own & ~goalie, F.col("player_id")))).alias(f"{side}_skaters"), F.count_if(own & goalie).alias(f"{side}_goalies")]
    ice = on_ice_candidates(events, feed.shifts).groupBy("game_id", "event_id").agg(*sides)
    empty = F.array().cast("array<bigint>")
    rows = running_score(events).join(ice, ["game_id", "event_id"], "left")
    return rows.select(
        "game_id", "season", "event_id", "period", "period_seconds", "event_type", "event_team_id", "home_team_id", "away_team_id", "zone_code", "player_1_id", "player_2_id", "player_3_id", "xg", "home_score", "away_score",
        *[F.coalesce(f"{s}_skaters", empty).alias(f"{s}_skaters") for s in ("home", "away")], *[F.coalesce(f"{s}_goalies", F.lit(0)).cast("long").alias(f"{s}_goalies") for s in ("home", "away")],
    )


def running_score(events: DataFrame) -> DataFrame:
    """Goals so far of each side, this row's included; a goal that isn't the home side's counts for the other."""
    w = Window.partitionBy("game_id").orderBy("period", "period_seconds", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    goal, home = F.col("event_type") == "GOAL", F.col("event_team_id") == F.col("home_team_id")
    return events.withColumns({"home_score": F.sum(F.when(goal & home, 1).otherwise(0)).over(w), "away_score": F.sum(F.when(goal & ~home, 1).otherwise(0)).over(w)})


def filter_strength(rows: DataFrame, strength: str) -> DataFrame:
    """5v5, pp (unequal sides of 3 to 5, both goalies in) or all."""
    h, a = F.size("home_skaters"), F.size("away_skaters")
    if strength == "5v5":
        return rows.filter((h == 5) & (a == 5))
    if strength == "pp":
        return rows.filter((h != a) & h.between(3, 5) & a.between(3, 5) & (F.col("home_goalies") > 0) & (F.col("away_goalies") > 0))
    return rows


def stint_ids(rows: DataFrame) -> DataFrame:
    """A stint ends when a lineup (as a set) or the period changes."""
    w = Window.partitionBy("game_id").orderBy("period", "period_seconds", "event_id")
    now = F.struct("period", "home_skaters", "away_skaters")
    changed = F.coalesce(F.lag(now).over(w) != now, F.lit(True))
    return rows.withColumn("stint_id", F.sum(changed.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: Seconds after an event in which its swing counts; xG of a high danger.
SWING_SECONDS, HIGH_DANGER = 10, 0.2

#: Measures of a side, in the order of the stints' columns. Swings: xG for less against in the seconds after an event.
MEASURES = (
    "corsi", "goals", "a1", "a2", "penalties", "xg", "xg_a1", "xg_a2", "hd_xg",
    "takeaway_swing", "giveaway_swing", "turnover_swing", "block_swing", "faceoff_swing",
)

_TRIGGERS = {"takeaway": "TAKEAWAY", "giveaway": "GIVEAWAY", "block": "BLOCKED_SHOT", "faceoff": "FACEOFF"}


def _with_swing(rows: DataFrame) -> DataFrame:
    """Adds swing: home less away xG of shots in the SWING_SECONDS after an event, seen from the event's side."""
    home = F.col("event_team_id") == F.col("home_team_id")
    side = lambda own: lookahead_sum(rows, ["game_id", "period"], "period_seconds", F.when(own, F.col("xg")), SWING_SECONDS)
    return rows.withColumn("swing", F.when(home, 1.0).otherwise(-1.0) * (F.coalesce(side(home), F.lit(0.0)) - F.coalesce(side(~home), F.lit(0.0))))


def stints(rows: DataFrame, period_length: int = 1200) -> DataFrame:
    """Measures of each side and their differences, start, duration, score state (the commonest running score of the
    stint's events, within two goals) and starting zone; stints without a duration go. Swings see the given rows only."""
    rows = _with_swing(stint_ids(rows))
    home, goal = F.col("event_team_id") == F.col("home_team_id"), F.col("event_type") == "GOAL"
    count = lambda test: F.when(test, 1).otherwise(0)
    part = lambda test: F.when(test, F.coalesce("xg", F.lit(0.0))).otherwise(0.0)
    first, second = goal & F.col("player_2_id").isNotNull(), goal & F.col("player_3_id").isNotNull()
    kinds = {"corsi": count(F.col("event_type").isin(*SHOTS)), "goals": count(goal), "a1": count(first), "a2": count(second), "penalties": count(F.col("event_type") == "PENALTY")}
    kinds |= {"xg": part(F.lit(True)), "xg_a1": part(first), "xg_a2": part(second), "hd_xg": part(F.col("xg") >= HIGH_DANGER)}
    kinds |= {f"{name}_swing": F.when(F.col("event_type") == kind, F.col("swing")).otherwise(0.0) for name, kind in _TRIGGERS.items()}
    kinds["turnover_swing"] = kinds["takeaway_swing"] + kinds["giveaway_swing"]
    sums = [F.sum(F.when(home if side == "home" else ~home, kinds[k]).otherwise(0)).alias(f"{side}_{k}") for k in MEASURES for side in ("home", "away")]
    order = F.struct("period_seconds", "event_id")
    state = bucket_clamp(F.col("home_score") - F.col("away_score"))
    faceoff = F.col("event_type") == "FACEOFF"
    out = rows.groupBy("game_id", "season", "stint_id", "period", "home_team_id", "away_team_id", "home_skaters", "away_skaters").agg(
        F.min("period_seconds").alias("start_seconds"), F.count("*").alias("n_events"), F.mode(state, True).alias("score_state"), F.min_by(F.when(faceoff, map_zone(F.col("zone_code"))), F.when(faceoff, order)).alias("zone"), *sums
    )
    ends = F.coalesce(F.lead("start_seconds").over(Window.partitionBy("game_id", "period").orderBy("stint_id")), F.lit(period_length))
    out = out.withColumn("duration", ends - F.col("start_seconds")).filter("duration > 0").withColumn("zone", F.coalesce("zone", F.lit("N")))
    net = {f"net_{k}": F.col(f"home_{k}") - F.col(f"away_{k}") for k in MEASURES}
    return out.withColumns(net).withColumn("net_finishing", F.col("net_goals") - F.col("net_xg"))


def player_stints(s: DataFrame) -> DataFrame:
    """A row for each skater of each stint, with sign +1 for the home side."""
    tag = lambda side, sign: F.transform(f"{side}_skaters", lambda p: F.struct(p.alias("player_id"), F.lit(sign).alias("sign")))
    return s.withColumn("m", F.explode(F.concat(tag("home", 1), tag("away", -1)))).select("*", "m.*").drop("m")


def top_net_xg(s: DataFrame, least: int = 200, top: int = 10) -> DataFrame:
    """Each season's best net xG an hour among skaters with `least` seconds."""
    own = player_stints(s).groupBy("season", "player_id").agg(F.sum("duration").alias("toi_seconds"), F.round(F.sum(F.col("sign") * F.col("net_xg")), 6).alias("net_xg"), F.count("*").alias("stints"))
    rated = own.filter(F.col("toi_seconds") >= least).withColumn("net_xg_60", F.round(F.col("net_xg") * 3600 / F.col("toi_seconds"), 6))
    rank = F.row_number().over(Window.partitionBy("season").orderBy(F.desc("net_xg_60"), "player_id")).cast("long")
    return rated.withColumn("rank", rank).filter(F.col("rank") <= top)
