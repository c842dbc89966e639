"""Profiles and checks: rules with reasons, grades, strength of rosters, timelines, signals and reconciliations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: Mapping[str, Column]) -> Column:
    """The texts of the rules that hold, in order, joined by "; "; empty where none does (a null is no)."""
    return F.concat_ws("; ", *[F.when(rule, F.lit(text)) for text, rule in rules.items()])


def grade(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first step (from the highest down) that the value reaches."""
    out = F.when(F.lit(False), F.lit(rest))
    for least, name in steps:
        out = out.when(value >= least, F.lit(name))
    return out.otherwise(rest)


def roster_strength(times: DataFrame, ratings: DataFrame, group: Sequence[str], entity: str, least_seconds: float) -> DataFrame:
    """Each group's time-weighted mean rating over members with enough time; members without a rating are left out."""
    own = times.filter(F.col("toi_seconds") >= least_seconds).join(ratings.select(entity, "rating"), entity)
    time = F.sum("toi_seconds")
    return own.groupBy(*group).agg(F.count("*").alias("members"), time.alias("toi_seconds"), (F.sum(F.col("toi_seconds") * F.col("rating")) / time).alias("strength"))


def team_rates(stints: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Each team's hours and net measures an hour: a stint counts for both its teams, with the sign of the side. Sums are
    of whole millionths and rates are cut to them, so that the order of addition can't show."""
    micro = lambda m, sign: (sign * F.round(F.col(f"net_{m}") * 1e6).cast("long")).alias(m)
    side = lambda team, sign: F.struct(F.col(team).alias("team_id"), *[micro(m, sign) for m in measures])
    both = stints.withColumn("o", F.explode(F.array(side("home_team_id", 1), side("away_team_id", -1)))).select("season", "duration", "o.*")
    seconds = F.sum("duration")
    return both.groupBy("season", "team_id").agg((seconds / 3600).alias("hours"), *[(F.floor(F.sum(m).cast("double") * 3600.0 / seconds) / 1e6).alias(f"{m}_60") for m in measures])


def timeline(history: DataFrame, forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History (keys, step, mean) and forecasts (keys, step, mean, variance) as one table, forecasts with 95 % bands."""
    reach = 1.96 * F.sqrt("variance")
    past = history.select(*keys, "step", F.lit("history").alias("kind"), "mean", F.col("mean").alias("low"), F.col("mean").alias("high"))
    ahead = forecasts.select(*keys, "step", F.lit("forecast").alias("kind"), "mean", (F.col("mean") - reach).alias("low"), (F.col("mean") + reach).alias("high"))
    return past.unionByName(ahead)


def signal(smoothed: DataFrame, filtered: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The smoothed value before the latest `order`, and the filtered one there; whichever exists where one is missing."""
    both = smoothed.select(*keys, F.col(value).alias("_s")).join(filtered.select(*keys, F.col(value).alias("_f")), list(keys), "full")
    latest = F.broadcast(both.agg(F.max(order).alias("_latest")))  # one row
    own = F.when(F.col(order) < F.col("_latest"), F.coalesce("_s", "_f")).otherwise(F.coalesce("_f", "_s"))
    return both.crossJoin(latest).select(*keys, own.alias("signal"))


def same_rows(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: rows of one side only (repeats counted), and whether there are none. Only counts by row are joined."""
    sides = one.select("*", F.lit(1).alias("_by")).unionByName(other.select("*", F.lit(-1).alias("_by")))
    left = sides.groupBy(*one.columns).agg(F.sum("_by").alias("_by"))
    extra, missing = (F.coalesce(F.sum(F.greatest(sign * F.col("_by"), F.lit(0))), F.lit(0)) for sign in (1, -1))
    return left.agg(extra.alias("extra"), missing.alias("missing")).withColumn("passed", F.expr("extra = 0 AND missing = 0"))


def mate_impact(stints: DataFrame, ratings: DataFrame, least_stint: int = 60, least_together: int = 600, margin: float = 0.05, steady: float = 0.0) -> DataFrame:
    """season, player_id, mates, boosted, hurt, avg_impact of rows (season, player_id, mates, duration, value): for each mate with
    enough time together in stints that last, the mean value together less the mate's own rating (season, player_id, off; 0 without one); how
    many lie above and below the margin, and the mean. Pairs come from lineups, so each stint has a few. `steady` is added before six decimals
    are kept, where sums of short decimals could lie on an edge."""
    rows = stints.filter(F.col("duration") >= least_stint).withColumn("mate_id", F.explode("mates")).filter("mate_id <> player_id")
    pairs = rows.groupBy("season", "player_id", "mate_id").agg(F.avg("value").alias("together"), F.sum("duration").alias("seconds")).filter(F.col("seconds") >= least_together)
    own = ratings.select("season", F.col("player_id").alias("mate_id"), "off")
    impact = F.round(F.col("together") - F.coalesce("off", F.lit(0.0)) + steady, 6)
    return pairs.join(own, ["season", "mate_id"], "left").withColumn("_i", impact).groupBy("season", "player_id").agg(
        F.count("*").alias("mates"), F.count_if(F.col("_i") > margin).alias("boosted"), F.count_if(F.col("_i") < -margin).alias("hurt"), F.avg("_i").alias("avg_impact")
    )
