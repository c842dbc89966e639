"""Conditional scores of entities from rows of context, and comparisons of rated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.operators.aggregates import weighted_mean, zscore

#: Quantiles of a season's rows from which an opponent counts as strong, and mates as strong or weak.
OPPONENT_HIGH, OPPONENT_LOW, MATE_HIGH, MATE_LOW = 0.8, 0.2, 0.75, 0.25

#: Flag, column, quantile, and whether a row must reach it or stay under it.
FLAGS = (
    ("shutdown", "opponent_off", OPPONENT_HIGH, True),
    ("breaker", "opponent_def", OPPONENT_LOW, False),
    ("mates_high", "mate_off", MATE_HIGH, True),
    ("mates_low", "mate_off", MATE_LOW, False),
    ("twoway_high", "mate_def", MATE_HIGH, True),
    ("twoway_low", "mate_def", MATE_LOW, False),
)

SCORES = ("shutdown", "breaker", "clutch_against", "clutch_for", "psi", "psi_twoway", "elasticity")


def context_flags(rows: DataFrame) -> DataFrame:
    """Rows with time, each with its flags against its season's quantiles; a season has one row of thresholds."""
    marks = rows.groupBy("season").agg(*[F.percentile(column, F.lit(q)).alias(f"_{name}") for name, column, q, _ in FLAGS])
    flags = {name: (F.col(column) >= F.col(f"_{name}")) if up else (F.col(column) <= F.col(f"_{name}")) for name, column, _, up in FLAGS}
    out = rows.filter("duration_seconds > 0").join(marks, "season").withColumns(flags | {"clutch": F.abs("score_state") <= 1})
    return out.drop(*[f"_{name}" for name, *_ in FLAGS])


def conditional_scores(flagged: DataFrame, least_seconds: float) -> DataFrame:
    """Time-weighted residuals under each flag, their spread and slope, for entities with enough time in a season; and
    z-scores within the season. A slope asks for ten rows and for mates that aren't all rated alike, else it's 0."""
    time = F.col("duration_seconds")

    def mean(value: str, flag: str, sign: int = 1) -> Column:
        return F.coalesce(weighted_mean(sign * F.col(value), time, F.col(flag)), F.lit(0.0))

    out = flagged.groupBy("season", "player_id").agg(
        F.count("*").alias("shifts"), F.sum(time).alias("toi_seconds"), F.count_if("shutdown").alias("n_shutdown"),
        mean("residual_against", "shutdown", -1).alias("shutdown"),
        F.coalesce(F.stddev_samp(F.when(F.col("shutdown"), F.col("residual_against"))), F.lit(0.0)).alias("consistency"),
        mean("residual_for", "breaker").alias("breaker"), mean("residual_against", "clutch", -1).alias("clutch_against"),
        mean("residual_for", "clutch").alias("clutch_for"), mean("residual_for", "mates_high").alias("psi_up"),
        mean("residual_for", "mates_low").alias("psi_floor"), mean("residual_against", "twoway_high").alias("twoway_up"),
        mean("residual_against", "twoway_low").alias("twoway_floor"),
        F.when((F.count("residual_for") >= 10) & (F.min("mate_off") < F.max("mate_off")), F.coalesce(F.regr_slope("residual_for", "mate_off"), F.lit(0.0))).otherwise(0.0).alias("elasticity"),
    )
    out = out.filter(F.col("toi_seconds") >= least_seconds)
    out = out.withColumn("psi", F.col("psi_up") - F.col("psi_floor")).withColumn("psi_twoway", F.col("twoway_floor") - F.col("twoway_up"))
    return out.withColumns({f"{name}_z": zscore(F.col(name), "season") for name in SCORES})


def partners(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Each pair from either side: entity, partner and the other columns."""
    rest = [c for c in pairs.columns if c not in (one, other)]
    sides = F.explode(F.array(F.struct(F.col(one).alias("entity"), F.col(other).alias("partner")), F.struct(F.col(other).alias("entity"), F.col(one).alias("partner"))))
    return pairs.select(sides.alias("_side"), *rest).select("_side.entity", "_side.partner", *rest)


def golden_difference(new: DataFrame, golden: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: rows in both, correlation, greatest difference, and whether they agree."""
    both = new.select(*keys, F.col(value).alias("_new")).join(golden.select(*keys, F.col(value).alias("_old")), list(keys))
    out = both.agg(F.count("*").alias("n"), F.corr("_new", "_old").alias("r"), F.max(F.abs(F.col("_new") - F.col("_old"))).alias("most"))
    return out.withColumn("passed", F.coalesce((F.col("r") > 0.99) & (F.col("most") < 0.001), F.lit(False)))


def shares(df: DataFrame, group: Sequence[str], value: str, weight: Column) -> Column:
    """Each positive weighted value's share of its group's; all alike where none is positive."""
    from pyspark.sql import Window

    own = F.greatest(F.col(value), F.lit(0.0)) * weight
    w = Window.partitionBy(*group)
    return F.when(F.sum(own).over(w) > 0, own / F.sum(own).over(w)).otherwise(1 / F.count("*").over(w))
