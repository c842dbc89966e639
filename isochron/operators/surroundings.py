"""Ratings of those around each interval, its totals, how it starts, and what its ratings leave unexplained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochron.operators.joins import BUCKET, asof_join, tick_bucketize

#: Columns that `surroundings` adds.
AROUND = ("mate_off", "mate_def", "forward_mate_off", "defence_mate_def", "opponent_off", "opponent_def")


def rating_lookup(ratings: DataFrame, keys: Sequence[str], chain: Sequence[tuple[str, str]], last_resort: str) -> DataFrame:
    """keys, off, def, source of ratings (keys, metric_name, value): an entity's pair of metrics is the first of `chain`
    whose attack it has (a defence that is missing or null is 0); without any, the first metric by name that contains
    `last_resort` stands for both. Entities with none have no row. One aggregate, no join."""
    name, value = F.col("metric_name"), F.col("value")
    has = lambda metric: F.max(F.when(name == metric, F.coalesce(value, F.lit(0.0))))
    pairs = [F.struct(has(off).alias("off"), F.coalesce(has(defence), F.lit(0.0)).alias("def"), F.lit(off).alias("source")) for off, defence in chain]
    other = name.contains(last_resort)
    first = F.min(F.when(other, F.struct(name.alias("source"), F.coalesce(value, F.lit(0.0)).alias("off"))))
    pairs.append(F.struct(first["off"].alias("off"), first["off"].alias("def"), first["source"].alias("source")))
    rows = ratings.groupBy(*keys).agg(F.array(*pairs).alias("_pairs"))
    best = F.element_at(F.filter("_pairs", lambda p: p["off"].isNotNull()), 1)
    return rows.filter(F.exists("_pairs", lambda p: p["off"].isNotNull())).select(*keys, best["off"].alias("off"), best["def"].alias("def"), best["source"].alias("source"))


def start_state(shifts: DataFrame, events: DataFrame) -> DataFrame:
    """Adds score_state and zone_start: the score of the shift's side at the period's last event up to its start (null before
    the first), and the zone of the last faceoff at its very start, else F. `events` has home_score, away_score, home_team_id."""
    faceoff = F.when(F.col("event_type") == "FACEOFF", F.struct(F.col("period_seconds").alias("t"), F.col("zone_code").alias("zone")))
    so_far = Window.partitionBy("game_id", "period").orderBy("period_seconds", "event_id")
    at = lambda t, n: F.struct(F.col(t).cast("long").alias("t"), n.cast("long").alias("n"))
    marks = events.select("game_id", "period", at("period_seconds", F.col("event_id")).alias("_at"), (F.col("home_score") - F.col("away_score")).alias("_lead"), "home_team_id", F.last(faceoff, True).over(so_far).alias("_faceoff"))
    rows = shifts.withColumn("_start", at("start_seconds", F.lit(2**63 - 1)))
    rows = asof_join(rows, marks, ["game_id", "period"], "_start", "_at", ["_lead", "home_team_id", "_faceoff"], "left")
    lead = F.when(F.col("team_id") == F.col("home_team_id"), F.col("_lead")).otherwise(-F.col("_lead"))
    zone = F.when(F.col("_faceoff.t") == F.col("start_seconds"), F.col("_faceoff.zone"))
    return rows.withColumns({"score_state": lead, "zone_start": F.coalesce(zone, F.lit("F"))}).select(*shifts.columns, "score_state", "zone_start")


def shift_totals(shifts: DataFrame, shots: DataFrame) -> DataFrame:
    """Adds xgf, xga, cf, ca: the shots in [start, end) of each shift, for its side and against; 0 without any. Shifts meet the
    shots of the buckets of the clock that they reach, and are dealt by game, so what follows by game needs no shuffle.
    Equal shifts become one; those without a start or an end have no row."""
    last = F.greatest(F.col("start_seconds"), F.col("end_seconds") - 1)
    buckets = F.sequence(F.floor(F.col("start_seconds") / BUCKET), F.floor(last / BUCKET))
    s = shifts.withColumn("_bucket", F.explode(buckets))
    e = shots.select("game_id", "period", F.floor(F.col("period_seconds") / BUCKET).alias("_bucket"), F.col("period_seconds").alias("_t"), F.col("event_team_id").alias("_team"), F.coalesce("xg", F.lit(0.0)).alias("_xg"), F.col("event_id").alias("_event"))
    inside = (F.col("_t") >= F.col("start_seconds")) & (F.col("_t") < F.col("end_seconds"))
    rows = s.join(e, ["game_id", "period", "_bucket"], "left").repartition("game_id")
    own, other = inside & (F.col("_team") == F.col("team_id")), inside & (F.col("_team") != F.col("team_id"))
    shot = F.struct("_event", "_xg")
    events = lambda test: F.collect_set(F.when(test, shot))  # noqa: E731  a shift's few shots; a repeated shift's count once
    total = lambda shots: F.aggregate(F.array_sort(shots), F.lit(0.0), lambda x, y: x + y["_xg"])
    out = rows.groupBy(*shifts.columns).agg(events(own).alias("_own"), events(other).alias("_other"))
    return out.withColumns({"xgf": total(F.col("_own")), "xga": total(F.col("_other")), "cf": F.size("_own").cast("long"), "ca": F.size("_other").cast("long")}).drop("_own", "_other")


def surroundings(shifts: DataFrame, step: int = 5, least_seconds: int = 30) -> DataFrame:
    """Adds AROUND to shifts that have off, def (null: not rated) and position: at each tick the mean rating of the rated ones of
    the own side without oneself (of its forwards, of its defenders), and of the other side; then the mean over the ticks
    that have one; 0 without any, and for shifts that aren't rated. Shifts under `least_seconds` are seen by others, but have no
    row; `step` is at most `least_seconds`. Windows over one tick of one game (a dozen rows), no self-join."""
    forward, defender = F.col("position").isin("F", "C", "L", "R"), F.col("position") == "D"
    tick, side = Window.partitionBy("game_id", "period", "tick"), Window.partitionBy("game_id", "period", "tick", "team_id")
    rows = tick_bucketize(shifts.repartition("game_id"), "start_seconds", "end_seconds", step)

    def mates(value: str, test: Column | None = None) -> Column:
        x = F.col(value) if test is None else F.when(test, F.col(value))
        return F.try_divide(F.coalesce(F.sum(x).over(side), F.lit(0.0)) - F.coalesce(x, F.lit(0.0)), F.count(x).over(side) - x.isNotNull().cast("long"))

    def opponents(value: str) -> Column:
        x = F.col(value)
        return F.try_divide(F.sum(x).over(tick) - F.coalesce(F.sum(x).over(side), F.lit(0.0)), F.count(x).over(tick) - F.count(x).over(side))

    parts = (mates("off"), mates("def"), mates("off", forward), mates("def", defender), opponents("off"), opponents("def"))
    rows = rows.withColumns({f"_{name}": x for name, x in zip(AROUND, parts)}).filter(F.col("end_seconds") - F.col("start_seconds") >= least_seconds)
    rated = F.col("off").isNotNull()
    return rows.groupBy(*shifts.columns).agg(*[F.coalesce(F.avg(F.when(rated, F.col(f"_{name}"))), F.lit(0.0)).alias(name) for name in AROUND])


def residuals(rows: DataFrame) -> DataFrame:
    """Adds residual_for and residual_against: what was scored less the sum of the own rating, the mates' and the opponents'."""
    part = lambda *names: sum((F.coalesce(n, F.lit(0.0)) for n in names[1:]), F.coalesce(names[0], F.lit(0.0)))
    return rows.withColumns({"residual_for": F.col("xgf") - part("off", "mate_off", "opponent_def"), "residual_against": F.col("xga") - part("def", "mate_def", "opponent_off")})


def shift_context(shifts: DataFrame, events: DataFrame, shots: DataFrame, lookup: DataFrame, least_seconds: int = 30) -> DataFrame:
    """Shifts of `least_seconds` or more with their start, totals, surroundings, own rating and residuals."""
    rated = shifts.join(lookup, ["season", "player_id"], "left")
    return residuals(surroundings(shift_totals(start_state(rated, events), shots), least_seconds=least_seconds))
