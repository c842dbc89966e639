"""Interval, as-of and pairing joins as equi-joins with a range predicate, or as windows where no join is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_event_join(intervals: DataFrame, events: DataFrame, keys: Sequence[str], start: str, end: str, at: str, how: str = "left", extra: Column | None = None) -> DataFrame:
    """Each interval with the events of its keys in [start, end). Columns of events other than keys come with it."""
    e = events.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    if extra is not None:
        on &= extra
    return intervals.join(e, on, how).drop(*[f"_{k}" for k in keys])


def interval_overlap_join(intervals: DataFrame, keys: Sequence[str], entity: str, start: str, end: str) -> DataFrame:
    """Pairs of entities of one key group whose intervals overlap by a positive length, the lesser first."""
    a, b = (intervals.select(*keys, F.col(entity).alias(f"{entity}_{i}"), F.col(start).alias(f"_s{i}"), F.col(end).alias(f"_e{i}")) for i in (1, 2))
    low, high = F.greatest("_s1", "_s2"), F.least("_e1", "_e2")
    pairs = a.join(b, list(keys)).filter((F.col(f"{entity}_1") < F.col(f"{entity}_2")) & (low < high))
    return pairs.select(*keys, f"{entity}_1", f"{entity}_2", low.alias("overlap_start"), high.alias("overlap_end"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str], how: str = "inner") -> DataFrame:
    """Each left row with the last right row at or before it: one sort by key and time, no range join."""
    took = F.struct(F.col(right_at), *values)
    side = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), took.alias("_value"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"))
    rows = left.select(*keys, F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(side.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_left"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = side.unionByName(rows).withColumn("_value", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    if how == "inner":
        out = out.filter(F.col("_value").isNotNull())
    return out.select("_left.*", F.col(f"_value.{right_at}").alias(f"asof_{right_at}"), *[F.col(f"_value.{v}").alias(v) for v in values])


def tick_bucketize(intervals: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """A row for each tick (a multiple of step) within [start, end); no timeline to join with."""
    first = F.ceil(F.col(start) / step).cast("long") * step
    ticks = F.when(first < F.col(end), F.sequence(first, F.col(end) - 1, F.lit(step).cast("long")))
    return intervals.withColumn("tick", F.explode(ticks))


#: Seconds of a bucket of the clock: events meet the intervals of their bucket, not those of a whole period.
BUCKET = 60


def _near(events: DataFrame, shifts: DataFrame, tolerance: int) -> DataFrame:
    """Each event with the shifts of its game and period that reach within `tolerance` of it. Shifts are dealt to all
    buckets of the clock that they reach; an event is in one, so no pair comes twice."""
    reach = F.sequence(F.floor((F.col("start_seconds") - tolerance) / BUCKET), F.floor((F.col("end_seconds") + tolerance) / BUCKET))
    s = shifts.filter("end_seconds >= start_seconds").select("game_id", "period", F.explode(reach).alias("_bucket"), "team_id", "player_id", "start_seconds", "end_seconds")
    e = events.select("game_id", "event_id", "period", "period_seconds", "player_1_id", F.floor(F.col("period_seconds") / BUCKET).alias("_bucket"))
    t = F.col("period_seconds")
    return e.join(s, ["game_id", "period", "_bucket"]).filter((F.col("start_seconds") <= t + tolerance) & (F.col("end_seconds") >= t - tolerance))


def on_ice_candidates(events: DataFrame, shifts: DataFrame, limit: int = 6, tolerances: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(game_id, event_id, team_id, player_id, member) of players near each event; see `on_ice`. Rows are dealt by game
    once, so what follows by game and event needs no shuffle."""
    widest = max(tolerances)
    t = F.col("period_seconds")
    required = F.coalesce(F.col("player_id") == F.col("player_1_id"), F.lit(False))
    rows = _near(events, shifts, widest).repartition("game_id")
    inside = [((F.col("start_seconds") < t + k) | ((F.col("start_seconds") <= t + k) & ((t == 0) | required))) & (F.col("end_seconds") >= t - k) for k in tolerances]
    margin = F.least(t - F.col("start_seconds"), F.col("end_seconds") - t)
    flags = [F.max(x).alias(f"in_{k}") for k, x in zip(tolerances, inside)]
    players = rows.groupBy("game_id", "event_id", "team_id", "player_id").agg(*flags, F.max(required).alias("required"), F.max(margin).alias("margin"))
    w = Window.partitionBy("game_id", "event_id", "team_id")
    counts = players.withColumns({f"n_{k}": F.sum(F.col(f"in_{k}").cast("int")).over(w) for k in tolerances})
    chosen = F.coalesce(*[F.when(F.col(f"n_{k}").between(1, limit), F.lit(k)) for k in tolerances])
    best = F.row_number().over(w.orderBy(F.desc(f"in_{widest}"), F.desc("required"), F.desc("margin"), "player_id"))
    member = F.lit(False)
    for k in tolerances:
        member |= (F.col("chosen") == k) & F.col(f"in_{k}")
    out = counts.withColumn("chosen", chosen).withColumn("best", best)
    member = F.coalesce(member, F.lit(False)) | (F.col("chosen").isNull() & F.col(f"in_{widest}") & (F.col("best") <= limit))
    return out.select("game_id", "event_id", "team_id", "player_id", member.alias("member"))


def on_ice(events: DataFrame, shifts: DataFrame, limit: int = 6, tolerances: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Who is on the ice for each team at each event: (game_id, event_id, team_id, player_id).

    A member of tolerance k has start < t + k (<= at t = 0, and for a player whom the event requires) and end >= t - k.
    The first tolerance whose set has 1 to `limit` members counts; where none has, the `limit` members of the widest are
    taken: required ones first, then by margin to the boundary."""
    return on_ice_candidates(events, shifts, limit, tolerances).filter("member").drop("member")


def within_tolerance(events: DataFrame, shifts: DataFrame, tolerance: int) -> DataFrame:
    """Distinct players with start <= t + tolerance and end >= t - tolerance."""
    return _near(events, shifts, tolerance).select("game_id", "event_id", "team_id", "player_id").distinct()


def lookahead_sum(rows: DataFrame, keys: Sequence[str], at: str, value: Column, seconds: int) -> Column:
    """Sum of value over rows of the same keys in (at, at + seconds]; a range frame, no join."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(1, seconds))


def first_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, seconds: int, order: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row of its keys in [left_at - seconds, left_at)."""
    r = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = (F.col(right_at) < F.col(left_at)) & (F.col(right_at) >= F.col(left_at) - seconds)
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    w = Window.partitionBy(*left.columns).orderBy(F.desc(right_at), *order)
    return left.join(r, on).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", *[f"_{k}" for k in keys])


def consecutive(df: DataFrame, entity: Sequence[str], order: str, within: Sequence[str], value: str) -> DataFrame:
    """Each row with its entity's value at the next *observed* step of its series (`within`)."""
    dense = F.dense_rank().over(Window.partitionBy(*within).orderBy(order))
    rows = df.select(*entity, *[c for c in within if c not in entity], order, F.col(value).alias("value"), dense.alias("_i"))
    w = Window.partitionBy(*dict.fromkeys([*within, *entity])).orderBy("_i")
    out = rows.withColumn("next_value", F.lead("value").over(w)).withColumn("_next", F.lead("_i").over(w))
    return out.filter(F.col("_next") == F.col("_i") + 1).drop("_i", "_next")


def side_pairs(rows: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """All ordered pairs of members of one side, from one row for each member; sides are lineups, so a few pairs."""
    lineup = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias("_l"))
    one = lineup.select(*keys, "_l", F.explode("_l").alias(f"{member}_1"))
    return one.select(*keys, f"{member}_1", F.explode("_l").alias(f"{member}_2")).filter(F.col(f"{member}_1") < F.col(f"{member}_2"))


def reconcile(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """both, missing or extra for each key of either side."""
    a = expected.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = present.select(*keys).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "missing").otherwise("extra")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"))


def latest_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given full order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)
