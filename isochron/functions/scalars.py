"""Scalar functions over columns; all stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Event labels as the feed sends them, and their names here.
EVENT_LABELS = {
    "faceoff": "FACEOFF",
    "hit": "HIT",
    "giveaway": "GIVEAWAY",
    "goal": "GOAL",
    "shot-on-goal": "SHOT",
    "missed-shot": "MISSED_SHOT",
    "blocked-shot": "BLOCKED_SHOT",
    "penalty": "PENALTY",
    "stoppage": "STOPPAGE",
    "period-start": "PERIOD_START",
    "period-end": "PERIOD_END",
    "game-end": "GAME_END",
    "takeaway": "TAKEAWAY",
    "delayed-penalty": "DELAYED_PENALTY",
    "failed-shot-attempt": "FAILED_SHOT",
}


def clock_to_seconds(clock: Column) -> Column:
    """`MM:SS` as seconds; 0 for anything else."""
    parts = F.split(F.trim(clock), ":")
    minute, second = (F.try_element_at(parts, F.lit(i)).try_cast("long") for i in (1, 2))
    return F.when(F.size(parts) == 2, F.coalesce(minute * 60 + second, F.lit(0))).otherwise(0).cast("long")


def remaining_to_elapsed(period: Column, remaining: Column, length: int = 1200, overtime: int = 300) -> Column:
    return F.when(period <= 3, length).otherwise(overtime).cast("long") - remaining


def game_seconds(period: Column, seconds: Column, length: int = 1200) -> Column:
    return F.when(period > 0, (period - 1) * length + seconds).otherwise(0).cast("long")


def normalize_type(label: Column, labels: Mapping[str, str] = EVENT_LABELS) -> Column:
    """The mapped name; other labels in upper case."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(table[label], F.upper(label))


def bucket_clamp(x: Column, low: int = -2, high: int = 2) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def map_zone(code: Column, default: str = "N") -> Column:
    zone = F.upper(F.trim(code))
    return F.when(zone.isin("O", "D"), zone).otherwise(default)


def shot_geometry(x: Column, y: Column, goal: float = 89.0) -> tuple[Column, Column]:
    """Distance and angle to the goal line's middle."""
    dx = F.greatest(F.lit(goal) - F.abs(x), F.lit(0.0))
    return F.sqrt(dx * dx + y * y), F.when(dx == 0, F.lit(3.141592653589793 / 2)).otherwise(F.atan2(F.abs(y), dx))


def one_hot(value: Column, categories: Sequence[str], prefix: str) -> list[Column]:
    """A 0/1 column for each category; others and nulls give all zeros."""
    return [F.when(value == c, 1).otherwise(0).cast("long").alias(f"{prefix}_{c.lower()}") for c in categories]


def strength_label(home: Column, away: Column) -> Column:
    return F.concat(home.cast("string"), F.lit("v"), away.cast("string"))


def rate_per(value: Column, seconds: Column, per: int = 3600) -> Column:
    return F.try_divide(value * per, seconds)


#: Position codes of the two groups.
FORWARDS, DEFENCE = ("C", "LW", "RW", "F", "L", "R"), ("D", "LD", "RD")


def position_group(code: Column) -> Column:
    p = F.upper(F.trim(code))
    return F.when(p.isin(*FORWARDS), "F").when(p.isin(*DEFENCE), "D").otherwise("UNKNOWN")


def infer_position(position: Column, kill_defence: Column, power_offence: Column) -> Column:
    """The given group, else D where the one measure is over 1.5 times the other, else F."""
    return F.when(position.isin("F", "D"), position).when(kill_defence > 1.5 * power_offence, "D").otherwise("F")


def tier_label(x: Column, tiers: Sequence[tuple[float, str]], otherwise: str, above: bool = False) -> Column:
    """The first label whose threshold x reaches (or exceeds); thresholds fall."""
    out = None
    for threshold, label in tiers:
        hit = x > threshold if above else x >= threshold
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def _holds(parts: Sequence[str]):
    return lambda n: F.greatest(*[n.contains(p) for p in parts], F.lit(False))


def suggest_label(names: Column, rules: Sequence[tuple[Sequence[str], str]], otherwise: str) -> Column:
    """The first rule of which some name holds one of the parts."""
    out = None
    for parts, label in rules:
        hit = F.exists(names, _holds(parts))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def usage_strength(metric: Column) -> Column:
    return F.when(metric.contains("_pp_"), "pp").when(metric.contains("_pk_"), "pk").when(metric.contains("_5v5"), "5v5").otherwise("other")


def season_of_game(game: Column) -> Column:
    """`20232024` from an id like 2023020001."""
    year = F.substring(game.cast("string"), 1, 4).cast("int")
    return F.concat(year.cast("string"), (year + 1).cast("string"))


def keep_interval_type(kind: Column, regular: int = 517) -> Column:
    return kind.isNull() | (kind == regular)


def name_matches(name: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(F.lower(name), F.lit(p.lower()))
    return out
