"""Profiles of entities as one row each: category scores with trends, a text, checks, and nested JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isochron.operators.aggregates import half_split_trend
from isochron.operators.profile import grade

#: Words for percentiles and for trends, from the highest down; a percentile from which a category is a strength.
LEVELS, LOWEST_LEVEL = ((95, "elite"), (85, "excellent"), (70, "above-average"), (30, "average"), (15, "below-average")), "poor"
TRENDS = ((0.5, "improving significantly"), (0.2, "trending upward"))
FALLS = ((0.5, "declining significantly"), (0.2, "trending downward"))
STRENGTH, TOP = 70, 85


def category_trends(scores: DataFrame, entity: Sequence[str], order: str) -> DataFrame:
    """Adds trend to scores (entity, order, suffix, category, score): the mean of the later half of an entity's seasons less that
    of the earlier half, on each of its rows; null for one season."""
    return half_split_trend(scores, [*entity, "suffix", "category"], order, "score")


def cards(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, categories: of long rows (keys, suffix, category, percentile, trend) a map from category to its actual and signal
    percentile and the signal's trend. A key has as many entries as there are categories; of equal rows the highest stands."""
    of = lambda suffix, value: F.max(F.when(F.col("suffix") == suffix, F.col(value)))
    one = scores.filter(F.col("category").isNotNull()).groupBy(*keys, "category").agg(of("actual", "percentile").alias("actual"), of("signal", "percentile").alias("signal"), of("signal", "trend").alias("trend"))
    entries = F.array_sort(F.collect_list(F.struct("category", F.struct("actual", "signal", "trend").alias("value"))))
    return one.groupBy(*keys).agg(F.map_from_entries(entries).alias("categories"))


def level(percentile: Column) -> Column:
    """The word for a percentile; average where it's null."""
    return F.when(percentile.isNull(), "average").otherwise(grade(percentile, LEVELS, LOWEST_LEVEL))


def trend_text(trend: Column) -> Column:
    """The words for a trend; null where it's null or small."""
    out = F.when(trend.isNull(), F.lit(None).cast("string"))
    for least, text in TRENDS:
        out = out.when(trend > least, text)
    for least, text in FALLS:
        out = out.when(trend < -least, text)
    return out


def narrative(name: Column, noun: Column, archetype: Column, strengths: Mapping[str, str], similar: Column, regression: Column, breakout: Column) -> Column:
    """Up to three sentences on a card: what an entity is and is good at (`strengths`: category to words, the first two
    categories being attack and defence), whom it resembles (an array of names), and its flag's reason, or else the trends of
    attack and defence. A percentile that is missing counts as 50, an archetype as `player`, an empty reason as no flag."""
    value = lambda category, field: F.col("categories")[category][field]
    pct = lambda category: F.coalesce(value(category, "signal"), F.lit(50.0))
    attack, defence = list(strengths)[:2]
    high = lambda least: [pct(c) >= least for c in (attack, defence)]
    (off, back), (some_off, some_back) = high(TOP), high(STRENGTH)
    kinds = ((off & back, "an elite two-way "), (off, "an elite offensive "), (back, "an elite defensive "), (some_off & some_back, "a well-rounded "), (some_off, "an offensive "), (some_back, "a defensive "))
    kind = F.when(F.lit(False), F.lit(""))
    for test, text in kinds:
        kind = kind.when(test, F.concat(F.lit(text), noun))
    kind = kind.otherwise(F.concat(F.lit("a "), F.coalesce(archetype, F.lit("player"))))
    own = [F.when(pct(c) >= STRENGTH, F.struct(F.lit(text).alias("text"), level(pct(c)).alias("level"))) for c, text in strengths.items()]
    strong = F.array_compact(F.array(*own))
    n = F.size(strong)
    good = F.when(n == 0, "").when(n == 1, F.concat(F.lit(" with "), strong[0]["level"], F.lit(" "), strong[0]["text"]))
    good = good.otherwise(F.concat(F.lit(", strong in "), F.array_join(F.transform(F.slice(strong, 1, 3), lambda x: x["text"]), ", ")))
    alike = F.when(F.size(similar) > 0, F.concat(F.lit(" Comparable to "), F.array_join(F.slice(similar, 1, 2), " and "), F.lit(".")))
    up, down = trend_text(value(attack, "trend")), trend_text(value(defence, "trend"))
    moves = F.concat_ws(", ", F.concat(F.lit("offense is "), up), F.concat(F.lit("defense is "), down))
    flag = F.when(regression != "", F.concat(F.lit(" Regression candidate: "), regression, F.lit("."))).when(breakout != "", F.concat(F.lit(" Breakout candidate: "), breakout, F.lit(".")))
    flag = flag.when(moves != "", F.concat(F.lit(" Lately "), moves, F.lit(".")))
    return F.concat(name, F.lit(" is "), kind, good, F.lit("."), F.coalesce(alike, F.lit("")), F.coalesce(flag, F.lit("")))


def first_rule(rules: Sequence[tuple[str, Column]], rest: Column) -> Column:
    """The name of the first rule that holds (a null doesn't), else `rest`."""
    out = F.when(F.lit(False), F.lit(""))
    for name, test in rules:
        out = out.when(test, F.lit(name))
    return out.otherwise(rest)


def card_checks(profiles: DataFrame, required: Sequence[str], categories: Sequence[str], groups: Sequence[str], peers: DataFrame, entity: str) -> DataFrame:
    """check, failures, passed: rows without a required column's value (all rows, where the column is missing), percentiles beyond
    0 to 100, rows without one of `categories`, groups out of `groups`, and peers (entity, peer_id) of another group than the
    entity's or without a profile. An empty table passes."""
    missing = [F.lit(True) if c not in profiles.columns else F.col(c).isNull() for c in required]
    lacks = lambda tests: F.coalesce(F.count_if(F.coalesce(F.greatest(*tests) if len(tests) > 1 else tests[0], F.lit(False))), F.lit(0))
    beyond = lambda v: F.coalesce(~v["actual"].between(0, 100), F.lit(False)) | F.coalesce(~v["signal"].between(0, 100), F.lit(False))
    own = profiles.agg(
        lacks(missing).alias("required"), F.count_if(F.exists(F.map_values("categories"), beyond)).alias("percentiles"),
        F.count_if(~F.coalesce(F.forall(F.array(*map(F.lit, categories)), lambda c: F.map_contains_key("categories", c)), F.lit(False))).alias("categories"),
        F.count_if(~F.coalesce(F.col("side").isin(*groups), F.lit(False))).alias("groups"),
    )
    side = profiles.select(F.col(entity).alias("_e"), F.col("side").alias("_s")).distinct()
    both = peers.join(side, F.col(entity) == F.col("_e")).withColumnRenamed("_s", "_own").drop("_e").join(side, F.col("peer_id") == F.col("_e"), "left")
    alike = both.agg(F.count_if(~F.coalesce(F.col("_own") == F.col("_s"), F.lit(False))).alias("similarity"))
    rows = own.unpivot([], own.columns, "check", "failures").unionByName(alike.unpivot([], ["similarity"], "check", "failures"))
    return rows.withColumn("passed", F.col("failures") == 0)


def nested(profiles: DataFrame) -> Column:
    """A profile as nested JSON: its columns, categories with nulls left out, trends (of the categories that have one), and flags
    that are set. Fields keep their order, so that equal profiles have equal texts."""
    known = F.map_filter("categories", lambda _, v: v["actual"].isNotNull() | v["signal"].isNotNull())
    short = F.transform_values(known, lambda _, v: F.struct(F.round(v["actual"], 1).alias("actual"), F.round(v["signal"], 1).alias("signal")))
    trends = F.transform_values(F.map_filter("categories", lambda _, v: v["trend"].isNotNull()), lambda _, v: F.round(v["trend"], 3))
    flags = F.struct(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("regression", "breakout") if c in profiles.columns])
    rest = [c for c in profiles.columns if c not in ("categories", "regression", "breakout")]
    return F.to_json(F.struct(*rest, short.alias("categories"), trends.alias("trends"), flags.alias("flags")))


def read_nested(texts: DataFrame, column: str, like: DataFrame) -> DataFrame:
    """What `nested` wrote of profiles such as `like`, as columns again. Written and read back by way of the shared folder, so
    that the texts are whole lines of a file."""
    from isochron.sources.shared import shared_folder

    rest = [f for f in like.schema.fields if f.name not in ("categories", "regression", "breakout")]
    nested = "categories map<string, struct<actual: double, signal: double>>, trends map<string, double>, flags struct<regression: string, breakout: string>"
    folder = shared_folder(texts.sparkSession)
    texts.select(column).write.text(folder)
    return texts.sparkSession.read.schema(StructType([*rest, *StructType.fromDDL(nested).fields])).json(folder)
