"""Gates between stages: checks with verdicts and reasons for each game, lineage records, and scores that fill gaps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The modulus of fingerprints, a prime, so that sums stay whole numbers of 18 digits.
_PRIME = 999_999_999_999_999_989


def plus_minus_gate(computed: DataFrame, official: DataFrame, keys: Sequence[str], entity: str, value: str, most: int = 2) -> DataFrame:
    """A row for each key: entities compared, unequal ones, the maximal difference, passed and reason. An entity of one
    side only counts as 0 on the other; a key of one side only fails."""
    a = computed.select(*keys, entity, F.col(value).alias("_a"))
    b = official.select(*keys, entity, F.col(value).alias("_b"))
    both = a.join(b, [*keys, entity], "full")
    off = F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)))
    rows = both.groupBy(*keys).agg(F.count("*").alias("entities"), F.count_if(off > 0).alias("unequal"), F.max(off).alias("max_diff"), F.count("_a").alias("_own"), F.count("_b").alias("_given"))
    reason = F.when(F.col("_given") == 0, "no official rows").when(F.col("_own") == 0, "no computed rows").when(F.col("max_diff") > most, F.concat(F.lit("difference of "), F.col("max_diff").cast("string")))
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull()).drop("_own", "_given")


def verdicts(checks: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """keys, passed and reasons (`check: reason; ...` in the checks' order) of checks that each have keys, passed, reason. A
    key that a check doesn't have isn't judged by it."""
    rows = None
    for i, (name, df) in enumerate(checks):
        own = df.select(*keys, F.lit(i).alias("_i"), F.col("passed").alias("_ok"), F.concat(F.lit(f"{name}: "), F.coalesce("reason", F.lit("failed"))).alias("_why"))
        rows = own if rows is None else rows.unionByName(own)
    why = F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.struct("_i", "_why"))))
    return rows.groupBy(*keys).agg(F.bool_and("_ok").alias("passed"), F.concat_ws("; ", F.transform(why, lambda x: x["_why"])).alias("reasons"))


def only_passed(df: DataFrame, verdict: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has passed; keys without a verdict haven't."""
    return df.join(verdict.filter("passed").select(*keys), list(keys), "left_semi")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n and hash of a table as a multiset, whatever the order of its rows, columns and partitions. Two sums of
    different hashes of the rows, each modulo a prime; a row that stands twice counts twice."""
    columns = sorted(df.columns)
    one, two = (F.pmod(F.xxhash64(*[F.lit(salt), *[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns]]), F.lit(_PRIME)).cast("decimal(38,0)") for salt in (1, 2))
    total = lambda x: F.coalesce(F.sum(x) % _PRIME, F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", F.lit(",".join(columns)), total(one), total(two)).alias("hash"))


def lineage(df: DataFrame, stage: str, parameters: str, seconds: float) -> DataFrame:
    """A record of a stage's result, to be appended to the log: stage, parameters, seconds, n, hash."""
    return fingerprint(df).select(F.lit(stage).alias("stage"), F.lit(parameters).alias("parameters"), F.lit(float(seconds)).alias("seconds"), "n", "hash")


def backfill_null(df: DataFrame, column: str, scorer: Callable[[DataFrame], DataFrame], overwrite: bool = False) -> DataFrame:
    """df with `column` filled by `scorer` (which returns the rows that it's given with that column set) where it's null, or
    everywhere. Rows that have a value never meet the scorer."""
    if overwrite:
        return scorer(df).select(*df.columns)
    return df.filter(F.col(column).isNotNull()).unionByName(scorer(df.filter(F.col(column).isNull())).select(*df.columns))


def head_count(rows: DataFrame, keys: Sequence[str], home: Column, away: Column, each: int) -> DataFrame:
    """keys, n, passed, reason: whether all rows of a key have `each` different members on both sides."""
    right = (F.size(F.array_distinct(home)) == each) & (F.size(F.array_distinct(away)) == each) & (F.size(F.array_intersect(home, away)) == 0)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~right).alias("_bad"))
    return out.select(*keys, "n", (F.col("_bad") == 0).alias("passed"), F.when(F.col("_bad") > 0, F.concat(F.col("_bad").cast("string"), F.lit(" rows"))).alias("reason"))


def spot_checks(rated: DataFrame, context: DataFrame, scores: DataFrame, mean: float = 0.5, spread: tuple[float, float] = (0.3, 5.0), least_r: float = 0.6, reliable: int = 50, share: float = 0.1) -> DataFrame:
    """check, value, passed before a long run. Of `rated` (value, other): mean near 0, deviation within `spread`, quantiles in
    order, correlation of the two. Of `context` (zone_start, score_state): the share of each zone, which must all occur, and of level and close
    scores. Of `scores` (shifts): the share of rows with `reliable` shifts. What an empty table can't tell has failed."""
    low, middle, high = (F.percentile("value", F.lit(q)) for q in (0.05, 0.5, 0.95))
    of = lambda test: F.try_divide(F.count_if(test).cast("double"), F.count("*"))
    zones = [of(F.col("zone_start") == z).alias(f"zone {z}") for z in ("O", "D", "N")]
    tables = (
        rated.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), low.alias("p05"), middle.alias("p50"), high.alias("p95"), F.corr("value", "other").alias("correlation")),
        context.agg(*zones, of(F.col("score_state") == 0).alias("score level"), of(F.abs("score_state") == 1).alias("score by one")),
        scores.agg(of(F.col("shifts") >= reliable).alias("reliable")),
    )
    rows = None
    for table in tables:
        own = table.unpivot([], table.columns, "check", "value")
        rows = own if rows is None else rows.unionByName(own)
    name, value = F.col("check"), F.col("value")
    passed = F.when(name == "mean", F.abs(value) <= mean).when(name == "deviation", (value > spread[0]) & (value < spread[1])).when(name == "correlation", value >= least_r)
    passed = passed.when(name == "reliable", value >= share).when(name.startswith("p"), value.isNotNull()).otherwise(value > 0)
    return rows.withColumn("passed", F.coalesce(passed, F.lit(False)))
