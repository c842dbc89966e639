"""Ranks within few, large groups: by range partitions, their counts and local ranks, so that no task holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochron.sources.shared import stored


def range_ranks(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ()) -> DataFrame:
    """Adds position (from 1, by value and then `order`), rank_min (the least position of equal values), ties (rows of equal
    value) and total (rows of the group). Rows are dealt by range of keys and value, so equal values lie together; a
    partition's place in its group is the count of the partitions before it. Null values come first."""
    keys = list(keys)
    dealt = stored(df.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("total"))
    on = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = Window.partitionBy(*keys, "_p")
    rows = dealt.join(places, on).drop("_q", *[f"_k{i}" for i in range(len(keys))])
    rows = rows.withColumns({"position": F.col("_before") + F.row_number().over(local.orderBy(value, *order)), "rank_min": F.col("_before") + F.rank().over(local.orderBy(value)), "ties": F.count("*").over(Window.partitionBy(*keys, "_p", value))})
    return rows.drop("_p", "_before")


def average_rank_pct() -> Column:
    """Of ranked rows: the mean position of equal values as a share of the group."""
    return (F.col("rank_min") + (F.col("ties") - 1) / 2) / F.col("total")


def ntile(n: int) -> Column:
    """Of ranked rows: which of n parts a position falls in; the first parts take what is left over."""
    size, more = F.floor(F.col("total") / n), F.col("total") % n
    edge = more * (size + 1)
    place = F.col("position") - 1
    return F.when(place < edge, F.floor(place / (size + 1))).otherwise(more + F.floor((place - edge) / F.greatest(size, F.lit(1)))).cast("int") + 1


def category_scores(long: DataFrame, keys: Sequence[str], group: str, categories: Mapping[str, Sequence[str]], lower_is_better: Sequence[str] = (), least: int = 10) -> DataFrame:
    """keys, group, suffix, category, score, percentile of long rows (keys, group, suffix, metric_name, value).

    A metric's z-score is within its group, with the sample deviation, sign changed where lower is better, 0 where all are
    equal; metrics with fewer than `least` values in a group have none. A category's score is the mean of the z-scores that
    its key has, 0 without any; its percentile is the average rank within the group, times 100. Means and deviations are
    aggregates (a row for each group, suffix and metric, which are given), and ranks go by range, so no group meets in a task."""
    table = [(c, m) for c, own in categories.items() for m in own]
    mapping = long.sparkSession.createDataFrame(table, "category string, metric_name string")
    stats = long.groupBy(group, "suffix", "metric_name").agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")).filter(F.col("_n") >= least)
    sign = F.when(F.col("metric_name").isin(*lower_is_better), -1.0).otherwise(1.0) if lower_is_better else F.lit(1.0)
    z = F.when(F.col("_s") > 0, sign * (F.col("value") - F.col("_m")) / F.col("_s")).when(F.col("value").isNotNull(), 0.0)
    scored = long.join(F.broadcast(stats), [group, "suffix", "metric_name"]).withColumn("_z", z).join(F.broadcast(mapping), "metric_name")
    scored = scored.groupBy(*keys, group, "suffix", "category").agg(F.coalesce(F.avg("_z"), F.lit(0.0)).alias("score"))
    everyone = long.select(*keys, group, "suffix").distinct().crossJoin(F.broadcast(mapping.select("category").distinct()))
    whole = everyone.join(scored, [*keys, group, "suffix", "category"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    ranked = range_ranks(whole, [group, "suffix", "category"], "score")
    return ranked.select(*keys, group, "suffix", "category", "score", (100 * average_rank_pct()).alias("percentile"))
