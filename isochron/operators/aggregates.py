"""Aggregates, window measures and set operations, by column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column, flag: Column | None = None) -> Column:
    """Sum of value * weight over sum of weight, over flagged rows; 0 where there are none."""
    if flag is not None:
        value, weight = F.when(flag, value), F.when(flag, weight)
    weight = F.when(value.isNotNull(), weight)
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))


def slope(y: Column, x: Column, least: int = 10) -> Column:
    """Regression slope, 0 under `least` pairs."""
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= least, F.coalesce(F.regr_slope(y, x), F.lit(0.0))).otherwise(0.0)


def slope_error(y: Column, x: Column) -> Column:
    """Standard error of the slope, from moments; null under three pairs."""
    n = F.regr_count(y, x)
    rest = F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)
    return F.when((n > 2) & (F.regr_sxx(y, x) > 0), F.sqrt(F.greatest(rest, F.lit(0.0)) / (n - 2) / F.regr_sxx(y, x)))


def bias_corrected_moments(x: Column) -> tuple[Column, Column]:
    """Sample skewness and excess kurtosis with the usual small-sample corrections."""
    n = F.count(x).cast("double")
    skew = F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
    kurtosis = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
    return skew, kurtosis


def correlations(long: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Correlation of each pair of names over the keys that have both: one self-join and one aggregate."""
    a = long.select(*keys, F.col(name).alias("name_1"), F.col(value).alias("_x"))
    b = long.select(*keys, F.col(name).alias("name_2"), F.col(value).alias("_y"))
    pairs = a.join(b, list(keys)).filter("name_1 < name_2")
    return pairs.groupBy("name_1", "name_2").agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("r"))


def zscore(x: Column, *partition: str) -> Column:
    """0 where the deviation is 0 or null."""
    w = Window.partitionBy(*partition)
    sd = F.stddev_samp(x).over(w)
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((x - F.avg(x).over(w)) / sd)


def rank_pct(x: Column, *partition: str) -> Column:
    """Percentile by mean rank of ties; null gives 50."""
    w = Window.partitionBy(*partition)
    n = F.count(x).over(w)
    low = F.rank().over(w.orderBy(x.asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*partition, x))
    return F.when(x.isNull(), 50.0).otherwise((low + (ties - 1) / 2) / n * 100)


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the columns that aren't null; 0 where all are."""
    kept = F.filter(F.array(*columns), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept)).otherwise(0.0)


def half_split_trend(df: DataFrame, entity: Sequence[str], order: str, value: str) -> DataFrame:
    """Mean of the second half less mean of the first (n // 2 rows), on every row; null for a single one."""
    w = Window.partitionBy(*entity)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    trend = F.avg(F.when(~first, F.col(value))).over(w) - F.avg(F.when(first, F.col(value))).over(w)
    return rows.withColumn("trend", F.when(F.col("_n") > 1, trend)).drop("_i", "_n")


def count_windows(members: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, stride: int) -> DataFrame:
    """(keys, window_id, member rows): whole windows of `size` members, one each `stride`; no self-join."""
    w = Window.partitionBy(*keys)
    rows = members.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    low = F.greatest(F.ceil((F.col("_i") - size) / stride), F.lit(0))
    high = F.least(F.floor((F.col("_i") - 1) / stride), F.floor((F.col("_n") - size) / stride))
    return rows.filter(low <= high).withColumn("window_id", F.explode(F.sequence(low.cast("long"), high.cast("long")))).drop("_i", "_n")


def window_blocks(members: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, stride: int) -> DataFrame:
    """The windows of `count_windows` in blocks of neighbours: (keys, member rows, place, block, first, last) for each block that has
    windows with a member. A window has the `size` places after window_id * stride; first and last are its block's windows.
    A block's windows reach over four times `size` places, so a member is in 1.25 blocks on average at most."""
    w, each = Window.partitionBy(*keys), max(4 * size // stride, 1)
    rows = members.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("_n", F.count("*").over(w))
    end = F.floor((F.col("_n") - size) / stride)
    low = F.greatest(F.ceil((F.col("place") - size) / stride), F.lit(0))
    high = F.least(F.floor((F.col("place") - 1) / stride), end)
    blocks = F.sequence(F.floor(low / each).cast("long"), F.floor(high / each).cast("long"))
    rows = rows.filter(low <= high).withColumn("block", F.explode(blocks)).withColumn("first", F.col("block") * each)
    return rows.withColumn("last", F.least(F.col("first") + each - 1, end).cast("long")).drop("_n")


def one_based_dense(df: DataFrame, order: str, *partition: str) -> Column:
    return F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)).cast("long")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows win."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns taken from the matching source row, unless they are null or empty there."""
    s = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = target.join(s, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}")), F.col(c)) for c in columns}).select(*target.columns)


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that are missing."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def incremental(new: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't done."""
    return new.join(done.select(*keys).distinct(), list(keys), "left_anti")


def presence(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each key and field: rows checked, rows where it's there, the percentage and its tier; one pass."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("checked"), *[F.count(f).alias(f) for f in fields])
    long = counted.select(*keys, "checked", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field", "present"))
    pct = F.col("present") * 100.0 / F.col("checked")
    tier = F.when(pct >= 100, "always").when(pct >= 90, "mostly").when(pct > 0, "sometimes").otherwise("never")
    return long.select(*keys, "field", "checked", "present", pct.alias("pct"), tier.alias("tier"))


def presence_drift(shares: DataFrame, keys: Sequence[str], order: str, points: float = 5.0) -> DataFrame:
    """Changes of more than `points` from one step to the next."""
    before = F.lag("pct").over(Window.partitionBy(*keys, "field").orderBy(order))
    return shares.withColumn("change", F.col("pct") - before).filter(F.abs("change") > points)
