"""Sparse latent dimensions: a dictionary fitted by alternating minimisation, codes, what dimensions mean, how well they fit.

A round codes each row against the broadcast dictionary (dimensions x features, a few KB) by coordinate descent, and sums
z z' and z x' in the tasks that hold the rows; only those sums, of the dictionary's size, come to the driver, which updates
the atoms one by one. The rows stay where they are, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Sweeps of coordinate descent over a row's dimensions, and the largest change at which it ends.
SWEEPS, STILL = 2000, 1e-10


def complete_vectors(df: DataFrame, keys: Sequence[str], name: str, value: str, features: Sequence[str]) -> DataFrame:
    """keys and x, the features' values in order, of keys that have them all."""
    wide = df.groupBy(*keys).pivot(name, list(features)).agg(F.first(value))
    return wide.dropna(subset=list(features)).select(*keys, F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))


def scaler(vectors: DataFrame, width: int) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each place of x; a deviation of 0 counts as 1."""
    row = vectors.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [row[f"m{i}"] or 0.0 for i in range(width)], [row[f"s{i}"] or 1.0 for i in range(width)]


def scaled(vectors: DataFrame, mean: Sequence[float], scale: Sequence[float]) -> DataFrame:
    return vectors.withColumn("x", F.array(*[(F.col("x")[i] - float(m)) / float(s) for i, (m, s) in enumerate(zip(mean, scale))]))


def _codes(x: np.ndarray, dictionary: np.ndarray, alpha: float) -> np.ndarray:
    """min 1/2 |x - z D|^2 + alpha |z|_1 for each row of x."""
    gram, fit = dictionary @ dictionary.T, x @ dictionary.T
    z = np.zeros_like(fit)
    own = np.maximum(np.diag(gram), 1e-12)
    for _ in range(SWEEPS):
        moved = 0.0
        for k in range(len(gram)):
            part = fit[:, k] - z @ gram[:, k] + z[:, k] * gram[k, k]
            new = np.sign(part) * np.maximum(np.abs(part) - alpha, 0) / own[k]
            moved = max(moved, float(np.abs(new - z[:, k]).max(initial=0)))
            z[:, k] = new
        if moved < STILL:
            break
    return z


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sparse_codes(vectors: DataFrame, dictionary: np.ndarray, alpha: float) -> DataFrame:
    """Adds z, each row's code."""
    shared = vectors.sparkSession.sparkContext.broadcast((dictionary, alpha))  # dimensions x features
    schema = StructType([*vectors.schema.fields, StructField("z", ArrayType(DoubleType()))])

    def apply(batches):
        d, a = shared.value
        for batch in batches:
            z = _codes(_matrix(batch.column("x"), d.shape[1]), d, a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(z), pa.list_(pa.float64()))], [*batch.schema.names, "z"])

    return vectors.mapInArrow(apply, schema)


def learn_dictionary(vectors: DataFrame, order: Sequence[str], dimensions: int, alpha: float, rounds: int = 30) -> np.ndarray:
    """Atoms of at most unit length. They begin as the vectors that come first by the hash of `order`, so the same rows
    give the same dictionary, however they are dealt."""
    spark = vectors.sparkSession
    begin = vectors.select("x", F.xxhash64(*order).alias("_h"), *order).orderBy("_h", *order).limit(dimensions).collect()
    if not begin:
        return np.zeros((0, 0))
    d = np.array([r.x for r in begin], float)
    d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
    k, width = d.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(d)

        def sums(batches, shared=shared):
            d = shared.value
            zz, zx = np.zeros((k, k)), np.zeros((k, width))
            for batch in batches:
                x = _matrix(batch.column("x"), width)
                z = _codes(x, d, alpha)
                zz += z.T @ z
                zx += z.T @ x
            flat = np.concatenate([zz.ravel(), zx.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "s"])

        total = np.zeros(k * k + k * width)
        for r in vectors.select("x").mapInArrow(sums, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
            total[r["at"]] = r.s
        zz, zx = total[: k * k].reshape(k, k), total[k * k :].reshape(k, width)
        for i in range(k):
            if zz[i, i] > 1e-10:
                atom = d[i] + (zx[i] - zz[i] @ d) / zz[i, i]
                d[i] = atom / max(np.linalg.norm(atom), 1.0)
        shared.unpersist()
    return d


def dictionary_rows(spark, dictionary: np.ndarray, features: Sequence[str]) -> DataFrame:
    rows = [(k, f, float(dictionary[k, i])) for k in range(len(dictionary)) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "dim_idx int, feature string, weight double")


def _constant(rows: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def rebuilt(codes: DataFrame, dictionary: np.ndarray) -> DataFrame:
    """Adds fitted, the vector that a code stands for."""
    columns = [F.aggregate(F.zip_with("z", F.array(*[F.lit(float(x)) for x in dictionary[:, i]]), lambda z, w: z * w), F.lit(0.0), lambda s, v: s + v) for i in range(dictionary.shape[1])]
    return codes.withColumn("fitted", F.array(*columns))


def optimality_gap(codes: DataFrame, dictionary: np.ndarray, alpha: float) -> DataFrame:
    """Adds gap: the largest breach of a code's optimality conditions. With c = d . (x - z D) for an atom d: c = alpha where
    z > 0, c = -alpha where z < 0, |c| <= alpha where z = 0."""
    left = rebuilt(codes, dictionary).withColumn("_left", F.zip_with("x", "fitted", lambda x, f: x - f))
    c = F.transform(_constant(dictionary), lambda atom: F.aggregate(F.zip_with(atom, F.col("_left"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    breach = F.zip_with("z", c, lambda z, c: F.when(z == 0, F.greatest(F.abs(c) - alpha, F.lit(0.0))).otherwise(F.abs(c - F.signum(z) * alpha)))
    return left.withColumn("gap", F.array_max(breach)).drop("_left", "fitted")


def reconstruction(codes: DataFrame, dictionary: np.ndarray, features: Sequence[str]) -> DataFrame:
    """feature (null for all), n, mse and r2 of what the codes rebuild."""
    rows = rebuilt(codes, dictionary).select(F.posexplode(F.zip_with("x", "fitted", lambda x, f: F.struct(x.alias("x"), f.alias("f")))).alias("i", "p"))
    rows = rows.select(F.array(*map(F.lit, features))[F.col("i")].alias("feature"), "p.x", ((F.col("p.x") - F.col("p.f")) ** 2).alias("_e"))
    return rows.cube("feature").agg(F.count("*").alias("n"), F.avg("_e").alias("mse"), (1 - F.avg("_e") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("r2"))


def dimension_meta(codes: DataFrame, features: Sequence[str], season: str, least_share: float = 0.1, least_size: float = 0.25) -> DataFrame:
    """dim_idx, top_features (the three that correlate most, either way), seasons_active (those in which `least_share` of the
    codes aren't 0 and their 95th percentile of size is `least_size`), stable_seasons."""
    long = codes.select(season, "x", F.posexplode("z").alias("dim_idx", "z"))
    wide = long.groupBy("dim_idx").agg(*[F.corr("z", F.col("x")[i]).alias(f"_{i}") for i in range(len(features))])
    pairs = F.array(*[F.struct((-F.abs(F.col(f"_{i}"))).alias("less"), F.lit(f).alias("feature")) for i, f in enumerate(features)])
    known = F.filter(pairs, lambda p: p["less"].isNotNull() & ~F.isnan(p["less"]))
    top = wide.select("dim_idx", F.transform(F.slice(F.array_sort(known), 1, 3), lambda p: p["feature"]).alias("top_features"))
    each = long.groupBy("dim_idx", season).agg(F.avg((F.abs("z") > 1e-3).cast("double")).alias("share"), F.percentile(F.abs("z"), 0.95).alias("size"))
    active = each.filter((F.col("share") >= least_share) & (F.col("size") >= least_size)).groupBy("dim_idx").agg(F.array_sort(F.collect_list(season)).alias("seasons_active"))
    none = F.array().cast(ArrayType(codes.schema[season].dataType))
    return top.join(active, "dim_idx", "left").withColumn("seasons_active", F.coalesce("seasons_active", none)).withColumn("stable_seasons", F.size("seasons_active"))


def entity_skills(codes: DataFrame, meta: DataFrame, keys: Sequence[str], stable: int) -> DataFrame:
    """keys, dim_idx, value, percentile among the season's codes, with what is known of the dimension (null where nothing
    is) and is_stable: whether it was active in `stable` seasons."""
    long = codes.select(*keys, F.posexplode("z").alias("dim_idx", "value"))
    rank = F.percent_rank().over(Window.partitionBy(keys[0], "dim_idx").orderBy("value"))
    return long.withColumn("percentile", rank).join(meta, "dim_idx", "left").withColumn("is_stable", F.coalesce(F.col("stable_seasons") >= stable, F.lit(False)))
