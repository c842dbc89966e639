"""Series models: local-level filter, noise from differences, forecasts, drift tests, cosine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from isochron.sources.shared import stored


def local_level(points: Column, q: Column, r: Column) -> Column:
    """Kalman recursion over an array of numbers: struct of the last mean and variance; starts at the first point."""
    start = F.struct(F.element_at(points, 1).alias("m"), F.greatest(r, F.lit(1e-6)).alias("p"))

    def step(s, y):
        p = s.p + q
        k = p / (p + r)
        return F.struct((s.m + k * (y - s.m)).alias("m"), ((1 - k) * p).alias("p"))

    return F.aggregate(F.slice(points, 2, F.size(points)), start, step)


def noise_from_differences(df: DataFrame, keys: Sequence[str], order: str, value: str, scale: float = 1.0, ratio: float = 0.1) -> DataFrame:
    """(keys, n, points, r, q) of each series: r from the variance of its differences, q a share of it."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("points"), F.var_pop("_d").alias("_v"))
    r = F.when(F.col("n") < 2, 0.1).otherwise(F.greatest(F.lit(1e-4), F.col("_v") * scale))
    return own.withColumn("r", r).withColumn("q", F.greatest(F.lit(1e-6), F.col("r") * ratio)).drop("_v")


def forecasts(series: DataFrame, keys: Sequence[str], horizons: Sequence[int], least: int = 8) -> DataFrame:
    """(keys, horizon, mean, variance) for series of `least` points or more."""
    s = series.filter(F.col("n") >= least).withColumn("s", local_level(F.col("points"), F.col("q"), F.col("r")))
    rows = s.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return rows.select(*keys, "horizon", F.col("s.m").alias("mean"), (F.col("s.p") + F.col("horizon") * F.col("q")).alias("variance"))


def _filtered(y: np.ndarray, q: np.ndarray, r: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances after each point (a column) of series (rows); the first point is expected at itself, with variance `first`."""
    m, p = np.empty_like(y), np.empty_like(y)
    mean, before = y[:, 0], first
    for t in range(y.shape[1]):
        gain = before / (before + r)
        m[:, t], p[:, t] = mean + gain * (y[:, t] - mean), (1 - gain) * before
        mean, before = m[:, t], p[:, t] + q
    return m, p


def _smoothed(m: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, variances, and covariances with the next, of each point given all of them, from the end backwards."""
    mean, variance, with_next = m.copy(), p.copy(), np.zeros_like(p)
    for t in range(m.shape[1] - 2, -1, -1):
        gain = p[:, t] / (p[:, t] + q)
        mean[:, t] = m[:, t] + gain * (mean[:, t + 1] - m[:, t])
        with_next[:, t] = gain * variance[:, t + 1]
        variance[:, t] = p[:, t] + gain * gain * (variance[:, t + 1] - p[:, t] - q)
    return mean, variance, with_next


def _em_round(y: np.ndarray, first: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New q and r from the smoothed series and their lag-one covariances, summed in order."""
    m, p, c = _smoothed(*_filtered(y, q, r, first), q)
    n, moves, misses = y.shape[1], np.zeros(len(y)), np.zeros(len(y))
    for t in range(n):
        misses = misses + ((y[:, t] - m[:, t]) * (y[:, t] - m[:, t]) + p[:, t])
        if t < n - 1:
            step = m[:, t + 1] - m[:, t]
            moves = moves + (step * step + p[:, t + 1] + p[:, t] - 2 * c[:, t])
    return moves / (n - 1), misses / n


def smooth(df: DataFrame, keys: Sequence[str], order: str, value: str, rounds: int = 10) -> DataFrame:
    """keys, order, value, filtered_mean, filtered_var, smoothed_mean, smoothed_var, process_variance and
    observation_variance of a local level for each series of two points or more that isn't all zeros; nulls are 0. Both
    variances begin as half the series' and take `rounds` EM steps. A series is a row; a batch's series of one length are
    worked on together."""
    own = df.withColumn("_y", F.coalesce(F.col(value).cast("double"), F.lit(0.0))).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_y").alias("y")))).alias("_p"), F.var_pop("_y").alias("_v"))
    own = own.filter((F.size("_p") >= 2) & F.exists("_p", lambda p: p["y"] != 0))
    own = own.withColumn("_v", F.when(F.col("_v") > 0, F.col("_v")).otherwise(0.01))
    numbers = (value, "filtered_mean", "filtered_var", "smoothed_mean", "smoothed_var", "process_variance", "observation_variance")
    schema = StructType([*own.select(*keys).schema.fields, StructField(order, df.schema[order].dataType), *(StructField(c, DoubleType()) for c in numbers)])

    def make(batches):
        for batch in batches:
            cells, first = batch.column("_p"), batch.column("_v").to_numpy(zero_copy_only=False)
            size, flat = pc.list_value_length(cells).to_numpy(zero_copy_only=False), cells.flatten()
            begin, y = np.cumsum(size) - size, flat.field("y").to_numpy(zero_copy_only=False)
            out = np.empty((6, len(y)))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                at = begin[rows][:, None] + np.arange(n)
                q = r = first[rows] * 0.5
                for _ in range(rounds):
                    q, r = _em_round(y[at], first[rows], q, r)
                m, p = _filtered(y[at], q, r, first[rows])
                mean, variance, _ = _smoothed(m, p, q)
                for i, x in enumerate((m, p, mean, variance, q[:, None], r[:, None])):
                    out[i][at] = x
            row = pa.array(np.repeat(np.arange(batch.num_rows), size))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), flat.field("at"), pa.array(y), *map(pa.array, out)], schema.fieldNames())

    return own.select(*keys, "_p", "_v").mapInArrow(make, schema)


def trend_forecasts(df: DataFrame, keys: Sequence[str], order: str, value: str, horizons: Sequence[int], least: int = 3) -> DataFrame:
    """Straight-line forecasts over the order's index, with 1.96 deviations that widen with the root of the horizon."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    own = df.withColumn("_i", i).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(value, "_i").alias("b"), F.regr_intercept(value, "_i").alias("a"), F.stddev_samp(value).alias("sd")).filter(F.col("n") >= least)
    rows = own.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    mean = F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("horizon"))
    half = 1.96 * F.col("sd") * F.sqrt("horizon")
    return rows.select(*keys, "horizon", mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"))


def ks_statistic(df: DataFrame, keys: Sequence[str], sample: str, value: str, a, b) -> DataFrame:
    """Greatest distance between two samples' distribution functions, and the asymptotic p-value's argument."""
    w = Window.partitionBy(*keys)
    rows = df.filter(F.col(sample).isin(a, b)).withColumn("_a", (F.col(sample) == a).cast("int"))
    steps = rows.groupBy(*keys, value).agg(F.sum("_a").alias("_na"), F.sum(1 - F.col("_a")).alias("_nb"))
    run = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = F.abs(F.sum("_na").over(run) / F.sum("_na").over(w) - F.sum("_nb").over(run) / F.sum("_nb").over(w))
    return steps.withColumn("_d", d).groupBy(*keys).agg(F.max("_d").alias("statistic"), F.sum("_na").alias("n_a"), F.sum("_nb").alias("n_b"))


#: Vectors and queries that meet at once, the queries of these that are taken at a time (64 by 20,000 doubles are 10 MB), and tasks.
SLICE, QUERIES, AT_ONCE, MOST_TASKS = 20_000, 2000, 64, 4096


def cosine_top(vectors: DataFrame, entity: str, group: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest of its group by cosine (of six decimals, then by entity), itself left out. Queries are a stated set. All pairs are
    compared, in tasks that hold a slice of the vectors and a block of the queries; a task sends on those that may be among a
    query's k nearest, so pairs neither travel nor lie on disk."""
    known = F.col(entity).isNotNull() & F.col(group).isNotNull()
    v = stored(vectors.filter(known).select(group, F.col(entity).alias("peer_id"), F.col(vector).cast("array<double>").alias("x")))
    q = stored(queries.filter(known).select(group, F.col(entity).alias("query_id"), F.col(vector).cast("array<double>").alias("x")))
    slices, blocks = max(-(-v.count() // SLICE), v.sparkSession.sparkContext.defaultParallelism), -(-q.count() // QUERIES)
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(max(n, 1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    keys = [group, "slice", "part"]
    dealt = v.withColumn("slice", part("peer_id", slices)).withColumn("part", every(blocks))
    asked = q.withColumn("part", part("query_id", blocks)).withColumn("slice", every(slices))
    schema = StructType([q.schema["query_id"], v.schema["peer_id"], StructField("similarity", DoubleType())])

    def nearest(left, right):
        found = [_nearest(left, right.slice(at, AT_ONCE), k) for at in range(0, right.num_rows, AT_ONCE)] if left.num_rows else []
        return pa.concat_tables(found) if found else pa.table([right["query_id"].slice(0, 0), left["peer_id"].slice(0, 0), pa.array([], pa.float64())], names=schema.fieldNames())

    dealt, asked = (df.repartition(min(max(slices * blocks, 1), MOST_TASKS), *keys) for df in (dealt, asked))  # by number, as a few MB are much work
    rows = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(nearest, schema).withColumn("similarity", F.round("similarity", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "peer_id")).cast("long")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors padded with zeros, their lengths (-1 where one is null or has nulls), and their norms, summed in order."""
    column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = column.flatten(), np.repeat(np.arange(len(size)), size)
    x = np.zeros((len(size), int(size.max(initial=0))))
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.to_numpy(zero_copy_only=False)
    size[column.is_null().to_numpy(zero_copy_only=False)] = -1
    size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    square = np.zeros(len(size))
    for d in range(x.shape[1]):
        square = square + x[:, d] * x[:, d]
    return x, size, np.sqrt(square)


def _nearest(peers: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """query_id, peer_id, similarity (not yet rounded) of each query's k nearest of these, and of all whose sixth decimal hangs on how it's
    rounded. A similarity that is null comes last, NaN first, as in a descending sort."""
    peers = peers.sort_by("peer_id")
    (x, n, norm), (y, m, own) = _vectors(peers["x"]), _vectors(queries["x"])
    dot = np.zeros((len(m), len(n)))
    for d in range(min(x.shape[1], y.shape[1])):
        dot += y[:, d, None] * x[None, :, d]
    length = own[:, None] * norm
    null = (m[:, None] != n) | (m[:, None] < 0) | (length == 0)
    with np.errstate(all="ignore"):
        similarity = dot / length
        scaled = similarity * 1e6 + 0.5
    level = np.floor(scaled)
    open_ = ~null & (np.abs(scaled - np.rint(scaled)) < 1e-6)
    level = np.where(null, -2e6, np.where(np.isnan(level), 2e6, level))
    place = level * len(n) + (len(n) - 1 - np.arange(len(n)))
    itself = pc.index_in(queries["query_id"].cast(peers.schema.field("peer_id").type), value_set=peers["peer_id"].combine_chunks()).combine_chunks()
    known = itself.is_valid().to_numpy(zero_copy_only=False)
    here = (np.flatnonzero(known), pc.fill_null(itself, 0).to_numpy(zero_copy_only=False)[known])
    place[here], open_[here] = -np.inf, False
    top = np.argpartition(-place, min(k, len(n)) - 1, axis=1)[:, :k]
    open_[np.repeat(np.arange(len(m)), top.shape[1]), top.ravel()] = True
    row, at = np.nonzero(open_ & (place > -np.inf))
    return pa.table([queries["query_id"].take(pa.array(row)), peers["peer_id"].take(pa.array(at)), pa.array(similarity[row, at], mask=null[row, at])], names=["query_id", "peer_id", "similarity"])


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation over all rows; a deviation of 0 counts as 1."""
    own = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(own))  # one row
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in columns}).select(*df.columns)
