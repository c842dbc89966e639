"""Queries of the smoother and of sparse latent dimensions over the feed's metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.operators import latent as L
from isochron.operators import profile as O
from isochron.operators import ranks as N
from isochron.operators import series as T
from isochron.plans.feed import Feed, with_feed
from isochron.plans.registry import query
from isochron.sources.shared import stored

_KEYS = ["metric_name", "player_id"]

#: One row a series and step: the filter adds a point, then the smoother one from the end, then new variances are taken.
SMOOTHED = """
series AS (SELECT metric_name, player_id, count(*) AS n, list(season ORDER BY season) AS seasons, list(coalesce(value, 0) ORDER BY season) AS y, var_pop(coalesce(value, 0)) AS v FROM feed_metric GROUP BY 1, 2 HAVING count(*) >= 2 AND bool_or(coalesce(value, 0) <> 0)),
em AS (SELECT metric_name, player_id, n, seasons, y, CASE WHEN v > 0 THEN v ELSE 0.01 END AS v0, CASE WHEN v > 0 THEN v ELSE 0.01 END * 0.5 AS q, CASE WHEN v > 0 THEN v ELSE 0.01 END * 0.5 AS r, 0 AS round,
    CAST([] AS STRUCT(m DOUBLE, p DOUBLE)[]) AS f, CAST([] AS STRUCT(m DOUBLE, p DOUBLE, c DOUBLE)[]) AS b FROM series
  UNION ALL SELECT metric_name, player_id, n, seasons, y, v0,
    CASE WHEN len(b) = n THEN list_sum(list_transform(range(1, n), lambda i: (b[i + 1].m - b[i].m) * (b[i + 1].m - b[i].m) + b[i + 1].p + b[i].p - 2 * b[i].c)) / (n - 1) ELSE q END,
    CASE WHEN len(b) = n THEN list_sum(list_transform(range(1, n + 1), lambda i: (y[i] - b[i].m) * (y[i] - b[i].m) + b[i].p)) / n ELSE r END,
    CASE WHEN len(b) = n THEN round + 1 ELSE round END,
    CASE WHEN len(b) = n THEN [] WHEN len(f) = 0 THEN [{'m': y[1], 'p': (1 - v0 / (v0 + r)) * v0}]
      WHEN len(f) < n THEN list_append(f, {'m': f[-1].m + (f[-1].p + q) / (f[-1].p + q + r) * (y[len(f) + 1] - f[-1].m), 'p': (1 - (f[-1].p + q) / (f[-1].p + q + r)) * (f[-1].p + q)}) ELSE f END,
    CASE WHEN len(b) = n THEN [] WHEN len(f) < n THEN b WHEN len(b) = 0 THEN [{'m': f[-1].m, 'p': f[-1].p, 'c': 0.0}]
      ELSE list_prepend({'m': f[n - len(b)].m + f[n - len(b)].p / (f[n - len(b)].p + q) * (b[1].m - f[n - len(b)].m),
        'p': f[n - len(b)].p + f[n - len(b)].p / (f[n - len(b)].p + q) * (f[n - len(b)].p / (f[n - len(b)].p + q)) * (b[1].p - f[n - len(b)].p - q),
        'c': f[n - len(b)].p / (f[n - len(b)].p + q) * b[1].p}, b) END
  FROM em WHERE round < 10 OR len(b) < n),
smoothed AS (SELECT metric_name, player_id, q, r, unnest(seasons) AS season, unnest(y) AS value, unnest(list_transform(f, lambda x: x.m)) AS filtered_mean, unnest(list_transform(f, lambda x: x.p)) AS filtered_var,
  unnest(list_transform(b, lambda x: x.m)) AS smoothed_mean, unnest(list_transform(b, lambda x: x.p)) AS smoothed_var FROM em WHERE round = 10 AND len(b) = n)"""


def over_smoothed(select: str) -> str:
    head = with_feed(f"{SMOOTHED.strip()} {select}")
    at = head.index("series AS (")
    return "WITH RECURSIVE " + head[len("WITH ") : at].rstrip() + ", " + head[at:]


def smoothed(feed: Feed) -> DataFrame:
    return T.smooth(feed.metric, _KEYS, "season", "value")


@query(over_smoothed("SELECT metric_name, player_id, season, round(filtered_mean, 3) AS filtered_mean, round(filtered_var, 0) AS filtered_var, round(smoothed_mean, 3) AS smoothed_mean, round(smoothed_var, 0) AS smoothed_var, round(q, 0) AS process_variance, round(r, 0) AS observation_variance FROM smoothed"))
def g21_smoother(feed: Feed) -> DataFrame:
    """Local-level filter and smoother with variances of ten EM rounds."""
    digits = {"filtered_mean": 3, "smoothed_mean": 3, "filtered_var": 0, "smoothed_var": 0, "process_variance": 0, "observation_variance": 0}
    return smoothed(feed).select(*_KEYS, "season", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(over_smoothed("SELECT season, metric_name, player_id, round(CASE WHEN season < (SELECT max(season) FROM feed_metric) THEN coalesce(smoothed_mean, value) ELSE coalesce(filtered_mean, value) END, 3) AS signal FROM (SELECT m.season, m.metric_name, m.player_id, m.value, smoothed_mean, filtered_mean FROM feed_metric m LEFT JOIN smoothed s USING (season, metric_name, player_id))"))
def i10_signal(feed: Feed) -> DataFrame:
    """The smoothed mean for past seasons, the filtered one for the latest; the value itself of series without either."""
    keys = ["season", *_KEYS]
    s = smoothed(feed).select(*keys, "smoothed_mean", "filtered_mean")
    rows = stored(feed.metric.select(*keys, "value").join(s, keys, "left"))  # else each side would be smoothed again
    own = lambda c: rows.select(*keys, F.coalesce(c, "value").alias("value"))
    return O.signal(own("smoothed_mean"), own("filtered_mean"), keys, "season", "value").withColumn("signal", F.round("signal", 3))


@query(over_smoothed("SELECT metric_name, count(DISTINCT player_id) AS series, round(stddev_samp(value), 3) AS observed, round(stddev_samp(smoothed_mean), 3) AS smoothed, round(1 - stddev_samp(smoothed_mean) / stddev_samp(value), 5) AS reduction FROM smoothed GROUP BY 1"))
def g36_variance_reduction(feed: Feed) -> DataFrame:
    """Spread of observed and smoothed values of each metric."""
    one, two = F.stddev_samp("value"), F.stddev_samp("smoothed_mean")
    return smoothed(feed).groupBy("metric_name").agg(F.count_distinct("player_id").alias("series"), F.round(one, 3).alias("observed"), F.round(two, 3).alias("smoothed"), F.round(1 - two / one, 5).alias("reduction"))


#: The feed's metrics; dimensions, penalty, seasons in which a stable dimension is active.
FEATURES, DIMENSIONS, ALPHA, STABLE = ("A_F", "A_O", "N_F", "N_O", "R_F", "R_O"), 4, 0.5, 2


def _features(feed: Feed) -> list[str]:
    """Those that the feed has, in order."""
    own = {r.metric_name for r in feed.metric.select("metric_name").distinct().collect()}
    return sorted(own & set(FEATURES)) or sorted(own)


def _model(feed: Feed) -> tuple[list[str], np.ndarray, DataFrame]:
    """Features, dictionary, and the stored codes of all complete vectors."""
    features = _features(feed)
    vectors = stored(L.complete_vectors(feed.metric, ["season", "player_id"], "metric_name", "value", features))
    vectors = L.scaled(vectors, *L.scaler(vectors, len(features)))
    dictionary = L.learn_dictionary(vectors, ["season", "player_id"], DIMENSIONS, ALPHA)
    return features, dictionary, stored(L.sparse_codes(vectors, dictionary, ALPHA))


_COMPLETE = "(SELECT season, player_id FROM feed_metric WHERE metric_name IN ({}) GROUP BY 1, 2 HAVING count(DISTINCT metric_name) = (SELECT count(DISTINCT metric_name) FROM feed_metric WHERE metric_name IN ({}))) c".replace("{}", ", ".join(f"'{f}'" for f in FEATURES))


@query()
def g14_dictionary(feed: Feed) -> DataFrame:
    features, dictionary, _ = _model(feed)
    return L.dictionary_rows(feed.spark, dictionary, features).withColumn("weight", F.round("weight", 6))


@query(with_feed(f"SELECT season, player_id, CAST({DIMENSIONS} AS INTEGER) AS dimensions, CAST(0 AS DOUBLE) AS gap FROM {_COMPLETE}"))
def g15_sparse_codes(feed: Feed) -> DataFrame:
    """Each code against the conditions that the best one meets: no breach."""
    _, dictionary, codes = _model(feed)
    return L.optimality_gap(codes, dictionary, ALPHA).select("season", "player_id", F.size("z").alias("dimensions"), F.abs(F.round("gap", 6)).alias("gap"))


@query()
def g16_k2_dimensions(feed: Feed) -> DataFrame:
    features, _, codes = _model(feed)
    meta = L.dimension_meta(codes, features, "season")
    return meta.select("dim_idx", F.concat_ws(",", "top_features").alias("top_features"), "stable_seasons", (F.col("stable_seasons") >= STABLE).alias("is_stable"))


@query(with_feed(f"SELECT coalesce(feature, 'all') AS feature, count(*) AS n, true AS fits FROM (SELECT metric_name AS feature FROM feed_metric JOIN {_COMPLETE} USING (season, player_id) WHERE metric_name IN ({', '.join(repr(f) for f in FEATURES)})) GROUP BY CUBE (feature)"))
def g17_reconstruction(feed: Feed) -> DataFrame:
    """Mean squared error and R2, of all features and of each: no worse than the mean, and an error of at least 0."""
    features, dictionary, codes = _model(feed)
    fits = (F.col("mse") >= 0) & (F.col("r2") > 0) & (F.col("r2") <= 1)
    return L.reconstruction(codes, dictionary, features).select(F.coalesce("feature", F.lit("all")).alias("feature"), "n", fits.alias("fits"))


@query(with_feed(f"SELECT season, player_id, d.dim_idx FROM {_COMPLETE}, (SELECT CAST(unnest(range({DIMENSIONS})) AS INTEGER) AS dim_idx) d"))
def k3_entity_skills(feed: Feed) -> DataFrame:
    """Each player's dimensions of each season, with what they mean where it's known."""
    features, _, codes = _model(feed)
    skills = L.entity_skills(codes, L.dimension_meta(codes, features, "season"), ["season", "player_id"], STABLE)
    return skills.filter("percentile BETWEEN 0 AND 1 AND size(top_features) > 0").select("season", "player_id", "dim_idx")


#: Categories of the feed's metrics, and metrics of which less is better.
CATEGORIES = {
    "offense": ("A_F", "A_O"),
    "defense": ("N_F",),
    "transition": ("N_O", "A_O"),
    "special_teams": ("R_F",),
    "discipline": ("R_O", "N_F"),
    "finishing": ("A_F",),
    "play_driving": ("A_F", "N_O", "R_O"),
}
LOWER_IS_BETTER = ("N_F", "R_O")

_LONG = """signals AS (SELECT m.season, m.metric_name, m.player_id, m.value, round(CASE WHEN m.season < (SELECT max(season) FROM feed_metric) THEN coalesce(smoothed_mean, m.value) ELSE coalesce(filtered_mean, m.value) END, 3) AS signal
  FROM feed_metric m LEFT JOIN smoothed s USING (season, metric_name, player_id)),
long AS (SELECT season, player_id, player_id % 2 AS side, 'actual' AS suffix, metric_name, value FROM signals UNION ALL SELECT season, player_id, player_id % 2, 'signal', metric_name, signal FROM signals)"""


def _scores_sql() -> str:
    pairs = ", ".join(f"('{c}', '{m}')" for c, own in CATEGORIES.items() for m in own)
    lower = ", ".join(f"'{m}'" for m in LOWER_IS_BETTER)
    return over_smoothed(f"""
SELECT season, player_id, suffix, category, score, round(100 * (rank() OVER (PARTITION BY side, suffix, category ORDER BY score) + (count(*) OVER (PARTITION BY side, suffix, category, score) - 1) / 2.0) / count(*) OVER (PARTITION BY side, suffix, category), 6) AS percentile
FROM (SELECT e.season, e.player_id, e.side, e.suffix, e.category, round(coalesce(avg(z), 0), 9) AS score FROM (SELECT DISTINCT season, player_id, side, suffix, category FROM long, pairs) e LEFT JOIN
  (SELECT l.season, l.player_id, l.suffix, p.category, CASE WHEN s > 0 THEN CASE WHEN metric_name IN ({lower}) THEN -1 ELSE 1 END * (value - m) / s ELSE 0 END AS z FROM long l JOIN pairs p USING (metric_name)
    JOIN (SELECT side, suffix, metric_name, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY 1, 2, 3 HAVING count(value) >= 10) t USING (side, suffix, metric_name) WHERE value IS NOT NULL) v
  USING (season, player_id, suffix, category) GROUP BY 1, 2, 3, 4, 5)""").replace("SELECT season, player_id, suffix, category, score, round(100", f", {_LONG}, pairs AS (SELECT * FROM (VALUES {pairs}) v(category, metric_name)) SELECT season, player_id, suffix, category, score, round(100", 1)


@query(_scores_sql())
def i12_category_scores(feed: Feed) -> DataFrame:
    """Seven categories of observed values and of signals: mean z-score within the group, and its percentile there."""
    keys = ["season", *_KEYS]
    rows = feed.metric.select(*keys, "value").join(i10_signal(feed), keys)
    two = F.explode(F.array(F.struct(F.lit("actual").alias("suffix"), F.col("value").alias("v")), F.struct(F.lit("signal").alias("suffix"), F.col("signal").alias("v")))).alias("x")
    long = rows.select(*keys, (F.col("player_id") % 2).alias("side"), two).select("season", "player_id", "side", "x.suffix", "metric_name", F.col("x.v").alias("value"))
    scores = N.category_scores(stored(long), ["season", "player_id"], "side", CATEGORIES, LOWER_IS_BETTER)
    return scores.select("season", "player_id", "suffix", "category", "score", F.round("percentile", 6).alias("percentile"))
