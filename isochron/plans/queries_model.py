"""Queries of the statistical operators: designs, ridge ratings, series, similarity, clustering, shot model."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isochron.functions import scalars as S
from isochron.operators import joins as J
from isochron.operators import regression as R
from isochron.operators import ridge as G
from isochron.operators import series as T
from isochron.plans import stints as P
from isochron.plans.feed import Feed, with_feed
from isochron.plans.registry import query
from isochron.plans.sql import STINTS, after

_ROW = "row_id"

def rated_stints(feed: Feed, strength: str = "5v5") -> DataFrame:
    s = P.stints(P.filter_strength(P.lineups(feed), strength))
    out = s.withColumn(_ROW, F.concat_ws("-", F.col("game_id").cast("string"), F.col("stint_id").cast("string")))
    return out.withColumn("w", F.col("duration").cast("double"))


def two_sided(rows: DataFrame) -> DataFrame:
    """Each stint seen from both sides: attack, defend, score and the attacking side's measures."""
    def side(a: str, d: str, sign: int):
        measures = [F.col(f"{a}_{k}").cast("double").alias(k) for k in ("corsi", "xg", "penalties", "hd_xg")]
        return F.struct(F.lit(a).alias("side"), F.col(f"{a}_skaters").alias("attack"), F.col(f"{d}_skaters").alias("defend"), (sign * F.col("score_state")).alias("score"), *measures)

    out = rows.withColumn("o", F.explode(F.array(side("home", "away", 1), side("away", "home", -1)))).select(F.concat_ws("/", _ROW, "o.side").alias(_ROW), "zone", "w", "season", "o.*")
    return out


def _scaled(both: DataFrame, off: str, dfn: str) -> DataFrame:
    side = lambda c, kind, x: both.select(_ROW, F.explode(c).alias("m"), F.expr(x).alias("x")).select(_ROW, F.concat(F.lit(kind), F.col("m").cast("string")).alias("name"), "x")
    return side("attack", "off:", off).unionByName(side("defend", "def:", dfn))


@query(after(STINTS, "SELECT game_id || '-' || stint_id AS row_id, CAST(player_id AS VARCHAR) AS name, CAST(sign AS DOUBLE) AS x FROM members"))
def g1_design_net(feed: Feed) -> DataFrame:
    return R.entries(rated_stints(feed), _ROW, "home_skaters", "away_skaters")


@query(after(STINTS, "SELECT game_id || '-' || stint_id || '/' || side AS row_id, name, 1.0::DOUBLE AS x FROM (SELECT game_id, stint_id, 'home' AS side, 'off:' || unnest(home_skaters) AS name FROM stints UNION ALL SELECT game_id, stint_id, 'home', 'def:' || unnest(away_skaters) FROM stints UNION ALL SELECT game_id, stint_id, 'away', 'off:' || unnest(away_skaters) FROM stints UNION ALL SELECT game_id, stint_id, 'away', 'def:' || unnest(home_skaters) FROM stints)"))
def g2_design_offence_defence(feed: Feed) -> DataFrame:
    return _scaled(two_sided(rated_stints(feed)), "1.0D", "1.0D")


@query(after(STINTS, "SELECT game_id || '-' || stint_id AS row_id, 'fe:score' || score_state AS name, 1.0::DOUBLE AS x FROM stints WHERE score_state <> 0 UNION ALL SELECT game_id || '-' || stint_id, 'fe:zone' || zone, 1.0 FROM stints WHERE zone IN ('O', 'D')"))
def g3_fixed_effects(feed: Feed) -> DataFrame:
    return R.fixed_effects(rated_stints(feed), _ROW, "score_state", "zone")


@query(after(STINTS, "SELECT CAST(a.player_id AS VARCHAR) AS a, CAST(b.player_id AS VARCHAR) AS b, CAST(sum(a.duration * a.sign * b.sign) AS DOUBLE) AS wxx FROM members a JOIN members b ON a.game_id = b.game_id AND a.stint_id = b.stint_id AND a.player_id <= b.player_id GROUP BY 1, 2"))
def g4_gram(feed: Feed) -> DataFrame:
    rows = rated_stints(feed).select("w", G.net_entries("home_skaters", "away_skaters").alias("entries"), F.array().cast("array<struct<name:string,y:double>>").alias("targets"))
    return G.moments(rows, []).filter(F.col("b") != G.INTERCEPT).select("a", "b", F.col("s").alias("wxx"))


@query(after(STINTS, "SELECT game_id || '-' || stint_id AS row_id FROM stints s WHERE NOT EXISTS (SELECT 1 FROM members m JOIN (SELECT player_id, sum(duration) AS d FROM members GROUP BY 1) t ON t.player_id = m.player_id AND t.d < 4500 WHERE m.game_id = s.game_id AND m.stint_id = s.stint_id)"))
def g7_min_exposure(feed: Feed) -> DataFrame:
    rows = rated_stints(feed)
    toi = P.player_stints(rows).groupBy("player_id").agg(F.sum("duration").alias("toi"))
    return R.min_exposure(rows, _ROW, ["home_skaters", "away_skaters"], toi, "player_id", "toi", 4500).select(_ROW)


@query()
def g8_shot_model(feed: Feed) -> DataFrame:
    """Chance of a goal from distance, angle and zone, classes balanced; scored for each shot."""
    distance, angle = S.shot_geometry(F.col("x_coord"), F.col("y_coord"))
    shots = feed.events.filter("xg IS NOT NULL").select("event_id", (F.col("event_type") == "GOAL").cast("double").alias("y"), distance.alias("distance"), angle.alias("angle"), *S.one_hot(F.col("zone_code"), ["O", "D"], "zone"))
    n = shots.groupBy("y").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    weighted = shots.join(F.broadcast(n), "y").crossJoin(F.broadcast(total)).withColumn("w", F.col("all") / (2 * F.col("n")))
    x = VectorAssembler(inputCols=["distance", "angle", "zone_o", "zone_d"], outputCol="features").transform(weighted)
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, maxIter=50).fit(x)
    return model.transform(x).select("event_id", F.round(vector_to_array("probability")[1], 4).alias("score"))


@query(with_feed("""SELECT metric_name, player_id, count(*) AS n, round(greatest(0.0001, var_pop(d)), 4) AS r FROM (SELECT *, value - lag(value) OVER (PARTITION BY metric_name, player_id ORDER BY season) AS d FROM feed_metric) GROUP BY 1, 2 HAVING count(*) >= 2"""))
def g19_noise(feed: Feed) -> DataFrame:
    return T.noise_from_differences(feed.metric, ["metric_name", "player_id"], "season", "value").filter("n >= 2").select("metric_name", "player_id", "n", F.round("r", 4).alias("r"))


@query(after("""p AS (SELECT metric_name, player_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY metric_name, player_id) AS n FROM feed_metric WINDOW w AS (PARTITION BY metric_name, player_id ORDER BY season)),
k AS (SELECT metric_name, player_id, i, n, value AS m, 2.0::DOUBLE AS p FROM p WHERE i = 1 UNION ALL SELECT p.metric_name, p.player_id, p.i, p.n, k.m + (k.p + 0.5) / (k.p + 0.5 + 2.0) * (p.value - k.m), (1 - (k.p + 0.5) / (k.p + 0.5 + 2.0)) * (k.p + 0.5) FROM k JOIN p ON p.metric_name = k.metric_name AND p.player_id = k.player_id AND p.i = k.i + 1)""",
"SELECT metric_name, player_id, round(m, 4) AS mean, round(p, 8) AS variance FROM k WHERE i = n").replace("WITH ", "WITH RECURSIVE ", 1))
def g18_local_level(feed: Feed) -> DataFrame:
    s = T.noise_from_differences(feed.metric, ["metric_name", "player_id"], "season", "value")
    level = T.local_level(F.col("points"), F.lit(0.5), F.lit(2.0))
    return s.withColumn("s", level).select("metric_name", "player_id", F.round("s.m", 4).alias("mean"), F.round("s.p", 8).alias("variance"))


_FORECAST = """points AS (SELECT metric_name, player_id, season, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY metric_name, player_id) AS n, value - lag(value) OVER w AS d
  FROM feed_metric WINDOW w AS (PARTITION BY metric_name, player_id ORDER BY season)),
noise AS (SELECT metric_name, player_id, greatest(0.0001, var_pop(d)) AS r, greatest(0.000001, greatest(0.0001, var_pop(d)) * 0.1) AS q FROM points WHERE n >= 5 GROUP BY 1, 2),
level AS (SELECT p.metric_name, p.player_id, i, n, value AS m, r AS p, q, r FROM points p JOIN noise USING (metric_name, player_id) WHERE i = 1
  UNION ALL SELECT p.metric_name, p.player_id, p.i, p.n, k.m + (k.p + k.q) / (k.p + k.q + k.r) * (p.value - k.m), (1 - (k.p + k.q) / (k.p + k.q + k.r)) * (k.p + k.q), k.q, k.r
  FROM level k JOIN points p ON p.metric_name = k.metric_name AND p.player_id = k.player_id AND p.i = k.i + 1)"""


@query(after(_FORECAST, "SELECT metric_name, player_id, h AS horizon, round(m, 4) AS mean, round(p + h * q, 2) AS variance FROM level, (VALUES (1), (2), (3)) v(h) WHERE i = n").replace("WITH ", "WITH RECURSIVE ", 1))
def g20_forecasts(feed: Feed) -> DataFrame:
    s = T.noise_from_differences(feed.metric, ["metric_name", "player_id"], "season", "value")
    return T.forecasts(s, ["metric_name", "player_id"], [1, 2, 3], least=5).withColumns({"mean": F.round("mean", 4), "variance": F.round("variance", 2)})


@query(with_feed("SELECT metric_name, player_id, h AS horizon, round(a + b * (n - 1 + h), 4) AS mean FROM (SELECT metric_name, player_id, count(*) AS n, regr_slope(value, i) AS b, regr_intercept(value, i) AS a FROM (SELECT *, row_number() OVER (PARTITION BY metric_name, player_id ORDER BY season) - 1 AS i FROM feed_metric) GROUP BY 1, 2 HAVING count(*) >= 3), (VALUES (1), (2), (3)) v(h)"))
def g22_trend_forecast(feed: Feed) -> DataFrame:
    return T.trend_forecasts(feed.metric, ["metric_name", "player_id"], "season", "value", [1, 2, 3]).select("metric_name", "player_id", "horizon", F.round("mean", 4).alias("mean"))


@query(with_feed("SELECT metric_name, count(*) AS n, round(corr(value, nv), 8) AS r, round(greatest(0, least(1, corr(value, nv) * sqrt(least(median(toi_seconds), 2000) / 2000))), 8) AS shrinkage FROM (SELECT *, lead(value) OVER w AS nv, lead(i) OVER w AS ni FROM (SELECT *, dense_rank() OVER (PARTITION BY metric_name ORDER BY season) AS i FROM feed_metric) WINDOW w AS (PARTITION BY metric_name, player_id ORDER BY i)) WHERE ni = i + 1 GROUP BY 1 HAVING count(*) >= 30"))
def g25_g26_stability(feed: Feed) -> DataFrame:
    pairs = J.consecutive(feed.metric, ["player_id"], "season", ["metric_name"], "value").join(feed.metric.select("season", "metric_name", "player_id", "toi_seconds"), ["season", "metric_name", "player_id"])
    g = pairs.groupBy("metric_name").agg(F.count("*").alias("n"), F.corr("value", "next_value").alias("r"), F.percentile("toi_seconds", 0.5).alias("m")).filter("n >= 30")
    shrink = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r") * F.sqrt(F.least(F.col("m"), F.lit(2000.0)) / 2000)))
    return g.select("metric_name", "n", F.round("r", 8).alias("r"), F.round(shrink, 8).alias("shrinkage"))


@query(with_feed("""SELECT metric_name, season, count(*) AS n, round(corr(value, nv), 8) AS r, coalesce(corr(value, nv) >= 0.4, false) AS passed FROM (SELECT metric_name, season, value, lead(value) OVER w AS nv, lead(i) OVER w AS ni, i
  FROM (SELECT *, dense_rank() OVER (PARTITION BY metric_name ORDER BY season) AS i FROM feed_metric) WINDOW w AS (PARTITION BY metric_name, player_id ORDER BY i)) WHERE ni = i + 1 GROUP BY 1, 2"""))
def g28_year_on_year(feed: Feed) -> DataFrame:
    """Each metric's correlation with the season after, and whether it is 0.4 or more."""
    pairs = J.consecutive(feed.metric, ["player_id"], "season", ["metric_name"], "value")
    r = F.corr("value", "next_value")
    return pairs.groupBy("metric_name", "season").agg(F.count("*").alias("n"), F.round(r, 8).alias("r"), F.coalesce(r >= 0.4, F.lit(False)).alias("passed"))


#: Career vectors: the mean of each of the feed's metrics.
_CAREER = ("A_F", "A_O", "N_F", "N_O", "R_F", "R_O")


_CAREER_SQL = f"""names AS (SELECT unnest({list(_CAREER)}) AS metric_name), players AS (SELECT DISTINCT player_id FROM feed_metric),
means AS (SELECT player_id, metric_name, coalesce(avg(f.value), 0.0) AS v FROM players CROSS JOIN names LEFT JOIN feed_metric f USING (player_id, metric_name) GROUP BY 1, 2),
career AS (SELECT player_id, player_id % 2 AS side, list(v ORDER BY metric_name) AS x FROM means GROUP BY 1),
alike AS (SELECT q.player_id AS query_id, v.player_id AS peer_id, round(list_dot_product(q.x, v.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(v.x, v.x))), 6) AS similarity
  FROM career q JOIN career v ON q.side = v.side AND q.player_id <> v.player_id WHERE q.player_id % 100 = 0)"""


@query(after(_CAREER_SQL, "SELECT query_id, peer_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, peer_id) AS rank FROM alike) WHERE rank <= 5"))
def g33_career_cosine(feed: Feed) -> DataFrame:
    """The five most alike of a player's group by career means, unweighted. Queries: the stated set of ids divisible by 100."""
    return career_peers(feed, 5)


def career_peers(feed: Feed, top: int) -> DataFrame:
    wide = feed.metric.groupBy("player_id").pivot("metric_name", list(_CAREER)).agg(F.avg("value"))
    career = wide.select("player_id", (F.col("player_id") % 2).alias("side"), F.array(*[F.coalesce(F.col(m), F.lit(0.0)) for m in _CAREER]).alias("x"))
    return T.cosine_top(career, "player_id", "side", "x", career.filter("player_id % 100 = 0"), top)


@query(with_feed("SELECT metric_name, round(max(abs(fa - fb)), 8) AS statistic FROM (SELECT metric_name, value, sum(a) OVER w / CAST(sum(a) OVER p AS DOUBLE) AS fa, sum(b) OVER w / CAST(sum(b) OVER p AS DOUBLE) AS fb FROM (SELECT metric_name, value, count(*) FILTER (season = 1995) AS a, count(*) FILTER (season = 1996) AS b FROM feed_metric WHERE season IN (1995, 1996) GROUP BY 1, 2) WINDOW w AS (PARTITION BY metric_name ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY metric_name)) GROUP BY 1"))
def g27_ks(feed: Feed) -> DataFrame:
    return T.ks_statistic(feed.metric, ["metric_name"], "season", "value", 1995, 1996).select("metric_name", F.round("statistic", 8).alias("statistic"))


@query("SELECT query_id, peer_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, peer_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS peer_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5")
def g32_cosine_top(feed: Feed) -> DataFrame:
    """Queries: the stated set of ids divisible by 100."""
    v = feed.table("embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return T.cosine_top(v, "vec_id", "label", "embedding", v.filter("vec_id % 100 = 0"), 5)


@query("SELECT p_partkey, round((p_size - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS p_size FROM part, (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part)")
def g13_standardize(feed: Feed) -> DataFrame:
    return T.standardize(feed.table("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size")), ["p_size"]).withColumn("p_size", F.round("p_size", 6))


@query()
def g30_kmeans(feed: Feed) -> DataFrame:
    """Clusters of career profiles by group, fitted on scaled means."""
    names = ["A_F", "N_O", "R_F"]
    wide = feed.metric.groupBy("player_id").pivot("metric_name", names).agg(F.avg("value")).na.fill(0.0)
    x = VectorAssembler(inputCols=names, outputCol="raw").transform(wide)
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    return KMeans(k=5, seed=42, featuresCol="features", predictionCol="cluster").fit(x).transform(x).select("player_id", "cluster")
