"""Queries over metrics and the given tables: scalars, aggregates, windows, sets, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isochron.functions import scalars as S
from isochron.operators import aggregates as A
from isochron.operators import ranks as N
from isochron.operators import joins as J
from isochron.plans.feed import Feed, with_feed
from isochron.plans.registry import query
from isochron.streaming import feeds as L

_M = ["season", "metric_name", "player_id"]


@query("SELECT o_orderkey, CAST(o_orderkey % 61 AS BIGINT) * 60 + o_orderkey % 60 AS seconds, CAST(CASE WHEN o_orderkey % 5 <= 3 THEN 1200 ELSE 300 END - o_orderkey % 60 AS BIGINT) AS elapsed, CAST(CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5 - 1) * 1200 + o_orderkey % 60 ELSE 0 END AS BIGINT) AS game_seconds FROM orders")
def b1_b3_clocks(feed: Feed) -> DataFrame:
    k = F.col("o_orderkey")
    clock = F.concat((k % 61).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    return feed.table("orders").select("o_orderkey", S.clock_to_seconds(clock).alias("seconds"), S.remaining_to_elapsed(k % 5, k % 60).alias("elapsed"), S.game_seconds(k % 5, k % 60).alias("game_seconds"))


#: Labels of the feed, dealt over the events by their number, and two that it doesn't know.
_LABELS = [*S.EVENT_LABELS, "shootout-complete", "goalie-pulled"]


@query(
    "SELECT label, CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.EVENT_LABELS.items()) + " ELSE upper(label) END AS name, count(*) AS n "
    f"FROM (SELECT {_LABELS!r}[1 + event_id % {len(_LABELS)}] AS label FROM events) GROUP BY 1"
)
def b4_normalize_type(feed: Feed) -> DataFrame:
    label = F.array(*map(F.lit, _LABELS))[(F.col("event_id") % len(_LABELS)).cast("int")]
    return feed.table("events").select(label.alias("label")).groupBy("label", S.normalize_type(F.col("label")).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, least(greatest(p_size - 25, -2), 2) AS clamped, CASE WHEN p_size % 3 = 0 THEN 'O' WHEN p_size % 3 = 1 THEN 'D' ELSE 'N' END AS zone, CASE WHEN p_size % 4 < 2 THEN 'F' WHEN p_size % 4 = 2 THEN 'D' ELSE 'UNKNOWN' END AS pos, CASE WHEN p_size >= 40 THEN 'elite' WHEN p_size >= 20 THEN 'good' ELSE 'low' END AS tier FROM part")
def b6_b7_b13_b15_labels(feed: Feed) -> DataFrame:
    size = F.col("p_size")
    zone = F.when(size % 3 == 0, " o ").when(size % 3 == 1, "D").otherwise("x")
    code = F.when(size % 4 == 0, "LW").when(size % 4 == 1, "c").when(size % 4 == 2, "D").otherwise("G")
    return feed.table("part").select("p_partkey", S.bucket_clamp(size - 25).alias("clamped"), S.map_zone(zone).alias("zone"), S.position_group(code).alias("pos"), S.tier_label(size, [(40, "elite"), (20, "good")], "low").alias("tier"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'F' WHEN s_suppkey % 3 = 1 THEN 'D' WHEN s_acctbal > 1.5 * s_suppkey THEN 'D' ELSE 'F' END AS position FROM supplier")
def b14_infer_position(feed: Feed) -> DataFrame:
    given = F.when(F.col("s_suppkey") % 3 == 0, "F").when(F.col("s_suppkey") % 3 == 1, "D")
    return feed.table("supplier").select("s_suppkey", S.infer_position(given, F.col("s_acctbal"), F.col("s_suppkey")).alias("position"))


@query("SELECT o_custkey, CASE WHEN bool_or(contains(o_orderpriority, 'URGENT')) THEN 'urgent' WHEN bool_or(contains(o_orderpriority, 'HIGH')) THEN 'high' ELSE 'calm' END AS label FROM orders GROUP BY 1")
def b16_suggest_label(feed: Feed) -> DataFrame:
    names = feed.table("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("names"))
    return names.select("o_custkey", S.suggest_label(F.col("names"), [(("URGENT",), "urgent"), (("HIGH",), "high")], "calm").alias("label"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%12%' OR lower(c_name) LIKE '%77%' ORDER BY c_custkey LIMIT 50")
def b17_k5_name_search(feed: Feed) -> DataFrame:
    return feed.table("customer").filter(S.name_matches(F.col("c_name"), "12", "77")).select("c_custkey", "c_name").orderBy("c_custkey").limit(50)


@query(with_feed("SELECT metric_name, CASE WHEN metric_name LIKE 'A%' THEN 'pp' WHEN metric_name LIKE 'N%' THEN 'pk' ELSE '5v5' END AS usage, CAST(2000 + season AS VARCHAR) || CAST(2001 + season AS VARCHAR) AS span, count(*) AS n FROM feed_metric GROUP BY 1, 2, 3"))
def b18_b19_usage_and_season(feed: Feed) -> DataFrame:
    m = feed.metric
    name = F.when(F.col("metric_name").startswith("A"), "x_pp_y").when(F.col("metric_name").startswith("N"), "x_pk_y").otherwise("x_5v5")
    return m.groupBy("metric_name", S.usage_strength(name).alias("usage"), S.season_of_game((F.col("season") + 2000) * 1_000_000).alias("span")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 516 + l_linenumber % 3 END IS NULL OR 516 + l_linenumber % 3 = 517")
def b20_keep_interval_type(feed: Feed) -> DataFrame:
    n = F.col("l_linenumber")
    return feed.table("lineitem").filter(S.keep_interval_type(F.when(n % 3 != 0, 516 + n % 3))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def c1_equi_join(feed: Feed) -> DataFrame:
    o, c = feed.table("orders"), feed.table("customer").select("c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def c2_anti_join(feed: Feed) -> DataFrame:
    return feed.table("customer").select("c_custkey").join(feed.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(with_feed("SELECT season, metric_name, player_id, round(value, 9) AS value, round(next_value, 9) AS next_value FROM (SELECT *, lead(value) OVER w AS next_value, lead(i) OVER w AS ni FROM (SELECT *, dense_rank() OVER (PARTITION BY metric_name ORDER BY season) AS i FROM feed_metric) WINDOW w AS (PARTITION BY metric_name, player_id ORDER BY i)) WHERE ni = i + 1"))
def c11_consecutive_seasons(feed: Feed) -> DataFrame:
    out = J.consecutive(feed.metric, ["player_id"], "season", ["metric_name"], "value")
    return out.select(*_M, F.round("value", 9).alias("value"), F.round("next_value", 9).alias("next_value"))


@query(with_feed("SELECT player_id, metric_name, season, round(value, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY player_id, metric_name ORDER BY season DESC, value DESC) AS n FROM feed_metric) WHERE n = 1"))
def c15_k4_latest_row(feed: Feed) -> DataFrame:
    return J.latest_by(feed.metric, ["player_id", "metric_name"], F.desc("season"), F.desc("value")).select("player_id", "metric_name", "season", F.round("value", 9).alias("value"))


@query("SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS returned, count(*) FILTER (l_discount > 0.05) AS discounted, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def d1_d3_conditional(feed: Feed) -> DataFrame:
    g = feed.table("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("_n"), F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)), 2).alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_distinct("l_partkey").alias("parts"))
    return g.filter("_n > 10").drop("_n")


@query("SELECT l_suppkey, round(coalesce(sum(l_discount * l_quantity) FILTER (l_returnflag = 'A') / sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 8) AS mean_discount FROM lineitem GROUP BY 1")
def d5_weighted_mean(feed: Feed) -> DataFrame:
    return feed.table("lineitem").groupBy("l_suppkey").agg(F.round(A.weighted_mean(F.col("l_discount"), F.col("l_quantity"), F.col("l_returnflag") == "A"), 8).alias("mean_discount"))


@query(with_feed("SELECT season, metric_name, round(quantile_cont(value, 0.8), 6) AS p80, round(quantile_cont(value, 0.2), 6) AS p20, round(median(value), 6) AS p50 FROM feed_metric GROUP BY 1, 2"))
def d6_i5_quantiles(feed: Feed) -> DataFrame:
    return feed.metric.groupBy("season", "metric_name").agg(*[F.round(F.percentile("value", q), 6).alias(f"p{int(q * 100)}") for q in (0.8, 0.2, 0.5)])


@query("SELECT o_custkey, min(o_orderpriority) AS priority FROM (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS m FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE n = m GROUP BY 1")
def d7_mode(feed: Feed) -> DataFrame:
    return feed.table("orders").groupBy("o_custkey").agg(F.mode("o_orderpriority", True).alias("priority"))


@query("SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status FROM orders GROUP BY 1")
def d8_first_by(feed: Feed) -> DataFrame:
    return feed.table("orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("first_status"))


@query("SELECT l_suppkey, round(CASE WHEN count(*) >= 10 THEN coalesce(regr_slope(l_discount, l_quantity), 0) ELSE 0 END, 8) AS slope FROM lineitem GROUP BY 1")
def d9_i8_slope(feed: Feed) -> DataFrame:
    return feed.table("lineitem").groupBy("l_suppkey").agg(F.round(A.slope(F.col("l_discount"), F.col("l_quantity")), 8).alias("slope"))


@query(with_feed("SELECT a.metric_name AS name_1, b.metric_name AS name_2, count(*) AS n, round(corr(a.value, b.value), 8) AS r FROM feed_metric a JOIN feed_metric b ON a.season = b.season AND a.player_id = b.player_id AND a.metric_name < b.metric_name GROUP BY 1, 2"))
def d10_j18_correlations(feed: Feed) -> DataFrame:
    return A.correlations(feed.metric, ["season", "player_id"], "metric_name", "value").withColumn("r", F.round("r", 8))


@query(with_feed("SELECT metric_name, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt, round(max(value) - min(value), 6) AS spread FROM feed_metric GROUP BY 1"))
def d11_moments(feed: Feed) -> DataFrame:
    skew, kurt = A.bias_corrected_moments(F.col("value"))
    return feed.metric.groupBy("metric_name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(skew, 6).alias("skew"), F.round(kurt, 6).alias("kurt"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))


@query(with_feed("SELECT season, player_id, round(avg(value) FILTER (metric_name = 'A_F'), 9) AS A_F, round(avg(value) FILTER (metric_name = 'N_O'), 9) AS N_O, round(avg(value) FILTER (metric_name = 'R_F'), 9) AS R_F FROM feed_metric GROUP BY 1, 2"))
def d12_i11_pivot(feed: Feed) -> DataFrame:
    return feed.metric.groupBy("season", "player_id").pivot("metric_name", ["A_F", "N_O", "R_F"]).agg(F.round(F.avg("value"), 9))


@query(with_feed("SELECT player_id, round(avg(value), 6) AS career, CAST(max(toi_seconds) AS BIGINT) AS most_toi, round(max(toi_seconds) FILTER (metric_name = 'A_F') / CAST(max(toi_seconds) AS DOUBLE), 6) AS share FROM feed_metric GROUP BY 1"))
def d20_d21_usage_and_career(feed: Feed) -> DataFrame:
    share = F.max(F.when(F.col("metric_name") == "A_F", F.col("toi_seconds"))) / F.max("toi_seconds")
    return feed.metric.groupBy("player_id").agg(F.round(F.avg("value"), 6).alias("career"), F.max("toi_seconds").alias("most_toi"), F.round(share, 6).alias("share"))


@query("SELECT user_id, round(sum(w * value), 4) AS credit FROM (SELECT user_id, 1.0 AS w, value FROM events UNION ALL SELECT (user_id + 1) % 150, 0.3, value FROM events UNION ALL SELECT (user_id + 2) % 150, 0.1, value FROM events) GROUP BY 1")
def d26_credit(feed: Feed) -> DataFrame:
    """An event's value counts whole for its own user, and in part for two partners, who are among the first 150."""
    user = F.col("user_id")
    roles = F.array(*[F.struct(who.alias("user_id"), F.lit(w).alias("w")) for who, w in ((user, 1.0), ((user + 1) % 150, 0.3), ((user + 2) % 150, 0.1))])
    return feed.table("events").select("value", F.explode(roles).alias("r")).groupBy("r.user_id").agg(F.round(F.sum(F.col("r.w") * F.col("value")), 4).alias("credit"))


@query("SELECT user_id, count(*) AS entries, count(*) FILTER (event_type = 'purchase') AS successes, round(count(*) FILTER (event_type = 'purchase') / CAST(count(*) AS DOUBLE), 6) AS rate FROM events GROUP BY 1")
def d27_success_rate(feed: Feed) -> DataFrame:
    good = F.count_if(F.col("event_type") == "purchase")
    return feed.table("events").groupBy("user_id").agg(F.count("*").alias("entries"), good.alias("successes"), F.round(good / F.count("*"), 6).alias("rate"))


@query(with_feed("SELECT count(DISTINCT season) AS seasons, count(DISTINCT player_id) AS players, count(DISTINCT metric_name) AS metrics, CAST(max(season) AS BIGINT) AS latest, count(*) AS n FROM feed_metric"))
def d33_k12_overview(feed: Feed) -> DataFrame:
    return feed.metric.agg(F.count_distinct("season").alias("seasons"), F.count_distinct("player_id").alias("players"), F.count_distinct("metric_name").alias("metrics"), F.max("season").alias("latest"), F.count("*").alias("n"))


@query(with_feed("SELECT count(*) FILTER (h >= 1000) AS high, count(*) FILTER (h >= 500) AS middle, count(*) FILTER (h >= 100) AS low, round(avg(h), 4) AS mean FROM (SELECT player_id, sum(toi_seconds) / 3600.0 AS h FROM feed_metric GROUP BY 1)"))
def d34_toi_bands(feed: Feed) -> DataFrame:
    per = feed.metric.groupBy("player_id").agg((F.sum("toi_seconds") / 3600.0).alias("h"))
    return per.agg(F.count_if(F.col("h") >= 1000).alias("high"), F.count_if(F.col("h") >= 500).alias("middle"), F.count_if(F.col("h") >= 100).alias("low"), F.round(F.avg("h"), 4).alias("mean"))


@query("SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS zeros, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, round(quantile_cont(abs(l_discount), 0.95), 6) AS p95, count(*) - count(l_tax) AS nulls FROM lineitem GROUP BY 1")
def d35_sparsity(feed: Feed) -> DataFrame:
    zero = F.col("l_discount") == 0
    return feed.table("lineitem").groupBy("l_returnflag").agg(F.count_if(zero).alias("zeros"), F.round(F.avg(F.when(zero, 1.0).otherwise(0.0)), 6).alias("zero_share"), F.round(F.percentile(F.abs("l_discount"), 0.95), 6).alias("p95"), F.count_if(F.col("l_tax").isNull()).alias("nulls"))


@query(with_feed("SELECT season, metric_name, player_id, round(100 * percent_rank() OVER (PARTITION BY season, metric_name ORDER BY value), 6) AS pct, count(*) OVER (PARTITION BY season, metric_name) AS cohort FROM feed_metric"))
def e2_k9_percent_rank(feed: Feed) -> DataFrame:
    w = Window.partitionBy("season", "metric_name")
    return feed.metric.select(*_M, F.round(100 * F.percent_rank().over(w.orderBy("value")), 6).alias("pct"), F.count("*").over(w).alias("cohort"))


@query("SELECT l_orderkey, l_linenumber, round((rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0) / count(*) OVER (PARTITION BY l_suppkey) * 100, 6) AS pct FROM lineitem")
def e3_rank_pct(feed: Feed) -> DataFrame:
    return feed.table("lineitem").select("l_orderkey", "l_linenumber", F.round(A.rank_pct(F.col("l_quantity"), "l_suppkey"), 6).alias("pct"))


@query(with_feed("SELECT season, metric_name, player_id, rank() OVER (PARTITION BY season, metric_name ORDER BY value DESC) AS overall, rank() OVER (PARTITION BY season, metric_name, player_id % 2 ORDER BY value DESC) AS in_group, round((1 - (rank() OVER (PARTITION BY season, metric_name ORDER BY value DESC) - 1) / CAST(count(*) OVER (PARTITION BY season, metric_name) AS DOUBLE)) * 100, 6) AS pct FROM feed_metric"))
def e4_e5_ranks(feed: Feed) -> DataFrame:
    w = Window.partitionBy("season", "metric_name")
    rank = F.rank().over(w.orderBy(F.desc("value"))).cast("long")
    group = F.rank().over(Window.partitionBy("season", "metric_name", F.col("player_id") % 2).orderBy(F.desc("value"))).cast("long")
    return feed.metric.select(*_M, rank.alias("overall"), group.alias("in_group"), F.round((1 - (rank - 1) / F.count("*").over(w)) * 100, 6).alias("pct"))


@query(with_feed("SELECT metric_name, season, player_id, round((rank() OVER (PARTITION BY metric_name ORDER BY value) - 1) / CAST(count(*) OVER (PARTITION BY metric_name) AS DOUBLE), 6) AS below FROM feed_metric"))
def e6_versus_history(feed: Feed) -> DataFrame:
    w = Window.partitionBy("metric_name")
    return feed.metric.select(*_M, F.round((F.rank().over(w.orderBy("value")) - 1) / F.count("*").over(w), 6).alias("below"))


_Z = "coalesce(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 0)"


@query(with_feed(f"SELECT season, metric_name, player_id, round({_Z}, 6) AS z, round(CASE WHEN metric_name LIKE 'R%' THEN -({_Z}) ELSE {_Z} END, 6) AS flipped FROM feed_metric WINDOW w AS (PARTITION BY season, metric_name)"))
def e7_e8_zscores(feed: Feed) -> DataFrame:
    z = A.zscore(F.col("value"), "season", "metric_name")
    return feed.metric.select(*_M, F.round(z, 6).alias("z"), F.round(F.when(F.col("metric_name").startswith("R"), -z).otherwise(z), 6).alias("flipped"))


@query(with_feed("SELECT season, player_id, round(coalesce(avg(m), 0), 6) AS score FROM (SELECT season, player_id, metric_name, avg(value) AS m FROM feed_metric WHERE metric_name IN ('A_F', 'N_O', 'R_F') GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def e9_row_mean(feed: Feed) -> DataFrame:
    names = ["A_F", "N_O", "R_F"]
    wide = feed.metric.filter(F.col("metric_name").isin(names)).groupBy("season", "player_id").pivot("metric_name", names).agg(F.avg("value"))
    return wide.select("season", "player_id", F.round(A.row_mean(names), 6).alias("score"))


@query(with_feed("SELECT season, metric_name, player_id, round(avg(CASE WHEN i > floor(n / 2.0) THEN value END) OVER w - avg(CASE WHEN i <= floor(n / 2.0) THEN value END) OVER w, 9) AS trend FROM (SELECT *, row_number() OVER (PARTITION BY metric_name, player_id ORDER BY season) AS i, count(*) OVER (PARTITION BY metric_name, player_id) AS n FROM feed_metric) WINDOW w AS (PARTITION BY metric_name, player_id)"))
def e10_half_split_trend(feed: Feed) -> DataFrame:
    return A.half_split_trend(feed.metric, ["metric_name", "player_id"], "season", "value").select(*_M, F.round("trend", 9).alias("trend"))


@query(with_feed("SELECT season, metric_name, player_id, round(value, 9) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY season, metric_name ORDER BY value DESC, player_id) AS rank FROM feed_metric WHERE toi_seconds >= 3600) WHERE rank <= 5"))
def e11_k6_leaderboard(feed: Feed) -> DataFrame:
    return J.top_per_group(feed.metric.filter("toi_seconds >= 3600"), ["season", "metric_name"], 5, F.desc("value"), "player_id").select(*_M, F.round("value", 9).alias("value"), "rank")


@query(with_feed("SELECT player_id, season, round(value, 9) AS value FROM feed_metric WHERE metric_name = 'N_O' AND season = (SELECT max(season) FROM feed_metric) AND player_id % 2 = 0 AND toi_seconds >= 600 ORDER BY feed_metric.value DESC, player_id LIMIT 20"))
def e12_e13_filtered_leaderboard(feed: Feed) -> DataFrame:
    m = feed.metric
    latest = m.agg(F.max("season").alias("season"))
    rows = m.join(F.broadcast(latest), "season").filter("metric_name = 'N_O' AND player_id % 2 = 0 AND toi_seconds >= 600")
    return rows.orderBy(F.desc("value"), "player_id").limit(20).select("player_id", "season", F.round("value", 9).alias("value"))


@query(with_feed("SELECT season, metric_name, player_id, round(avg(value / toi_seconds) OVER (PARTITION BY metric_name, player_id ORDER BY season ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling FROM feed_metric"))
def e14_rolling_mean(feed: Feed) -> DataFrame:
    w = Window.partitionBy("metric_name", "player_id").orderBy("season").rowsBetween(-2, 0)
    return feed.metric.select(*_M, F.round(F.avg(F.col("value") / F.col("toi_seconds")).over(w), 6).alias("rolling"))


@query("SELECT o_orderstatus, count(*) AS runs, round(avg(CASE WHEN last_price > 100000 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(sum(last_price), 2) AS total FROM (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1) GROUP BY 1")
def e16_j32_latest_summary(feed: Feed) -> DataFrame:
    last = feed.table("orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderstatus", F.col("o_totalprice").alias("last_price")), F.struct("o_orderdate", "o_orderkey")).alias("x")).select("x.*")
    return last.groupBy("o_orderstatus").agg(F.count("*").alias("runs"), F.round(F.avg(F.when(F.col("last_price") > 100000, 1.0).otherwise(0.0)), 6).alias("pass_rate"), F.round(F.sum("last_price"), 2).alias("total"))


@query(with_feed("SELECT metric_name, count(*) FILTER (abs(value - m) > 3 * s) AS beyond_3, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr FROM feed_metric JOIN (SELECT metric_name, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM feed_metric GROUP BY 1) USING (metric_name) GROUP BY 1"))
def e18_j21_j30_outliers(feed: Feed) -> DataFrame:
    m = feed.metric
    own = m.groupBy("metric_name").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)
    return m.join(own, "metric_name").groupBy("metric_name").agg(F.count_if(F.abs(F.col("value") - F.col("m")) > 3 * F.col("s")).alias("beyond_3"), F.count_if(out).alias("iqr"))


@query("SELECT bin, count(*) AS n, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM (SELECT *, ntile(10) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS bin FROM lineitem) GROUP BY 1")
def e19_deciles(feed: Feed) -> DataFrame:
    """Tenths of each flag's rows by price; three flags hold all rows, so ranks go by range."""
    rows = feed.table("lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    ranked = N.range_ranks(rows, ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"])
    out = ranked.groupBy(N.ntile(10).cast("long").alias("bin"))
    return out.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT o_orderstatus, count(*) FILTER (is_train) AS train, count(*) FILTER (NOT is_train) AS test FROM (SELECT o_orderstatus, count(*) OVER (ORDER BY o_orderdate) <= 0.8 * count(*) OVER () AS is_train FROM orders) GROUP BY 1")
def e20_holdout(feed: Feed) -> DataFrame:
    from isochron.operators.regression import time_split

    return time_split(feed.table("orders"), "o_orderdate").groupBy("o_orderstatus").agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"))


@query(with_feed("SELECT season, player_id, round(a + b, 7) AS both_, round(100 * percent_rank() OVER (PARTITION BY season ORDER BY a + b), 6) AS pct FROM (SELECT x.season, x.player_id, x.value AS a, y.value AS b FROM feed_metric x JOIN feed_metric y ON x.season = y.season AND x.player_id = y.player_id AND x.metric_name = 'A_F' AND y.metric_name = 'R_F' AND x.toi_seconds >= 600)"))
def e21_combined_ranks(feed: Feed) -> DataFrame:
    m = feed.metric
    a = m.filter("metric_name = 'A_F' AND toi_seconds >= 600").select("season", "player_id", F.col("value").alias("a"))
    b = m.filter("metric_name = 'R_F'").select("season", "player_id", F.col("value").alias("b"))
    total = F.col("a") + F.col("b")
    return a.join(b, ["season", "player_id"]).select("season", "player_id", F.round(total, 7).alias("both_"), F.round(100 * F.percent_rank().over(Window.partitionBy("season").orderBy(total)), 6).alias("pct"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def f2_intersect(feed: Feed) -> DataFrame:
    return feed.table("orders").select(F.col("o_custkey").alias("k")).intersect(feed.table("customer").filter("c_acctbal > 0").select("c_custkey"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def f3_keep_first(feed: Feed) -> DataFrame:
    return J.latest_by(feed.table("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def f4_duplicates(feed: Feed) -> DataFrame:
    return feed.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def f5_top_k(feed: Feed) -> DataFrame:
    return feed.table("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def a7_incremental_skip(feed: Feed) -> DataFrame:
    done = feed.table("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return A.incremental(feed.table("orders"), done, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer")
def a9_upsert(feed: Feed) -> DataFrame:
    c = feed.table("customer").select("c_custkey", "c_acctbal")
    return A.upsert(c, c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2)), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer")
def a10_a11_update_from(feed: Feed) -> DataFrame:
    c = feed.table("customer").select("c_custkey", "c_name")
    source = c.filter("c_custkey % 3 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, "new").otherwise(""))
    return A.update_from(c, source, ["c_custkey"], ["c_name"])


@query("SELECT r_regionkey, 'F' AS position FROM region")
def a12_missing_columns(feed: Feed) -> DataFrame:
    return A.with_columns(feed.table("region").select("r_regionkey"), {"position": F.lit("F"), "r_regionkey": F.lit(0)})


_PRESENT = "SELECT event_type, field, n AS checked, p AS present, p * 100.0 / n AS pct FROM (SELECT event_type, count(*) AS n, count(CASE WHEN user_id % 10 <> 0 THEN 1 END) AS u, count(CASE WHEN value > 25 THEN 1 END) AS v FROM events GROUP BY 1) UNPIVOT (p FOR field IN (u, v))"


@query(f"SELECT event_type, field, checked, present, round(pct, 6) AS pct, CASE WHEN pct >= 100 THEN 'always' WHEN pct >= 90 THEN 'mostly' WHEN pct > 0 THEN 'sometimes' ELSE 'never' END AS tier FROM ({_PRESENT})")
def a13_a14_field_presence(feed: Feed) -> DataFrame:
    rows = feed.table("events").select("event_type", F.when(F.col("user_id") % 10 != 0, 1).alias("u"), F.when(F.col("value") > 25, 1).alias("v"))
    return A.presence(rows, ["event_type"], ["u", "v"]).withColumn("pct", F.round("pct", 6))


@query("SELECT day, field, round(pct - before, 6) AS change FROM (SELECT *, lag(pct) OVER (ORDER BY day) AS before FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 'v' AS field, count(*) FILTER (value > 50) * 100.0 / count(*) AS pct FROM events GROUP BY 1)) WHERE abs(pct - before) > 5")
def a15_presence_drift(feed: Feed) -> DataFrame:
    rows = feed.table("events").select(F.to_date("ts").cast("string").alias("day"), F.when(F.col("value") > 50, 1).alias("v"))
    return A.presence_drift(A.presence(rows, ["day"], ["v"]), [], "day").select("day", "field", F.round("change", 6).alias("change"))


@query("SELECT 'orders' AS source, count(*) AS n FROM orders")
def a4_scan_with_path(feed: Feed) -> DataFrame:
    from isochron.sources.files import scan_partitioned

    return scan_partitioned(feed.spark, f"{feed.sf_dir}/orders.parquet", source=r"/(\w+)\.parquet").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def l3_windows(feed: Feed) -> DataFrame:
    e = feed.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return L.windows(e, "ts", ["event_type"], "value", "1 hour")


@query("SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def l3_sessions(feed: Feed) -> DataFrame:
    e = feed.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return L.sessions(e, "ts", ["user_id"], "30 minutes")


@query("SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS goals, max(event_id) AS last_event FROM events GROUP BY 1")
def l2_stream_counters(feed: Feed) -> DataFrame:
    import uuid

    stream = L.arrivals(feed.spark, feed.sf_dir, feed.table("events").schema, "events*.parquet")
    return L.to_completion(L.counters(stream, ["user_id"]), f"counters_{uuid.uuid4().hex}")


@query(with_feed("SELECT l.metric_name, l.season, l.player_id, CAST(count(*) AS BIGINT) AS seasons FROM feed_metric l JOIN feed_metric r ON l.player_id = r.player_id AND l.metric_name = r.metric_name AND r.season <= l.season GROUP BY 1, 2, 3"))
def k7_history(feed: Feed) -> DataFrame:
    return feed.metric.select(*_M, F.count("*").over(Window.partitionBy("metric_name", "player_id").orderBy("season").rangeBetween(Window.unboundedPreceding, 0)).alias("seasons"))


@query(with_feed("SELECT season, metric_name, count(DISTINCT player_id) AS players, count(*) AS n FROM feed_metric GROUP BY 1, 2"))
def k1_metrics(feed: Feed) -> DataFrame:
    return feed.metric.groupBy("season", "metric_name").agg(F.count_distinct("player_id").alias("players"), F.count("*").alias("n"))


@query(with_feed("SELECT metric_name, CAST(count(DISTINCT player_id) AS BIGINT) AS n, stddev_samp(value) < 0.0001 OR count(DISTINCT value) = 1 AS degenerate, avg(value) BETWEEN 20000 AND 60000 AS in_range FROM feed_metric GROUP BY 1"))
def j17_j35_metric_range(feed: Feed) -> DataFrame:
    return feed.metric.groupBy("metric_name").agg(F.count_distinct("player_id").alias("n"), ((F.stddev_samp("value") < 0.0001) | (F.count_distinct("value") == 1)).alias("degenerate"), F.avg("value").between(20000, 60000).alias("in_range"))


@query("SELECT 'orphan_orders' AS name, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS failures UNION ALL SELECT 'orphan_lines', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) UNION ALL SELECT 'duplicate_orders', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'bad_discount', (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1)")
def j13_source_checks(feed: Feed) -> DataFrame:
    o, li, c = feed.table("orders"), feed.table("lineitem"), feed.table("customer")
    found = {
        "orphan_orders": o.join(c, o.o_custkey == c.c_custkey, "left_anti"), "orphan_lines": li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"),
        "duplicate_orders": o.groupBy("o_orderkey").agg(F.count("*").alias("n")).filter("n > 1"), "bad_discount": li.filter("l_discount < 0 OR l_discount > 1"),
    }
    out = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("name"), "failures") for name, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS runs, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, bool_and(event_type <> 'error') AS passed FROM events GROUP BY 1")
def j29_j31_daily_health(feed: Feed) -> DataFrame:
    ok = F.col("event_type") != "error"
    return feed.table("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("pass_rate"), F.bool_and(ok).alias("passed"))


@query("SELECT day, n, n < 0.95 * lag(n) OVER (ORDER BY day) AS dropped FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def j27_row_count_drop(feed: Feed) -> DataFrame:
    per = feed.table("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return per.select("day", "n", (F.col("n") < 0.95 * F.lag("n").over(Window.orderBy("day"))).alias("dropped"))


@query("SELECT user_id % 2 AS side, round(avg((event_type = 'purchase')::INT), 6) AS mean, round(avg(((event_type = 'purchase')::INT - value / 100) ** 2), 6) AS brier FROM events GROUP BY 1")
def g10_model_quality(feed: Feed) -> DataFrame:
    hit = (F.col("event_type") == "purchase").cast("double")
    return feed.table("events").groupBy((F.col("user_id") % 2).alias("side")).agg(F.round(F.avg(hit), 6).alias("mean"), F.round(F.avg(F.pow(hit - F.col("value") / 100, F.lit(2))), 6).alias("brier"))
