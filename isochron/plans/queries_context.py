"""Conditional metrics, partners, comparisons, forecast errors and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isochron.operators import context as C
from isochron.operators import gates as G
from isochron.operators import joins as J
from isochron.operators import profile as O
from isochron.operators import surroundings as S
from isochron.plans import stints as P
from isochron.plans.feed import GAME_COLUMNS, Feed, with_feed
from isochron.plans.registry import query
from isochron.plans.sql import STINTS, after
from isochron.sources.shared import stored

#: Metrics that stand for a rating, by how much time at 5v5 they ask for; ratings of the feed are on-ice rates, as SQL can't fit
#: coefficients (see i4_rated_residuals for those). Defence: less against is higher.
CHAIN = (("xg_off_5v5", "xg_def_5v5"), ("corsi_off_5v5", "corsi_def_5v5"))
XG_SECONDS, CORSI_SECONDS = 900, 450

_RATE = "floor(CAST({0} AS DOUBLE) * {1} / seconds / 1000) / 1000"

RATED = (
    STINTS
    + f""",
on_ice_sums AS (SELECT season, player_id, CAST(sum(duration) AS BIGINT) AS seconds, CAST(round(sum(CASE WHEN sign = 1 THEN home_xg ELSE away_xg END) * 1000000) AS BIGINT) AS xf,
  CAST(round(sum(CASE WHEN sign = 1 THEN away_xg ELSE home_xg END) * 1000000) AS BIGINT) AS xa, 1000000 * sum(CASE WHEN sign = 1 THEN home_corsi ELSE away_corsi END)::BIGINT AS cf,
  1000000 * sum(CASE WHEN sign = 1 THEN away_corsi ELSE home_corsi END)::BIGINT AS ca FROM members GROUP BY 1, 2),
lookup AS (SELECT season, player_id, CASE WHEN seconds >= {XG_SECONDS} THEN {_RATE.format(3600, "xf")} WHEN seconds >= {CORSI_SECONDS} THEN {_RATE.format(60, "cf")} ELSE {_RATE.format(3600, "(xf - xa)")} END AS off,
  CASE WHEN seconds >= {XG_SECONDS} THEN -{_RATE.format(3600, "xa")} WHEN seconds >= {CORSI_SECONDS} THEN -{_RATE.format(60, "ca")} ELSE {_RATE.format(3600, "(xf - xa)")} END AS def,
  CASE WHEN seconds >= {XG_SECONDS} THEN 'xg_off_5v5' WHEN seconds >= {CORSI_SECONDS} THEN 'corsi_off_5v5' ELSE 'xg_net_5v5' END AS source FROM on_ice_sums)
"""
)

_AROUND_SQL = {
    "mate_off": "(m.o - t.off) / nullif(m.n_o - 1, 0)", "mate_def": "(m.d - t.def) / nullif(m.n_d - 1, 0)",
    "forward_mate_off": "(m.fo - CASE WHEN t.position = 'F' THEN t.off ELSE 0 END) / nullif(m.n_fo - CASE WHEN t.position = 'F' THEN 1 ELSE 0 END, 0)",
    "defence_mate_def": "(m.dd - CASE WHEN t.position = 'D' THEN t.def ELSE 0 END) / nullif(m.n_dd - CASE WHEN t.position = 'D' THEN 1 ELSE 0 END, 0)",
    "opponent_off": "r.o / nullif(r.n_o, 0)", "opponent_def": "r.d / nullif(r.n_d, 0)",
}

_AROUND_COLUMNS = ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in _AROUND_SQL)

CONTEXT = (
    RATED
    + f""",
rated_shifts AS (SELECT s.*, off, def, source FROM feed_shifts s LEFT JOIN lookup USING (season, player_id)),
ticks AS (SELECT *, unnest(generate_series(CAST(ceil(start_seconds / 5.0) AS BIGINT) * 5, end_seconds - 1, 5)) AS tick FROM rated_shifts),
tick_sums AS (SELECT game_id, period, tick, team_id, sum(off) AS o, count(off) AS n_o, sum(def) AS d, count(def) AS n_d, coalesce(sum(off) FILTER (position = 'F'), 0) AS fo, count(off) FILTER (position = 'F') AS n_fo,
  coalesce(sum(def) FILTER (position = 'D'), 0) AS dd, count(def) FILTER (position = 'D') AS n_dd FROM ticks GROUP BY 1, 2, 3, 4),
around AS (SELECT t.game_id, t.period, t.player_id, t.start_seconds, {", ".join(f"avg({x}) AS {c}" for c, x in _AROUND_SQL.items())} FROM (SELECT * FROM ticks WHERE off IS NOT NULL) t
  JOIN tick_sums m ON m.game_id = t.game_id AND m.period = t.period AND m.tick = t.tick AND m.team_id = t.team_id
  LEFT JOIN tick_sums r ON r.game_id = t.game_id AND r.period = t.period AND r.tick = t.tick AND r.team_id <> t.team_id GROUP BY 1, 2, 3, 4),
totals AS (SELECT s.game_id, s.period, s.player_id, s.start_seconds, coalesce(sum(xg) FILTER (event_team_id = team_id), 0) AS xgf, coalesce(sum(xg) FILTER (event_team_id <> team_id), 0) AS xga,
  count(*) FILTER (event_team_id = team_id) AS cf, count(*) FILTER (event_team_id <> team_id) AS ca FROM feed_shifts s LEFT JOIN feed_events e ON e.game_id = s.game_id AND e.period = s.period
  AND period_seconds >= start_seconds AND period_seconds < end_seconds AND event_type IN ('SHOT', 'MISSED_SHOT', 'GOAL', 'BLOCKED_SHOT') GROUP BY 1, 2, 3, 4),
starts AS (SELECT s.game_id, s.period, s.player_id, s.start_seconds, max_by(CASE WHEN team_id = home_team_id THEN home_score - away_score ELSE away_score - home_score END, (period_seconds, event_id)) AS score_state,
  coalesce(max_by(zone_code, event_id) FILTER (event_type = 'FACEOFF' AND period_seconds = start_seconds), 'F') AS zone_start
  FROM feed_shifts s LEFT JOIN lineups l ON l.game_id = s.game_id AND l.period = s.period AND period_seconds <= start_seconds GROUP BY 1, 2, 3, 4),
context AS (SELECT season, game_id, team_id, period, player_id, position, start_seconds, CAST(end_seconds - start_seconds AS DOUBLE) AS duration_seconds, source, zone_start, CAST(score_state AS BIGINT) AS score_state,
  round(xgf, 6) AS xgf, round(xga, 6) AS xga, cf, ca, {_AROUND_COLUMNS},
  round(xgf - (coalesce(off, 0) + coalesce(mate_off, 0) + coalesce(opponent_def, 0)), 6) AS residual_for, round(xga - (coalesce(def, 0) + coalesce(mate_def, 0) + coalesce(opponent_off, 0)), 6) AS residual_against
  FROM rated_shifts JOIN totals USING (game_id, period, player_id, start_seconds) JOIN starts USING (game_id, period, player_id, start_seconds) LEFT JOIN around USING (game_id, period, player_id, start_seconds)
  WHERE end_seconds - start_seconds >= 30)
"""
)

FLAGGED = (
    CONTEXT
    + """,
marks AS (SELECT season, quantile_cont(opponent_off, 0.8) AS off_high, quantile_cont(opponent_def, 0.2) AS def_low, quantile_cont(mate_off, 0.75) AS mate_high,
  quantile_cont(mate_off, 0.25) AS mate_low, quantile_cont(mate_def, 0.75) AS way_high, quantile_cont(mate_def, 0.25) AS way_low FROM context GROUP BY season),
flagged AS (SELECT c.*, opponent_off >= off_high AS shutdown, opponent_def <= def_low AS breaker, mate_off >= mate_high AS mates_high, mate_off <= mate_low AS mates_low,
  mate_def >= way_high AS twoway_high, mate_def <= way_low AS twoway_low, abs(score_state) <= 1 AS clutch FROM context c JOIN marks USING (season) WHERE duration_seconds > 0)
"""
)

SCORED = (
    FLAGGED
    + """,
raw AS (SELECT season, player_id, count(*) AS shifts, sum(duration_seconds) AS toi_seconds, count(*) FILTER (shutdown) AS n_shutdown,
  coalesce(sum(-residual_against * duration_seconds) FILTER (shutdown) / sum(duration_seconds) FILTER (shutdown), 0) AS shutdown,
  coalesce(stddev_samp(residual_against) FILTER (shutdown), 0) AS consistency,
  coalesce(sum(residual_for * duration_seconds) FILTER (breaker) / sum(duration_seconds) FILTER (breaker), 0) AS breaker,
  coalesce(sum(-residual_against * duration_seconds) FILTER (clutch) / sum(duration_seconds) FILTER (clutch), 0) AS clutch_against,
  coalesce(sum(residual_for * duration_seconds) FILTER (clutch) / sum(duration_seconds) FILTER (clutch), 0) AS clutch_for,
  coalesce(sum(residual_for * duration_seconds) FILTER (mates_high) / sum(duration_seconds) FILTER (mates_high), 0)
    - coalesce(sum(residual_for * duration_seconds) FILTER (mates_low) / sum(duration_seconds) FILTER (mates_low), 0) AS psi,
  coalesce(sum(residual_against * duration_seconds) FILTER (twoway_low) / sum(duration_seconds) FILTER (twoway_low), 0)
    - coalesce(sum(residual_against * duration_seconds) FILTER (twoway_high) / sum(duration_seconds) FILTER (twoway_high), 0) AS psi_twoway,
  CASE WHEN count(residual_for) >= 10 AND min(mate_off) < max(mate_off) THEN coalesce(regr_slope(residual_for, mate_off), 0) ELSE 0 END AS elasticity
  FROM flagged GROUP BY season, player_id HAVING sum(duration_seconds) >= 600),
scored AS (SELECT *, """
    + ", ".join(f"coalesce(({c} - avg({c}) OVER s) / nullif(stddev_samp({c}) OVER s, 0), 0) AS {c}_z" for c in C.SCORES)
    + " FROM raw WINDOW s AS (PARTITION BY season))"
)

#: Means of values of six decimals often lie halfway between two results, where the order of a sum would decide; this moves the
#: edges of rounding to where no mean of few rows lies.
STEADY = 1.6180339e-7

_VALUES = ("shutdown", "consistency", "breaker", "clutch_against", "clutch_for", "psi", "psi_twoway", "elasticity", *(f"{c}_z" for c in C.SCORES))


def on_ice_ratings(feed: Feed) -> DataFrame:
    """season, player_id, metric_name, value: rates at 5v5 in whole thousandths, of those with enough time for a metric."""
    s = P.stints(P.filter_strength(P.lineups(feed), "5v5"))
    own, other = (lambda x: F.when(F.col("sign") == 1, F.col(f"home_{x}")).otherwise(F.col(f"away_{x}"))), (lambda x: F.when(F.col("sign") == 1, F.col(f"away_{x}")).otherwise(F.col(f"home_{x}")))
    micro = lambda x: F.round(F.sum(x) * 1000000).cast("long")
    sums = P.player_stints(s).groupBy("season", "player_id").agg(F.sum("duration").alias("seconds"), micro(own("xg")).alias("xf"), micro(other("xg")).alias("xa"), micro(own("corsi")).alias("cf"), micro(other("corsi")).alias("ca"))
    rate = lambda x, per: F.floor(F.lit(float(per)) * x / F.col("seconds") / 1000).cast("double") / 1000
    metrics = {"xg_off_5v5": (rate(F.col("xf"), 3600), XG_SECONDS), "xg_def_5v5": (-rate(F.col("xa"), 3600), XG_SECONDS), "corsi_off_5v5": (rate(F.col("cf"), 60), CORSI_SECONDS), "corsi_def_5v5": (-rate(F.col("ca"), 60), CORSI_SECONDS), "xg_net_5v5": (rate(F.col("xf") - F.col("xa"), 3600), 0)}
    long = F.array(*[F.struct(F.lit(name).alias("metric_name"), F.when(F.col("seconds") >= least, value).alias("value")) for name, (value, least) in metrics.items()])
    return sums.select("season", "player_id", F.explode(long).alias("m")).select("season", "player_id", "m.*").filter("value IS NOT NULL")


def _lookup(feed: Feed) -> DataFrame:
    return S.rating_lookup(on_ice_ratings(feed), ["season", "player_id"], CHAIN, "xg_net")


def shift_context(feed: Feed, lookup: DataFrame) -> DataFrame:
    """The feed's shifts with their surroundings and residuals by the ratings of `lookup`, to six decimals."""
    events = feed.events.withColumns({name: F.expr(x) for name, x in GAME_COLUMNS.items()})
    rows = S.shift_context(feed.shifts, P.running_score(events), feed.events.filter(F.col("event_type").isin(*P.SHOTS)), lookup)
    rounded = [F.round(c, 6).alias(c) for c in ("xgf", "xga")], [F.round(c, 6).alias(c) for c in (*S.AROUND, "residual_for", "residual_against")]
    return rows.select("season", "game_id", "team_id", "period", "player_id", "position", "start_seconds", (F.col("end_seconds") - F.col("start_seconds")).cast("double").alias("duration_seconds"), "source", "zone_start", F.col("score_state").cast("long").alias("score_state"), *rounded[0], "cf", "ca", *rounded[1])


def _context(feed: Feed) -> DataFrame:
    """Read twice, for thresholds and rows, so it's stored."""
    return stored(shift_context(feed, _lookup(feed)))


def _scored(feed: Feed) -> DataFrame:
    return C.conditional_scores(C.context_flags(_context(feed)), 600)


@query(after(RATED, "SELECT season, player_id, off, def, source FROM lookup"))
def i2_rating_lookup(feed: Feed) -> DataFrame:
    return _lookup(feed)


@query(after(CONTEXT, "SELECT * FROM context"))
def i4_shift_residuals(feed: Feed) -> DataFrame:
    """Start, totals, surroundings and residuals of each shift of the feed."""
    return shift_context(feed, _lookup(feed))


@query()
def i4_rated_residuals(feed: Feed) -> DataFrame:
    """The same by fitted ratings: xG of both sides, else attempts, else any net rating. No SQL, as coefficients have none."""
    from isochron.plans.queries_ratings import season_ratings

    ratings = season_ratings(feed, {"net": {"xg_rapm_5v5": "xg"}, "sides+": {"corsi_{}_rapm_5v5": "corsi"}, "sides": {"xg_{}_rapm_5v5": "xg"}})
    chain = [(f"{x}_off_rapm_5v5", f"{x}_def_rapm_5v5") for x in ("xg", "corsi")]
    return shift_context(feed, S.rating_lookup(ratings, ["season", "player_id"], chain, "rapm"))


@query(after(FLAGGED, "SELECT season, count(*) AS n, " + ", ".join(f"count(*) FILTER ({x}) AS {x}" for x in ("shutdown", "breaker", "clutch", "mates_high", "mates_low", "twoway_high", "twoway_low")) + " FROM flagged GROUP BY season"))
def i5_i6_shift_flags(feed: Feed) -> DataFrame:
    names = ("shutdown", "breaker", "clutch", "mates_high", "mates_low", "twoway_high", "twoway_low")
    return C.context_flags(_context(feed)).groupBy("season").agg(F.count("*").alias("n"), *[F.count_if(x).alias(x) for x in names])


@query(after(SCORED, "SELECT season, player_id, shifts, toi_seconds, n_shutdown, " + ", ".join(f"round({c} + {STEADY}, 6) AS {c}" for c in _VALUES) + " FROM scored"))
def i7_i8_i9_conditional_scores(feed: Feed) -> DataFrame:
    return _scored(feed).select("season", "player_id", "shifts", "toi_seconds", "n_shutdown", *[F.round(F.col(c) + STEADY, 6).alias(c) for c in _VALUES])


@query(after(SCORED, """SELECT season, player_id, round(psi_z, 5) AS psi_z, place FROM (SELECT *, row_number() OVER (ORDER BY round(psi_z, 5) DESC, player_id) AS place
  FROM scored WHERE season = (SELECT max(season) FROM scored)) WHERE place <= 10"""))
def k10_conditional_leaderboard(feed: Feed) -> DataFrame:
    """The ten best of the latest season by five decimals, then by number: a top-k report."""
    scored = _scored(feed).select("season", "player_id", F.round("psi_z", 5).alias("psi_z"))
    latest = scored.agg(F.max("season").alias("season"))
    best = scored.join(F.broadcast(latest), "season").orderBy(F.desc("psi_z"), "player_id").limit(10)  # one row is broadcast
    return best.select("season", "player_id", "psi_z", F.row_number().over(Window.orderBy(F.desc("psi_z"), "player_id")).alias("place"))


_PAIRS = """pairs AS (SELECT a.player_id AS one, b.player_id AS two, CAST(sum(least(a.end_seconds, b.end_seconds) - greatest(a.start_seconds, b.start_seconds)) AS BIGINT) AS toi_seconds
  FROM feed_shifts a JOIN feed_shifts b ON a.game_id = b.game_id AND a.team_id = b.team_id AND a.period = b.period AND a.player_id < b.player_id
    AND greatest(a.start_seconds, b.start_seconds) < least(a.end_seconds, b.end_seconds) WHERE a.position = 'D' AND b.position = 'D' GROUP BY 1, 2),
ends AS (SELECT one AS entity, two AS partner, toi_seconds FROM pairs UNION ALL SELECT two, one, toi_seconds FROM pairs)
"""


@query(after(_PAIRS, """SELECT entity, partner, toi_seconds, place FROM
  (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY toi_seconds DESC, partner) AS place FROM ends) WHERE place <= 3"""))
def k11_partners(feed: Feed) -> DataFrame:
    """Each defender's three commonest partners, from either side of the pair."""
    pairs = J.interval_overlap_join(feed.shifts.filter("position = 'D'"), ["game_id", "team_id", "period"], "player_id", "start_seconds", "end_seconds")
    pairs = pairs.groupBy("player_id_1", "player_id_2").agg(F.sum(F.col("overlap_end") - F.col("overlap_start")).alias("toi_seconds"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("toi_seconds"), "partner"))
    return C.partners(pairs, "player_id_1", "player_id_2").withColumn("place", place).filter("place <= 3")


_NEXT = "(SELECT *, lag(value) OVER (PARTITION BY metric_name, player_id ORDER BY season) AS forecast FROM feed_metric)"


@query(with_feed(f"SELECT metric_name, count(forecast) AS n, round(avg(abs(value - forecast)), 4) AS mae, round(sqrt(avg((value - forecast) ** 2)), 4) AS rmse FROM {_NEXT} GROUP BY 1"))
def g24_forecast_error(feed: Feed) -> DataFrame:
    """Of each season's value as the forecast of the entity's next one."""
    rows = feed.metric.withColumn("forecast", F.lag("value").over(Window.partitionBy("metric_name", "player_id").orderBy("season")))
    miss = F.col("value") - F.col("forecast")
    return rows.groupBy("metric_name").agg(F.count("forecast").alias("n"), F.round(F.avg(F.abs(miss)), 4).alias("mae"), F.round(F.sqrt(F.avg(miss * miss)), 4).alias("rmse"))


@query(with_feed("SELECT metric_name, season, round(stddev_samp(value / 1000) + 10 * avg(CASE WHEN abs(value / 1000) > 40 THEN 1.0 ELSE 0.0 END), 5) AS fitness FROM feed_metric GROUP BY 1, 2"))
def g29_fitness(feed: Feed) -> DataFrame:
    """Spread and ten times the share of outliers (values in thousands, beyond 40)."""
    value = F.col("value") / 1000
    return feed.metric.groupBy("metric_name", "season").agg(F.round(F.stddev_samp(value) + 10 * F.avg(F.when(F.abs(value) > 40, 1.0).otherwise(0.0)), 5).alias("fitness"))


@query(with_feed("""SELECT season, player_id, metric_name, round(CASE WHEN sum(own) OVER g > 0 THEN own / sum(own) OVER g ELSE 1.0 / count(*) OVER g END, 6) AS share
  FROM (SELECT *, greatest(value - 30000, 0) * CASE WHEN metric_name = 'A_F' THEN 2 ELSE 1 END AS own FROM feed_metric) WINDOW g AS (PARTITION BY season, player_id)"""))
def g35_shares(feed: Feed) -> DataFrame:
    """Metrics' shares of an entity's season; a stable metric weighs twice, what isn't above 30,000 nothing."""
    rows = feed.metric.withColumn("over", F.col("value") - 30000)
    weight = F.when(F.col("metric_name") == "A_F", 2).otherwise(1)
    return rows.select("season", "player_id", "metric_name", F.round(C.shares(rows, ["season", "player_id"], "over", weight), 6).alias("share"))


@query(with_feed("""SELECT a.metric_name, a.player_id AS one, b.player_id AS two, count(*) AS seasons, round(avg(a.value), 3) AS mean_one, round(avg(b.value), 3) AS mean_two,
  CASE WHEN avg(a.value) >= avg(b.value) THEN a.player_id ELSE b.player_id END AS winner
  FROM feed_metric a JOIN feed_metric b ON a.metric_name = b.metric_name AND a.season = b.season AND b.player_id = a.player_id + 1 GROUP BY 1, 2, 3"""))
def i20_head_to_head(feed: Feed) -> DataFrame:
    """Entities of successive numbers over their common seasons."""
    a = feed.metric.select("metric_name", "season", F.col("player_id").alias("one"), F.col("value").alias("x"))
    b = feed.metric.select("metric_name", "season", (F.col("player_id") - 1).alias("one"), F.col("player_id").alias("two"), F.col("value").alias("y"))
    x, y = F.avg("x"), F.avg("y")
    out = a.join(b, ["metric_name", "season", "one"]).groupBy("metric_name", "one", "two").agg(F.count("*").alias("seasons"), F.round(x, 3).alias("mean_one"), F.round(y, 3).alias("mean_two"), (x >= y).alias("_first"))
    return out.withColumn("winner", F.when(F.col("_first"), F.col("one")).otherwise(F.col("two"))).drop("_first")


@query(with_feed("""SELECT season, player_id, games, toi_seconds, CASE WHEN season < (SELECT max(season) FROM feed_games) THEN games >= 2 AND toi_seconds >= 3000 ELSE games >= 1 END AS qualified
  FROM (SELECT season, player_id, count(DISTINCT game_id) AS games, CAST(sum(end_seconds - start_seconds) AS BIGINT) AS toi_seconds FROM feed_shifts WHERE position <> 'G' GROUP BY 1, 2)"""))
def i13_qualified(feed: Feed) -> DataFrame:
    """Past seasons ask for games and time, the latest for games alone (here 2 games, 3,000 seconds and 1 game)."""
    rows = feed.shifts.filter("position <> 'G'").groupBy("season", "player_id")
    rows = rows.agg(F.count_distinct("game_id").alias("games"), F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("toi_seconds"))
    latest = F.broadcast(feed.games.agg(F.max("season").alias("_latest")))  # one row
    past = (F.col("games") >= 2) & (F.col("toi_seconds") >= 3000)
    return rows.crossJoin(latest).withColumn("qualified", F.when(F.col("season") < F.col("_latest"), past).otherwise(F.col("games") >= 1)).drop("_latest")


@query(with_feed("""SELECT count(*) AS n, round(corr(a.value, b.old), 6) AS r, round(max(abs(a.value - b.old)), 3) <= 0.001 AS close, corr(a.value, b.old) > 0.99 AND max(abs(a.value - b.old)) < 0.001 AS passed
  FROM feed_metric a JOIN (SELECT season, metric_name, player_id, round(value, 4) AS old FROM feed_metric) b USING (season, metric_name, player_id)"""))
def j25_golden(feed: Feed) -> DataFrame:
    """The metric against its values as a golden file keeps them, to four places."""
    golden = feed.metric.withColumn("value", F.round("value", 4))
    out = C.golden_difference(feed.metric, golden, ["season", "metric_name", "player_id"], "value")
    return out.select("n", F.round("r", 6).alias("r"), (F.round("most", 3) <= 0.001).alias("close"), "passed")


@query(with_feed("""SELECT metric_name, count(*) AS n, count(*) FILTER (abs(value - mean) > 3 * spread) AS outliers, round(max(spread) / max(mean), 5) AS cv, bool_and(toi_seconds > 0) AS toi_ok
  FROM (SELECT *, avg(value) OVER m AS mean, stddev_samp(value) OVER m AS spread FROM feed_metric WINDOW m AS (PARTITION BY metric_name)) GROUP BY 1"""))
def j19_j21_rating_audit(feed: Feed) -> DataFrame:
    """Each metric's spread, outliers and times. The mean and spread are a row a metric, joined back."""
    marks = feed.metric.groupBy("metric_name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"))
    rows = feed.metric.join(marks, "metric_name")
    far = F.abs(F.col("value") - F.col("mean")) > 3 * F.col("spread")
    return rows.groupBy("metric_name").agg(F.count("*").alias("n"), F.count_if(far).alias("outliers"), F.round(F.max("spread") / F.max("mean"), 5).alias("cv"), F.bool_and(F.col("toi_seconds") > 0).alias("toi_ok"))


@query("""SELECT severity, count(*) AS checks, sum(failures) AS failures FROM (SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'critical' WHEN event_type = 'signup' THEN 'warning' ELSE 'info' END AS severity,
  event_type, CAST(count(*) FILTER (value < 10) AS BIGINT) AS failures FROM events GROUP BY 1, 2) GROUP BY 1""")
def j34_triage(feed: Feed) -> DataFrame:
    """Failed checks (here values under 10 by type of event) by the severity that their name has."""
    checks = feed.table("events").groupBy("event_type").agg(F.count_if(F.col("value") < 10).alias("failures"))
    severity = F.when(F.col("event_type").isin("error", "purchase"), "critical").when(F.col("event_type") == "signup", "warning").otherwise("info")
    return checks.groupBy(severity.alias("severity")).agg(F.count("*").alias("checks"), F.sum("failures").alias("failures"))


@query(after(RATED, f"""SELECT season, player_id, count(*) AS mates, count(*) FILTER (impact > 0.05) AS boosted, count(*) FILTER (impact < -0.05) AS hurt, round(avg(impact) + {STEADY}, 6) AS avg_impact
  FROM (SELECT p.season, p.player_id, round(together - coalesce(off, 0) + {STEADY}, 6) AS impact FROM (SELECT season, player_id, mate_id, avg(net) AS together FROM (SELECT season, player_id, duration, CAST(3600 AS DOUBLE) * CASE WHEN sign = 1 THEN home_xg ELSE away_xg END / duration AS net,
    unnest(CASE WHEN sign = 1 THEN home_skaters ELSE away_skaters END) AS mate_id FROM members WHERE duration >= 30) WHERE mate_id <> player_id GROUP BY 1, 2, 3 HAVING sum(duration) >= 300) p
  LEFT JOIN lookup l ON l.season = p.season AND l.player_id = p.mate_id AND source = 'xg_off_5v5') GROUP BY 1, 2"""))
def i22_teammate_impact(feed: Feed) -> DataFrame:
    """How many mates have more or less xG an hour beside a player than they have in all (stints of 30 seconds, 300 seconds together);
    mates without that rating count from 0. The feed's shifts last 50 seconds, so the bounds are half of the operator's."""
    m = P.player_stints(P.stints(P.filter_strength(P.lineups(feed), "5v5")))
    mates = F.when(F.col("sign") == 1, F.col("home_skaters")).otherwise(F.col("away_skaters"))
    rows = m.select("season", "player_id", "duration", mates.alias("mates"), (3600.0 * F.when(F.col("sign") == 1, F.col("home_xg")).otherwise(F.col("away_xg")) / F.col("duration")).alias("value"))
    return O.mate_impact(rows, _lookup(feed).filter(F.col("source") == CHAIN[0][0]), 30, 300, steady=STEADY).withColumn("avg_impact", F.round(F.col("avg_impact") + STEADY, 6))


def _checks_sql() -> str:
    rated = {"mean": "avg(value)", "deviation": "stddev_samp(value)", "p05": "quantile_cont(value, 0.05)", "p50": "quantile_cont(value, 0.5)", "p95": "quantile_cont(value, 0.95)", "correlation": "corr(value, other)"}
    passed = {"mean": "abs(value) <= 0.5", "deviation": "value > 0.3 AND value < 5", "correlation": "value >= 0.6", "reliable": "value >= 0.1"}
    parts = [f"SELECT '{name}' AS \"check\", {x} AS value FROM rated" for name, x in rated.items()]
    shares = {**{f"zone {z}": f"zone_start = '{z}'" for z in "ODN"}, "score level": "score_state = 0", "score by one": "abs(score_state) = 1"}
    parts += [f"SELECT '{name}', count(*) FILTER ({test}) / CAST(count(*) AS DOUBLE) FROM context" for name, test in shares.items()]
    parts.append("SELECT 'reliable', count(*) FILTER (shifts >= 50) / CAST(count(*) AS DOUBLE) FROM scored WHERE season = (SELECT max(season) FROM scored)")
    tests = " ".join(f"WHEN '{name}' THEN {test}" for name, test in passed.items())
    return after(f"""{SCORED}, rated AS (SELECT {_RATE.format(60, "cf")} - {_RATE.format(60, "ca")} AS value, {_RATE.format(3600, "xf")} - {_RATE.format(3600, "xa")} AS other FROM on_ice_sums
  WHERE seconds >= {XG_SECONDS} AND season = (SELECT max(season) FROM on_ice_sums)), checks AS ({" UNION ALL ".join(parts)})""",
        f"SELECT \"check\", round(value + {STEADY}, 6) AS value, coalesce(CASE \"check\" {tests} WHEN 'p05' THEN value IS NOT NULL WHEN 'p50' THEN value IS NOT NULL WHEN 'p95' THEN value IS NOT NULL ELSE value > 0 END, false) AS passed FROM checks")


@query(_checks_sql())
def j24_spot_checks(feed: Feed) -> DataFrame:
    """Of the latest season's net rates of attempts and xG, of the context of all shifts, and of conditional scores."""
    ratings = on_ice_ratings(feed)
    pairs = ratings.groupBy("season", "player_id").pivot("metric_name", [x for pair in CHAIN for x in pair]).agg(F.first("value")).dropna()
    pairs = stored(pairs.select("season", (F.col("corsi_off_5v5") + F.col("corsi_def_5v5")).alias("value"), (F.col("xg_off_5v5") + F.col("xg_def_5v5")).alias("other")))
    context = stored(shift_context(feed, S.rating_lookup(ratings, ["season", "player_id"], CHAIN, "xg_net")))
    scores = stored(C.conditional_scores(C.context_flags(context), 600).select("season", "shifts"))
    late = lambda df: df.join(F.broadcast(df.agg(F.max("season").alias("season"))), "season")  # noqa: E731  one row
    return G.spot_checks(late(pairs), context, late(scores)).withColumn("value", F.round(F.col("value") + STEADY, 6))
