"""Profiles: trends of category scores, texts, checks and nested export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.operators import cards as K
from isochron.operators import joins as J
from isochron.plans.feed import Feed
from isochron.plans.queries_latent import CATEGORIES, i12_category_scores
from isochron.plans.queries_model import career_peers
from isochron.plans.queries_profile import i14_rules
from isochron.plans.registry import oracle_of, query
from isochron.sources.shared import stored

#: What a category is called among an entity's strengths; attack and defence first.
STRENGTHS = {"offense": "offensive production", "defense": "defensive impact", "transition": "transition play", "special_teams": "special teams", "discipline": "discipline", "finishing": "finishing"}

#: The metric whose rules flag an entity; the most texts (a report of the best).
FLAG_METRIC, TEXTS = "A_F", 200

#: As in the queries of conditional scores: moves the edges of rounding to where no mean of few rows lies.
_STEADY = 1.6180339e-7

_TREND_SQL = f"""scores AS ({oracle_of("i12_category_scores")}),
halves AS (SELECT *, row_number() OVER e AS i, count(*) OVER (PARTITION BY player_id, suffix, category) AS n FROM scores WINDOW e AS (PARTITION BY player_id, suffix, category ORDER BY season)),
trends AS (SELECT h.*, round(t.trend + {_STEADY}, 6) AS trend FROM halves h JOIN (SELECT player_id, suffix, category, CASE WHEN max(n) > 1 THEN avg(score) FILTER (i > n // 2) - avg(score) FILTER (i <= n // 2) END AS trend
  FROM halves GROUP BY 1, 2, 3) t USING (player_id, suffix, category))"""

_CARD_SQL = f"""{_TREND_SQL}, latest AS (SELECT * FROM trends WHERE season = (SELECT max(season) FROM trends)),
rules AS ({oracle_of("i14_rules")}), flags AS (SELECT player_id, regression, breakout FROM rules WHERE metric_name = '{FLAG_METRIC}' AND season = (SELECT max(season) FROM trends)),
alike AS ({oracle_of("g33_career_cosine")}), peers AS (SELECT query_id AS player_id, list('Player ' || peer_id ORDER BY rank) FILTER (rank <= 3) AS near_names FROM alike GROUP BY 1)"""


def _signal(category: str, column: str = "percentile") -> str:
    return f"max({column}) FILTER (category = '{category}' AND suffix = 'signal')"


_MOVES = "CASE WHEN {0} > 0.5 THEN 'improving significantly' WHEN {0} > 0.2 THEN 'trending upward' WHEN {0} < -0.5 THEN 'declining significantly' WHEN {0} < -0.2 THEN 'trending downward' END"
_LEVEL = "CASE WHEN {0} >= 95 THEN 'elite' WHEN {0} >= 85 THEN 'excellent' ELSE 'above-average' END"
_STRONG = ", ".join(f"CASE WHEN {c} >= 70 THEN '{text}' END" for c, text in STRENGTHS.items())
_ONLY = " ".join(f"WHEN {c} >= 70 THEN " + _LEVEL.format(c) for c in STRENGTHS)

_TEXT_SQL = f"""{_CARD_SQL},
wide AS (SELECT player_id, player_id % 2 AS side, {", ".join(f"{_signal(c)} AS {c}" for c in STRENGTHS)}, {_signal("offense", "trend")} AS up, {_signal("defense", "trend")} AS down FROM latest GROUP BY 1),
listed AS (SELECT *, list_filter([{_STRONG}], lambda x: x IS NOT NULL) AS strong, CASE WHEN side = 0 THEN 'forward' ELSE 'defender' END AS noun FROM wide),
parts AS (SELECT player_id, offense, CASE WHEN offense >= 85 AND defense >= 85 THEN 'an elite two-way ' || noun WHEN offense >= 85 THEN 'an elite offensive ' || noun WHEN defense >= 85 THEN 'an elite defensive ' || noun
  WHEN offense >= 70 AND defense >= 70 THEN 'a well-rounded ' || noun WHEN offense >= 70 THEN 'an offensive ' || noun WHEN defense >= 70 THEN 'a defensive ' || noun ELSE 'a ' || noun END AS kind,
  CASE WHEN len(strong) = 0 THEN '' WHEN len(strong) = 1 THEN ' with ' || (CASE {_ONLY} END) || ' ' || strong[1] ELSE ', strong in ' || array_to_string(strong[1:3], ', ') END AS good,
  concat_ws(', ', 'offense is ' || {_MOVES.format("up")}, 'defense is ' || {_MOVES.format("down")}) AS moves FROM listed)"""


def _trends(feed: Feed) -> DataFrame:
    rows = K.category_trends(i12_category_scores(feed), ["player_id"], "season")
    return rows.withColumn("trend", F.round(F.col("trend") + _STEADY, 6))


def profiles(feed: Feed, alike: DataFrame | None = None) -> DataFrame:
    """The latest season's profile of each entity: categories, peers (`alike`, where they're known already), flags and text."""
    trends = stored(_trends(feed))
    latest = F.broadcast(trends.agg(F.max("season").alias("season")))  # one row
    own = K.cards(trends.join(latest, "season"), ["season", "player_id"]).withColumn("side", F.when(F.col("player_id") % 2 == 0, "F").otherwise("D"))
    flags = i14_rules(feed).filter(F.col("metric_name") == FLAG_METRIC).select("season", "player_id", "regression", "breakout")
    near = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("Player "), F.col("peer_id")).alias("name"))))
    peers = (career_peers(feed, 3) if alike is None else alike).groupBy(F.col("query_id").alias("player_id")).agg(F.transform(near, lambda x: x["name"]).alias("similar"))
    rows = own.join(flags, ["season", "player_id"], "left").join(peers, "player_id", "left").withColumn("similar", F.coalesce("similar", F.array().cast("array<string>")))
    noun = F.when(F.col("side") == "F", "forward").otherwise("defender")
    text = K.narrative(F.concat(F.lit("Player "), F.col("player_id")), noun, noun, STRENGTHS, F.col("similar"), F.col("regression"), F.col("breakout"))
    return rows.withColumn("narrative", text)


@query(f"WITH {_TREND_SQL} SELECT season, player_id, suffix, category, trend FROM trends")
def i12_category_trends(feed: Feed) -> DataFrame:
    """Later half of an entity's seasons against the earlier half, for each category and suffix."""
    return _trends(feed).select("season", "player_id", "suffix", "category", "trend")


@query(f"""WITH {_TEXT_SQL} SELECT player_id, 'Player ' || player_id || ' is ' || kind || good || '.' || coalesce(' Comparable to ' || array_to_string(near_names[1:2], ' and ') || '.', '')
  || CASE WHEN regression <> '' THEN ' Regression candidate: ' || regression || '.' WHEN breakout <> '' THEN ' Breakout candidate: ' || breakout || '.' WHEN moves <> '' THEN ' Lately ' || moves || '.' ELSE '' END AS narrative
  FROM parts LEFT JOIN flags USING (player_id) LEFT JOIN peers USING (player_id) ORDER BY offense DESC, player_id LIMIT {TEXTS}""")
def i15_narratives(feed: Feed) -> DataFrame:
    """Texts of the latest season's 200 best by offense: a top-k report."""
    rows = profiles(feed).withColumn("_best", F.col("categories")["offense"]["signal"])
    return rows.orderBy(F.desc("_best"), "player_id").limit(TEXTS).select("player_id", "narrative")


def _checks_sql() -> str:
    players = {"as is": "SELECT DISTINCT player_id, player_id % 2 AS side FROM latest", "planted": "SELECT DISTINCT player_id, CASE WHEN player_id % 5 <> 0 THEN player_id % 2 END FROM latest"}
    parts = [f"SELECT '{run}' AS run, * FROM ({rows})" for run, rows in players.items()]
    counts = {
        "required": "SELECT run, count(*) FILTER (side IS NULL) FROM players GROUP BY 1",
        "percentiles": "SELECT run, count(*) FILTER (beyond > 0 OR (run = 'planted' AND player_id % 7 = 0)) FROM players JOIN (SELECT player_id, count(*) FILTER (percentile NOT BETWEEN 0 AND 100) AS beyond FROM latest GROUP BY 1) USING (player_id) GROUP BY 1",
        "categories": f"SELECT run, count(*) FILTER (own < {len(CATEGORIES)}) FROM players JOIN (SELECT player_id, count(DISTINCT category) AS own FROM latest GROUP BY 1) USING (player_id) GROUP BY 1",
        "groups": "SELECT run, count(*) FILTER (side IS NULL) FROM players GROUP BY 1",
        "similarity": "SELECT run, coalesce(n, 0) FROM (SELECT DISTINCT run FROM players) LEFT JOIN (SELECT q.run, count(*) FILTER (coalesce(q.side <> p.side, true)) AS n FROM alike JOIN players q ON q.player_id = query_id LEFT JOIN players p ON p.run = q.run AND p.player_id = peer_id WHERE rank <= 3 GROUP BY 1) USING (run)",
    }
    rows = " UNION ALL ".join(f"SELECT run, '{check}' AS \"check\", CAST(n AS BIGINT) AS failures, n = 0 AS passed FROM ({sql}) t(run, n)" for check, sql in counts.items())
    return f"WITH {_CARD_SQL}, players AS ({' UNION ALL '.join(parts)}) {rows}"


@query(_checks_sql())
def i17_profile_checks(feed: Feed) -> DataFrame:
    """Checks of all profiles of the latest season; and again with planted faults: no group for each fifth player, a percentile of
    150 for each seventh."""
    feed = feed.with_stored_metric()
    alike = stored(career_peers(feed, 3))
    rows = stored(profiles(feed, alike))
    high = lambda c, v: F.when((c == "offense") & (F.col("player_id") % 7 == 0), 150.0).otherwise(v["signal"])
    worse = F.transform_values("categories", lambda c, v: F.struct(v["actual"].alias("actual"), high(c, v).alias("signal"), v["trend"].alias("trend")))
    planted = rows.withColumns({"side": F.when(F.col("player_id") % 5 != 0, F.col("side")), "categories": worse})
    peers = alike.select(F.col("query_id").alias("player_id"), "peer_id")
    runs = [K.card_checks(df, ["player_id", "side", "narrative"], list(CATEGORIES), ["F", "D"], peers, "player_id").withColumn("run", F.lit(name)) for name, df in (("as is", rows), ("planted", planted))]
    return runs[0].unionByName(runs[1])


@query(f"""WITH {_CARD_SQL}, wide AS (SELECT player_id, category, max(percentile) FILTER (suffix = 'actual') AS actual, max(percentile) FILTER (suffix = 'signal') AS signal, max(trend) FILTER (suffix = 'signal') AS trend FROM latest GROUP BY 1, 2),
best AS (SELECT player_id, CASE WHEN player_id % 2 = 0 THEN 'F' ELSE 'D' END AS side, row_number() OVER (PARTITION BY player_id % 2 ORDER BY signal DESC, player_id) AS place FROM wide WHERE category = 'offense')
SELECT player_id, side, place AS rank, category, round(actual + 0.001, 1) AS actual, round(signal + 0.001, 1) AS signal, regression <> '' AS regression, breakout <> '' AS breakout, coalesce(len(near_names), 0) AS n_similar
FROM best JOIN wide USING (player_id) JOIN flags USING (player_id) LEFT JOIN peers USING (player_id) WHERE place <= CASE side WHEN 'F' THEN 15 ELSE 5 END""")
def i18_nested_export(feed: Feed) -> DataFrame:
    """The best 15 of one group and 5 of the other (a report), written as nested JSON and read back: a row for each category."""
    rows = profiles(feed).withColumn("_best", F.col("categories")["offense"]["signal"])
    top = J.top_per_group(rows, ["side"], 15, F.desc("_best"), "player_id").filter("side = 'F' OR rank <= 5").drop("_best")
    steady = F.transform_values("categories", lambda _, v: F.struct((v["actual"] + 0.001).alias("actual"), (v["signal"] + 0.001).alias("signal"), v["trend"].alias("trend")))
    top = top.withColumn("categories", steady)
    back = K.read_nested(top.select(K.nested(top).alias("profile")), "profile", top)
    one = back.select("player_id", "side", "rank", F.col("flags.regression").isNotNull().alias("regression"), F.col("flags.breakout").isNotNull().alias("breakout"), F.size("similar").cast("long").alias("n_similar"), F.explode("categories").alias("category", "v"))
    return one.select("player_id", "side", "rank", "category", "v.actual", "v.signal", "regression", "breakout", "n_similar")
