"""Queries of gates, lineage, stored scores and live streams."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.functions import scalars as S
from isochron.operators import gates as G
from isochron.plans import stints as P
from isochron.plans.feed import Feed, with_feed
from isochron.plans.registry import query
from isochron.plans.sql import EVEN, LINEUPS, after
from isochron.sources.shared import shared_folder, stored
from isochron.streaming import feeds, scores

#: Goals that count for plus-minus: all but those with a skater more.
_COUNTS = "event_type = 'GOAL' AND NOT (CASE WHEN event_team_id = home_team_id THEN len(home_skaters) > len(away_skaters) AND home_goalies > 0 ELSE len(away_skaters) > len(home_skaters) AND away_goalies > 0 END)"

#: The largest difference of plus-minus that a game may have. A fifth of this feed's goals fall on the second of a line
#: change, where the two sources may take different lines, so it's more than the two that a real feed is allowed.
MOST = 6

#: The second source: shifts that hold the goal's second in their inside, as an official scorer would read them. Games of
#: one number in 13 have it from a book that lost the away side's goals.
GATE = LINEUPS + f""",
scoring AS (SELECT * FROM lineups WHERE {_COUNTS}),
computed AS (SELECT game_id, player_id, sum(v) AS v FROM (SELECT game_id, unnest(home_skaters) AS player_id, CASE WHEN event_team_id = home_team_id THEN 1 ELSE -1 END AS v FROM scoring
  UNION ALL SELECT game_id, unnest(away_skaters), CASE WHEN event_team_id = home_team_id THEN -1 ELSE 1 END FROM scoring) GROUP BY 1, 2),
official AS (SELECT c.game_id, s.player_id, sum(CASE WHEN s.team_id = c.event_team_id THEN 1 ELSE -1 END) AS v FROM scoring c JOIN feed_shifts s ON s.game_id = c.game_id AND s.period = c.period AND s.start_seconds < c.period_seconds AND s.end_seconds >= c.period_seconds
  WHERE s.position <> 'G' AND NOT (c.game_id % 13 = 4 AND c.event_team_id <> c.home_team_id) GROUP BY 1, 2),
gate AS (SELECT coalesce(a.game_id, b.game_id) AS game_id, count(*) AS entities, count(*) FILTER (coalesce(a.v, 0) <> coalesce(b.v, 0)) AS unequal, CAST(max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS BIGINT) AS max_diff, count(a.v) AS own, count(b.v) AS given
  FROM computed a FULL JOIN official b ON a.game_id = b.game_id AND a.player_id = b.player_id GROUP BY 1),
judged AS (SELECT game_id, entities, unequal, max_diff, CASE WHEN given = 0 THEN 'no official rows' WHEN own = 0 THEN 'no computed rows' WHEN max_diff > {MOST} THEN 'difference of ' || max_diff END AS reason FROM gate),
heads AS (SELECT game_id, count(*) FILTER (NOT (len(list_distinct(home_skaters)) = 5 AND len(list_distinct(away_skaters)) = 5 AND len(list_intersect(home_skaters, away_skaters)) = 0)) AS bad FROM lineups WHERE {EVEN} GROUP BY 1),
verdicts AS (SELECT game_id, coalesce(j.reason IS NULL, true) AND coalesce(bad = 0, true) AS passed,
  concat_ws('; ', CASE WHEN bad > 0 THEN 'head count: ' || bad || ' rows' END, CASE WHEN j.game_id IS NOT NULL AND j.reason IS NOT NULL THEN 'plus-minus: ' || j.reason END) AS reasons FROM judged j FULL JOIN heads USING (game_id))"""


def _sources(feed: Feed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lineups, and plus-minus by game and player: computed from them, and from the second source."""
    lineups = stored(P.lineups(feed))
    home = F.col("event_team_id") == F.col("home_team_id")
    h, a = F.size("home_skaters"), F.size("away_skaters")
    advantage = F.when(home, (h > a) & (F.col("home_goalies") > 0)).otherwise((a > h) & (F.col("away_goalies") > 0))
    goals = lineups.filter("event_type = 'GOAL'").filter(~advantage)
    tag = lambda side, sign: F.transform(side, lambda p: F.struct(p.alias("player_id"), F.when(home, sign).otherwise(-sign).alias("v")))
    own = goals.select("game_id", F.explode(F.concat(tag("home_skaters", 1), tag("away_skaters", -1))).alias("m")).groupBy("game_id", "m.player_id").agg(F.sum("m.v").alias("v"))
    shifts = feed.shifts.filter("position <> 'G'").select(F.col("game_id").alias("_g"), F.col("period").alias("_p"), "team_id", "player_id", "start_seconds", "end_seconds")
    seen = (F.col("game_id") == F.col("_g")) & (F.col("period") == F.col("_p")) & (F.col("start_seconds") < F.col("period_seconds")) & (F.col("end_seconds") >= F.col("period_seconds"))
    book = goals.filter(~((F.col("game_id") % 13 == 4) & ~home)).join(shifts, seen)
    given = book.groupBy("game_id", "player_id").agg(F.sum(F.when(F.col("team_id") == F.col("event_team_id"), 1).otherwise(-1)).alias("v"))
    return lineups, own, given


def judged(feed: Feed) -> tuple[DataFrame, DataFrame]:
    """The lineups that are judged, and game_id, passed, reasons."""
    lineups, own, given = _sources(feed)
    even = P.filter_strength(lineups, "5v5")
    checks = [("head count", G.head_count(even, ["game_id"], F.col("home_skaters"), F.col("away_skaters"), 5)), ("plus-minus", G.plus_minus_gate(own, given, ["game_id"], "player_id", "v", MOST))]
    return lineups, stored(G.verdicts(checks, ["game_id"]))


def game_verdicts(feed: Feed) -> DataFrame:
    """game_id, passed, reasons: what goes on to ratings."""
    return judged(feed)[1]


@query(after(GATE, "SELECT game_id, entities, unequal, max_diff, reason IS NULL AS passed, reason FROM judged"))
def j9_plus_minus_gate(feed: Feed) -> DataFrame:
    """Computed plus-minus against the second source, by game."""
    _, own, given = _sources(feed)
    return G.plus_minus_gate(own, given, ["game_id"], "player_id", "v", MOST).select("game_id", "entities", "unequal", "max_diff", "passed", "reason")


@query(after(GATE, "SELECT game_id, passed, reasons FROM verdicts"))
def j8_game_verdicts(feed: Feed) -> DataFrame:
    """Head counts at full strength and plus-minus together, with reasons."""
    return game_verdicts(feed)


@query(after(GATE, "SELECT season, count(*) AS games, count(*) FILTER (passed) AS passed, CAST(sum(n) FILTER (passed) AS BIGINT) AS rows_kept FROM feed_games JOIN verdicts USING (game_id) JOIN (SELECT game_id, count(*) AS n FROM feed_events GROUP BY 1) e USING (game_id) GROUP BY 1"))
def j10_gate_filter(feed: Feed) -> DataFrame:
    """The stored verdicts drive the filter: games and the events that go on, by season."""
    verdict = game_verdicts(feed)
    kept = G.only_passed(feed.events, verdict, ["game_id"]).groupBy("game_id").agg(F.count("*").alias("n"))
    games = feed.games.join(verdict, "game_id").join(kept, "game_id", "left")
    return games.groupBy("season").agg(F.count("*").alias("games"), F.count_if("passed").alias("passed"), F.sum("n").alias("rows_kept"))


_LOGGED = ("orders", "customer", "events", "lineitem")


@query(" UNION ALL ".join(f"SELECT '{t}' AS stage, count(*) AS n, true AS same_when_shuffled, true AS differs_when_one_row_repeats, true AS differs_when_one_is_gone FROM {t}" for t in _LOGGED))
def j28_lineage(feed: Feed) -> DataFrame:
    """Records of four tables, of the same rows dealt anew, and of tables with one row more or less."""
    out = None
    for name in _LOGGED:
        df = feed.table(name)
        one = df.limit(1)
        key = df.columns[0]
        less = df.exceptAll(one) if name == "customer" else df.filter(~F.col(key).eqNullSafe(F.lit(df.agg(F.max(key)).first()[0])))
        hashes = [G.lineage(x, name, "", 0.0).select("n", F.col("hash").alias(f"h{i}")) for i, x in enumerate((df, df.repartition(7).select(*reversed(df.columns)), df.unionByName(one), less))]
        row = hashes[0]
        for other in hashes[1:]:
            row = row.crossJoin(F.broadcast(other.drop("n")))  # one row each
        row = row.select(F.lit(name).alias("stage"), "n", (F.col("h0") == F.col("h1")).alias("same_when_shuffled"), (F.col("h0") != F.col("h2")).alias("differs_when_one_row_repeats"), (F.col("h0") != F.col("h3")).alias("differs_when_one_is_gone"))
        out = row if out is None else out.unionByName(row)
    return out


def _shots(feed: Feed) -> DataFrame:
    distance, angle = S.shot_geometry(F.col("x_coord"), F.col("y_coord"))
    goal = (F.col("event_type") == "GOAL").cast("double").alias("y")
    return feed.events.filter("xg IS NOT NULL AND x_coord IS NOT NULL AND y_coord IS NOT NULL").select("event_id", goal, distance.alias("distance"), angle.alias("angle"), *S.one_hot(F.col("zone_code"), ["O", "D"], "zone"))


def fit_shot_model(shots: DataFrame, folder: str) -> None:
    """A pipeline with balanced classes, saved."""
    n = shots.groupBy("y").agg(F.count("*").alias("_n"))
    total = shots.count()
    weighted = shots.join(F.broadcast(n), "y").withColumn("w", F.lit(float(total)) / (2 * F.col("_n")))  # two rows
    features = VectorAssembler(inputCols=["distance", "angle", "zone_o", "zone_d"], outputCol="features")
    Pipeline(stages=[features, LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, maxIter=50)]).fit(weighted).write().overwrite().save(folder)


def stored_scorer(folder: str):
    """Sets `score` by the model that is saved in the folder."""
    model = PipelineModel.load(folder)
    return lambda df: model.transform(df).withColumn("score", vector_to_array("probability")[1])


@query(with_feed("SELECT run, CASE run WHEN 'second' THEN 0 ELSE count(*) END AS scored, count(*) AS n, true AS equal FROM feed_events, (VALUES ('first'), ('second'), ('overwrite')) v(run) WHERE xg IS NOT NULL GROUP BY 1"))
def g9_a11_stored_scores(feed: Feed) -> DataFrame:
    """A saved model fills null scores: all in the first run, none in the second; overwriting gives the first's."""
    folder = shared_folder(feed.spark)
    shots = stored(_shots(feed))
    fit_shot_model(shots, folder)
    scorer = stored_scorer(folder)
    blank = shots.withColumn("score", F.lit(None).cast("double"))
    first = stored(G.backfill_null(blank, "score", scorer))
    second = stored(G.backfill_null(first, "score", lambda df: scorer(df).withColumn("score", -F.col("score"))))
    third = stored(G.backfill_null(second, "score", scorer, overwrite=True))
    out = None
    for name, before, now in (("first", blank, first), ("second", first, second), ("overwrite", blank, third)):
        both = now.select("event_id", F.col("score").alias("_now")).join(before.select("event_id", F.col("score").alias("_was")), "event_id").join(first.select("event_id", F.col("score").alias("_first")), "event_id")
        row = both.agg(F.count_if(F.col("_was").isNull()).alias("scored"), F.count("_now").alias("n"), F.bool_and(F.abs(F.col("_now") - F.col("_first")) < 1e-12).alias("equal")).select(F.lit(name).alias("run"), "scored", "n", "equal")
        out = row if out is None else out.unionByName(row)
    return out


def _stream(feed: Feed) -> DataFrame:
    stream = feeds.arrivals(feed.spark, feed.sf_dir, feed.table("events").schema, "events*.parquet")
    return stream.withColumns({"ts": F.col("ts").cast("timestamp"), "game_id": F.floor(F.col("event_id") / 360).cast("long")})


#: Ten minutes behind the latest time, in milliseconds.
_PASSED = "(SELECT epoch_ms(max(ts)) - 600000 FROM events)"


@query(f"""
SELECT game_id, row_id, home_score, away_score FROM (SELECT CAST(floor(event_id / 360) AS BIGINT) AS game_id, event_id AS row_id, epoch_ms(ts) AS ms,
  CAST(sum(CASE WHEN event_type = 'purchase' AND user_id % 4 < 2 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS home_score, CAST(sum(CASE WHEN event_type = 'purchase' AND user_id % 4 >= 2 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS away_score
  FROM events WINDOW w AS (PARTITION BY floor(event_id / 360) ORDER BY epoch_ms(ts), event_id ROWS UNBOUNDED PRECEDING)) WHERE ms < {_PASSED}""")
def l2_running_score(feed: Feed) -> DataFrame:
    """The ordered score of a stream: rows that the watermark has passed."""
    rows = _stream(feed)
    goal, home = F.col("event_type") == "purchase", F.col("user_id") % 4 < 2
    with scores.timers(feed.spark):
        return feeds.to_completion(scores.running_score(rows, "game_id", "ts", "event_id", goal & home, goal & ~home), f"score_{uuid.uuid4().hex}", "append")


@query(f"SELECT start, event_type, n, total FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE epoch_ms(start) + 3600000 <= {_PASSED}")
def l3_stream_windows(feed: Feed) -> DataFrame:
    """Tumbling windows of a stream, written once the watermark has closed them."""
    rows = feeds.windows(_stream(feed), "ts", ["event_type"], "value", "1 hour")
    return feeds.to_completion(rows, f"windows_{uuid.uuid4().hex}", "append").withColumn("start", F.col("start").cast("timestamp_ntz"))
