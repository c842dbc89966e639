"""Gates, fingerprints, filled scores, and streams whose rows come late or out of order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from isochron.operators import gates as G
from isochron.streaming import feeds, scores

START = datetime.datetime(2024, 1, 1)
SCHEMA = "game_id long, row_id long, ts timestamp, home boolean, away boolean"


def test_plus_minus_gate(spark):
    own = spark.createDataFrame([(1, 10, 2), (1, 11, -1), (2, 10, 3), (3, 10, 0)], "game long, player long, v long")
    given = spark.createDataFrame([(1, 10, 1), (1, 12, 1), (2, 10, 0), (4, 10, 1)], "game long, player long, v long")
    got = {r.game: (r.entities, r.unequal, r.max_diff, r.passed, r.reason) for r in G.plus_minus_gate(own, given, ["game"], "player", "v").collect()}
    assert got == {1: (3, 3, 1, True, None), 2: (1, 1, 3, False, "difference of 3"), 3: (1, 0, 0, False, "no official rows"), 4: (1, 1, 1, False, "no computed rows")}
    other = spark.createDataFrame([(1, False, "few"), (5, True, None)], "game long, passed boolean, reason string")
    verdict = G.verdicts([("a", G.plus_minus_gate(own, given, ["game"], "player", "v")), ("b", other)], ["game"])
    assert {r.game: (r.passed, r.reasons) for r in verdict.collect()} == {1: (False, "b: few"), 2: (False, "a: difference of 3"), 3: (False, "a: no official rows"), 4: (False, "a: no computed rows"), 5: (True, "")}
    assert G.only_passed(own, verdict, ["game"]).count() == 0


def test_head_count(spark):
    rows = spark.createDataFrame([(1, [1, 2], [3, 4]), (1, [1, 1], [3, 4]), (2, [1, 2], [3, 4]), (3, [1, 2], [2, 4])], "game long, h array<long>, a array<long>")
    got = {r.game: (r.passed, r.reason) for r in G.head_count(rows, ["game"], F.col("h"), F.col("a"), 2).collect()}
    assert got == {1: (False, "1 rows"), 2: (True, None), 3: (False, "1 rows")}


def test_fingerprints(spark):
    rows = [(i, None if i % 3 else "x", float(i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    of = lambda d: G.fingerprint(d).first().hash
    assert of(df) == of(df.repartition(7).select("c", "a", "b"))
    others = [df.unionByName(df.limit(1)), df.filter("a > 0"), df.withColumn("b", F.coalesce("b", F.lit(""))), df.withColumnRenamed("a", "d"), df.limit(0), df.withColumn("c", F.when(F.col("a") == 7, 9.0).otherwise(F.col("c")))]
    assert len({of(x) for x in others} | {of(df)}) == len(others) + 1


def test_backfill_scores_nulls_only(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "k long, score double")
    met = []

    def scorer(d):
        met.append(d.count())
        return d.withColumn("score", F.lit(1.0))

    assert {tuple(r) for r in G.backfill_null(df, "score", scorer).collect()} == {(1, 0.5), (2, 1.0)} and met == [1]
    assert {tuple(r) for r in G.backfill_null(df, "score", scorer, overwrite=True).collect()} == {(1, 1.0), (2, 1.0)}


def run(spark, folder, files, name, late="10 minutes"):
    """Each list of rows is a file, and a batch of its own."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/all")
    for i in range(len(files)):
        for f in glob.glob(f"{folder}/{i}/part-*"):
            shutil.move(f, f"{folder}/all/{i}.parquet")
            os.utime(f"{folder}/all/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/all")
    with scores.timers(spark):
        out = feeds.to_completion(scores.running_score(stream, "game_id", "ts", "row_id", F.col("home"), F.col("away"), late), name, "append")
    return {r.row_id: (r.home_score, r.away_score) for r in out.collect()}


def rows_of(n):
    rng = random.Random(3)
    return [(i % 2, i, START + datetime.timedelta(minutes=i), rng.random() < 0.3, rng.random() < 0.3) for i in range(n)]


def in_order(rows, end):
    out, score = {}, {}
    for game, i, ts, home, away in sorted(rows, key=lambda r: (r[2], r[1])):
        h, a = score.get(game, (0, 0))
        score[game] = (h + home, a + away)
        if ts < end:
            out[i] = score[game]
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_score_is_in_order_however_rows_come(spark, tmp_path, shuffled):
    """Within the ten minutes that the watermark waits, the order of arrival doesn't show."""
    rows = rows_of(40)
    if shuffled:
        rows = sorted(rows, key=lambda r: r[1] + random.Random(r[1]).uniform(0, 8))
    got = run(spark, tmp_path, [rows[i : i + 10] for i in range(0, 40, 10)], f"order{shuffled}")
    assert got == in_order(rows, START + datetime.timedelta(minutes=29))


def test_a_late_row_is_dropped(spark, tmp_path):
    rows = rows_of(40)
    late = (0, 99, START + datetime.timedelta(minutes=2), True, False)
    got = run(spark, tmp_path, [rows[:20], rows[20:30], [late], rows[30:]], "late")
    assert got == in_order(rows, START + datetime.timedelta(minutes=29)) and 99 not in got


def test_windows_close_by_the_watermark(spark, tmp_path):
    rows = rows_of(90)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = feeds.arrivals(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema).withColumn("v", F.lit(1.0))
    out = feeds.to_completion(feeds.windows(stream, "ts", ["game_id"], "v", "20 minutes"), "closed", "append")
    assert sorted((r.game_id, r.start.minute + 60 * r.start.hour, r.n) for r in out.collect()) == [(g, m, 10) for g in (0, 1) for m in (0, 20, 40)]


def test_spot_checks_tell_good_from_bad(spark):
    from isochron.operators import gates as G

    values = [-2.0, -1.0, 0.0, 1.0, 2.0]
    rated = spark.createDataFrame([(v, 2 * v + (i % 2)) for i, v in enumerate(values)], "value double, other double")
    context = spark.createDataFrame([("O", 0), ("D", 1), ("N", -1), ("F", None)], "zone_start string, score_state long")
    scores = spark.createDataFrame([(50,), (10,)], "shifts long")
    good = {r.check: (r.value, r.passed) for r in G.spot_checks(rated, context, scores).collect()}
    assert len(good) == 12 and all(passed for _, passed in good.values())
    assert good["mean"][0] == 0 and good["p50"][0] == 0 and good["zone O"][0] == 0.25 and good["score by one"][0] == 0.5 and good["reliable"][0] == 0.5
    shifted = rated.selectExpr("value + 1 AS value", "-other AS other")
    bad = {r.check: r.passed for r in G.spot_checks(shifted, context.filter("zone_start <> 'N' AND score_state <> 0"), scores.filter("shifts < 50")).collect()}
    assert {c for c, passed in bad.items() if not passed} == {"mean", "correlation", "zone O", "zone N", "score level", "reliable"}
    assert not any(r.passed for r in G.spot_checks(rated.limit(0), context.limit(0), scores.limit(0)).collect())
