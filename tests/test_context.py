"""Conditional scores, shares, partners and comparisons on small tables."""

import pytest
from pyspark.sql import functions as F

from isochron.operators import context as C

COLUMNS = "season long, player_id long, duration_seconds double, opponent_off double, opponent_def double, mate_off double, mate_def double, score_state long, residual_for double, residual_against double"


def test_conditional_scores_by_hand(spark):
    rows = [(1, i % 2, 10.0, float(i), float(i), float(i), float(i), i % 5 - 2, float(i), float(-i)) for i in range(20)]
    rows += [(1, 9, 0.0, 99.0, 0.0, 0.0, 0.0, 0, 5.0, 5.0), (2, 7, 5.0, None, None, None, None, None, None, None)]
    flagged = C.context_flags(spark.createDataFrame(rows, COLUMNS))
    assert flagged.filter("duration_seconds = 0").isEmpty()
    got = {(r.season, r.player_id): r for r in C.conditional_scores(flagged, 5).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 7)}
    off = sorted([float(i) for i in range(20)] + [99.0])
    high = off[16]  # the 0.8 quantile of 21 values
    for player in (0, 1):
        own = [i for i in range(20) if i % 2 == player and i >= high]
        assert got[1, player].n_shutdown == len(own) and got[1, player].shutdown == pytest.approx(sum(own) / len(own))
        assert got[1, player].elasticity == pytest.approx(1.0)
    assert got[2, 7].shutdown == 0 and got[2, 7].elasticity == 0 and got[2, 7].psi_z == 0
    assert C.conditional_scores(flagged.limit(0), 5).collect() == []


def test_partners_from_both_sides(spark):
    pairs = spark.createDataFrame([(1, 2, 30), (1, 3, 40)], "a long, b long, toi long")
    assert {tuple(r) for r in C.partners(pairs, "a", "b").collect()} == {(1, 2, 30), (2, 1, 30), (1, 3, 40), (3, 1, 40)}


def test_shares_add_up_and_fall_back(spark):
    df = spark.createDataFrame([("x", "a", 3.0), ("x", "b", 1.0), ("x", "c", -5.0), ("y", "a", -1.0), ("y", "b", 0.0)], "g string, m string, v double")
    got = {(r.g, r.m): r.s for r in df.select("g", "m", C.shares(df, ["g"], "v", F.when(F.col("m") == "a", 2).otherwise(1)).alias("s")).collect()}
    assert got == {("x", "a"): 6 / 7, ("x", "b"): 1 / 7, ("x", "c"): 0.0, ("y", "a"): 0.5, ("y", "b"): 0.5}


def test_golden_difference(spark):
    old = spark.createDataFrame([(i, float(i)) for i in range(10)], "k long, v double")
    assert C.golden_difference(old, old, ["k"], "v").first().passed
    assert not C.golden_difference(old.withColumn("v", F.col("v") + F.when(F.col("k") == 3, 1).otherwise(0)), old, ["k"], "v").first().passed
    assert not C.golden_difference(old.limit(0), old, ["k"], "v").first().passed


def test_stream_runs_to_a_table(spark, tmp_path):
    import uuid

    from isochron.streaming import feeds

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k long, v string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = feeds.arrivals(spark, f"{tmp_path}/in", rows.schema)
    got = feeds.to_completion(stream.groupBy("k").agg(F.count("*").alias("n")), uuid.uuid4().hex)
    assert {tuple(r) for r in got.collect()} == {(1, 2), (2, 1)}
    again = feeds.to_completion(feeds.arrivals(spark, f"{tmp_path}/in", rows.schema), uuid.uuid4().hex, "append")
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (1, "b"), (2, "a")]
