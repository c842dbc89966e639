"""Profiles on small tables: trends, cards, texts, checks, nested export."""

import json

from pyspark.sql import functions as F

from isochron.operators import cards as K

SCORE = "season long, player_id long, suffix string, category string, score double, percentile double"


def scores(spark, rows):
    return spark.createDataFrame(rows, SCORE)


def card(spark, offense, defense=50.0, up=None, down=None, more=()):
    rows = [(1, "offense", offense, up), (1, "defense", defense, down), *[(1, c, p, None) for c, p in more]]
    df = spark.createDataFrame(rows, "player_id long, category string, percentile double, trend double").withColumn("suffix", F.lit("signal"))
    return K.cards(df, ["player_id"])


def text(df, similar=(), regression=None, breakout=None, archetype=None):
    words = {"offense": "scoring", "defense": "checking", "finishing": "finishing"}
    lit = lambda x: F.lit(x).cast("string")
    names = F.array(*map(F.lit, similar)) if similar else F.array().cast("array<string>")
    return df.select(K.narrative(F.lit("A"), F.lit("forward"), lit(archetype), words, names, lit(regression), lit(breakout)).alias("t")).first().t


def test_texts(spark):
    assert text(card(spark, 90.0, 85.0)) == "A is an elite two-way forward, strong in scoring, checking."
    assert text(card(spark, 96.0)) == "A is an elite offensive forward with elite scoring."
    assert text(card(spark, 50.0, 70.0)) == "A is a defensive forward with above-average checking."
    assert text(card(spark, 70.0, 70.0, more=[("finishing", 99.0)])) == "A is a well-rounded forward, strong in scoring, checking, finishing."
    assert text(card(spark, 10.0, 50.0), archetype="Sniper") == "A is a Sniper."
    assert text(card(spark, None, None), ["B", "C", "D"]) == "A is a player. Comparable to B and C."
    assert text(card(spark, 10.0, up=0.3, down=-0.6), ["B"]) == "A is a player. Comparable to B. Lately offense is trending upward, defense is declining significantly."
    assert text(card(spark, 10.0, up=0.2), regression="late", breakout="early") == "A is a player. Regression candidate: late."
    assert text(card(spark, 10.0, up=0.3), regression="", breakout="early") == "A is a player. Breakout candidate: early."


def test_trends_of_halves(spark):
    rows = [(s, 1, "actual", "offense", v, 0.0) for s, v in ((1, 1.0), (2, 2.0), (3, 6.0))] + [(1, 2, "actual", "offense", 5.0, 0.0), (1, 3, "actual", "offense", None, 0.0), (2, 3, "actual", "offense", 1.0, 0.0)]
    got = {(r.player_id, r.season): r.trend for r in K.category_trends(scores(spark, rows), ["player_id"], "season").collect()}
    assert got == {(1, 1): 3.0, (1, 2): 3.0, (1, 3): 3.0, (2, 1): None, (3, 1): None, (3, 2): None}


def made(spark, sides=("F", "D", "F")):
    rows = [(i, "offense", s, 10.0 * i, 0.1234 if s == "signal" else None) for i in (1, 2, 3) for s in ("actual", "signal")] + [(1, "defense", "signal", 33.333, None)]
    df = K.cards(spark.createDataFrame(rows, "player_id long, category string, suffix string, percentile double, trend double"), ["player_id"])
    side = spark.createDataFrame(list(zip((1, 2, 3), sides, ("due", "", None))), "player_id long, side string, regression string")
    return df.join(side, "player_id").withColumn("breakout", F.lit(""))


def test_checks_find_planted_faults(spark):
    peers = spark.createDataFrame([(1, 3), (1, 2), (2, 9), (8, 1)], "player_id long, peer_id long")
    got = {r.check: (r.failures, r.passed) for r in K.card_checks(made(spark), ["player_id", "side"], ["offense"], ["F", "D"], peers, "player_id").collect()}
    assert got == {"required": (0, True), "percentiles": (0, True), "categories": (0, True), "groups": (0, True), "similarity": (2, False)}
    bad = made(spark, ("F", None, "X"))
    got = {r.check: r.failures for r in K.card_checks(bad.withColumn("categories", F.transform_values("categories", lambda _, v: F.struct((v["actual"] * 9).alias("actual"), v["signal"].alias("signal"), v["trend"].alias("trend")))), ["side", "name"], ["offense", "defense"], ["F", "D"], peers.limit(0), "player_id").collect()}
    assert got == {"required": 3, "percentiles": 2, "categories": 2, "groups": 2, "similarity": 0}
    got = K.card_checks(bad.limit(0), ["side", "name"], ["offense"], ["F"], peers, "player_id").collect()
    assert len(got) == 5 and all(r.passed and r.failures == 0 for r in got)


def test_nested_export_is_read_back(spark):
    df = made(spark)
    texts = df.select(K.nested(df).alias("p"))
    first = json.loads(sorted(r.p for r in texts.collect())[0])
    assert first == {"player_id": 1, "side": "F", "categories": {"defense": {"signal": 33.3}, "offense": {"actual": 10.0, "signal": 10.0}}, "trends": {"offense": 0.123}, "flags": {"regression": "due"}}
    back = {r.player_id: r for r in K.read_nested(texts, "p", df).collect()}
    assert set(back) == {1, 2, 3} and back[2].categories["offense"].signal == 20.0 and back[2].flags.regression is None and back[1].flags.regression == "due"
    assert K.read_nested(texts.limit(0), "p", df).collect() == []


def test_first_rule(spark):
    x = F.col("x")
    df = spark.createDataFrame([(0.9,), (0.4,), (None,)], "x double").select("x", K.first_rule([("high", x > 0.5), ("middle", x > 0.3)], F.lit("none")).alias("n"))
    assert {r.x: r.n for r in df.collect()} == {0.9: "high", 0.4: "middle", None: "none"}
