"""Ratings around shifts, their totals, starts and residuals, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from isochron.operators import surroundings as S

SHIFT = "season string, game_id long, team_id long, period long, player_id long, position string, start_seconds long, end_seconds long"
EVENT = "game_id long, event_id long, period long, period_seconds long, event_type string, event_team_id long, zone_code string, xg double, home_team_id long, home_score long, away_score long"


def mean(xs):
    xs = list(xs)
    return sum(xs) / len(xs) if xs else None


def plain(shifts, events, ratings, least=30):
    out = {}
    for s in shifts:
        _, game, team, period, player, position, start, end = s
        if end - start < least:
            continue
        shots = [e for e in events if (e[0], e[2]) == (game, period) and start <= e[3] < end and e[4] != "FACEOFF"]
        own, other = [e for e in shots if e[5] == team], [e for e in shots if e[5] != team]
        seen = sorted([e for e in events if (e[0], e[2]) == (game, period) and e[3] <= start], key=lambda e: (e[3], e[1]))
        state = None if not seen else (1 if team == seen[-1][8] else -1) * (seen[-1][9] - seen[-1][10])
        zones = [e[6] for e in seen if e[4] == "FACEOFF" and e[3] == start]
        mine, parts = ratings.get(player), {c: [] for c in S.AROUND}
        for tick in range(0, 1300, 5):
            if mine is None or not start <= tick < end:
                continue
            on = [t for t in shifts if (t[1], t[3]) == (game, period) and t[6] <= tick < t[7] and t[4] in ratings]
            mates, rivals = [t for t in on if t[2] == team and t != s], [t for t in on if t[2] != team]
            off, back = (lambda x: ratings[x[4]][0]), (lambda x: ratings[x[4]][1])
            values = [map(off, mates), map(back, mates), (off(t) for t in mates if t[5] == "F"), (back(t) for t in mates if t[5] == "D"), map(off, rivals), map(back, rivals)]
            for c, xs in zip(S.AROUND, values):
                parts[c].append(mean(xs))
        around = [mean(x for x in parts[c] if x is not None) or 0.0 for c in S.AROUND]
        xgf, xga, (o, d) = sum(e[7] or 0 for e in own), sum(e[7] or 0 for e in other), mine or (0, 0)
        out[game, period, player, start] = (state, (zones[-1] if zones else None) or "F", xgf, xga, len(own), len(other), *around, xgf - o - around[0] - around[5], xga - d - around[1] - around[4])
    return out


def made(seed):
    rnd = random.Random(seed)
    shifts, events = [], []
    for game in (1, 2):
        for team in (10, 20):
            for player in range(8):
                start = 0
                while start < 1100:
                    end = start + rnd.choice([7, 29, 30, 61, 130])
                    shifts.append(("a", game, team, 1, team * 100 + player, "FFFFDDG"[player % 7], start, end))
                    start = end + rnd.choice([0, 3, 90])
        for i in range(60):
            kind = rnd.choice(["SHOT", "FACEOFF", "GOAL"])
            events.append((game, i, 1, rnd.choice(shifts)[6], kind, rnd.choice([10, 20]), rnd.choice(["O", "D", None]), rnd.choice([None, rnd.random()]), 10, i // 9, i // 14))
    return shifts, events


@pytest.mark.parametrize("seed", [1, 2])
def test_context_is_that_of_plain_python(spark, seed):
    shifts, events = made(seed)
    ratings = {team * 100 + p: (p / 8, -team / (p + 1)) for team in (10, 20) for p in range(7)}  # one of each side isn't rated
    lookup = spark.createDataFrame([("a", k, *v) for k, v in ratings.items()], "season string, player_id long, off double, def double")
    e = spark.createDataFrame(events, EVENT)
    got = S.shift_context(spark.createDataFrame(shifts, SHIFT), e, e.filter("event_type <> 'FACEOFF'"), lookup).collect()
    want = plain(shifts, events, ratings)
    assert len(got) == len(want) > 50
    for r in got:
        own = (r.score_state, r.zone_start, r.xgf, r.xga, r.cf, r.ca, *(r[c] for c in S.AROUND), r.residual_for, r.residual_against)
        expected = want[r.game_id, r.period, r.player_id, r.start_seconds]
        assert own[:2] == expected[:2] and own[2:] == pytest.approx(expected[2:], abs=1e-9)


def test_context_of_nothing_and_of_odd_shifts(spark):
    e = spark.createDataFrame([], EVENT)
    lookup = spark.createDataFrame([("a", 1, 2.0, 3.0)], "season string, player_id long, off double, def double")
    rows = [("a", 1, 10, 1, 1, "F", 0, 60), ("a", 1, 10, 1, 2, None, 0, None), ("a", 1, 10, 1, 3, "F", 90, 20), ("a", 1, 10, 1, 4, "D", 5, 40)]
    got = {r.player_id: r for r in S.shift_context(spark.createDataFrame(rows, SHIFT), e, e, lookup).collect()}
    assert set(got) == {1, 4} and (got[1].score_state, got[1].zone_start, got[1].mate_off, got[1].residual_for) == (None, "F", 0.0, -2.0)
    assert (got[4].off, got[4].mate_off, got[4].residual_against) == (None, 0.0, 0.0)
    assert S.shift_context(spark.createDataFrame([], SHIFT), e, e, lookup).collect() == []


def test_equal_shifts_count_their_shots_once(spark):
    rows = [("a", 1, 10, 1, 1, "F", 0, 200)] * 2
    shots = [(1, i, 1, i * 50, "SHOT", 10, None, 0.25, 10, 0, 0) for i in range(4)] + [(1, 9, 1, 200, "SHOT", 10, None, 0.25, 10, 0, 0)]
    got = S.shift_totals(spark.createDataFrame(rows, SHIFT), spark.createDataFrame(shots, EVENT)).collect()
    assert [(r.xgf, r.xga, r.cf, r.ca) for r in got] == [(1.0, 0.0, 4, 0)]


def test_ratings_by_the_first_pair_that_is_there(spark):
    rows = [(1, "xg_off", 1.0), (1, "xg_def", 2.0), (1, "c_off", 3.0), (2, "c_off", 4.0), (2, "c_def", 5.0), (3, "z_rapm", 6.0), (3, "y_rapm", 7.0), (4, "xg_off", None), (4, "c_off", 8.0), (5, "xg_def", 9.0), (6, "other", 1.0), (None, "y_rapm", 1.0)]
    df = spark.createDataFrame(rows, "id long, metric_name string, value double")
    got = {r.id: tuple(r)[1:] for r in S.rating_lookup(df, ["id"], [("xg_off", "xg_def"), ("c_off", "c_def")], "rapm").collect()}
    assert got == {1: (1.0, 2.0, "xg_off"), 2: (4.0, 5.0, "c_off"), 3: (7.0, 7.0, "y_rapm"), 4: (0.0, 0.0, "xg_off"), None: (1.0, 1.0, "y_rapm")}
    assert S.rating_lookup(df.limit(0), ["id"], [("a", "b")], "rapm").collect() == []


def test_a_tick_needs_no_shuffle_of_its_own(spark):
    shifts, _ = made(3)
    df = spark.createDataFrame(shifts, SHIFT).withColumns({"off": F.lit(1.0), "def": F.lit(1.0)})
    plan = S.surroundings(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_mates_that_do_better_and_worse(spark):
    from isochron.operators import profile as O

    rows = [("a", 1, [1, 2, 3, 4], 400, 1.0), ("a", 1, [1, 2], 300, 0.4), ("a", 1, [1, 4], 59, 50.0), ("a", 5, [5], 900, 1.0), (None, 6, None, 900, 1.0)]
    stints = spark.createDataFrame(rows, "season string, player_id long, mates array<long>, duration long, value double")
    ratings = spark.createDataFrame([("a", 2, 0.5), ("a", 3, 2.0), ("b", 4, 9.0)], "season string, player_id long, off double")
    got = [tuple(r) for r in O.mate_impact(stints, ratings, 60, 400).collect()]
    assert got == [("a", 1, 3, 2, 1, pytest.approx((0.2 - 1.0 + 1.0) / 3))]
    assert O.mate_impact(stints, ratings).collect()[0].mates == 1
    assert O.mate_impact(stints.limit(0), ratings).collect() == []
