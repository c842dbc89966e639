"""Windows of games: blocks against windows, fits in blocks against moments by joins, and what is written to disk on the way."""

import math

import pytest
from pyspark.sql import functions as F

from isochron.operators import aggregates as A
from isochron.operators import ridge as G
from isochron.plans import registry
from isochron.plans.feed import Feed

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("size, stride", [(3, 1), (5, 2), (2, 7), (40, 1)])
def test_blocks_hold_their_windows_members(spark, size, stride):
    members = spark.createDataFrame([(k, 10 * i) for k, n in (("a", 37), ("b", 2), ("c", 3)) for i in range(n)], "k string, at long")
    want = {tuple(r) for r in A.count_windows(members, ["k"], ["at"], size, stride).select("k", "window_id", "at").collect()}
    blocks = A.window_blocks(members, ["k"], ["at"], size, stride).collect()
    got = [(r.k, w, r["at"]) for r in blocks for w in range(r["first"], r["last"] + 1) if w * stride < r.place <= w * stride + size]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(blocks) <= 1.25 * len({(k, at) for k, _, at in want}) + math.ceil(size / stride)


def test_fits_in_blocks_equal_those_of_moments(spark):
    from isochron.plans import queries_ratings as Q

    keys = ["season", "window_id", "design"]
    feed = Feed(spark, SF)
    value = lambda df: {tuple(r[:5]): (r.coefficient, r.intercept) for r in df.select(*keys, "target", "name", "coefficient", "intercept").collect()}
    fitted = Q.window_fits(feed, 3, 1)
    got, want = value(fitted), value(G.fit(Q._only_kept(Q.window_parts(feed, 3, 1)[0]), keys, Q.ROLLING_ALPHA))
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-7 for k in want for x, y in zip(got[k], want[k]))


def test_gaps_are_of_the_rows(spark):
    """Of one place and window, by hand: names a and b, the second row left out by c, who is short."""
    member = lambda name: [(name, 1.0)]
    rows = [
        ("s", 0, 0, 0, 1, "x", [1, 2], 50, 10, 50.0, [("d", [("a", 1.0), ("b", -1.0)], [("y", 2.0)]), ("e", member("a"), [("z", 1.0)])]),
        ("s", 0, 0, 0, 1, "x", [1, 3], 5, 10, 5.0, [("d", [("a", 1.0), ("c", -1.0)], [("y", 9.0)])]),
        ("s", 0, 0, 0, 2, "x", [2, 1], 30, 10, 30.0, [("d", [("b", 1.0)], [("y", -1.0)])]),
    ]
    schema = "k string, block long, first long, last long, place long, kind string, members array<long>, seconds long, least int, w double, variants array<struct<design:string,entries:array<struct<name:string,x:double>>,targets:array<struct<name:string,y:double>>>>"
    out = G.fit_windows(spark.createDataFrame(rows, schema), ["k"], 2, 1, 4.0).collect()
    assert {(r.design, r.target, r.name) for r in out} == {("d", "y", "a"), ("d", "y", "b"), ("e", "z", "a")}
    b = {r.name: r.coefficient for r in out if r.design == "d"}
    b0 = out[[r.design for r in out].index("d")].intercept
    left = 50 * (2.0 - b0 - b["a"] + b["b"]), 30 * (-1.0 - b0 - b["b"])
    assert abs(sum(left)) < 1e-9 and abs(left[0] - 4 * b["a"]) < 1e-9 and abs(left[1] - left[0] - 4 * b["b"]) < 1e-9
    assert all(abs(r.gap) < 1e-9 for r in out)


def written(spark):
    """Bytes of shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("name, most", [("h18_normal_equations", 500), ("h18_rolling_ratings", 250), ("g12_residuals", 600)])
def test_what_is_shuffled_is_little(spark, name, most):
    """Bytes an event of the feed, of which this table has 10,000."""
    before = written(spark)
    registry.queries()[name](spark, SF).collect()
    assert written(spark) - before < most * 10_000


ROWS = [
    (1, "a", 2.0, [("p", 1.0), ("q", -1.0)], [("y", 1.0), ("z", 4.0)]),
    (2, "a", 3.0, [("q", 0.5), ("new", 1.0)], [("y", 2.0), ("z", 0.5)]),
    (3, "b", 1.0, [("p", 1.0)], [("y", 3.0)]),
    (4, "b", 1.0, [("p", -1.0), ("r", 2.0)], [("y", 1.0), ("more", 9.0)]),
    (5, "a", 1.0, [("new", 1.0)], [("y", 5.0)]),
    (6, "c", 1.0, [("p", 1.0)], [("y", 5.0)]),
    (7, "a", 4.0, [("p", 1.0)], [("y", None), ("z", 1.0)]),
    (8, "b", 1.0, [], [("y", 1.0)]),
]
FITTED = [("a", "y", "p", 0.5, 1.0, 2.0), ("a", "y", "q", -2.0, 1.0, 2.0), ("a", "z", "p", 3.0, -1.0, 2.0), ("a", "z", "q", 1.5, -1.0, 2.0), ("b", "y", "p", 1.0, 0.25, 2.0), ("b", "y", "r", 0.0, 0.25, 2.0)]


def test_residuals_by_broadcast_and_by_join(spark, monkeypatch):
    """Names, targets and groups that weren't fitted, rows without entries, a null."""
    rows = spark.createDataFrame(ROWS, "row_id long, k string, w double, entries array<struct<name:string,x:double>>, targets array<struct<name:string,y:double>>")
    fitted = spark.createDataFrame(FITTED, "k string, target string, name string, coefficient double, intercept double, alpha double")
    left = lambda: {tuple(r) for r in G.residuals(rows, fitted, ["k"], "row_id", "w").collect()}
    gaps = lambda: {(r.k, r.target, r.name): r.gap for r in G.normal_gaps(rows, fitted, ["k"], "row_id").collect()}
    one, two = left(), gaps()
    assert (1, "y") in {(r[1], r[2]) for r in one} and {r[1] for r in one} == {1, 2, 3, 4, 7}
    monkeypatch.setattr(G, "MOST_SHARED", 5)
    assert left() == one
    other = gaps()
    assert other.keys() == two.keys() and all(abs(other[k] - two[k]) < 1e-9 for k in two)


def test_least_seconds_by_lists_and_by_ids(spark, monkeypatch):
    from isochron.operators import regression as R

    rows = spark.createDataFrame([(1, "a", [1, 2], [3]), (2, "a", [2], [4]), (3, "b", [1], [5]), (4, "b", [], None), (5, "c", [1], [2])], "id long, k string, h array<long>, a array<long>")
    exposure = spark.createDataFrame([("a", 1, 5), ("a", 2, 50), ("b", 1, 50), ("b", 5, 9), ("b", 2, 1)], "k string, player_id long, toi long")
    ids = lambda: {r.id for r in R.min_exposure(rows, "id", ["h", "a"], exposure, "player_id", "toi", 10, ["k"]).collect()}
    everywhere = lambda: {r.id for r in R.min_exposure(rows, "id", ["h", "a"], exposure.filter("k = 'a'"), "player_id", "toi", 10).collect()}
    assert (ids(), everywhere()) == ({2, 4, 5}, {2, 4})
    monkeypatch.setattr(R, "MOST_SHORT", 0)
    assert ids() == {2, 4, 5}
