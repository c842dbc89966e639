"""The nearest by cosine in slices, against all pairs; copies, ties, zero vectors and groups without queries."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from isochron.operators import series as T


def brute(rows, queries, k):
    out = set()
    for q, g, x in queries:
        own = []
        for p, h, y in rows:
            if h == g and p != q:
                dot = a = b = 0.0
                for i, j in zip(x, y):
                    dot, a, b = dot + i * j, a + i * i, b + j * j
                length = a**0.5 * b**0.5
                own.append((float(Decimal(repr(dot / length)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) if length else None, p))
        own.sort(key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))
        out |= {(q, p, s, i + 1) for i, (s, p) in enumerate(own[:k])}
    return out


@pytest.mark.parametrize("size", [7, 20_000])
def test_nearest_equals_all_pairs(spark, monkeypatch, size):
    for name, value in (("SLICE", size), ("QUERIES", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(T, name, value)
    rng = random.Random(6)
    kinds = [[rng.choice([0.0, 1.0, 0.5, -1.0, 3.0]) for _ in range(3)] for _ in range(12)] + [[0.0, 0.0, 0.0], [1.0, 1.0, 1e-3]]
    rows = [(i, rng.choice("ab"), rng.choice(kinds)) for i in range(160)] + [(200, "c", [1.0, 2.0, 3.0]), (201, "d", [1.0, 0.0, 0.0])]
    queries = [r for r in rows if r[0] % 10 == 0 and r[1] != "b"]
    schema = "id long, g string, x array<double>"
    got = T.cosine_top(spark.createDataFrame(rows, schema), "id", "g", "x", spark.createDataFrame(queries, schema), 4).collect()
    assert {(r.query_id, r.peer_id, r.similarity, r["rank"]) for r in got} == brute(rows, queries, 4) and len(got) > 20
    assert T.cosine_top(spark.createDataFrame(rows, schema), "id", "g", "x", spark.createDataFrame([], schema), 4).collect() == []


def test_pairs_are_no_rows(spark):
    """A plan without a join of vectors and queries, and more tasks than groups."""
    df = spark.range(2000).selectExpr("id", "0L AS g", "transform(sequence(0, 5), i -> double(1 + (id * 7919 * (i + 3)) % 1009)) AS x")
    out = T.cosine_top(df, "id", "g", "x", df.filter("id % 100 = 0"), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(g#" in plan and "slice#" in plan
    assert out.count() == 60
