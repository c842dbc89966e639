"""Ranks by range against a sort, and category scores by plain code."""

import random
import statistics

from isochron.operators import ranks as N


def test_range_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(6)
    got = {r.i: r for r in N.range_ranks(df, ["k"], "v", ["i"]).withColumn("bin", N.ntile(7)).collect()}
    assert len(got) == 400
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        n, base, more = len(own), len(own) // 7, len(own) % 7
        bins = [b + 1 for b in range(7) for _ in range(base + (b < more))]
        for at, (_, v, i) in enumerate(own):
            same = [j for j, r in enumerate(own) if r[1] == v]
            assert (got[i].position, got[i].rank_min, got[i].ties, got[i].total, got[i].bin) == (at + 1, same[0] + 1, len(same), n, bins[at])
    assert N.range_ranks(df.limit(0), ["k"], "v").collect() == []


def test_category_scores(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, "actual", m, None if rng.random() < 0.1 else rng.choice([1.0, 2.0, 5.0, 9.0])) for i in range(30) for m in ("p", "q", "same")]
    rows += [(i, i % 2, "actual", "rare", 1.0 + i) for i in range(8)]
    rows = [(i, g, s, m, 3.0 if m == "same" else v) for i, g, s, m, v in rows]
    cats = {"one": ("p",), "both": ("p", "q", "same"), "none": ("rare",)}
    got = {(r.id, r.category): r for r in N.category_scores(spark.createDataFrame(rows, "id long, side long, suffix string, metric_name string, value double"), ["id"], "side", cats, ["q"]).collect()}
    assert len(got) == 90
    score = {}
    for i in range(30):
        for c, own in cats.items():
            z = []
            for m in own:
                values = [r[4] for r in rows if r[1] == i % 2 and r[3] == m and r[4] is not None]
                mine = [r[4] for r in rows if r[0] == i and r[3] == m and r[4] is not None]
                if mine and len(values) >= 10:
                    s = statistics.stdev(values)
                    z.append((-1 if m == "q" else 1) * (mine[0] - statistics.mean(values)) / s if s else 0.0)
            score[i, c] = round(sum(z) / len(z), 9) if z else 0.0
            assert abs(got[i, c].score - score[i, c]) < 2e-9
    for (i, c), s in score.items():
        group = [v for (j, d), v in score.items() if d == c and j % 2 == i % 2]
        below, same = sum(v < s - 5e-9 for v in group), sum(abs(v - s) <= 5e-9 for v in group)
        assert abs(got[i, c].percentile - 100 * (below + (same + 1) / 2) / len(group)) < 1e-9
