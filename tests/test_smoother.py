"""The smoother against plain code, series of several lengths in one batch, to the last digit."""

import random

from isochron.operators import series as T


def plain(y, rounds):
    n = len(y)
    mean = sum(y) / n
    v = sum((x - mean) ** 2 for x in y) / n or 0.01
    q = r = v * 0.5

    def forward():
        out = []
        for t, x in enumerate(y):
            m, p = (out[-1][0], out[-1][1] + q) if t else (x, v)
            g = p / (p + r)
            out.append((m + g * (x - m), (1 - g) * p))
        return out

    def backward(f):
        out = [(*f[-1], 0.0)]
        for m, p in f[-2::-1]:
            g, (am, ap, _) = p / (p + q), out[0]
            out.insert(0, (m + g * (am - m), p + g * g * (ap - p - q), g * ap))
        return out

    for _ in range(rounds):
        b = backward(forward())
        q, r = sum((b[t + 1][0] - b[t][0]) ** 2 + b[t + 1][1] + b[t][1] - 2 * b[t][2] for t in range(n - 1)) / (n - 1), sum((y[t] - b[t][0]) ** 2 + b[t][1] for t in range(n)) / n
    f = forward()
    return [(*a, *b[:2], q, r) for a, b in zip(f, backward(f))]


def test_smoother_equals_plain_code(spark):
    rng = random.Random(8)
    series = {k: [rng.choice([0.0, 1.5, 4.0]) if k % 3 else 2.0 for _ in range(1 + k % 7)] for k in range(60)} | {90: [0.0, 0.0, 0.0], 91: [3.0, None, 1.0]}
    rows = [(k, t, y) for k, ys in series.items() for t, y in enumerate(ys)]
    rng.shuffle(rows)
    out = T.smooth(spark.createDataFrame(rows, "k long, t long, v double"), ["k"], "t", "v", 4)
    assert out.columns == ["k", "t", "v", "filtered_mean", "filtered_var", "smoothed_mean", "smoothed_var", "process_variance", "observation_variance"]
    got = {(r.k, r.t): r for r in out.collect()}
    want = {k: [y or 0.0 for y in ys] for k, ys in series.items() if len(ys) > 1 and any(ys)}
    assert got.keys() == {(k, t) for k, ys in want.items() for t in range(len(ys))} and 90 not in want
    for k, ys in want.items():
        for t, numbers in enumerate(plain(ys, 4)):
            assert got[k, t].v == ys[t] and all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(tuple(got[k, t])[3:], numbers))


def test_smoother_is_one_pass_over_the_series(spark):
    """A signal reads its smoothed rows from where they're stored: the metric is aggregated for none of its sides again."""
    from isochron.plans import queries_latent as Q
    from isochron.plans.feed import Feed

    plan = Q.i10_signal(Feed(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "l_extendedprice" not in plan
