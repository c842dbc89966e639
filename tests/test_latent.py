"""The smoother against a plain loop, and sparse codes against their conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.operators import latent as L
from isochron.operators import series as T


def plain(y, rounds=10):
    v = np.var(y) if np.var(y) > 0 else 0.01
    q = r = v / 2
    for step in range(rounds + 1):
        m, p, ms, ps = y[0], v, [], []
        for t, x in enumerate(y):
            if t:
                p = p + q
            k = p / (p + r)
            m, p = m + k * (x - m), (1 - k) * p
            ms.append(m)
            ps.append(p)
        sm, sp, lag = [ms[-1]], [ps[-1]], []
        for t in range(len(y) - 2, -1, -1):
            j = ps[t] / (ps[t] + q)
            lag.insert(0, j * sp[0])
            sp.insert(0, ps[t] + j * j * (sp[0] - ps[t] - q))
            sm.insert(0, ms[t] + j * (sm[0] - ms[t]))
        if step < rounds:
            r = np.mean([(a - b) ** 2 + c for a, b, c in zip(y, sm, sp)])
            q = np.mean([(sm[t + 1] - sm[t]) ** 2 + sp[t + 1] + sp[t] - 2 * lag[t] for t in range(len(y) - 1)])
    return list(zip(ms, ps, sm, sp)), q, r


def test_smoother(spark):
    rng = np.random.default_rng(2)
    series = {"a": rng.normal(5, 2, 9).tolist(), "b": [1.0, 1.0], "c": [3.0], "d": [0.0, 0.0, 0.0], "e": [0.0, None, 4.0]}
    df = spark.createDataFrame([(k, i, v) for k, own in series.items() for i, v in enumerate(own)], "k string, t long, v double")
    got = {}
    for r in T.smooth(df, ["k"], "t", "v").collect():
        got.setdefault(r.k, {})[r.t] = r
    assert set(got) == {"a", "b", "e"}
    for k, own in got.items():
        want, q, r = plain([x or 0.0 for x in series[k]])
        for t, row in enumerate(want):
            assert np.allclose((own[t].filtered_mean, own[t].filtered_var, own[t].smoothed_mean, own[t].smoothed_var), row, rtol=1e-9)
        assert np.allclose((own[0].process_variance, own[0].observation_variance), (q, r), rtol=1e-9)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    atoms = rng.normal(size=(3, 5))
    x = rng.laplace(size=(120, 3)) @ atoms + rng.normal(0, 0.05, (120, 5))
    return spark.createDataFrame([(i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)], "id long, season long, x array<double>").repartition(3)


def test_dictionary_and_codes(spark, vectors):
    d = L.learn_dictionary(vectors, ["id"], 3, 0.1, 25)
    again = L.learn_dictionary(vectors.repartition(5), ["id"], 3, 0.1, 25)
    assert np.allclose(d, again, atol=1e-6) and (np.linalg.norm(d, axis=1) <= 1 + 1e-9).all()
    codes = L.sparse_codes(vectors, d, 0.1)
    assert codes.count() == 120 and L.optimality_gap(codes, d, 0.1).agg(F.max("gap")).first()[0] < 1e-6
    wrong = codes.withColumn("z", F.transform("z", lambda v: v * 1.01))
    assert L.optimality_gap(wrong, d, 0.1).agg(F.max("gap")).first()[0] > 1e-4
    rows = codes.collect()
    x, z = np.array([r.x for r in rows]), np.array([r.z for r in rows])
    got = {r.feature: (r.n, r.mse, r.r2) for r in L.reconstruction(codes, d, list("abcde")).collect()}
    e = (x - z @ d) ** 2
    assert got[None] == (600, pytest.approx(e.mean()), pytest.approx(1 - e.mean() / x.var())) and got[None][2] > 0.9
    assert all(got[f][1:] == (pytest.approx(e[:, i].mean()), pytest.approx(1 - e[:, i].mean() / x[:, i].var())) for i, f in enumerate("abcde"))
    meta = {r.dim_idx: r for r in L.dimension_meta(codes, list("abcde"), "season").collect()}
    for k in range(3):
        size = sorted("abcde", key=lambda f: -abs(np.corrcoef(z[:, k], x[:, "abcde".index(f)])[0, 1]))
        assert meta[k].top_features == size[:3] and meta[k].stable_seasons == len(meta[k].seasons_active)


def test_nothing_to_code(spark):
    empty = spark.createDataFrame([], "id long, x array<double>")
    assert len(L.learn_dictionary(empty, ["id"], 3, 0.1)) == 0
    one = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0), ("q", "a", 3.0)], "k string, name string, v double")
    assert [(r.k, r.x) for r in L.complete_vectors(one, ["k"], "name", "v", ["a", "b"]).collect()] == [("p", [1.0, 2.0])]
