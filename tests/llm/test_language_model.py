"""Language-model scoring: counts and base score by plain code, the network by its gradients and probabilities."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from isochron.llm import language_model as L

SCHEMA = "doc_id long, text string"


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), "\n"]


def expected(table):
    seen = Counter()
    for i, text in table:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update(tokens(text))
    n, v = sum(seen.values()), len(seen)
    out = []
    for i, text in table:
        own = tokens(text)
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own)
        out.append((i is None, i or 0, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(seen[w] > 0 for w in own), n, round(base, 4)))
    return sorted(out)


def scored(spark, table, schema=SCHEMA, **more):
    return L.language_model(spark.createDataFrame(table, schema), **more).collect()


def plain(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)


TABLE = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 40)) + f" Rare{i % 60}, É{i} x") for i in range(120)]
TABLE += [(None, "w1 w2 unheard"), (7, None), (8, ""), (9, " \n\t"), *TABLE[20:24], (500, "long " * 30_000), (501, "y" * 300_000), (501, "other text")]


@pytest.mark.parametrize("frequent", [10, L.FREQUENT])
def test_counts_and_base_score(spark, frequent):
    """With few frequent words the others come by the join."""
    rows = scored(spark, TABLE, frequent=frequent)
    assert plain(rows) == expected(TABLE)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    equal = {}
    for r in rows:
        equal.setdefault((r.doc_id, r.n_tokens, r.base_score), []).append(r.score)
    assert all(max(x) - min(x) <= 1e-4 * max(1, -min(x)) for x in equal.values())


def test_nothing_to_learn_from(spark):
    own = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = scored(spark, [(own, "two words")])
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0) and row.score < 0
    assert scored(spark, []) == []
    clash = spark.createDataFrame([(1, "a b", 2, "x")], f"{SCHEMA}, row int, score string")
    assert L.language_model(clash).count() == 1


def network(seed=1):
    own = L.Network(np.full(L.Network.size(), 1e-8, np.float32).astype(np.float64))
    rng = np.random.default_rng(seed)
    for w in own.weight.values():
        w[:] = rng.normal(0, 0.3, w.shape)
    return own, rng


def test_gradients_by_differences():
    """Weights change along the loss's slope: the gradient of each kind of weight against central differences."""
    own, rng = network()
    x, y = rng.integers(0, L.WORDS + L.SHAPES, (5, 3)), rng.integers(0, L.WORDS + L.SHAPES, (5, 3))
    keep = np.ones((5, 3, 1))
    keep[2, 1] = keep[0, 0] = 0
    h = rng.normal(0, 0.3, (3, L.STATE))

    def loss():
        return -own.log10(own.states(x, keep, h).reshape(-1, L.STATE).astype(np.float64), y.ravel()).mean() * np.log(10)

    got = {}
    own._step = lambda name, rows, g: got.setdefault(name, (rows, g))
    own.learn(x, keep, y, h)
    rows, g = got["w"]
    full = np.zeros_like(own.weight["w"])
    full[rows] = g
    got["w"] = (slice(None), full)
    for name, (_, g) in got.items():
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-abs(g).ravel())[:3]]:
            w, kept = own.weight[name], own.weight[name][at]
            w[at] = kept + 1e-2
            up = loss()
            w[at] = kept - 1e-2
            down = loss()
            w[at] = kept
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3 + 0.05 * abs(g[at]), name


def test_probabilities_sum_to_one():
    own, rng = network(2)
    h = np.repeat(rng.normal(0, 1, (1, L.STATE)), L.WORDS + L.SHAPES, 0)
    total = (10 ** own.log10(h, np.arange(L.WORDS + L.SHAPES))).sum()
    assert abs(total - 1) < 1e-5


def test_classes_lie_together():
    """Each class' tokens are gathered once and lie together, in parts that stay in the cache; none is lost."""
    y = np.random.default_rng(4).integers(0, L.WORDS + L.SHAPES, 9000)
    y[:5000] %= 70
    order, place, parts = L.Network._members(y)
    assert sorted(order.tolist()) == np.flatnonzero(y < L.WORDS).tolist()
    covered = [(y[order[i]] // L.MEMBERS, y[order[i]] % L.MEMBERS) == (c, place[i]) for c, a, b in parts for i in range(a, b)]
    assert all(covered) and len(covered) == len(order) and max(b - a for _, a, b in parts) <= L.ROWS


def test_state_goes_through_the_whole_text():
    """Windows of any length give the same probability, and early words change later ones'."""
    own, rng = network(3)
    ids = [rng.integers(0, L.WORDS, n).astype(np.uint16) for n in (1, 40, 7, 200)]
    a, b = (L.document_scores(own, [x.tobytes() for x in ids], steps) for steps in (3, 64))
    assert np.allclose(a, b, atol=1e-3)
    other = ids[3].copy()
    other[0] += 1
    longer, shorter = [x.tobytes() for x in (ids[3], other)], [x[:1].tobytes() for x in (ids[3], other)]
    assert abs(np.subtract(*L.document_scores(own, longer)) - np.subtract(*L.document_scores(own, shorter))) > 1e-6


def test_better_than_the_unigram_on_held_out_documents(spark):
    from isochron.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = queries.op13_language_model(spark, folder).collect()
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert plain(rows) == expected(table)
    own = [r for r in rows if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.2 * sum(r.n_tokens for r in own)
