"""Spelling variants against plain code: every pair of words compared."""

import random
import re
import zlib
from collections import Counter

import pytest

from isochron.llm import spelling_variants as V

SCHEMA = "doc_id long, text string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(table):
    counts = Counter()
    for doc_id, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    out, form = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(own), form[w], n.get(form[w])]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return out


def found(spark, table, schema=SCHEMA):
    rows = V.variants(spark.createDataFrame(table, schema)).collect()
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in rows}
    assert len(got) == len(rows)
    return got


def edits(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words(spark, seed):
    """Many near words of few letters, chains of forms, letters of two bytes, words around the length that isn't
    reduced, null ids and texts, repeated rows."""
    rng = random.Random(seed)
    letters = "abcéÿ×Z"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(40)]
    words += ["".join(rng.choice(letters) for _ in range(V.LONG + k)) for k in (-1, 0, 1, 2)] + ["ab" * 5000]
    for _ in range(2):
        words += [edits(rng, w, letters) for w in words]
    table = [(None, None), (3, "")]
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(60)) + "œ" + ", ".join(words[: rng.randrange(len(words))])
        table.append((None if i == 7 else i, text))
    table += [(100 + i, "hello hello hello " + "hallo " * (i % 2) + "halli " * (i % 5 == 0)) for i in range(15)]
    table.append((200, "hella hella hella hellos hellos hellos helle helle helle"))
    table += table[5:9] + [(99, "1" * 1000 + "\U0001f600" + "q" * 200_000)] * 3
    got, want = found(spark, table), expected(table)
    assert got == want
    assert any(r[4] not in (r[2], w) for w, r in got.items()) and max(r[1] for r in got.values()) > 3


def test_deleted_code_points(spark):
    """Documents whose words lose a code point, of one byte or two, first and last ones too."""
    table = [(i, "cafés naïvely überall summer éééééé") for i in range(2000)]
    got = found(spark, table)
    assert got == expected(table) and len(got) > 5


def test_pairs_need_no_common_symbols():
    """Each one-edit pair has a common key, whatever the edit and its place."""
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abcdefghé") for _ in range(rng.choice([5, 6, 7, 9, 63, 64, 65, 66])))
        b = edits(rng, a, "abcdefghé")
        if near(a, b):
            w = V._Word(pa.array([a, b]))
            (own, mine), (which, theirs) = V._own_keys(w), V._neighbour_keys(w)
            assert any(set(theirs[which == i]) & set(mine[own == 1 - i]) for i in (0, 1))


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == {} and found(spark, [(1, "few words")]) == {}
    frame = spark.createDataFrame([(i, "hello hello hallo", "x", 1) for i in range(9)], f"{SCHEMA}, word string, key int")
    assert {r.word: r.root for r in V.variants(frame).collect()} == {"hello": "hello", "hallo": "hello"}
