"""The pipeline's stages: what stays, edge rows, clashing columns, and the whole run against plain code."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed string, kept_text string, number int"


def prose(seed: int, n: int) -> str:
    """Made-up words; other seeds give other words."""
    return " ".join(f"w{seed}x{i * 7919 % 10007}" for i in range(n))


def rows(*texts):
    return [(i, x, "en", "s", len(x or ""), 0.5, "r", "k", 7) for i, x in enumerate(texts)]


def run(spark, stage, data, folder=""):
    out = stage(spark, spark.createDataFrame(data, SCHEMA), folder)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_near_duplicates_stay_once(spark):
    text = prose(1, 100)
    near = text.replace("w1x0 ", "other ", 1)
    data = rows(text, near, prose(2, 80), None, "", "one two") + [(2, prose(2, 80), "en", "s", 0, 0.5, "r", "k", 7), (None, text, "en", "s", 0, 0.5, "r", "k", 7)]
    got = [(r[0], r[1]) for r in run(spark, corpus_pipeline.keep_one_of_near_duplicates, data)]
    assert got == [(None, text), (0, text), (2, prose(2, 80)), (3, None), (4, ""), (5, "one two")]
    assert run(spark, corpus_pipeline.keep_one_of_near_duplicates, []) == []


def test_passages_with_clashing_columns(spark):
    passage = prose(3, 80)
    data = rows(passage + " " + prose(4, 30), prose(5, 30) + " " + passage + " " + prose(6, 20), passage, None, "")
    got = {r[0]: r for r in run(spark, corpus_pipeline.cut_repeated_passages, data)}
    assert sorted(got) == [0, 1, 3, 4] and got[0] == data[0] and got[3] == data[3] and got[4] == data[4]
    assert passage not in got[1][1] and got[1][1].startswith(prose(5, 30)) and got[1][4] == len(got[1][1]) and got[1][5:] == data[1][5:]
    assert run(spark, corpus_pipeline.cut_repeated_passages, []) == []


def test_contaminated_go(spark, tmp_path):
    item = prose(7, 12)
    spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = rows(prose(8, 50), "x " + item.upper() + " y", None, "") + [(None, item, "en", "s", 0, 0.5, "r", "k", 7)]
    assert [r[0] for r in run(spark, corpus_pipeline.drop_contaminated, data, str(tmp_path))] == [None, 0, 2, 3]


def test_unknown_language_goes(spark):
    english, german = "the cat sat on the mat and looked at the other one over there ", "der hund lief über die straße und sah den anderen nicht mehr "
    data = [(i, (english, german)[i % 2] * 20, ("en", "de")[i % 2], "s", 0, 0.5, "r", "k", 7) for i in range(40)]
    data += [(100, None, None, "s", 0, 0.5, "r", "k", 7), (101, "", "en", "s", 0, 0.5, "r", "k", 7), (102, "12 34 !!", None, "s", 0, 0.5, "r", "k", 7), (103, english * 20_000, "en", "s", 0, 0.5, "r", "k", 7)]
    got = run(spark, corpus_pipeline.keep_known_language, data)
    assert [r[0] for r in got] == [*range(40), 103] and got[0] == data[0]
    assert run(spark, corpus_pipeline.keep_known_language, data[-4:-1]) == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_run_against_brute_force(spark, folder):
    """From language id's own verdicts on, every stage in plain Python over whole texts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = {r.doc_id: r.text for r in corpus_pipeline.keep_known_language(spark, docs, folder).collect()}
    sets = {}
    for i, x in known.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    least = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    one = {i: known[i] for i in ids if least[i] == i}
    span, words = corpus_pipeline.PASSAGE, corpus_pipeline.PASSAGE_WORDS
    loose = r"\x20\x09-\x0D!-/:-@\[-`{-~"

    def short(x: bytes):
        w = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)]
        for k in range(len(w) - words + 1):
            a, b = w[k], w[k + words - 1]
            head, tail = re.search(f"[^{loose}]".encode(), x[a[0] : a[1]]), re.search(f"[{loose}]*$".encode(), x[b[0] : b[1]])
            start, end = (a[0] + head.start() if head else a[0]), (b[0] + tail.start() if tail.start() else b[1])
            if end - start < span:
                yield start, end

    had, cut = set(), {}
    for i in sorted(one):
        x = one[i].encode()
        cover, own = bytearray(len(x)), []
        for a, b in [(a, a + span) for a in range(len(x) - span + 1)] + list(short(x)):
            own.append(x[a:b])
            if x[a:b] in had:
                cover[a:b] = b"\1" * (b - a)
        had.update(own)
        text = bytes(c for c, gone in zip(x, cover) if not gone).decode("utf-8", "ignore")
        if not any(cover) or text.strip(" "):
            cut[i] = text
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda x: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} - {()}
    sizes = {len(w) for w in windows}
    clean = {i: x for i, x in cut.items() if not any(tuple(w[k : k + n]) in windows for w in [split(x)] for n in sizes for k in range(len(w) - n + 1))}
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(i, p): min(4096, n - 4096 * p) for i, x in clean.items() for n in [len(own.encode(x, add_special_tokens=False).ids) + 1] for p in range(-(-n // 4096))}
    got = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length").collect()
    assert {(r.doc_id, r.piece): r.length for r in got} == want and len(got) == len(want)
