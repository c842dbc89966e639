"""Training-data operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing
columns, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"w{i % 97} x{i % 89}" for i in range(6000))
BASE = "the quick brown fox jumps over the lazy dog and then it runs away from the hound that was asleep under the tree"
TEXTS = [None, "", "   \n ", "one", BASE, BASE, BASE + " tonight", BASE.replace("quick", "slow"), LONG, "Ünï çödé " * 30, "a b c d " * 40, "end\n" * 9 + "tail " + BASE]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, sig string, score double"


def table(spark, texts=TEXTS, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if n % 2 else None, None, 0, "x", "y", 1.0) for n, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_url_filter(spark):
    from isochron.llm.url_filter import judge

    urls = [(1, None), (2, "no scheme"), (3, "http://A.example.ORG/es/x?q"), (4, "https://example.org/en/12#a"), (5, "http://b.com/fr/"), (6, "http://b.com"), (7, "http://xexample.org/es/"), (7, "http://xexample.org/es/"), (8, "http://")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    rules = spark.createDataFrame([("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), (None, "block")], "rule string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(df, rules, ["page_id"], shard_bytes=30).collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "/es/x", "example.org/es/", "block"), (4, "example.org", "/en/12", "example.org/en/1", "block"),
        (5, "b.com", "/fr/", "com/fr/", "allow"), (6, "b.com", "", None, "allow"), (7, "xexample.org", "/es/", "org/", "allow"), (7, "xexample.org", "/es/", "org/", "allow"), (8, "", "", None, "allow"),
    ]
    assert judge(df.limit(0), rules, ["page_id"]).count() == 0


def test_quality_counts(spark):
    from isochron.llm.quality_rules import quality

    got = {r.doc_id: tuple(r[1:6]) for r in quality(table(spark), ["doc_id"]).collect()}
    for i, text in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = collections.Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
        hit = {b for a in range(len(w) - 7) if n[tuple(w[a : a + 8])] > 1 for b in range(a, a + 8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got[i] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)), i
    assert quality(table(spark).limit(0), ["doc_id"]).count() == 0


def test_quality_fences_adapt(spark):
    from isochron.llm.quality_rules import fences

    rows = [("en", "a", "dup_lines", 0, 960), ("en", "a", "dup_lines", 20, 40), ("en", "b", "dup_lines", 0, 1000), ("en", "c", "dup_lines", 40, 1), ("en", "a", "symbols", 0, 1000)]
    got = {(r.source, r.feature): r.high for r in fences(spark.createDataFrame(rows, "lang string, source string, feature string, bucket int, n long")).collect()}
    # the high quantile of "en" and of all documents is 20, four times which is 80
    assert got[("a", "dup_lines")] == pytest.approx(80)
    assert got[("b", "dup_lines")] == pytest.approx(4 * 200 * 20 / 1200)
    mid, high = 40 / 201, (40 + 200 * 20) / 201  # one document hardly moves its source's fence
    assert got[("c", "dup_lines")] == pytest.approx(high + 3 * (high - mid))
    assert got[("a", "symbols")] == 100


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_decontamination(spark, block_words):
    from isochron.llm.decontaminate import decontaminate

    items = spark.createDataFrame([(1, BASE[:80]), (1, BASE[:80]), (2, "one"), (10, "b c"), (3, ""), (None, "lazy dog"), (4, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate(table(spark), items, 10, block_words).collect()}
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for i, t in ((1, BASE[:80]), (2, "one"), (10, "b c"), (None, "lazy dog")):
        w = words(t, pattern)
        n = min(10, len(w))
        for a in range(len(w) - n + 1):
            windows[tuple(w[a : a + n])].add(i)
    for i, text in enumerate(TEXTS):
        w, hit, found = words(text, pattern), set(), set()
        for g, of in windows.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit.update(range(a, a + len(g)))
                    found |= of - {None}
        assert got[i] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()), i
    assert decontaminate(table(spark), items.limit(0)).filter("contaminated").count() == 0


def brute_removed(rows, span):
    least = {}
    for i, x in sorted(rows, key=lambda r: r[0]):
        for a in range(len(x) - span + 1):
            least.setdefault(x[a : a + span], i)
    out = []
    for i, x in rows:
        cover = bytearray(len(x))
        for a in range(len(x) - span + 1):
            if least[x[a : a + span]] < i:
                cover[a : a + span] = b"\1" * span
        spans = sum(c and (j == 0 or not cover[j - 1]) for j, c in enumerate(cover))
        out.append((i, len(x), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(x, cover) if not c)).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark):
    from isochron.llm.suffix_dedup import dedup

    ids = [5, 4, 3, 2, 9, 9, 7, 8, 1, 6, 10, 11]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup(table(spark, ids=ids), ["doc_id"], 50).collect())
    assert got == brute_removed([(i, (t or "").encode()) for i, t in zip(ids, TEXTS)], 50)
    assert dedup(table(spark).limit(0), ["doc_id"], 50).count() == 0
    null = table(spark, [BASE, BASE], [None, 1])
    assert {r.n_removed for r in dedup(null, ["doc_id"], 50).collect()} == {0}


def test_suffix_dedup_of_words(spark):
    from isochron.llm.suffix_dedup import dedup

    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "bcd", "'a", "-", "é-"], rng.integers(0, 60))) for _ in range(60)]
    raws = [t.encode() for t in texts]
    loose = b"-'"

    def short(x):
        w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)]
        lead = [a + (len(x[a:b]) - len(x[a:b].lstrip(loose))) * bool(x[a:b].strip(loose)) for a, b in w]
        tail = [b - (len(x[a:b]) - len(x[a:b].rstrip(loose))) * bool(x[a:b].strip(loose)) for a, b in w]
        return [(lead[i], tail[i + 4]) for i in range(len(w) - 4) if tail[i + 4] - lead[i] < 20]

    got = {r.doc_id: r.n_removed for r in dedup(table(spark, texts), ["doc_id"], 20, words=5).collect()}
    had, fewer = set(), 0
    for i, x in enumerate(raws):
        cover = bytearray(len(x))
        for a, b in [(a, a + 20) for a in range(len(x) - 19)] + short(x):
            if x[a:b] in had:
                cover[a:b] = b"\1" * (b - a)
        assert got[i] == sum(cover), i
        fewer += sum(cover)
        had |= {x[a : a + 20] for a in range(len(x) - 19)} | {x[a:b] for a, b in short(x)}
    assert fewer


def test_pipeline_cuts_short_worded_passages(spark):
    import corpus_pipeline

    own = lambda c: " ".join(f"{c}word{i}" for i in range(60))
    over, fifty = " ".join(f"{i:02}" for i in range(10, 61)), " ".join(f"x{i:02}" for i in range(50))
    texts = [f"{own('a')} {over} {own('b')}\n{fifty}", f'{own("c")} "{over}" {own("d")} {fifty} e', None]
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeated_passages(spark, table(spark, texts), "").collect()}
    cut = texts[1].replace(over, "")
    assert kept == {0: (texts[0], 0), 1: (cut, len(cut)), 2: (None, 0)}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=24, max_size=24), min_size=1, max_size=12))
def test_columns_find_equal_strings(rows):
    from isochron.llm.suffix_dedup import repeats

    symbols = np.array([list(r.encode()) for r in rows], np.uint8)
    docs = np.arange(len(rows))
    piece, column = repeats(symbols, docs, 8, 16)
    want = {(i, c) for i in range(len(rows)) for c in range(17) if any(rows[j][c : c + 8] == rows[i][c : c + 8] for j in range(i))}
    assert set(zip(piece.tolist(), column.tolist())) == want


def test_token_output(spark):
    from tokenizers import Tokenizer

    from isochron.llm.token_output import token_output

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, at, want = Tokenizer.from_file(path), 0, []
    for i, text in enumerate([*TEXTS, "<|endoftext|>x", "a  b　 c  d\n\n e"]):
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    df = table(spark, [*TEXTS, "<|endoftext|>x", "a  b　 c  d\n\n e"])
    assert sorted(map(tuple, token_output(df, path).collect())) == want
    assert token_output(df.limit(0), path).count() == 0


ODD = ["\nÉté", "a\n\nWord", "x\x0bword\tWord\r\nÖl", "é.É,", "ß's don't ÀÖ'S", "é<|endoftext|>É", "e\u0301 É\u0301 ñ<\u0338", "\n\u00a0x \n x", "ª º ×a ÷É µ", "a1 1a É1\n1", "\nİx K", "ÿ " * 3 + "Ñandú-Ñ", "\n" + "Wörter" * 300]
LETTERS = st.sampled_from([*"abE19 \n\t.'<|-", "é", "É", "×", "ß", "\u0301", "\u00a0", "漢", "don't"])


@pytest.mark.parametrize("name, drops_space", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@settings(max_examples=60, deadline=None)
@given(rows=st.lists(st.lists(LETTERS, max_size=25).map("".join), max_size=6))
def test_ids_are_the_tokenizers(name, drops_space, rows):
    import pyarrow as pa

    from isochron.llm.tokens import encoder

    own = encoder(public_tokenizers.path(name), drops_space)
    rows = [*rows, *ODD]
    ids, starts = own.encode(pa.array(rows, pa.string()), 7)
    got = [ids[a : b - 1].tolist() for a, b in zip(starts.tolist(), starts[1:].tolist())]
    assert got == [x.ids for x in own.tokenizer.encode_batch(rows, add_special_tokens=False)]


@pytest.mark.parametrize("name, drops_space", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_words_go_to_the_model_alone(name, drops_space, monkeypatch):
    """The whole tokenizer, four times as dear, gets what isn't a word, and the break before a word apart from it."""
    import pyarrow as pa

    from isochron.llm.tokens import Encoder

    own, seen = Encoder(public_tokenizers.path(name), drops_space), []
    monkeypatch.setattr(own, "_others", lambda parts, f=own._others: seen.extend(parts) or f(parts))
    own.encode(pa.array(["Plain words,\nÉté é.\nNew"]), 0)
    assert {x.strip() for x in seen} <= {"", ",", "."}


def test_packing_remembers_little():
    """Beside a full JVM, 3,000 MB hold two workers of packing only if they keep few words and small slices."""
    import pyarrow as pa

    from isochron.llm import packing
    from isochron.llm.tokens import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    own = encoder(path, True, packing.CACHE)
    for i in range(0, 400_000, 20_000):
        own.encode(pa.array([" ".join("".join(chr(97 + int(c)) for c in str(j)) for j in range(i, i + 20_000))]), 1)
        assert len(own.known) + len(own.old[0] if own.old else ()) <= 2 * (100_000 + 20_000)
    assert packing.SLICE <= 1 << 20


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_coding_round_trip(values):
    from isochron.llm.token_output import pack, unpack

    assert unpack(*pack(np.array(values, "<u4")), len(values)).tolist() == values


def test_packing(spark):
    from isochron.llm.packing import best_fit_plan, pack_sequences

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pack_sequences(table(spark), path, size=512).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert {r.doc_id for r in rows} == set(range(len(TEXTS)))
    plan = best_fit_plan({6: 1, 5: 2, 4: 3, 1: 1}, 10)
    assert len({s for _, n, first, each, _, _ in plan.tolist() for s in range(first, first + -(-n // each))}) == 3
    assert pack_sequences(table(spark).limit(0), path).count() == 0


def test_language_id(spark):
    from isochron.llm.language_id import language_id

    rows = [(i, f"the dog and the house are in the garden {i}" if i % 2 else f"der hund und das haus sind in dem garten {i}", "en" if i % 2 else "de") for i in range(80)] + [(900, None, "en"), (901, "12 34 !!", "de"), (None, "the dog", "en")]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].held_out is False
    assert {r.lang_pred for r in language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80)])
def test_jaccard_join(spark, size, num):
    from isochron.llm.jaccard_join import near_duplicates

    rng = np.random.default_rng(3)
    texts = list(TEXTS)
    for _ in range(12):
        base = [f"v{x}" for x in rng.integers(0, 400, int(rng.integers(8, 160)))]
        for _ in range(4):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 4))):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, texts), size, num, 100).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}
    assert near_duplicates(table(spark).limit(0)).count() == 0


def test_html(spark):
    from isochron.llm.html_extract import extract, main_text

    assert main_text(None) == main_text("") == ""
    assert main_text("<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp;  two<div class='ad'>buy</div><p>three<br>four</article><div id=comments>no</div><footer>f</footer>") == "Head\nOne & two\nthree\nfour"
    assert main_text("<article class='post tag-x'>&#233;<script>x<y</script></article>") == "é"
    df = spark.createDataFrame([(1, "u", None), (1, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in extract(df, ["page_id", "url"]).collect()) == [("", 0), ("a", 1)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article data-comments='12'><p>Hello</p></article>", "Hello"),
        ("<article data-class='comment'><p>Hello</p></article><article>you</article>", "Hello\nyou"),
        ("<main class='has-comments'><p>Hello</p></main>", "Hello"),
        ("<article><p>Hello</p><article class='x comment' id=comment-5>no</article></article>", "Hello"),
        ("<p>see<article class='comment'>Hello</article>", "see\nHello"),
        ("<div>Body</div><article class='comment'>no</article><article class='reply'>no</article>", "Body"),
        ("<article class='comment'>a</article><article class='reply'>b</article>", "a\nb"),
        ("<!-- <article> --><p>Hello</p>", "Hello"),
        ("<div>Body</div><aside><article>teaser</article></aside>", "Body"),
        ("<article><figure><img><figcaption>Cap</figcaption></figure></article>", "Cap"),
        ("<article>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='tex'>x=1</annotation></semantics></math> be.</article>", "Let x=1 be."),
        ("<article><math><annotation-xml/><mi>x</mi></math> is<annotation-xml>y</annotation-xml> here</article>", "x is here"),
    ],
)
def test_html_keeps_main_text(page, text):
    from isochron.llm.html_extract import main_text

    assert main_text(page) == text


def test_toxicity(spark):
    from isochron.llm.toxicity import toxicity

    rows = [(i, ("you are an awful zork today " if i % 4 == 0 else "they met a kind friend today ") * 3) for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(901, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200)) and 0 <= got[900].score <= 1
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
