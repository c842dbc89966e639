"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isochron.llm import conversation_repair, decontaminate, html_extract, jaccard_join, language_id, language_model, packing, quality_rules, spelling_variants, suffix_dedup, token_output, toxicity, url_filter

#: Rules of the URL filter: host and the beginning of the path, and what they say.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules, ["page_id"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"), ["doc_id"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), span=10).drop("spans")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), ["doc_id"], span=50)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, size=4096)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold=0, folds=5)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"), fold=2, folds=4)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(rows), rows)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_table(spark, sf_dir, "documents"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model(_table(spark, sf_dir, "documents"), fold=2, folds=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_quality_rules, op3_decontamination, op4_suffix_dedup, op5_token_output, op6_best_fit_packing, op7_toxicity, op8_language_id, op9_jaccard_join, op10_html_extraction, op11_conversation_repair, op12_spelling_variants, op13_language_model)
    return {f.__name__: f for f in own}


#: The URL filter's rules are few, so SQL can hold them against each url one by one.
OP1_SQL = """
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rests),
rules AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM (VALUES %s) AS r(rule, verdict)),
fits AS (SELECT page_id, max_by({'rule': rule, 'verdict': verdict}, length(rule)) AS best FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
""" % ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of every item against every window of every document, by equality.
OP3_SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
placed AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS place FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[place:place + size - 1], ' ') AS win FROM placed),
sizes AS (SELECT DISTINCT size FROM windows),
spread AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS place FROM docs JOIN sizes ON len(w) >= size),
hits AS (SELECT d.doc_id, d.place, d.size, x.item_id FROM (SELECT doc_id, size, place, array_to_string(w[place:place + size - 1], ' ') AS win FROM spread) d JOIN windows x ON d.size = x.size AND d.win = x.win),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Every pair of documents with a shingle in common, and what links reach by recursion.
OP9_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS place FROM docs WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[place:place + 3], ' ') AS shingle FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


#: Every string of 50 bytes with the least document that has it, and the bytes that such strings cover.
OP4_SQL = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
sized AS (SELECT *, octet_length(body) AS n FROM raw),
bytes AS (SELECT doc_id, n, place, hex(body[place:place]) AS own, CASE WHEN place + 49 <= n THEN body[place:place + 49] END AS string
  FROM (SELECT *, unnest(range(1, n + 1)) AS place FROM sized)),
least_doc AS (SELECT string, min(doc_id) AS first_doc FROM bytes WHERE string IS NOT NULL GROUP BY string HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT doc_id, place, own, coalesce(first_doc < doc_id, false) AS repeated FROM bytes LEFT JOIN least_doc USING (string)),
covered AS (SELECT doc_id, place, own, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY place ROWS 49 PRECEDING) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY place), false) AS begins FROM covered),
found AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(own, '' ORDER BY place) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM sized LEFT JOIN found USING (doc_id)
"""


def _crc32_sql(key: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes: each byte is mixed in, then shifted out bit by bit."""
    bits = f"flatten(list_transform(range(1, octet_length(encode({key})) + 1), lambda i: [('0x' || hex(encode({key})[i:i]))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda c, e: {step}), 4294967295)"


def _op11_sql() -> str:
    """All states' cheapest (cost, audit, text) forward, row by row; of equal costs the least audit."""
    to = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {s}.o || chr(10) || {line}}}"
    gone = lambda s: f"{{'c': {s}.c + 4, 'a': {s}.a || 'D', 'o': {s}.o}}"
    may = lambda test, s, cost, letter, line: f"CASE WHEN NOT must AND {test} THEN {to(s, cost, letter, line)} END"
    kept, rerole = "role || ':' || text", lambda role: f"'{role}:' || text"
    after = {
        "n0": gone("b0"),
        "n1": f"least({gone('b1')}, {may("initial = 's'", 'b0', 'cut', 'K', kept)})",
        "n2": "least(" + ", ".join([gone("b2"), *[may("initial = 'u'", s, "cut", "K", kept) for s in ("b0", "b1", "b3")], *[may("true", s, "3 + cut", "R", rerole("user")) for s in ("b0", "b1", "b3")]]) + ")",
        "n3": f"least({gone('b3')}, {may("initial = 'a'", 'b2', 'cut', 'K', kept)}, {may('true', 'b2', '3 + cut', 'R', rerole('assistant'))})",
    }
    user = "least(n2, " + ", ".join(to(s, 3, "I", "'user:'") for s in ("n0", "n1", "n3")) + ")"
    nothing = lambda cost: f"{{'c': {cost}::BIGINT, 'a': '', 'o': ''}}"
    closed = f"SELECT conv_id, i, n0 AS b0, n1 AS b1, b2, least(n3, {to('b2', 3, 'I', "'assistant:'")}) AS b3 FROM (SELECT *, {user} AS b2 FROM "
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""
WITH RECURSIVE named AS (SELECT *, {key} AS k FROM conversations),
kinds AS (SELECT k, {_crc32_sql("k")} % 20 AS kind FROM (SELECT DISTINCT k FROM named)),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM named JOIN kinds USING (k) WHERE kind <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM damaged),
found AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
rows AS (SELECT *, blank OR again AS must, CASE WHEN open THEN 3 ELSE 0 END AS cut,
  i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS odd FROM found),
totals AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (open AND NOT again AND NOT blank) AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
best AS ({closed} (SELECT DISTINCT conv_id, 0::BIGINT AS i, {nothing(0)} AS n0, {nothing(10**9)} AS n1, {nothing(10**9)} AS n2, {nothing(10**9)} AS n3 FROM conversations) t) u
  UNION ALL {closed} (SELECT conv_id, i, {", ".join(f"{x} AS {name}" for name, x in after.items())}
  FROM (SELECT b.conv_id, r.i, b0, b1, b2, b3, must, cut, initial, role, text FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1) t) v) w)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  least(b0, b3).c AS cost, least(b0, b3).a AS audit, sha256(substr(least(b0, b3).o, 2)) AS repaired_sha256
FROM best b LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(t.n, 0)
"""


OP11_SQL = _op11_sql()


#: Every word without one code point, and with a mark in its place, joined by equality.
OP12_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
own AS (SELECT name, run, count(*) AS n FROM runs GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc32_sql("name || ':' || run")} AS h FROM own),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
placed AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS holed FROM placed),
pairs AS (SELECT c.word AS a, w.word AS b FROM cuts c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT c.word, d.word FROM cuts c JOIN cuts d ON c.holed = d.holed AND c.word <> d.word),
near AS (SELECT a AS word, count(*) AS n_near, min({{'less': -w.n, 'near': b}}) AS best FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.near END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS now FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.now WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.now AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.now AND g.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op9_jaccard_join": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_spelling_variants": OP12_SQL}
