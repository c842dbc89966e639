"""Quality rules with adaptive thresholds from mergeable quantile sketches, per language and source.

Each text's counts come from one pass over its bytes. A feature's sketch is a histogram over buckets of bounded
relative error (a power of two and SUB steps within it), so sketches merge by adding their counts, whatever the
order, and the result is the same on every run. Each (lang, source) gets fences from a low quantile, the median and a
high one of its sketch: the high fence is the high quantile plus `reach` times its distance from the median, the low
fence likewise. A group's quantiles are blended by count with those of its language, which weigh as much as `least`
documents, and a language's likewise with those of all documents. Where the blended high quantile equals the median
(no such spread at any level), the feature's floor is the distance of the high fence from it. The fences are joined
back to the documents, which are kept when all their features lie within.

Defined results: a null or empty text has no words and fails the base rules; a null lang or source is a group of its
own; repeated rows each get their row and each count in the sketches; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochron.llm.store import written
from isochron.llm.words import SPACE, runs, slices, split_words, strings, text_bytes, word_ids

#: Words of a window whose repetition counts.
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Steps within a power of two: a bucket is at most 1/SUB of its value wide.
SUB = 32

#: Features in whole per-milles; the low and high quantiles of their fences; the floor where the high one is the median.
#: Symbols have the upper quartile, as what lies above it can be all junk (a tenth of some groups).
FEATURES = {
    "word_length": (lambda: F.expr("word_chars * 1000 div greatest(n_words, 1L)"), 0.1, 0.9, 1000),
    "symbols": (lambda: F.expr("n_symbols * 1000 div greatest(n_words, 1L)"), 0.0, 0.75, 100),
    "dup_lines": (lambda: F.expr("n_dup_lines * 1000 div greatest(n_words, 1L)"), 0.0, 0.99, 50),
    "repeats": (lambda: F.expr("n_repeat_words * 1000 div greatest(n_words, 1L)"), 0.0, 0.99, 250),
}

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(places: np.ndarray, mask: np.ndarray) -> np.ndarray:
    done = np.concatenate([[0], np.cumsum(mask)])
    return done[places[1:]] - done[places[:-1]]


def _repeats(ids: np.ndarray, distinct: int, first: np.ndarray) -> np.ndarray:
    """For each row, its words in windows of WINDOW words that stand in the row twice or more."""
    n, rows = len(ids), len(first) - 1
    if n < WINDOW:
        return np.zeros(rows, np.int64)
    ranks, length = ids, distinct
    for step in (1, 2, 4):  # equal ranks: equal runs of twice as many words
        ranks = ranks[:-step] * length + ranks[step:]
        ranks, seen = pd.factorize(ranks)
        length = len(seen)
    row = np.repeat(np.arange(rows), np.diff(first))
    whole = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    keys, _ = pd.factorize(ranks[whole] * rows + row[whole])
    twice = whole[(np.bincount(keys) > 1)[keys]] if len(keys) else whole
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    return _per_row(first, np.cumsum(change[:-1]) > 0)


def _dup_lines(data: np.ndarray, places: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """For each row, its lines with a word that equal an earlier line of the row."""
    rows = len(places) - 1
    inside = data != 0x0A
    starts, ends = runs(inside, places)  # an empty line has no word
    lines = strings(data, inside, starts, ends)
    with_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    row = np.searchsorted(places, starts, "right") - 1
    code, distinct = word_ids(lines)
    row, code = row[with_word], code[with_word]
    keys, seen = pd.factorize(row * distinct + code)
    own = np.bincount(np.asarray(seen, np.int64) // distinct, minlength=rows) if len(keys) else np.zeros(rows, np.int64)
    return np.bincount(row, minlength=rows) - own


def counts(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    data, places = text_bytes(column)
    words, starts, _, first = split_words(data, places, ~SPACE)
    ids, distinct = word_ids(words)
    chars = ~SPACE[data] & ((data & 0xC0) != 0x80)
    return [np.diff(first), _per_row(places, chars), _per_row(places, _SYMBOL[data]), _dup_lines(data, places, starts), _repeats(ids, distinct, first)]


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` with the counts of the whole text, and base_failed."""

    def apply(batches):
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x, pa.int64()) for x in counts(batch.column("_text")))], [*keep, *_COUNTS])

    schema = docs.select(*keep).schema
    for c in _COUNTS:
        schema = schema.add(c, "long")
    out = docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(apply, schema)
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n, over the documents that pass the base rules. A value below 2 * SUB is its own
    bucket; from there each power of two has SUB."""
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), value().alias("value")) for name, (value, *_) in FEATURES.items()])).alias("x")
    rows = measured.filter("NOT base_failed").select("lang", "source", long).select("lang", "source", "x.*")
    bits = len(f"{SUB:b}")
    power = F.expr(f"greatest(length(bin(value)) - {bits}, 0)")
    rows = rows.withColumn("power", power).withColumn("bucket", F.expr("shiftright(value, power)") + F.col("power") * SUB)
    return rows.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def _low(bucket: Column) -> Column:
    """Least value of a bucket."""
    power = F.when(bucket < 2 * SUB, 0).otherwise((bucket / SUB).cast("int") - 1)
    return F.call_function("shiftleft", (bucket - power * SUB).cast("long"), power)


def fences(sketch: DataFrame, least: int = 200, reach: float = 3.0) -> DataFrame:
    """lang, source, feature, low, high for each group; coarser groups' sketches are sums of finer ones'."""

    def constant(i: int) -> Column:
        return F.create_map(*[x for name, row in FEATURES.items() for x in (F.lit(name), F.lit(float(row[i])))])[F.col("feature")]

    def quantiles(keys: list[str]) -> DataFrame:
        own = Window.partitionBy(*keys, "feature")
        merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
        rows = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("all", F.sum("n").over(own))
        at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), _low(F.col("bucket"))))
        rows = rows.withColumn("low_at", constant(1)).withColumn("high_at", constant(2))
        return rows.groupBy(*keys, "feature").agg(F.max("all").alias("n"), at(F.col("low_at")).alias("low"), at(F.lit(0.5)).alias("mid"), at(F.col("high_at")).alias("high"))

    groups = sketch.select("lang", "source", "feature").distinct()
    levels = [quantiles(keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("feature").alias("_f"), F.struct("n", "low", "mid", "high").alias(f"level{i}")) for i, keys in enumerate((["lang", "source"], ["lang"], []))]
    out = groups
    for i, (level, keys) in enumerate(zip(levels, (["lang", "source"], ["lang"], []))):
        on = F.col("feature") == F.col("_f")
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(level, on, "left").select(*groups.columns, *[f"level{j}" for j in range(i + 1)])

    def blended(i: int, q: str) -> Column:
        own, n = F.col(f"level{i}.{q}"), F.col(f"level{i}.n")
        return own.cast("double") if i == 2 else (n * own + least * blended(i + 1, q)) / (n + least)

    out = out.select("lang", "source", "feature", *[blended(0, q).alias(q) for q in ("low", "mid", "high")], constant(3).alias("floor"))
    above, below = F.col("high") - F.col("mid"), F.col("mid") - F.col("low")
    high = F.when(above > 0, F.col("high") + reach * above).otherwise(F.col("mid") + F.col("floor"))
    low = F.when(below > 0, F.col("low") - reach * below).otherwise(F.col("mid") - F.col("floor"))
    return out.select("lang", "source", "feature", low.alias("low"), high.alias("high"))


def quality(docs: DataFrame, keep: list[str], least: int = 200, reach: float = 3.0, broadcast_groups: int = 20_000) -> DataFrame:
    """Columns `keep` with the counts, base_failed and kept. The fences are broadcast while there are at most
    `broadcast_groups` groups; beyond that Spark joins them by group, splitting groups that are too large."""
    extra = [c for c in ("lang", "source") if c not in keep]
    measured = written(measure(docs, [*keep, *extra]))
    width = {name: [F.min(F.when(F.col("feature") == name, F.col(x))).alias(f"{name}_{x}") for x in ("low", "high")] for name in FEATURES}
    limits = written(fences(sketches(measured), least, reach).groupBy("lang", "source").agg(*[x for pair in width.values() for x in pair]))
    if limits.count() <= broadcast_groups:
        limits = F.broadcast(limits)
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = ~F.col("base_failed")
    for name, (value, *_) in FEATURES.items():
        within &= F.coalesce(value().between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(False))
    return out.select(*keep, *_COUNTS, "base_failed", within.alias("kept"))
