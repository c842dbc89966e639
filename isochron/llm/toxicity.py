"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and word beginnings of 4 to 6 characters, that toxic labelled texts have far more
often than others. The features of a whole text are rates, so its length doesn't matter: how dense lexicon words,
beginnings and disguised lexicon words are and the share of the strongest, how often they stand near a word of the
second person, capitals, exclamation and other marks, and words that mix letters with digits or marks. Trees and
lexicon are fitted on a bounded sample of the labelled rows (`sample` at most), picked by hash; a part of it that the
trees don't see fits the isotonic calibration.

Defined results: a null or empty text has all features 0 and gets the score of that; labels with a null mark aren't
learned from, and a text with several labels counts once for each; documents with a null doc_id are scored, not
learned from, and not held out; without labels of both classes each score is the learned share of toxic labels (0
without labels); repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.llm.store import written
from isochron.llm.words import ALNUM, LOWER, SPACE, runs, slices, split_words, strings, text_bytes

#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros os su sus".split()

#: Marks and digits that stand for letters.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

#: Words on either side within which a second-person word is near.
NEAR = 5

FEATURES = ("words", "lexicon", "beginnings", "disguised", "strongest", "weight", "near_you", "you", "capitals", "capital_words", "exclamations", "marks", "mixed", "digits", "repeated_letters")

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[0x30:0x3A] = _MARK[0x41:0x5B] = _MARK[0x61:0x7B] = False
_PLAIN = LOWER.copy()
for _mark, _letter in DISGUISE.items():
    _PLAIN[ord(_mark)] = ord(_letter)


def held_out(fold: int = 0, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def _starts(words: pa.Array, n: int) -> pa.Array:
    """The first n characters of each word; null where it has no more."""
    text = words.cast(pa.large_string(), safe=False)
    return pc.if_else(pc.greater(pc.utf8_length(text), n), pc.utf8_slice_codeunits(text, 0, n), pa.scalar(None, pa.large_string()))


def learn_lexicon(labelled: DataFrame, least: int = 5, most: int = 4000) -> dict[str, float]:
    """Words, and beginnings marked by a final `*`, with the log ratio of their shares of toxic and other texts."""

    def terms(batches):
        for batch in slices(batches):
            data, places = text_bytes(batch.column("text"))
            words, _, _, first = split_words(LOWER[data], places, ALNUM)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            words = words.cast(pa.large_string(), safe=False)
            for column in (words, *(pc.binary_join_element_wise(_starts(words, n), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string())) for n in (4, 5, 6))):
                coded = column.dictionary_encode()
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = max(1, len(coded.dictionary))
                both = np.unique(row[code >= 0] * n + code[code >= 0])  # a text counts once
                bad = np.bincount(both[toxic[both // n] == 1] % n, minlength=n)
                good = np.bincount(both[toxic[both // n] != 1] % n, minlength=n)
                keep = np.flatnonzero(bad if wanted is None else pc.is_in(coded.dictionary, value_set=wanted.value).to_numpy(zero_copy_only=False))
                if len(coded.dictionary) and len(keep):
                    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(keep)).cast(pa.string()), pa.array(bad[keep]), pa.array(good[keep])], ["term", "bad", "good"])

    kind = "term string, bad long, good long"
    sizes = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    wanted = None
    often = labelled.filter("toxic = 1").mapInArrow(terms, kind).groupBy("term").agg(F.sum("bad").alias("bad")).filter(F.col("bad") >= least)
    often = [r.term for r in often.orderBy(F.desc("bad"), "term").limit(10 * most).collect()]  # of a bounded sample
    wanted = labelled.sparkSession.sparkContext.broadcast(pa.array(often, pa.large_string()))
    counted = labelled.mapInArrow(terms, kind).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    out = {r.term: math.log((r.bad + 0.1) / (sizes.get(1, 0) + 1)) - math.log((r.good + 0.1) / (sizes.get(0, 0) + 1)) for r in counted}
    return dict(sorted(((t, w) for t, w in out.items() if w > 1.5), key=lambda x: (-x[1], x[0]))[:most])


def features(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """Columns `keep` and an array of the features of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # `most` entries

    def measure(batches):
        whole = {t: w for t, w in shared.value.items() if not t.endswith("*")}
        begun = {t[:-1]: w for t, w in shared.value.items() if t.endswith("*")}
        terms, weights = pa.array(list(whole), pa.large_string()), np.array([*whole.values(), 0.0])
        begins, begin_weights = pa.array(list(begun), pa.large_string()), np.array([*begun.values(), 0.0])
        you = pa.array(SECOND_PERSON, pa.large_string())
        find = lambda column, among: pc.index_in(column, among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        for batch in slices(batches, "_text"):
            data, places = text_bytes(batch.column("_text"))
            rows = batch.num_rows
            lower = LOWER[data]
            words, starts, _, first = split_words(lower, places, ALNUM)
            words = words.cast(pa.large_string(), safe=False)
            n = np.diff(first)
            row = np.repeat(np.arange(rows), n)
            per_row = lambda mask: np.bincount(row[mask], minlength=rows)
            hit = find(words, terms)
            stem = np.full(len(hit), -1)
            for length in (4, 5, 6):
                got = find(_starts(words, length), begins)
                stem = np.where(got >= 0, got, stem)
            weight = np.maximum(weights[hit], begin_weights[stem])
            bad = (hit >= 0) | (stem >= 0)
            is_you = find(words, you) >= 0
            done = np.concatenate([[0], np.cumsum(is_you)])
            at = np.flatnonzero(bad)
            near = done[np.minimum(at + NEAR + 1, first[1:][row[at]])] > done[np.maximum(at - NEAR, first[:-1][row[at]])]
            strongest = np.zeros(rows)
            np.maximum.at(strongest, row, weight)
            # words as written, for disguises and capitals
            mask = ~SPACE[data]
            a, b = runs(mask, places)
            raw_row = np.searchsorted(places, a, "right") - 1
            sums = lambda table: (lambda d: d[b] - d[a])(np.concatenate([[0], np.cumsum(table[data])]))
            letters, digits, marks, upper = sums(ALNUM[LOWER] & ~_DIGIT), sums(_DIGIT), sums(_MARK), sums(_UPPER)
            mixed = (letters >= 2) & (digits + marks > 0)
            plain = _PLAIN[data]
            inner = ALNUM[plain]
            pa_, pb = runs(inner, places)
            disguised = find(strings(plain, inner, pa_, pb).cast(pa.large_string(), safe=False), terms) >= 0
            odd = np.concatenate([[0], np.cumsum(_DIGIT[data] | (_MARK[data] & inner))])
            disguised &= odd[pb] > odd[pa_]
            disguise_row = np.searchsorted(places, pa_, "right") - 1
            triple = np.zeros(len(data), bool)
            triple[2:] = (lower[2:] == lower[1:-1]) & (lower[2:] == lower[:-2]) & ALNUM[lower[2:]]
            in_row = lambda table: (lambda d: d[places[1:]] - d[places[:-1]])(np.concatenate([[0], np.cumsum(table)]))
            size, length = np.maximum(n, 1), np.maximum(np.diff(places), 1)
            columns = [
                np.log1p(n), per_row(hit >= 0) / size, per_row(bad) / size, np.bincount(disguise_row[disguised], minlength=rows) / size, strongest,
                np.bincount(row, weight, rows) / size, np.bincount(row[at][near], minlength=rows) / size, per_row(is_you) / size, in_row(_UPPER[data]) / length,
                np.bincount(raw_row[(upper >= 2) & (upper == letters)], minlength=rows) / size, in_row(data == 0x21) / length, in_row(_MARK[data]) / length,
                np.bincount(raw_row[mixed], minlength=rows) / size, in_row(_DIGIT[data]) / length, in_row(triple) / length,
            ]
            flat = pa.array(np.stack(columns, 1).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), lists], [*keep, "features"])

    schema = docs.select(*keep).schema.add("features", T.ArrayType(T.DoubleType()))
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(measure, schema)


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted for each document; labels of held-out documents aren't looked at."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(fold, folds))
    n = labels.count()
    picked = written(labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < min(1_000_000, -(-sample * 1_000_000 // max(1, n)))))
    seen = written(docs.join(picked, "doc_id"))
    sizes = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = float(sizes.get(1, 0) > 0)
        return docs.select("doc_id", held_out(fold, folds).alias("held_out"), F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    lexicon = learn_lexicon(seen.filter(F.col("toxic").isNotNull()))
    vectors = written(features(seen, lexicon, ["doc_id", "toxic"])).select("doc_id", F.col("toxic").cast("double").alias("toxic"), array_to_vector("features").alias("vector"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4))
    trees = GBTClassifier(featuresCol="vector", labelCol="toxic", maxIter=10, maxDepth=3, stepSize=0.3, seed=7).fit(vectors.filter(part != 0))
    p = vector_to_array("probability")[1]
    rest = trees.transform(vectors.filter(part == 0)).select(p.alias("p"), "toxic")
    rest = rest if not rest.isEmpty() else trees.transform(vectors).select(p.alias("p"), "toxic")
    curve = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="score").fit(rest)
    scored = trees.transform(features(docs, lexicon, ["doc_id"]).select("doc_id", array_to_vector("features").alias("vector"))).select("doc_id", p.alias("p"))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    # a step of the calibration holds many texts; within it the trees' own order breaks ties
    score = F.when(F.col("score").between(0.0, 1.0), 0.999 * score + 0.001 * F.col("p")).otherwise(score)
    return curve.transform(scored).select("doc_id", held_out(fold, folds).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
