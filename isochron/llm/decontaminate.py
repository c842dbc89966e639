"""Benchmark decontamination by winnowing.

A text's fingerprints are those k-gram hashes that are the least of some window of w successive ones, with
k + w - 1 = span: two texts that share `span` words share a whole window, so they share a fingerprint, wherever the
span lies. Items of fewer than `span` words are one window of their own length, and have a k and a w of their own.
The items' fingerprints are joined with the documents'; each hit is extended to the windows around it, which are
compared word by word, so hash collisions can't mark anything. Words are numbers in the items' vocabulary; a word
that no item has ends every window.

The test set is held by each task in blocks of at most `block_words` words. While one block holds it, it is
broadcast, and one pass over the documents gives the result. A larger test set takes a pass for each block over
documents numbered once, and the hits of a document's passes are merged; nothing is left out.

Defined results: a null or empty text has no words and no hits; an item without words hits nothing; an item with a
null id marks words, but has no id to list; items with the same id count once; repeated doc_ids keep a row each;
an empty table of items leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.store import written
from isochron.llm.words import ALNUM, LOWER, runs, slices, split_words, text_bytes

#: Odd multipliers of the k-gram hash.
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shape(span: int) -> tuple[int, int]:
    """k and w with k + w - 1 = span."""
    k = span // 2 if span > 1 else 1
    return k, span - k + 1


def gram_hashes(ids: np.ndarray, row_end: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; the greatest number where the row ends before, or a word is -1."""
    n = len(ids)
    out = np.full(n, _NONE, np.uint64)
    if n < k:
        return out
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_P)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(_Q)
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = h * np.uint64(_P) + mixed[i : n - k + 1 + i]
        h ^= h >> np.uint64(32)
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    good = (np.arange(n - k + 1) + k <= row_end[: n - k + 1]) & (unknown[k:] == unknown[: n - k + 1])
    out[: n - k + 1] = np.where(good & (h != _NONE), h, np.where(good, _NONE - np.uint64(1), _NONE))
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of a window of w that holds it (each of them, where several tie)."""
    n = len(hashes)
    padded = np.concatenate([np.full(w - 1, _NONE, np.uint64), hashes, np.full(w - 1, _NONE, np.uint64)])
    least = padded[: n + w - 1].copy()  # of the window that ends w - 1 after each place of `padded`
    for i in range(1, w):
        np.minimum(least, padded[i : i + n + w - 1], out=least)
    most = least[:n].copy()
    for i in range(1, w):
        np.maximum(most, least[i : i + n], out=most)
    return np.flatnonzero((hashes == most) & (hashes != _NONE))


class Block:
    """Items of a test set, ready to be matched."""

    def __init__(self, ids: list[str | None], texts: list[str | None], span: int):
        data, places = text_bytes(pa.array(texts, pa.large_string()))
        words, _, _, first = split_words(LOWER[data], places, ALNUM)
        self.ids, self.vocabulary = ids, words.unique()
        code = pc.index_in(words, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.diff(first)
        self.classes = []
        for length in sorted({min(span, x) for x in n.tolist() if x}):
            k, w = shape(length)
            rows = np.flatnonzero((n == length) if length < span else (n >= span))
            spans = np.concatenate([np.arange(first[r], first[r + 1] - length + 1) for r in rows])
            owner = np.repeat(rows, n[rows] - length + 1)
            windows, which = np.unique(code[spans[:, None] + np.arange(length)], axis=0, return_inverse=True)
            which = which.reshape(-1)
            pairs = np.unique(np.stack([which, owner], 1), axis=0)
            sums = _window_hash(windows)
            order = np.argsort(sums, kind="stable")
            own_end = np.repeat(first[1:], n)
            keep = np.isin(np.repeat(np.arange(len(n)), n), rows)
            grams = gram_hashes(np.where(keep, code, -1), own_end, k)
            self.classes.append((length, k, w, np.unique(grams[winnow(grams, w)]), windows[order], sums[order], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1], order))

    def hits(self, words: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word, whether it is hit; and each (row, item) with a window that occurs."""
        code = pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.diff(first)
        end = np.repeat(first[1:], n)
        row = np.repeat(np.arange(len(n)), n)
        change, rows, items = np.zeros(len(code) + 1, np.int64), [], []
        for length, k, w, fingerprints, windows, sums, pair_first, pair_item, order in self.classes:
            grams = gram_hashes(code, end, k)
            at = winnow(grams, w)
            at = at[np.isin(grams[at], fingerprints)]
            if not len(at):
                continue
            starts = np.unique(at[:, None] - np.arange(w))
            starts = starts[(starts >= 0) & (starts + length <= len(code))]
            starts = starts[(starts + length <= end[starts])]
            if not len(starts):
                continue
            own = code[starts[:, None] + np.arange(length)]
            hashed = _window_hash(own)
            found = np.full(len(starts), -1)
            near = np.searchsorted(sums, hashed)
            while True:  # windows of one hash follow each other
                open_ = np.flatnonzero((found < 0) & (near < len(sums)))
                open_ = open_[sums[near[open_]] == hashed[open_]]
                if not len(open_):
                    break
                same = (windows[near[open_]] == own[open_]).all(1)
                found[open_[same]] = near[open_[same]]
                near[open_[~same]] += 1
            starts, found = starts[found >= 0], found[found >= 0]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
            each = np.unique(np.stack([row[starts], order[found]], 1), axis=0)
            many = pair_first[each[:, 1] + 1] - pair_first[each[:, 1]]
            rows.append(np.repeat(each[:, 0], many))
            items.append(np.concatenate([pair_item[pair_first[x] : pair_first[x + 1]] for x in each[:, 1]]) if len(each) else np.zeros(0, np.int64))
        both = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], 1), axis=0) if rows else np.zeros((0, 2), np.int64)
        return np.cumsum(change[:-1]) > 0, both[:, 0], both[:, 1]


def _window_hash(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(windows.shape[1]):
            h = (h ^ windows[:, i].astype(np.uint64)) * np.uint64(_P)
            h ^= h >> np.uint64(31)
    return h


def _blocks(items: DataFrame, block_words: int):
    """(id, text) of the items, in blocks of about so many words at most; one block is on the driver at a time."""
    held, words = [], 0
    for r in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        held.append((r[0], r[1]))
        words += (len(r[1] or "") + 1) // 2
        if words >= block_words:
            yield held
            held, words = [], 0
    if held:
        yield held


def hits(docs: DataFrame, items: DataFrame, span: int = 10, block_words: int = 4_000_000) -> DataFrame:
    """doc_id, n_words, spans (starts and lengths of runs of hit words), item_ids (distinct, sorted as strings)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "n_words long, spans array<struct<start:long,length:long>>, item_ids array<string>"

    def scan(source: DataFrame, block: list, keys: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def match(batches):
            own = Block([x for x, _ in shared.value], [x for _, x in shared.value], span)
            names = np.array([x or "" for x in own.ids], object)
            named = np.array([x is not None for x in own.ids], bool)
            for batch in slices(batches):
                data, places = text_bytes(batch.column("text"))
                words, _, _, first = split_words(LOWER[data], places, ALNUM)
                hit, rows, found = own.hits(words, first)
                runs_at, runs_to = runs(hit, first)
                of = np.searchsorted(runs_at, first)
                begun = np.repeat(first[:-1], np.diff(of))
                spans = pa.StructArray.from_arrays([pa.array(runs_at - begun), pa.array(runs_to - runs_at)], ["start", "length"])
                keep = named[found]
                rows, found = rows[keep], found[keep]
                lists: list[list[str]] = [[] for _ in range(batch.num_rows)]
                for r, x in zip(rows.tolist(), names[found].tolist()):
                    lists[r].append(x)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keys), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(of, pa.int32()), spans), pa.array([sorted(set(x)) for x in lists], pa.list_(pa.string()))],
                    [*keys, "n_words", "spans", "item_ids"],
                )

        return source.mapInArrow(match, ", ".join(f"{k} long" for k in keys) + ", " + kinds)

    blocks = _blocks(items, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return scan(docs, first, ["doc_id"])
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    out = scan(numbered, first, ["_row", "doc_id"])
    while second is not None:
        out = out.unionByName(scan(numbered, second, ["_row", "doc_id"]).filter(F.size("spans") > 0))
        second = next(blocks, None)
    merged = out.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    joined = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start:long,length:long>>"),
        lambda done, x: F.when((F.size(done) > 0) & (x.start <= F.element_at(done, -1).start + F.element_at(done, -1).length), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1).start.alias("start"), F.greatest(F.element_at(done, -1).length, x.start + x.length - F.element_at(done, -1).start).alias("length"))))).otherwise(F.concat(done, F.array(x))),
    )
    return merged.select("doc_id", "n_words", joined.alias("spans"), "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, block_words: int = 4_000_000) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.length)
    return hits(docs, items, span, block_words).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans"
    )
