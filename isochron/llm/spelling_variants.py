"""Spelling variants: words of the corpus, the words one edit away from each, and the form that each is a variant of.

Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Two words are near if they differ by
exactly one inserted, deleted or replaced code point. A word's form is its most frequent near word (of equal ones the
first in code-point order), if that has at least `times` its count; its root is what following forms ends at.

Method (reduced-alphabet generation): each letter is hashed to one of SYMBOLS symbols, and of each reduced word the full
one-edit neighbourhood is generated, by numpy on polynomial hashes of its prefixes and suffixes. A pair of reduced words
is found from the one with the lesser hash, so half the neighbourhood is dealt out. An edit leaves either the beginning or
the end of a word as it was, whichever half it isn't in, so a neighbour's key holds the reduced neighbour and the letters
of its untouched half; vocabulary words are keyed by both of their halves. Thus a bucket holds words that share half
their letters, not all words of one reduced form. The join's pairs are verified on the original strings, so that hashes
only propose. Forms at least double the count, so chains are short; roots are found by pointer jumping.

Defined results: null texts have no words; a null doc_id counts as an empty one; repeated rows each count; a word without
near words has n_near 0 and itself as its root; other columns are ignored, whatever their names; an empty table, or one
without frequent words, gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.store import written
from isochron.llm.words import LOWER, ragged, runs, slices, strings, text_bytes

#: Symbols that letters are hashed to.
SYMBOLS = 4

#: Letters of the words whose neighbours are generated at once.
BLOCK = 40_000

#: Longer words aren't reduced: their halves alone are keys, as nothing but near words shares so many letters.
LONG = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)

_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of many strings, place by place; `begun` holds the registers after what stands before them."""
    register = begun.copy()
    for i in np.flatnonzero(lengths > LONG):
        register[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), int(register[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    lengths = np.where(lengths > LONG, 0, lengths)
    order = np.argsort(-lengths, kind="stable")
    left = len(order) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), "right")
    for place, n in enumerate(left):  # the first n in order are longer than place
        own = order[:n]
        now = register[own]
        register[own] = _CRC[(now ^ data[starts[own] + place]) & 0xFF] ^ (now >> 8)
    return register ^ np.uint32(0xFFFFFFFF)


def _registers(names: list[str]) -> np.ndarray:
    """The CRC register after each `<name>:`."""
    raw = [f"{x}:".encode() for x in names]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(x) for x in raw], np.int64)
    starts = np.cumsum(lengths) - lengths
    return _crc32(data, starts, lengths, np.full(len(raw), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)


def damaged_words(column: pa.Array, names: list[str], modulus: int, least: int) -> pa.Array:
    """All words of at least `least` code points of all rows. Let h be the CRC-32 of `<name>:<word>`; where modulus
    divides it, the word's code point number h % length goes first."""
    data, places = text_bytes(column)
    data = LOWER[data]
    mask = _ASCII[data] | (data == 0xC3)
    mask[1:] |= data[:-1] == 0xC3  # U+00C0 to U+00FF are all that begin with this byte
    starts, ends = runs(mask, places)
    row = np.searchsorted(places, starts, "right") - 1
    h = _crc32(data, starts, ends - starts, _registers(names)[row])
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = heads[ends] - heads[starts]
    hit = np.flatnonzero(h % modulus == 0)
    gone = np.searchsorted(heads, heads[starts[hit]] + h[hit].astype(np.int64) % length[hit] + 1) - 1
    keep = mask.copy()
    keep[gone] = False
    two = gone[data[gone] == 0xC3]
    keep[two + 1] = False
    length[hit] -= 1
    kept = np.concatenate([[0], np.cumsum(keep)])
    size = kept[ends] - kept[starts]
    long = length >= least
    return strings(data, _only(keep, starts[long], ends[long]), np.zeros(int(long.sum()), np.int64), size[long])


def _only(keep: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`keep` within the given runs, which don't overlap."""
    step = np.zeros(len(keep) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    return keep & (np.cumsum(step[:-1], dtype=np.int8) > 0)


def word_counts(docs: DataFrame, modulus: int = 97, least: int = 5, times: int = 3) -> DataFrame:
    """(word, n) of words with at least `least` code points and `times` occurrences in all texts."""

    def apply(batches):
        held: list[pa.Table] = []
        for batch in slices(batches, "_text"):
            words = damaged_words(batch.column("_text"), batch.column("_name").to_pylist(), modulus, least)
            own = words.value_counts()
            held.append(pa.table({"word": own.field("values").cast(pa.binary()), "n": own.field("counts")}))
            if sum(t.num_rows for t in held) > 150_000:
                yield from merged(held)
                held = []
        if held:
            yield from merged(held)

    def merged(held):
        table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        yield from pa.table({"word": table["word"].cast(pa.string()), "n": table["n_sum"]}).to_batches()

    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name"), F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(apply, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and where each begins."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return points.astype(np.uint64), np.concatenate([[0], np.cumsum(lengths)])


def _powers(n: int) -> np.ndarray:
    out = [1]
    for _ in range(n):
        out.append(out[-1] * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
    return np.array(out, np.uint64)


class _Word:
    """A block of words: hashes of each prefix and suffix, of the letters and of their symbols, at first + letter."""

    def __init__(self, words: pa.Array):
        points, self.starts = _letters(words)
        self.length = np.diff(self.starts)
        self.number = np.arange(len(words))
        self.first = self.starts[:-1] + self.number  # a place more for each word
        self.powers = _powers(int(self.length.max(initial=0)) + 1)
        letters = _mixed(points)
        self.symbol = (letters >> np.uint64(17)) % np.uint64(SYMBOLS) + np.uint64(1)
        self.prefix, self.suffix = self._hashes(letters)
        self.low, self.high = self._hashes(self.symbol)
        self.reduced = self.low[self.first + self.length]

    def _hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.length.sum()) + len(self.length)
        prefix, suffix = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        for place in range(int(self.length.max(initial=0))):
            own = np.flatnonzero(self.length > place)
            at, begin, end = self.first[own], self.starts[own], self.length[own] - 1 - place
            prefix[at + place + 1] = prefix[at + place] * _BASE + codes[begin + place]
            suffix[at + end] = codes[begin + end] * self.powers[place] + suffix[at + end + 1]
        return prefix, suffix

    def halves(self, which: np.ndarray, length: np.ndarray, second: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
        """Hash of the letters that a neighbour of `length` letters has in one half, where that half is the word's own
        but for a shift."""
        half = length // 2
        return np.where(second, self.suffix[self.first[which] + np.where(second, half - shift, 0)], self.prefix[self.first[which] + np.where(second, 0, half)])


def _key(reduced: np.ndarray | int, part: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The key of a reduced word and the letters of its first half, or its second. 0 for a long word that isn't reduced."""
    return _mixed(np.uint64(reduced) ^ _mixed(part + second.astype(np.uint64) + np.uint64(1)))


def _own_keys(w: _Word) -> tuple[np.ndarray, np.ndarray]:
    """(number of word, key) by which a vocabulary word is found."""
    found = []
    for second in (False, True):
        side = np.full(len(w.number), second)
        part = w.halves(w.number, w.length, side, 0)
        for own, reduced in ((w.length <= LONG + 1, w.reduced), (w.length >= LONG, np.zeros_like(w.reduced))):
            found.append((w.number[own], _key(reduced[own], part[own], side[own])))
    return tuple(np.concatenate(x) for x in zip(*found))


def _neighbour_keys(w: _Word) -> tuple[np.ndarray, np.ndarray]:
    """(number of word, key) of all words that may be near: those of the reduced one-edit neighbourhood, and the word's
    own reduced form, as replaced letters may share their symbol."""
    found = []

    def add(which, place, reduced, length, shift):
        """Neighbours of words `which` with `length` letters, edited at `place`; later letters have moved by `shift`."""
        take = np.flatnonzero(_mixed(reduced) > _mixed(w.reduced[which]))  # each pair of reduced words from one side
        which, length, second = which[take], length[take], place[take] < (length // 2)[take]
        found.append((which, _key(reduced[take], w.halves(which, length, second, shift), second)))

    short, long = np.flatnonzero(w.length <= LONG), np.flatnonzero(w.length > LONG)
    for second in (False, True):
        side = np.full(len(short), second)
        found.append((short, _key(w.reduced[short], w.halves(short, w.length[short], side, 0), side)))
        for shift in (-1, 0, 1):
            side = np.full(len(long), second)
            found.append((long, _key(np.zeros(len(long), np.uint64), w.halves(long, w.length[long] + shift, side, shift), side)))
    size = w.length[short]
    which, place = np.repeat(short, size), ragged(np.zeros(len(short), np.int64), size)
    at, tail = w.first[which] + place, w.length[which] - place - 1
    add(which, place, w.low[at] * w.powers[tail] + w.high[at + 1], w.length[which] - 1, -1)
    own = w.symbol[w.starts[which] + place]
    gaps, holes = np.repeat(short, size + 1), ragged(np.zeros(len(short), np.int64), size + 1)
    before, after = w.first[gaps] + holes, w.length[gaps] - holes
    for s in range(1, SYMBOLS + 1):
        other = np.flatnonzero(own != s)
        add(which[other], place[other], (w.low[at[other]] * _BASE + np.uint64(s)) * w.powers[tail[other]] + w.high[at[other] + 1], w.length[which[other]], 0)
        add(gaps, holes, (w.low[before] * _BASE + np.uint64(s)) * w.powers[after] + w.high[before], w.length[gaps] + 1, 1)
    number, key = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, number))
    number, key = number[order], key[order]
    fresh = np.ones(len(key), bool)  # one neighbour by several edits
    fresh[1:] = (number[1:] != number[:-1]) | (key[1:] != key[:-1])
    return number[fresh], key[fresh]


def _keyed(vocabulary: DataFrame, make) -> DataFrame:
    """(key, word, n) by the keys that `make` gives."""

    def apply(batches):
        for batch in batches:
            ends = np.cumsum(pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
                part, at = batch.slice(at, to - at), to
                number, key = make(_Word(part.column("word")))
                for cut in range(0, len(key), 100_000):
                    rows = pa.array(number[cut : cut + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut : cut + 100_000].view(np.int64)), part.column("word").take(rows), part.column("n").take(rows)], ["key", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(apply, "key long, word string, n long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all pairs of distinct words one edit apart, both ways."""
    other = _keyed(vocabulary, _own_keys).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = _keyed(vocabulary, _neighbour_keys).join(other, "key").filter("word <> near AND levenshtein(word, near, 1) = 1")
    pairs = pairs.select(F.least("word", "near").alias("a"), F.greatest("word", "near").alias("b"), F.when(F.col("word") < F.col("near"), F.col("n")).otherwise(F.col("near_n")).alias("n_a"), F.when(F.col("word") < F.col("near"), F.col("near_n")).otherwise(F.col("n")).alias("n_b"))
    once = pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    return once.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: what following forms ends at. A round doubles the steps that are done."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        now = written(now.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, modulus: int = 97, least: int = 5, times: int = 3, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word. One word in `modulus` (by hash of its document and itself) loses
    a code point first; words have `least` code points and `times` occurrences; a form has `factor` times the count."""
    vocabulary = written(word_counts(docs, modulus, least, times))
    near = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    near = near.select(F.col("word").alias("_word"), "n_near", F.col("best.near").alias("_near"), (-F.col("best.less")).alias("_near_n"))
    own = vocabulary.join(near, F.col("word") == F.col("_word"), "left")
    fits = F.col("_near_n") >= factor * F.col("n")
    own = written(own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("_near")).alias("form"), F.when(fits, F.col("_near_n")).alias("form_n")))
    ends = roots(own.filter("form IS NOT NULL")).withColumnsRenamed({"word": "_word", "root": "_root"})
    return own.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
