"""Token ids of whole texts, with each distinct stretch of text encoded once per worker."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from isochron.llm.words import LOWER, SPACE, held, ragged, strings, text_bytes

#: Distinct stretches in a generation of a worker's memory; it remembers two.
CACHE = 300_000

#: Bytes of text that are encoded at once.
SLICE = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK &= ~_LETTER
_MARK[0x30:0x3A] = False
_LATIN = np.zeros(256, bool)  # after 0xC3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False

#: Stretches that are one word to the pre-tokenizers: none of their patterns cuts these.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

#: The characters by which byte-level models name bytes; a new line stays.
_BYTES = np.arange(256, dtype="<u2")
_UNSHOWN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTES[_UNSHOWN] = 256 + np.arange(len(_UNSHOWN))
_BYTES[0x0A] = 0x0A


def _special(data: np.ndarray) -> bool:
    """Whether a special token's name may stand in it."""
    return bool(((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any())


def _parts(data: np.ndarray, places: np.ndarray, drops_space: bool) -> tuple[pa.Array, np.ndarray]:
    """Stretches of text that encode alone as they do in the whole text, and where each row's begin.

    Pre-tokenizers of this kind never join an ASCII or Latin-1 letter with an ASCII mark after it, nor a character
    with white space after it, so the text is cut there: before white space that follows a printable ASCII character
    or a Latin-1 letter, or around white space where the tokenizer drops it anyway. A single white space other than
    a blank isn't joined with what is shown after it either. Special tokens' names hold marks and letters; where one
    may stand, only white space cuts.
    """
    n = len(data)
    if drops_space:
        mask = ~SPACE[data]
    else:
        mask = np.ones(n, bool)
    before = np.zeros(n + 1, bool)  # a stretch begins here
    before[places] = True
    if n:
        last, this = data[:-1], data[1:]
        safe = (last > 0x20) & (last < 0x7F)
        safe[1:] |= (data[:-2] == 0xC3) & (last[1:] >= 0x80)
        before[1:n] |= SPACE[this] & safe
        if drops_space:
            before[1:n] |= SPACE[last]
        else:
            before[1:n] |= before[: n - 1] & SPACE[last] & (last != 0x20) & ((this > 0x20) & (this < 0x7F) | (this == 0xC3))
        if not _special(data):
            letter = _LETTER[last]
            letter[1:] |= (data[:-2] == 0xC3) & _LATIN[last[1:]]
            before[1:n] |= letter & _MARK[this]
    starts = np.flatnonzero(before[:n] & mask)
    if drops_space:
        before[1:n] |= ~mask[1:]
    ends = np.flatnonzero(before[1:] & mask)
    return strings(data, mask, starts, ends + 1), np.searchsorted(starts, places)


class Encoder:
    """drops_space: the tokenizer removes white space and lower-cases. cache: see CACHE."""

    def __init__(self, path: str, drops_space: bool, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores; threads here would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space, self.cache = drops_space, cache
        self.known: dict[str, int] = {}
        self._forget()
        tried = ["a", " b", "word", " Word", "\u00c9t\u00e9", " stra\u00dfe\u00ff", "the", " internationalization", "\u00c0\u00d6\u00d8\u00de", " xq\u00fcz"]
        tried = [x.strip() for x in tried] if drops_space else tried
        self.direct = self._words(tried) == [x.ids for x in self.tokenizer.encode_batch_fast(tried, add_special_tokens=False)]

    def _forget(self) -> None:
        """A new generation. The one before stays until the next, and what is met again moves on from it, so that
        common stretches are never encoded twice and rare ones go."""
        self.old = (self.known, self.flat, self.first) if self.known else None
        self.known = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _remember(self, parts: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.first) - 1, len(self.first) - 1 + len(parts))))
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])

    def _distinct(self, parts: list[str]) -> np.ndarray:
        """Each part's number: ids flat[first[number]:first[number + 1]]."""
        if len(self.known) > self.cache:
            self._forget()
        new = [x for x in parts if x not in self.known]
        if new and self.old:
            known, flat, first = self.old
            again = [x for x in new if x in known]
            at = np.fromiter(map(known.__getitem__, again), np.int64, len(again))
            lengths = first[at + 1] - first[at]
            self._remember(again, flat[ragged(first[at], lengths)], lengths)
            new = [x for x in new if x not in known]
        if new:
            self._remember(new, *self._each(new))
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _words(self, words: list[str]) -> list[list[int]]:
        """Each word's ids from the tokenizer's model, as normalizer and pre-tokenizer leave it whole."""
        text = "\n".join(words)
        text = _BYTES[np.frombuffer((text.lower() if self.drops_space else text).encode(), np.uint8)].tobytes().decode("utf-16-le")
        model = self.tokenizer.model
        return [[x.id for x in model.tokenize(word)] for word in text.split("\n")]

    def _each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The parts' ids, and how many each has: words by the model, the rest by the whole tokenizer."""
        word = np.fromiter((self.direct and _WORD.fullmatch(x) is not None for x in parts), bool, len(parts))
        flats, lengths = [], np.zeros(len(parts), np.int64)
        for own, encode in ((np.flatnonzero(word), self._words), (np.flatnonzero(~word), self._others)):
            if len(own):
                ids = encode([parts[i] for i in own.tolist()])
                lengths[own] = np.fromiter(map(len, ids), np.int64, len(ids))
                flats.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        flat, starts = np.concatenate(flats), np.empty(len(parts), np.int64)
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return flat[ragged(starts, lengths)], lengths

    def _others(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each row's followed by end_id, and where each row's ids begin."""
        data, places = text_bytes(column)
        parts, first = _parts(LOWER[data] if self.drops_space and not _special(data) else data, places, self.drops_space)
        coded = parts.dictionary_encode()
        try:
            distinct = coded.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        except pa.ArrowInvalid:  # not UTF-8
            distinct = [x.decode("utf-8", "replace") for x in coded.dictionary.to_pylist()]
        which = self._distinct(distinct)[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.first[which + 1] - self.first[which]
        done = np.concatenate([[0], np.cumsum(each)])
        starts = done[first] + np.arange(len(places))  # an end id follows each row
        out = np.empty(starts[-1], np.uint32)
        out[starts[1:] - 1] = end_id
        keep = np.ones(len(out), bool)
        keep[starts[1:] - 1] = False
        out[keep] = self.flat[ragged(self.first[which], each)]
        return out, starts


def encoder(path: str, drops_space: bool, cache: int = CACHE) -> Encoder:
    """One for each worker process, as long as it tokenises."""
    return held(owner(path, drops_space, cache), lambda: Encoder(path, drops_space, cache))


def owner(path: str, drops_space: bool, cache: int = CACHE) -> tuple:
    return "tokens", path, drops_space, cache
