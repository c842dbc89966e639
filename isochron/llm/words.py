"""Words, lines and slices of Arrow text columns by numpy on UTF-8 bytes; exact, with no loop over rows or words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


_HELD: dict = {}


def held(owner: tuple, make):
    """What a worker keeps between the tasks of one operator; it goes when the worker turns to another."""
    if owner not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[owner] = make()
    return _HELD[owner]


def give_back() -> None:
    """Hands freed memory back to the system, as a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str | tuple[str, ...] = "text", most: int = SLICE_BYTES, owner: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most `most` bytes of text (or of several columns), or one row."""
    columns = (column,) if isinstance(column, str) else column
    if owner not in _HELD:
        _HELD.clear()
        give_back()
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends = sizes.cumsum()
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and each row's place among them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[places[0] : places[-1]], places - places[0]


def runs(mask: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; a run ends with its row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(mask) + 1, bool)
    first[places] = True
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    return starts, np.flatnonzero(mask & (~after | first[1:])) + 1


def strings(data: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of `mask` as an Arrow column."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[mask]))])


def split_words(data: np.ndarray, places: np.ndarray, is_word: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows; their starts and ends; and where each row's words begin among them."""
    mask = is_word[data]
    starts, ends = runs(mask, places)
    return strings(data, mask, starts, ends), starts, ends, np.searchsorted(starts, places)


def word_ids(words: pa.Array) -> tuple[np.ndarray, int]:
    """Equal words have equal ids within this column, others don't."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of each run."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)
