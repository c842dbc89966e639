"""Repeated-passage removal by column-wise suffix sorting of many documents at once.

A byte goes when it lies in a string of `span` bytes that also starts in a document with a smaller doc_id. Equal
strings are found in three steps.

1. Anchors. In each document those K-grams are anchors whose hash is the least of a window of span - K + 1 successive
   ones, so each string of `span` bytes holds an anchor, and equal strings hold the same one at the same place.
   Anchors are dealt by hash; those in two documents or more are candidates. (A task sends an anchor once, with its
   least doc_id, and settles by itself that its own documents share it, so a common passage can't fill a bucket.)
2. Pieces. Around each candidate a document gives the bytes of the strings whose least hash it is. Of equal pieces
   in a task only the one of the least doc_id goes on: in the others every string is a repeat already.
3. Columns. A task holds all pieces of its anchors, lined up at the anchor, as columns in an external file, and goes
   through them from the last to the first: each round inserts one symbol of each piece, which moves the pieces'
   order (their suffixes from this column on, sorted: a stable sort by the new symbol, as the rest is sorted already;
   the symbols in that order are the column's part of the collection's Burrows-Wheeler transform) and their common
   prefixes with the piece before (one more than the least common prefix between the two in the last round, where
   the symbols agree). Order and prefixes of a round come from one sequential read and are written in turn. Runs with
   common prefixes of `span` or more are equal strings; all but those of a run's least doc_id are repeats.

As the pieces are lined up, suffixes need be compared within their column only, so the transform is kept by column
rather than merged into one; a round costs as much as there are pieces, not as much as all text inserted so far.

Defined results: null text is empty; documents with a null doc_id lose nothing and take nothing from others; rows
with the same doc_id aren't compared with each other, and each gets its row; texts under `span` bytes stay whole;
an empty table gives no rows; other columns pass unread.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.llm.store import written
from isochron.llm.words import SPACE, ragged, runs, slices, text_bytes

#: Bytes of an anchor: 2, 4, 8, 16 ...
K = 16

#: Anchors, or bytes of pieces, that a task deals at once.
FLUSH_ANCHORS, FLUSH_BYTES = 1_000_000, 12 << 20

#: Bytes of text that are hashed at once.
TEXT_BYTES = 1 << 20

#: Marks a column outside the document; no UTF-8 text has this byte.
OUTSIDE = 0xFF

#: Space and ASCII punctuation, which a passage of words neither begins nor ends with.
_LOOSE = SPACE.copy()
_LOOSE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _P)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the K bytes from each place on, by doubling."""
    h, n = _BYTE[data], 1
    with np.errstate(over="ignore"):
        while n < K:
            h = h[: max(0, len(h) - n)] * (_P + np.uint64(2 * n)) + h[n:]
            n *= 2
    return _mix(h)


def _sliding(values: np.ndarray, w: int, least) -> np.ndarray:
    """least(values[i], ..., values[i + w - 1]) for each i."""
    out, n = values, 1
    while 2 * n <= w:
        out = least(out[: len(out) - n], out[n:])
        n *= 2
    return least(out[: len(out) - (w - n)], out[w - n :]) if w > n else out


def anchors(data: np.ndarray, places: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors, and their hashes."""
    n, w = len(data) - K + 1, span - K + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    length = np.diff(places)
    last = places[1:-1]  # K-grams that run over a row's end, and rows that have no string, have no hash
    over = ragged(np.maximum(last - K + 1, 0), np.minimum(last, K - 1)) if len(last) else np.zeros(0, np.int64)
    h[over[over < n]] = _MOST
    short = np.flatnonzero((length < span) & (length > 0))
    gone = ragged(places[:-1][short], length[short])
    h[gone[gone < n]] = _MOST
    edge = np.full(w - 1, _MOST, np.uint64)
    least = _sliding(np.concatenate([edge, h, edge]), w, np.minimum)
    most = _sliding(least, w, np.maximum)
    at = np.flatnonzero((h == most) & (h != _MOST))
    return at, h[at]


def _blob(values: np.ndarray, first: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(values)])


def _pressed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Stretches of numbers, or of rows of bytes, each compressed plane by plane (first bytes first)."""
    import zstandard

    coder, width = zstandard.ZstdCompressor(level=1), values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    return pa.array([coder.compress(np.ascontiguousarray(raw[a:b].T)) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())


def _unpressed(blob: bytes, kind: str, width: int = 0) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    raw = np.ascontiguousarray(raw.reshape(width or np.dtype(kind).itemsize, -1).T)
    return raw if width else raw.view(kind).reshape(-1)


def _parts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, the buckets there are, and where each begins in that order."""
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    return order, used, np.append(first, len(bucket)).astype(np.int64)


def _dealt(columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows of numbers as a blob for each column and bucket of documents; the first column is the doc_id."""
    order, used, first = _parts((_mix(columns[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(_pressed(c[order], first) for c in columns)], ["bucket", *(f"c{i}" for i in range(len(columns)))])


def _gathered(batches, kinds: list[str]):
    """The rows of each bucket that _dealt() dealt, a bucket at a time."""
    held: dict[int, list] = {}
    for batch in batches:
        for b, *blobs in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            held.setdefault(b, []).append(blobs)
    for blobs in held.values():
        yield [np.concatenate([_unpressed(x[i], kind) for x in blobs]) for i, kind in enumerate(kinds)]


def _buckets(df: DataFrame) -> int:
    """As many as there are partitions to deal to, so that a task sends no more rows than Spark writes blocks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def candidates(docs: DataFrame, span: int) -> DataFrame:
    """doc_id and the places (32-bit, in any order) of its anchors that other documents have as well."""
    buckets = _buckets(docs)

    def deal(batches):
        held, n = [], 0
        for batch in slices(batches, most=TEXT_BYTES):
            data, places = text_bytes(batch.column("text"))
            at, h = anchors(data, places, span)
            row = np.searchsorted(places, at, "right") - 1
            held.append((h, batch.column("doc_id").to_numpy(zero_copy_only=False)[row], (at - places[row]).astype(np.uint32)))
            n += len(at)
            if n >= FLUSH_ANCHORS:
                yield from dealt(held)
                held, n = [], 0
        if n:
            yield from dealt(held)

    def dealt(held):
        h, doc, at = (np.concatenate(x) for x in zip(*held))
        key = h // np.uint64(buckets) & np.uint64(0xFFFFFFFF)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((at, doc, key, bucket))
        key, bucket, doc, at = key[order].astype(np.uint32), bucket[order], doc[order], at[order]
        start = np.ones(len(key), bool)
        start[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        other = np.zeros(len(key), bool)
        other[1:] = ~start[1:] & (doc[1:] != doc[:-1])
        group = np.cumsum(start) - 1
        many = (np.bincount(group, other) > 0)[group]
        if many.any():  # settled here
            yield _places(doc[many], at[many])
        # the rest of a least document's own places must learn of others as well
        own = ~many | start
        key, bucket, doc, at = key[own], bucket[own], doc[own], at[own]
        used, first = np.unique(bucket, return_index=True)
        first = np.append(first, len(bucket)).astype(np.int64)
        steps = np.diff(key.astype(np.int64), prepend=0)
        steps[first[:-1]] = key[first[:-1]]  # ascending within a bucket
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()), _pressed(steps.astype(np.uint32), first), _pressed(doc, first), _pressed(at, first)], names)

    def _places(doc, at):
        order, used, first = _parts(doc)
        empty = np.zeros(len(used) + 1, np.int64)
        return pa.RecordBatch.from_arrays([pa.array((used % buckets).astype(np.int32)), pa.array(used), _blob(at[:0], empty), _blob(doc[:0], empty), _blob(at[order], first)], names)

    names = ["bucket", "doc_id", "keys", "docs", "places"]

    def gather(batches):
        held: dict[int, list] = {}
        docs_, places = [], []
        for batch in batches:
            for b, doc, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "keys", "docs", "places"))):
                if doc is None:
                    held.setdefault(b, []).append(blobs)
                else:  # settled by the task that dealt it
                    places.append(np.frombuffer(blobs[2], "<u4"))
                    docs_.append(np.full(len(places[-1]), doc, np.int64))
        for blobs in held.values():  # a bucket at a time
            key = np.concatenate([np.cumsum(_unpressed(x, "<u4"), dtype=np.int64) for x, _, _ in blobs])
            doc, at = np.concatenate([_unpressed(y, "<i8") for _, y, _ in blobs]), np.concatenate([_unpressed(z, "<u4") for _, _, z in blobs])
            order = np.lexsort((doc, key))
            key, doc, at = key[order], doc[order], at[order]
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            other = np.zeros(len(key), bool)
            other[1:] = ~start[1:] & (doc[1:] != doc[:-1])
            group = np.cumsum(start) - 1
            many = (np.bincount(group, other) > 0)[group]
            docs_.append(doc[many])
            places.append(at[many])
        if docs_:
            yield _dealt([np.concatenate(docs_), np.concatenate(places)], buckets)

    def collect(batches):
        for doc, at in _gathered(batches, ["<i8", "<u4"]):
            order, used, first = _parts(doc)
            yield pa.RecordBatch.from_arrays([pa.array(used), _blob(at[order], first)], ["doc_id", "places"])

    dealt_out = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(deal, "bucket int, doc_id long, keys binary, docs binary, places binary")
    found = dealt_out.repartition("bucket").mapInArrow(gather, "bucket int, c0 binary, c1 binary")
    return found.repartition("bucket").mapInArrow(collect, "doc_id long, places binary")


def squeezed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, and the text compressed for the shuffle."""

    def press(batches):
        import zstandard

        coder = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "_text"):
            packed = [None if x is None else coder.compress(x) for x in batch.column("_text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(packed, pa.binary())], [*keep, "_z"])

    schema = docs.select(*keep).schema.add("_z", "binary")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(press, schema)


def _opened(batch: pa.RecordBatch) -> list[bytes]:
    import zstandard

    coder = zstandard.ZstdDecompressor()
    return [b"" if x is None else coder.decompress(x) for x in batch.column("_z").to_pylist()]


def owned(at: np.ndarray, h: np.ndarray, row: np.ndarray, places: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose least hash is each anchor's (the leftmost, where several tie)."""
    n, reach = len(at), span - K
    lo, hi = np.maximum(at - reach, places[row]), np.minimum(at, places[row + 1] - span)
    for step in range(1, reach + 1):
        if step >= n or not (at[step:] - at[:-step] <= reach).any():
            break
        near = (at[step:] - at[:-step] <= reach) & (row[step:] == row[:-step])
        left = near & (h[:-step] <= h[step:])  # an earlier one that is as low
        lo[step:][left] = np.maximum(lo[step:][left], at[:-step][left] + 1)
        right = near & (h[step:] < h[:-step])  # a later one that is lower
        hi[:-step][right] = np.minimum(hi[:-step][right], at[step:][right] - reach - 1)
    return lo, hi


def pieces(docs: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """Buckets of pieces: bucket, docs, marks (the text's hash), starts (of the piece's first column in the text) and
    the pieces' bytes; or, with a null bucket, (doc_id, mark) and intervals that are repeats already."""
    buckets, left = _buckets(docs), span - K
    width = 2 * left + K

    def cut(batches):
        held, size = [], 0
        for batch in slices(batches, "_z", 1 << 19):
            raws = _opened(batch)
            places = np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int64)
            data = np.full(places[-1] + 2 * left, OUTSIDE, np.uint8)
            data[left : left + places[-1]] = np.frombuffer(b"".join(raws), np.uint8)
            at, h = anchors(data[left : left + places[-1]], places, span)
            row = np.searchsorted(places, at, "right") - 1
            lo, hi = owned(at, h, row, places, span)
            wanted = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("places").to_pylist()]
            wanted = np.concatenate([x + a for x, a in zip(wanted, places[:-1].tolist())])
            keep = np.isin(at, wanted) & (lo <= hi)
            at, row, lo, hi = at[keep], row[keep], lo[keep], hi[keep]
            if not len(at):
                continue
            rows = np.lib.stride_tricks.sliding_window_view(data, width)[at]
            column = np.arange(width) + (at - left)[:, None]
            rows[(column < lo[:, None]) | (column >= hi[:, None] + span)] = OUTSIDE
            doc, mark = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "mark"))
            held.append((doc, mark, (at - places[row]).astype(np.int64), rows, lo - places[row], hi - places[row] + span))
            size += rows.size
            if size >= FLUSH_BYTES:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    def dealt(held):
        doc, mark, at, rows, lo, hi = (np.concatenate(x) for x in zip(*held))
        _, same = np.unique(rows.view(f"V{width}").reshape(-1), return_inverse=True)
        same = same.reshape(-1)
        least = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc)
        later = doc > least[same]
        if later.any():
            yield from _intervals(doc[later], mark[later], lo[later], hi[later], names)
        goes = ~later
        # one of the least document's equal pieces tells others enough, but each of its own must hear of others
        rows, doc, mark, at = rows[goes], doc[goes], mark[goes], at[goes]
        h = gram_hashes(np.ascontiguousarray(rows[:, left : left + K]).reshape(-1))[::K]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((h, bucket))
        used, first = np.unique(bucket[order], return_index=True)
        first = np.append(first, len(bucket)).astype(np.int64)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), none, none, _pressed(doc[order], first), _pressed(mark[order], first), _pressed((at[order] - left).astype(np.int32), first), _pressed(rows[order], first)], names)

    names = ["bucket", "doc_id", "mark", "docs", "marks", "starts", "bytes"]
    joined = squeezed(docs.filter("doc_id IS NOT NULL"), ["doc_id", "mark"]).join(found, "doc_id")
    return joined.mapInArrow(cut, "bucket int, doc_id long, mark long, docs binary, marks binary, starts binary, bytes binary")


def union(doc: np.ndarray, mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of the [a, b) intervals of each (doc, mark), in order."""
    order = np.lexsort((a, mark, doc))
    doc, mark, a, b = doc[order], mark[order], a[order], b[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    far = (np.cumsum(new) - 1) << 32  # rows apart, so that one running maximum serves all
    end = np.maximum.accumulate(b + far)
    open_ = np.ones(len(doc), bool)  # an interval begins: the text between isn't covered
    open_[1:] = (a + far)[1:] > end[:-1]
    at = np.flatnonzero(open_)
    return doc[at], mark[at], a[at], (end - far)[np.append(at[1:], len(doc)) - 1]


def _intervals(doc, mark, a, b, names):
    """Rows of (doc_id, mark) with the union of their intervals, as the null-bucket rows of pieces()."""
    doc, mark, a, b = union(doc, mark, a, b)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    first = np.append(np.flatnonzero(new), len(doc)).astype(np.int64)
    none = pa.nulls(len(first) - 1, pa.binary())
    yield pa.RecordBatch.from_arrays([pa.nulls(len(first) - 1, pa.int32()), pa.array(doc[new]), pa.array(mark[new]), none, none, none, _blob(np.stack([a, b], 1).astype(np.int32), first)], names)


def repeats(symbols: np.ndarray, docs: np.ndarray, span: int, last_start: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, column) of strings of `span` bytes that also start, in the same column, in a piece of a smaller doc.
    `symbols`: a row for each piece. Strings start in columns 0 to last_start."""
    m, width = symbols.shape
    order = np.arange(m)
    common = np.zeros(m, np.int64)  # of each piece's suffix with the one before in `order`
    found, where = [], []
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as state:
        for c in range(width - 1, -1, -1):  # in the order in which they are read
            columns.write(np.ascontiguousarray(symbols[:, c]).tobytes())
        columns.seek(0)
        for c in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(m), np.uint8)[order]
            sort = np.argsort(symbol, kind="stable")
            bwt = symbol[sort]  # this column's part of the transform
            after = np.zeros(m, np.int64)
            starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), m]):
                if b - a > 1 and bwt[a] != OUTSIDE:
                    own = sort[a:b]  # places of the symbol in the last order
                    after[a + 1 : b] = np.minimum.reduceat(common[: own[-1] + 1], own[:-1] + 1) + 1
            common = np.minimum(after, span)
            order = order[sort]
            if c <= last_start:
                run = np.cumsum(common < span) - 1
                long = np.bincount(run)[run] > 1
                if long.any():
                    at = np.flatnonzero(common < span)
                    least = np.minimum.reduceat(docs[order], at)[run]
                    hit = docs[order] > least
                    found.append(order[hit])
                    where.append(np.full(int(hit.sum()), c))
            state.seek(0)
            state.write(order.astype(np.int32).tobytes())
            state.write(common.astype(np.uint8).tobytes() if span < 256 else common.tobytes())
            state.seek(0)
            order = np.frombuffer(state.read(4 * m), np.int32).astype(np.int64)
    return (np.concatenate(found), np.concatenate(where)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def removed_intervals(dealt: DataFrame, span: int) -> DataFrame:
    """doc_id, mark and [start, end) intervals (32-bit pairs) to remove."""
    left = span - K
    width = 2 * left + K

    def sort(batches):
        held: dict[int, list] = {}
        found = []
        for batch in batches:
            for b, doc, mark, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "mark", "docs", "marks", "starts", "bytes"))):
                if doc is None:
                    held.setdefault(b, []).append(blobs)
                else:  # settled by the task that dealt it
                    own = np.frombuffer(blobs[3], "<i4").reshape(-1, 2).astype(np.int64)
                    found.append((np.full(len(own), doc, np.int64), np.full(len(own), mark, np.int64), own[:, 0], own[:, 1]))
        for blobs in held.values():  # equal anchors share a bucket; one is open at a time
            doc, mark = (np.concatenate([_unpressed(x[i], "<i8") for x in blobs]) for i in (0, 1))
            start = np.concatenate([_unpressed(x[2], "<i4") for x in blobs]).astype(np.int64)
            piece, column = repeats(np.concatenate([_unpressed(x[3], "u1", width) for x in blobs]), doc, span, left)
            if len(piece):
                a = start[piece] + column
                found.append(union(doc[piece], mark[piece], a, a + span))
        if found:
            doc, mark, a, b = union(*(np.concatenate(x) for x in zip(*found)))
            yield _dealt([doc, mark, a.astype(np.int32), b.astype(np.int32)], buckets)

    def collect(batches):
        for doc, mark, a, b in _gathered(batches, ["<i8", "<i8", "<i4", "<i4"]):
            for out in _intervals(doc, mark, a.astype(np.int64), b.astype(np.int64), ["bucket", "doc_id", "mark", "docs", "marks", "starts", "bytes"]):
                yield pa.RecordBatch.from_arrays([out.column(c) for c in ("doc_id", "mark", "bytes")], ["doc_id", "mark", "intervals"])

    buckets = _buckets(dealt)
    sorted_ = dealt.repartition(F.coalesce("bucket", F.pmod(F.col("mark"), F.lit(buckets)).cast("int"))).mapInArrow(sort, "bucket int, c0 binary, c1 binary, c2 binary, c3 binary")
    return sorted_.repartition("bucket").mapInArrow(collect, "doc_id long, mark long, intervals binary")


def merge(blob: bytes, size: int) -> np.ndarray:
    """The union of intervals, in order, clipped to the text."""
    x = np.frombuffer(blob, "<i4").reshape(-1, 2).astype(np.int64)
    x = np.clip(x[np.argsort(x[:, 0], kind="stable")], 0, size)
    x = x[x[:, 1] > x[:, 0]]
    if not len(x):
        return x
    end = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > end[:-1]])
    at = np.flatnonzero(new)
    return np.stack([x[at, 0], np.append(end[at[1:] - 1], end[-1])], 1)


def passages(data: np.ndarray, places: np.ndarray, words: int, under: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of `words` successive words that have less than `under` bytes, without the
    punctuation before their first word and after their last."""
    starts, ends = runs(~SPACE[data], places)
    row = np.searchsorted(places, starts, "right") - 1
    n = max(0, len(starts) - words + 1)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    solid = np.flatnonzero(~_LOOSE[data])
    at = np.append(solid, len(data))[np.searchsorted(solid, starts)]
    a = np.where(at < ends, at, starts)
    at = np.append(solid, -1)[np.searchsorted(solid, ends) - 1]
    b = np.where(at >= starts, at + 1, ends)[words - 1 :]
    own = np.flatnonzero((row[:n] == row[words - 1 :]) & (b - a[:n] < under))
    return a[own], b[own], row[own]


def repeated_words(docs: DataFrame, words: int, under: int) -> DataFrame:
    """doc_id, mark and `places` (start << 32 | end) of passages of `words` words and less than `under` bytes that a
    document with a smaller doc_id has as well, by their 128-bit digests. A task sends a passage of its least doc_id
    alone and settles those of its other documents by itself, so a common one can't gather its documents."""

    def deal(batches):
        held, n = [], 0
        for batch in slices(batches, most=TEXT_BYTES):
            data, places = text_bytes(batch.column("text"))
            a, b, row = passages(data, places, words, under)
            if not len(a):
                continue
            raw = data.tobytes()
            keys = np.frombuffer(b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist())), "<i8").reshape(-1, 2)
            doc, mark = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "mark"))
            held.append((keys[:, 0], keys[:, 1], doc, mark, a - places[row], b - places[row]))
            n += len(a)
            if n >= FLUSH_ANCHORS:
                yield from dealt(held)
                held, n = [], 0
        if held:
            yield from dealt(held)

    def dealt(held):
        k, l, doc, mark, a, b = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, l, k))
        k, l, doc, mark, a, b = (x[order] for x in (k, l, doc, mark, a, b))
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1])
        later = doc > doc[new][np.cumsum(new) - 1]
        if later.any():
            of, text, x, y = union(doc[later], mark[later], a[later], b[later])
            yield rows(True, text, of, of, text, x, y)
        yield rows(False, *(x[~later] for x in (k, l, doc, mark, a, b)))

    def rows(settled, k, l, doc, mark, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), settled)), *(pa.array(x) for x in (k, l, doc, mark, a << 32 | b))], ["settled", "k", "l", "doc_id", "mark", "place"])

    sent = docs.filter("doc_id IS NOT NULL").select("doc_id", "mark", "text").mapInArrow(deal, "settled boolean, k long, l long, doc_id long, mark long, place long")
    least = sent.withColumn("least", F.min("doc_id").over(Window.partitionBy("settled", "k", "l")))
    return least.filter("settled OR doc_id > least").groupBy("doc_id", "mark").agg(F.collect_list("place").alias("places"))


def dedup(docs: DataFrame, keep: list[str], span: int = 50, with_text: bool = False, words: int | None = None) -> DataFrame:
    """Columns `keep` with n_bytes, n_removed, n_spans, kept_sha256, and the kept text if it's asked for (where a cut
    splits a character, its remaining bytes are left out there; the other figures are of the bytes themselves). With
    `words`, passages of so many words go as well, however few bytes they have."""
    source = docs.select(*keep, F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("_t")).withColumn("_m", F.xxhash64("_t"))
    own = source.select(F.col("_d").alias("doc_id"), F.col("_t").alias("text"), F.col("_m").alias("mark"))
    found = candidates(own, span)
    gone = written(removed_intervals(pieces(own, found, span), span))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("intervals").alias("_gone"))
    if words:
        more = written(repeated_words(own, words, span)).select(F.col("doc_id").alias("_also"), F.col("mark").alias("_same"), "places")
        gone = gone.join(more, (F.col("_doc") == F.col("_also")) & (F.col("_mark") == F.col("_same")), "full")
        gone = gone.select(F.coalesce("_doc", "_also").alias("_doc"), F.coalesce("_mark", "_same").alias("_mark"), "_gone", F.col("places").alias("_places"))
    else:
        gone = gone.withColumn("_places", F.lit(None).cast("array<long>"))

    def finish(batches):
        for batch in batches:
            out = []
            for raw, blob, more in zip(_opened(batch), batch.column("_gone").to_pylist(), batch.column("_places").to_pylist()):
                if more:
                    x = np.array(more, np.int64)
                    blob = (blob or b"") + np.stack([x >> 32, x & 0xFFFFFFFF], 1).astype("<i4").tobytes()
                cuts = merge(blob, len(raw)) if blob else np.zeros((0, 2), np.int64)
                kept, at = [], 0
                for a, b in cuts.tolist():
                    kept.append(raw[at:a])
                    at = b
                body = b"".join([*kept, raw[at:]])
                out.append((len(raw), int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), hashlib.sha256(body).hexdigest(), *([body.decode("utf-8", "ignore")] * with_text)))
            columns = list(zip(*out)) or [()] * (4 + with_text)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))], [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    schema = T.StructType(docs.select(*keep).schema.fields).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")
    marked = squeezed(source.select(*keep, "_d", "_m", F.col("_t").alias("text")) if "text" not in keep else source.drop("text").withColumnRenamed("_t", "text"), [*keep, "_d", "_m"])
    return marked.join(gone, (F.col("_d") == F.col("_doc")) & (F.col("_m") == F.col("_mark")), "left").mapInArrow(finish, schema)
