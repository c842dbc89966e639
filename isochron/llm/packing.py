"""Best-fit packing of token sequences, bulk-synchronous over size classes.

Documents are cut into pieces of at most `size` tokens, sorted by range of (length, doc_id, piece), longest first,
and numbered by that order. Lengths and gaps are whole numbers up to `size`, and pieces of one length as well as
open sequences with one gap are interchangeable, so a round works on classes: it takes the next class of pieces,
sweeps the gap classes upwards for its successor (the smallest gap that holds it), matches as many pieces as that
class has room for, settles which piece gets which sequence by rank, and updates the gaps; what is left goes on to
the next successor, and then opens sequences. The rounds need the histogram of lengths alone (`size` numbers,
whatever the corpus), give the very sequences that best-fit decreasing gives, and yield a plan of a few thousand
rank intervals; each piece then finds its place by its number, in parallel.

Defined results: a null text is empty and gives one piece with the end id; repeated doc_ids keep a piece each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.store import written
from isochron.llm.tokens import encoder, owner
from isochron.llm.words import slices

#: As in tokens.py, but smaller: in the pipeline, packing's workers run beside a JVM whose heap earlier stages filled.
CACHE, SLICE = 100_000, 1 << 20

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, end_id: int, size: int, drops_space: bool = True) -> DataFrame:
    """A row for each piece of each document, with the crc32 of its ids."""

    def encode(batches):
        own = encoder(path, drops_space, CACHE)
        for batch in slices(batches, most=SLICE, owner=owner(path, drops_space, CACHE)):
            ids, starts = own.encode(batch.column("text"), end_id)
            n = np.diff(starts)
            pieces = -(-n // size)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(size, n[row] - start)
            at = starts[row] + start
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, _PIECE)


def best_fit_plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Rounds of best fit over the histogram of lengths. Rows: first number of the pieces, how many, first sequence,
    pieces in each sequence, first offset, length; numbers count pieces from the longest."""
    gaps: list[int] = []  # ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: ranges of sequences that have it
    plan, number, sequences = [], 0, 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                bisect.insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            else:
                gap, first, n = size, sequences, -(-left // (size // length))
                sequences += n
            room = gap // length
            full = min(n, left // room)
            for some, each in ((full, room), (int(full < n and left > full * room), left - full * room)):
                if some:
                    plan.append((number, some * each, first, each, size - gap, length))
                    give(gap - each * length, first, some)
                    number, left, first, n = number + some * each, left - some * each, first + some, n - some
            give(gap, first, n)
    return np.array(plan, np.int64).reshape(-1, 6)


def place(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to size. They are written first: to find the ranges,
    Spark reads its input twice."""
    pieces = written(pieces)
    spark = pieces.sparkSession
    ordered = pieces.repartitionByRange(F.desc("length"), "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece", *[c for c in pieces.columns if c not in ("length", "doc_id", "piece")])
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in ordered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, size))  # a few rows for each length, whatever the input
    part = F.shiftright("_at", 33)
    base, bases = 0, {}
    for r in sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each partition
        bases[r.part], base = base, base + r.n
    bases = spark.sparkContext.broadcast(bases)

    def number(batches):
        rows, base = plan.value, bases.value
        for batch in batches:
            at = batch.column("_at").to_numpy(zero_copy_only=False)
            own = np.array([base[x] for x in (at >> 33).tolist()], np.int64) + (at & (1 << 33) - 1)
            r = rows[np.searchsorted(rows[:, 0], own, "right") - 1]
            i = own - r[:, 0]
            got = [pa.array(r[:, 2] + i // r[:, 3]), pa.array(r[:, 4] + i % r[:, 3] * r[:, 5])]
            yield pa.RecordBatch.from_arrays([c for c, name in zip(batch.columns, batch.schema.names) if name != "_at"] + got, [x for x in batch.schema.names if x != "_at"] + ["sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ordered.mapInArrow(number, f"{kinds}, sequence_id long, offset long")


def pack_sequences(docs: DataFrame, path: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(cut(docs, path, end_id, size), size)
