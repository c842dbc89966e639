"""Token-ID output: ids ranked by frequency, in byte-aligned variable-length coding with separate control bytes.

A file holds blocks of up to BLOCK values. A block has its number of values and of data bytes, then the control
bytes (two bits for each value: its length in bytes less one), then the data bytes, low byte first. After the
blocks come the documents' ids, a null mark for each and their lengths, and a trailer that points there. Values are ranks: rank 0 is the corpus'
commonest id, so most values take one byte. `ranks.bin` beside the files gives each rank's id.

Defined results: a null text is empty, so it gives the end id alone; repeated doc_ids give a row each, in order of
their ids' bytes; a null doc_id sorts first; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.store import open_fs, shared_folder, written
from isochron.llm.tokens import SLICE, encoder, owner
from isochron.llm.words import slices

MAGIC = b"SVBRANK1"
BLOCK = 1 << 16
_HEAD = "<II"
_TAIL = "<QQ8s"

#: For each control byte the lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
_AT = np.arange(4)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    code = ((values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)).astype(np.uint8)
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[: len(values)] = code
    quads = quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[_AT < code[:, None] + 1]
    return quads.sum(1, dtype=np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_AT < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def tokenise(docs: DataFrame, path: str, end_id: int, drops_space: bool = False) -> DataFrame:
    """doc_id and the ids of the whole text and end_id, as little-endian 16-bit values where they fit, else 32-bit."""

    def encode(batches):
        own = encoder(path, drops_space)
        for batch in slices(batches, most=SLICE, owner=owner(path, drops_space)):
            ids, starts = own.encode(batch.column("text"), end_id)
            data = pa.py_buffer(ids.astype("<u2" if narrow else "<u4"))
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((starts * width).astype(np.int32)), data])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blobs], ["doc_id", "ids"])

    narrow = encoder(path, drops_space).tokenizer.get_vocab_size() <= 1 << 16
    width = 2 if narrow else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(encode, "doc_id long, ids binary").withColumn("width", F.lit(width))


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    width = batch.column("width")[0].as_py()
    blobs = batch.column("ids").cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int64, len(blobs) + 1, 8 * blobs.offset)
    data = np.frombuffer(blobs.buffers()[2], f"<u{width}", (offsets[-1] - offsets[0]) // width, int(offsets[0]))
    return data, (offsets - offsets[0]) // width


def frequency_ranks(tokens: DataFrame, size: int) -> np.ndarray:
    """Each rank's id, commonest first, ties by id. As long as the vocabulary, whatever the corpus."""

    def count(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(_values(batch)[0], minlength=size)
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in tokens.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return np.lexsort((np.arange(size), -counts)).astype("<u4")


def write_files(tokens: DataFrame, ranks: np.ndarray, folder: str) -> DataFrame:
    """Files in ascending doc_id order, one for each range of doc_ids; returns their names, ranges and sizes."""
    rank_of = np.empty(len(ranks), np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    fs, root = open_fs(folder)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/ranks.bin") as f:
        f.write(ranks.astype("<u4").tobytes())
    shared = tokens.sparkSession.sparkContext.broadcast(rank_of)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.svb"
        fs, root = open_fs(folder)
        draft = f"{root}/.{name}.{task.taskAttemptId()}"
        ids, nulls, lengths, at, out = [], [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root)
                out = fs.open_output_stream(draft)
                at += out.write(MAGIC)
            values, starts = _values(batch)
            values = shared.value[values]
            for a in range(0, len(values), BLOCK):
                part = values[a : a + BLOCK]
                control, data = pack(part)
                at += out.write(struct.pack(_HEAD, len(part), len(data)) + control + data)
            ids.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            lengths.append(np.diff(starts).astype("<u4"))
        if out is None:
            return
        n = sum(map(len, ids))
        out.write(b"".join(x.tobytes() for x in (*ids, *nulls, *lengths)) + struct.pack(_TAIL, n, at, MAGIC))
        out.close()
        fs.move(draft, f"{root}/{name}")  # a retried task puts the same file there again
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([int(sum(x.sum(dtype=np.int64) for x in lengths))], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return written(ordered.mapInArrow(write, "part int, file string, n_docs long, n_ids long"))


def read_file(f, size: int, ranks: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a file, in order; holds a block and a document at a time."""
    f.seek(size - struct.calcsize(_TAIL))
    n, index, magic = struct.unpack(_TAIL, f.read(struct.calcsize(_TAIL)))
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    f.seek(index)
    ids = np.frombuffer(f.read(8 * n), "<i8")
    nulls = np.frombuffer(f.read(n), np.uint8)
    lengths = np.frombuffer(f.read(4 * n), "<u4")
    f.seek(len(MAGIC))
    held, got = [], 0
    for doc, null, length in zip(ids.tolist(), nulls.tolist(), lengths.tolist()):
        while got < length:
            values, size = struct.unpack(_HEAD, f.read(struct.calcsize(_HEAD)))
            control = f.read(-(-values // 4))
            held.append(ranks[unpack(control, f.read(size), values)])
            got += values
        whole = held[0] if len(held) == 1 else np.concatenate(held)
        yield None if null else doc, whole[:length]
        held, got = [whole[length:]], got - length


def read_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """One row for each document, from the files alone: doc_id, start, n_tokens, ids_crc32. `files`: what
    write_files() returned; of it the driver sees a name and a number for each file."""
    rows, start = [], 0
    for x in sorted(files.select("part", "file", "n_ids").collect()):
        rows.append((x.file, start))
        start += x.n_ids

    def read(batches):
        fs, root = open_fs(folder)
        with fs.open_input_file(f"{root}/ranks.bin") as f:
            ranks = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                out = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    for doc, ids in read_file(f, f.size(), ranks):
                        out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    plan = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_output(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the ids of all documents to `folder` and returns what its files hold, a row for each document."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    tokens = written(tokenise(docs, path, end_id), "zstd")
    ranks = frequency_ranks(tokens, max(encoder(path, False).tokenizer.get_vocab_size(), end_id + 1))
    return read_files(spark, folder, write_files(tokens, ranks, folder))
