"""URL filter over a sorted array of 64-bit digests.

The list (rules like `example.org/es/`: a host and the beginning of a path; a bare URL's host and path is such a
rule too) is kept as one file for each shard: its keys' xxhash64 digests in ascending order, then places and the
full strings. A task memory-maps the file, makes each URL's candidates (each suffix of its host that begins a
label, with each beginning of its path whose length some rule has), probes the digests by vectorised binary
search, and compares the stored string of each hit, so two strings with one digest can't be mistaken. The longest
rule that fits decides; where none fits, the list says nothing against the URL and the default verdict holds.

A list is cut by digest into shards of at most `shard_bytes`; each is handed to the executors in turn, and a pass
over the candidates keeps the longest hit so far, so the list may outgrow a machine's memory.

Defined results: a null url, or one without `://`, has an empty host and path and no rule; rules with a null or
empty host are ignored; of equal rules `block` wins; of two of one length that fit, the greater by bytes; repeated rows each get their row; other columns pass unread.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.store import open_fs, shared_folder
from isochron.llm.words import slices

_HEAD = "<8sQQ"
_MAGIC = b"URLDIG01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def _digests(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def shard_file(rules: list[tuple[str, str]]) -> bytes:
    """(rule, verdict) pairs as a file: header, digests, places of the strings, verdicts, strings."""
    best: dict[bytes, str] = {}
    for rule, verdict in rules:
        key = rule.encode()
        best[key] = verdict if best.get(key, verdict) == verdict else "block"
    keys = list(best)
    digests = _digests(keys)
    order = np.argsort(digests, kind="stable")
    keys = [keys[i] for i in order]
    places = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("<u8") if keys else np.zeros(1, "<u8")
    block = np.array([best[k] == "block" for k in keys], np.uint8)
    body = b"".join(keys)
    return struct.pack(_HEAD, _MAGIC, len(keys), len(body)) + digests[order].astype("<u8").tobytes() + places.tobytes() + body + block.tobytes()


class Shard:
    """A memory-mapped shard file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        magic, n, size = struct.unpack(_HEAD, raw[: struct.calcsize(_HEAD)].tobytes())
        if magic != _MAGIC:
            raise ValueError("not a digest file")
        at = struct.calcsize(_HEAD)
        self.digests = raw[at : at + 8 * n].view("<u8")
        self.places = raw[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.body = raw[at + 16 * n + 8 : at + 16 * n + 8 + size]
        self.block = raw[at + 16 * n + 8 + size :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Each key's number, or -1."""
        wanted = _digests(keys)
        at = np.searchsorted(self.digests, wanted)
        found = np.full(len(keys), -1)
        near = np.flatnonzero(at < len(self.digests))
        near = near[self.digests[at[near]] == wanted[near]]
        for i in near.tolist():
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:  # one digest may stand for several strings
                if self.body[int(self.places[j]) : int(self.places[j + 1])].tobytes() == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Longest first for each host suffix; `lengths`: those that rules' paths have, in characters."""
    if not host:
        return []
    labels = host.split(".")
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [(".".join(labels[i:]) + start).encode() for i in range(len(labels)) for start in starts]


_SHARDS: dict[str, Shard] = {}


def _shard(name: str) -> Shard:
    if name not in _SHARDS:
        _SHARDS[name] = Shard(SparkFiles.get(name))
    return _SHARDS[name]


def judge(urls: DataFrame, rules: DataFrame, keep: list[str], default: str = "allow", shard_bytes: int = 64 << 20) -> DataFrame:
    """Columns `keep` of rows with a `url`, with host, path, rule and verdict. `rules` has rule and verdict."""
    spark = urls.sparkSession
    rules = rules.select(F.col("rule").cast("string"), F.col("verdict").cast("string")).filter("rule IS NOT NULL AND verdict IS NOT NULL AND rule NOT LIKE '/%' AND rule <> ''")
    total, longest = rules.agg(F.sum(F.octet_length("rule") + 17), F.max(F.octet_length("rule"))).first()
    lengths = sorted((r[0] for r in rules.select(F.length(F.regexp_extract("rule", r"(?s)\A[^/]*(.*)", 1))).distinct().collect()), reverse=True)  # as many as a path has characters at most
    shards = max(1, -(-(total or 0) // shard_bytes))
    host, path = host_and_path(F.col("_url"))
    out = urls.select(*keep, F.col("url").cast("string").alias("_url")).select(*keep, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    sharded = rules.withColumn("_shard", F.pmod(F.xxhash64("rule"), F.lit(shards)))
    folder = shared_folder(spark)
    for k in range(shards):
        held = [(r.rule, r.verdict) for r in sharded.filter(F.col("_shard") == k).select("rule", "verdict").toLocalIterator()]  # shard_bytes at most
        name = f"urls-{uuid.uuid4().hex}.bin"
        fs, at = open_fs(folder)
        fs.create_dir(at)
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(shard_file(held))
        spark.sparkContext.addFile(f"{folder}/{name}")
        out = out.mapInArrow(_pass(name, lengths, keep), out.schema)
    return out


def _pass(name: str, lengths: list[int], keep: list[str]):
    def probe(batches):
        shard = _shard(name)
        for batch in slices(batches, "path"):
            rows = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            each = [candidates(h, p, lengths) for h, p in rows]
            keys = list(dict.fromkeys(k for x in each for k in x))
            number = dict(zip(keys, shard.find(keys).tolist()))
            found, verdicts = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            for i, own in enumerate(each):
                fits = max((k for k in own if number[k] >= 0), key=lambda k: (len(k.decode()), k), default=None)
                if fits is not None and (found[i] is None or len(fits.decode()) > len(found[i])):
                    found[i], verdicts[i] = fits.decode(), "block" if shard.block[number[fits]] else "allow"
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), batch.column("host"), batch.column("path"), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], [*keep, "host", "path", "rule", "verdict"])

    return probe
