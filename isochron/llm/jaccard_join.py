"""N-gram Jaccard join by PartEnum signatures.

A text's set holds its distinct shingles of `words` words, as 64-bit hashes; a set is a node, so equal sets are one
node however many documents have it. Two sets r and s with |r & s| * den >= num * |r | s| differ in at most
(|r| + |s|) * (den - num) / (den + num) elements. Sizes are banded by steps of the square root of two; a set takes
part in its own band, and in the next if a partner can be there.

Signatures. Each band, with k the greatest difference in it, deals the domain of shingles by hash into n1 first-level
partitions with more than k / (K2 + 1), and each of those into N2 second-level ones. Linked sets differ in at most K2
of the N2 somewhere, so they agree wholly on N2 - K2 of them: a signature is such a subset of second-level partitions
with all that the set has in it, and each set enumerates all subsets. Of these it keeps the strongest by an order
that only the signature's content sets (most elements, then hash), one more than its own greatest difference can
spoil: if a strongest common signature were dropped by one of the sets, all common ones would be, and that's more
than it drops. So linked sets always share a kept signature, empty and thin ones are rarely kept, and sets so small
that k is 0 need none, as only equal sets are linked.

Signatures that two nodes or more share give candidates, in two steps, each linear in the groups' sizes.

1. Each node is compared with one node of each of its signatures' groups, the one that has most shared signatures (of
   copies of one text it's the nearest to that text). Sets are compared in full, and components formed.
2. Then come the signatures whose nodes still lie in several components. A pair inside a component needs no
   comparison, so nodes outside a group's largest component are paired with the rest. A pair is left out only where
   its sizes rule a link out. The elements of the nodes in groups of over FEW are counted (by a groupBy, summed before
   the shuffle). Two such nodes may have an element in common that RARE of them or fewer have: those are paired by
   it, RARE at most an element. Otherwise what they share lies in their `cores`, the rest of their elements, and
   sets of n and m elements need cores of (n + m) * num / (num + den) at least. Copies that were each changed too much
   to link have no such core, and go before any pair is made.

Defined results: a null text, or one without words, has an empty set and is its own component; a text with fewer
words than a shingle is one shingle; a null doc_id has no component (null) and links nothing; repeated rows fall
into one component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.components import components
from isochron.llm.store import scratch, written
from isochron.llm.words import LOWER, SPACE, ragged, slices, split_words, text_bytes

_P = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of a signature. Where two that differ get the same ones, sets are compared that needn't be, no more.
WIDTH = 6

#: Bytes of text whose sets are made at once.
TEXT_BYTES = 1 << 19

#: Signatures that a task sorts at once, rows in a batch that it returns, and bytes of sets that it compares at once.
FLUSH, ROWS, PAIR_BYTES = 300_000, 50_000, 4 << 20

#: Second-level partitions, and how many of them may differ in a signature.
N2, K2 = 3, 1

#: Nodes in a group up to which its nodes' cores aren't counted: their pairs are few anyhow.
FEW = 16

#: Nodes with an element up to which it's outside their cores.
RARE = 8

#: Least sizes of the bands.
BANDS = np.unique(np.ceil(np.sqrt(2.0) ** np.arange(64)).astype(np.int64))

#: Candidates' doc_ids that are broadcast at most (8 bytes each); beyond that the texts are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int, is_word: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and where each row's begin."""
    data, places = text_bytes(column)
    found, _, _, first = split_words(LOWER[data], places, is_word)
    coded = found.dictionary_encode()
    distinct = np.array(coded.dictionary.to_pylist(), object)
    own = pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.zeros(0, np.uint64)
    h = _mix(own)[coded.indices.to_numpy(zero_copy_only=False)]
    n = np.diff(first)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    with np.errstate(over="ignore"):
        out = h.copy()
        for i in range(1, words):
            n_more = max(0, len(h) - i)
            out[:n_more] = out[:n_more] * _P + h[i:]
        short = np.flatnonzero((n < words) & (n > 0))
        for r in short.tolist():  # fewer words than a shingle has
            x = np.uint64(n[r])
            for y in h[first[r] : first[r + 1]]:
                x = x * _P + y
            out[first[r]] = x
    keep = np.zeros(len(h), bool)
    if len(h) >= words:
        keep[: len(h) - words + 1] = row[: len(h) - words + 1] == row[words - 1 :]
    keep[first[short]] = True
    row, out = row[keep], _mix(out[keep])
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    return out[new], np.searchsorted(row[new], np.arange(rows + 1))


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        done = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return done[first[1:]] - done[first[:-1]]


def nodes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit name for each row's set."""
    n = np.diff(first).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (_mix(_row_sums(_mix(hashes * _P), first) ^ (n * _P)) >> np.uint64(1)).astype(np.int64)


def signatures(hashes: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all rows, and the row of each."""
    size = np.diff(first)
    band = np.searchsorted(BANDS, np.maximum(size, 1), "right") - 1
    out, of = [], []
    for step in (0, 1):  # own band, and the next where a partner can be
        low, top = BANDS[band + step], BANDS[band + step + 1] - 1
        partner = np.minimum(size * den // num, top)
        most = (size + partner) * (den - num) // (den + num)
        rows = np.flatnonzero((most > 0) & (size > 0) & (partner >= low))
        if not len(rows):
            continue
        k = 2 * top[rows] * (den - num) // (den + num)
        n1 = (5 * (k + 1)) // (4 * (K2 + 1)) + 1
        cells = N2 * n1
        base = np.cumsum(cells) - cells
        lengths = size[rows]
        h = hashes[ragged(first[:-1][rows], lengths)]
        salt = (band[rows] + step).astype(np.uint64)
        with np.errstate(over="ignore"):
            cell = (_mix(h + np.repeat(salt, lengths) * _P) % np.repeat(cells, lengths).astype(np.uint64)).astype(np.int64)
            slot = np.repeat(base, lengths) + cell
            count = np.bincount(slot, minlength=int(cells.sum()))
            sums = np.zeros(len(count), np.uint64)
            np.add.at(sums, slot, _mix(h ^ _P))
            # the subsets of N2 - K2 second-level partitions: all but one of each first-level partition
            group = np.repeat(np.arange(len(count) // N2), N2)
            number = (np.arange(len(count)) - np.repeat(base, cells)).astype(np.uint64)
            own = _mix(sums + number * _P)
            count = np.bincount(group, count)[group].astype(np.int64) - count
            sums = np.add.reduceat(own, np.arange(0, len(own), N2))[group] - own
            owner = np.repeat(np.arange(len(rows)), cells)
            sums = _mix(_mix(sums + number * _P) + salt[owner]) >> np.uint64(64 - 8 * WIDTH)
        spoilt = 2 * np.minimum(most[rows], n1) + np.maximum(0, most[rows] - n1)  # of a partition's three, one difference spoils two
        order = np.lexsort((sums, -count, owner))
        rank = np.arange(len(order)) - base[owner[order]]
        kept = order[rank <= spoilt[owner[order]]]
        out.append(sums[kept])
        of.append(rows[owner[kept]])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _read(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All 8-byte values of a binary column, and where each row's begin."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    body = column.buffers()[2]
    n = int(offsets[-1] - offsets[0]) // 8
    return (np.frombuffer(body, kind, n, int(offsets[0])) if n else np.zeros(0, kind)), (offsets - offsets[0]) // 8


def _narrow(sigs: np.ndarray, first: np.ndarray) -> pa.Array:
    """Signatures as blobs of WIDTH bytes each."""
    body = np.ascontiguousarray(sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * WIDTH).astype(np.int32)), pa.py_buffer(body)])


def _widened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a column of such blobs, and where each row's begin."""
    data, places = text_bytes(column)
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = data.reshape(-1, WIDTH)
    return out.view("<u8").reshape(-1), places // WIDTH


def described(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n, node and the set's signatures of each document."""

    def describe(batches):
        for batch in slices(batches, most=TEXT_BYTES):
            hashes, first = shingle_sets(batch.column("text"), words)
            sigs, of = signatures(hashes, first, num, den)
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(nodes(hashes, first)), _narrow(sigs[order], starts)], ["doc_id", "n", "node", "sigs"])

    return docs.mapInArrow(describe, "doc_id long, n long, node long, sigs binary")


def shared_signatures(table: DataFrame) -> DataFrame:
    """(sig, node) for signatures of two nodes or more. Nodes of a task that share a signature are settled there;
    only the least of them goes on to where other tasks' are, so a signature reaches the shuffle once a task and a
    hot one can't gather its group."""
    buckets = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        held, n = [], 0
        for batch in batches:
            sigs, first = _widened(batch.column("sigs"))
            held.append((sigs, np.repeat(batch.column("node").to_numpy(zero_copy_only=False), np.diff(first))))
            n += len(sigs)
            if n >= FLUSH:
                yield from _dealt(held, buckets)
                held, n = [], 0
        if n:
            yield from _dealt(held, buckets)

    def gather(batches):
        sigs, own = [], []
        for batch in batches:
            x, first = _widened(batch.column("sigs"))
            y = np.concatenate([_named(*r) for r in zip(batch.column("names").to_pylist(), batch.column("which").to_pylist(), np.diff(first).tolist())] or [np.zeros(0, np.int64)])
            local = np.repeat(batch.column("local").to_numpy(zero_copy_only=False), np.diff(first))
            if local.any():
                yield from _members(x[local], y[local])
            sigs.append(x[~local])
            own.append(y[~local])
        if sigs:
            sigs, own = np.concatenate(sigs), np.concatenate(own)
            for part in range(8):  # an eighth is sorted at a time
                here = sigs >> np.uint64(8 * WIDTH - 3) == part
                x, y, _, many = _grouped(sigs[here], own[here])
                yield from _members(x[many], y[many])

    dealt = table.filter("doc_id IS NOT NULL AND octet_length(sigs) > 0").select("node", "sigs").mapInArrow(deal, "bucket int, local boolean, sigs binary, names binary, which binary")
    return dealt.repartition("bucket").mapInArrow(gather, "sig long, node long").distinct()


def _grouped(sigs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, node), sorted; each signature's least node; and whether it has several."""
    order = np.lexsort((own, sigs))
    sigs, own = sigs[order], own[order]
    new = np.ones(len(sigs), bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (own[1:] != own[:-1])
    sigs, own = sigs[new], own[new]
    start = np.ones(len(sigs), bool)
    start[1:] = sigs[1:] != sigs[:-1]
    at = np.flatnonzero(start)
    lengths = np.diff(np.append(at, len(sigs)))
    return sigs, own, np.repeat(own[at], lengths), np.repeat(lengths > 1, lengths)


def _members(sigs: np.ndarray, own: np.ndarray):
    for a in range(0, len(sigs), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(sigs[a : a + ROWS].view(np.int64)), pa.array(own[a : a + ROWS])], ["sig", "node"])


def _dealt(held: list, buckets: int):
    sigs, own, rep, many = _grouped(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
    for local, keep in ((False, own == rep), (True, many)):  # one row of each signature goes on; groups are known
        x, y = sigs[keep], own[keep]
        bucket = ((_mix(y.view(np.uint64)) if local else x) % np.uint64(buckets)).astype(np.int64)  # groups may lie anywhere
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        if len(used):
            first = np.append(first, len(x))
            names, which = zip(*(_names(part) for part in np.split(y[order], first[1:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), local)), _narrow(x[order], first), pa.array(names, pa.binary()), pa.array(which, pa.binary())], ["bucket", "local", "sigs", "names", "which"])


def _names(nodes: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct nodes, and the number of each one's node among them, in two bytes where that's enough."""
    names, which = np.unique(nodes, return_inverse=True)
    return names.astype("<i8").tobytes(), which.astype("<u2" if len(names) <= 1 << 16 else "<u4").tobytes()


def _named(names: bytes, which: bytes, n: int) -> np.ndarray:
    return np.frombuffer(names, "<i8")[np.frombuffer(which, "<u2" if len(which) == 2 * n else "<u4")]


def sets_of(wanted: DataFrame, docs: DataFrame, table: DataFrame, words: int) -> DataFrame:
    """(node, set) for the nodes in `wanted`, made anew from the text of one document each."""
    ids = written(table.filter("doc_id IS NOT NULL").join(wanted.distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    shared = None
    if ids.count() <= BROADCAST_IDS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64)))
    else:
        docs = docs.join(ids.distinct(), "doc_id", "left_semi")

    def pick(batches):  # in the same worker as what follows
        for batch in batches:
            if shared is None:
                yield batch
            elif len(shared.value):
                known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(shared.value, doc), len(shared.value) - 1)
                yield batch.filter(pa.array((shared.value[at] == doc) & known))

    def make(batches):
        for batch in slices(pick(batches), most=TEXT_BYTES):
            hashes, first = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([pa.array(nodes(hashes, first)), pa.array(np.diff(first)), _blobs(hashes, first)], ["node", "n", "set"])

    return docs.mapInArrow(make, "node long, n long, set binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs of nodes whose sets are linked."""

    def compare(batches):
        for batch in slices(batches, ("x", "y"), PAIR_BYTES):
            (x, fx), (y, fy) = _read(batch.column("x"), "<u8"), _read(batch.column("y"), "<u8")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
                both = len(p) + len(q)
                if min(len(p), len(q)) * den >= max(len(p), len(q)) * num:
                    merged = np.concatenate([p, q])
                    merged.sort(kind="stable")
                    same = int((merged[1:] == merged[:-1]).sum())
                    keep[i] = den * same >= num * (both - same)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return written(two.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def elements(sets: DataFrame) -> DataFrame:
    """(key, node) of each element of each set."""

    def take(batches):
        for batch in slices(batches, "set"):
            values, first = _read(batch.column("set"), "<u8")
            own = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), np.diff(first))
            for a in range(0, len(own), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(values[a : a + ROWS].view(np.int64)), pa.array(own[a : a + ROWS])], ["key", "node"])

    return sets.select("node", "set").mapInArrow(take, "key long, node long")


def central(members: DataFrame) -> DataFrame:
    """(node, rep): each node with the node of each of its groups that has most shared signatures, ties to the least."""
    fame = members.groupBy("node").agg(F.count("*").alias("fame"))
    first = members.join(fame, "node").groupBy("sig").agg(F.max(F.struct("fame", (-F.col("node")).alias("minus"))).alias("top"))
    return members.join(first, "sig").select("node", (-F.col("top.minus")).alias("rep")).filter("node <> rep")


def crossing(members: DataFrame, known: DataFrame) -> DataFrame:
    """(sig, node, component, main, many): signatures whose nodes lie in several components; main is the component
    with most of them."""
    rows = members.join(known, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    parts = rows.groupBy("sig", "component").agg(F.count("*").alias("size"))
    groups = parts.groupBy("sig").agg(F.sum("size").alias("many"), F.count("*").alias("parts"), F.max_by("component", F.struct("size", "component")).alias("main"))
    return rows.join(groups.filter("parts > 1").drop("parts"), "sig")


def across(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) pairs of nodes of different components in a group, where their sizes and cores allow a link."""
    sizes = sets.select("node", "n")
    large = rows.filter(F.col("many") > FEW).select("node", "component").distinct()
    own = elements(sets.join(large, "node", "left_semi"))
    rare = written(own.join(own.groupBy("key").agg(F.count("*").alias("times")).filter(F.col("times") <= RARE), "key"))
    alone = rare.groupBy("node").agg(F.count("*").alias("rare"))
    # pairs of small groups have no such bound, as the elements there aren't counted
    core = F.when(F.col("many") > FEW, F.col("n") - F.coalesce("rare", F.lit(0))).otherwise(F.col("n"))
    reach = lambda most: F.floor(most * (num + den) / num) - F.col("n")
    alike = F.floor(F.col("n") * den / num)
    rows = rows.join(sizes, "node").join(alone, "node", "left").withColumn("reach", F.least(reach(core), alike).cast("long"))
    least = rows.groupBy("sig").agg(F.min("n").alias("least"))
    rows = written(rows.join(least, "sig").filter("reach >= least").select("sig", "node", "component", "main", "n", "reach"))
    p, q = rows.filter("component <> main").alias("p"), rows.alias("q")
    on = (F.col("p.sig") == F.col("q.sig")) & (F.col("p.component") != F.col("q.component")) & (F.col("p.n") <= F.col("q.reach")) & (F.col("q.n") <= F.col("p.reach"))
    pair = (F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
    bounded = p.join(q, on).select(*pair)
    ends = rare.filter("times > 1").join(large, "node").join(sizes, "node").withColumn("reach", alike.cast("long"))
    p, q = ends.alias("p"), ends.alias("q")
    on = (F.col("p.key") == F.col("q.key")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.component") != F.col("q.component")) & (F.col("p.n") <= F.col("q.reach")) & (F.col("q.n") <= F.col("p.reach"))
    return bounded.unionByName(p.join(q, on).select(*pair)).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the least doc_id that links reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(described(docs, words, num, den)) as signed:  # signatures take more room than all else: they go first
        members = written(shared_signatures(signed))
        table = written(signed.select("doc_id", "n", "node"))
    stars = written(central(members).select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct())
    with scratch(sets_of(members.select("node"), docs, table, words)) as sets:
        links = verified(stars, sets, num, den)
        known = written(components(links))
        more = verified(across(crossing(members, known), sets, num, den).join(stars, ["a", "b"], "left_anti"), sets, num, den)
    if not more.isEmpty():
        known = written(components(links.unionByName(more)))
    labelled = table.select("doc_id", "n", "node").join(known, "node", "left")
    labelled = labelled.select("doc_id", "n", "node", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component"))
    least = labelled.filter("component IS NOT NULL AND doc_id IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = labelled.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
