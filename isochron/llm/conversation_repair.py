"""Conversation structure repair: the cheapest edits that turn each conversation into `(system? (user assistant)+)?`.

Rows have conv_id, turn, role and text; a conversation's order is by turn (nulls first), then role and text. A row's
first fault counts: blank (no character but ASCII white space), duplicate (its role and text came earlier), truncated
(its last such character isn't one of `.!?`). Keep costs 0, rerole to user or assistant 3, delete 4, insert an empty
user or assistant row 3; blank and duplicate rows must go, truncated rows that stay cost 3 more. Of the cheapest edits
the audit (K, R, D, I in order) that sorts first in ASCII is taken.

Method: equal consecutive symbols (role initial and fault) are a run; a run of n rows is the n-th power of its symbol's
4 x 4 min-plus transition (states: nothing, system, user, assistant last), made of cached binary powers; from the costs
at the ends of runs the choices are unrolled row by row, with equal situations looked up. As the product of transitions
is associative, a conversation may have any number of rows: it's dealt by range into segments of at most SEGMENT rows,
each makes its matrix, the driver chains the matrices of conversations with several segments (their number is bounded by
rows / SEGMENT and the partitions' borders), and the segments unroll on their own. Equal rows are counted, not repeated,
so that hot copies are one row before anything is dealt. Only the last pass reads a conversation in one task, as SHA-256
is sequential; it's a stream that holds one batch.

Defined results: null roles and texts are one space; a null conv_id is a conversation of its own; null turns come
first; repeated rows are duplicates; of roles only the first character counts, and other initials than s, u and a can't
be kept; other columns are ignored, whatever their names. A conversation without rows has zeros, an empty audit and the
hash of the empty string; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from isochron.llm.store import written

SPACES = " \t\n\x0b\x0c\r"

#: Rows of a segment.
SEGMENT = 1 << 16

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: What comes after each state by an inserted or reroled row, and the role of that row. States: 0 nothing yet, 1 system,
#: 2 user, 3 assistant.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_FINAL = (0, 6, 3, 0)
_BIG = 10**15

#: Symbol 0 must go; others are 1 + 2 * (place in _INITIALS) + truncated.
_INITIALS = "sua"

_COUNTS = ("blank", "duplicate", "truncated")

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


@lru_cache
def _steps(symbol: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state, the edits (letter, cost, next state) that use up a row of this symbol."""
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if symbol:
            initial, more = (_INITIALS + "?")[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
            if state in _KEPT.get(initial, ()):
                edits.append(("K", KEEP + more, _KEPT[initial][state]))
            edits.append(("R", REROLE + more, _NEXT[state]))
        out.append(tuple(edits))
    return tuple(out)


@lru_cache
def _power(symbol: int, k: int) -> Matrix:
    """The transition of 2^k rows of a symbol, inserted rows before each of them included."""
    if k:
        half = _power(symbol, k - 1)
        return _product(half, half)
    out = []
    for state in range(4):
        costs, at = [_BIG] * 4, state
        for inserted in range(4):
            for _, cost, to in _steps(symbol)[at]:
                costs[to] = min(costs[to], INSERT * inserted + cost)
            at = _NEXT[at]
        out.append(tuple(costs))
    return tuple(out)


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_BIG, *(x[k] + b[k][j] for k in range(4))) for j in range(4)) for x in a)


def _applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x[k] + v[k] for k in range(4)) for x in a)


def _before(symbol: int, rows: int, after: Vector) -> Vector:
    """Costs to the end before a run, from those after it."""
    k = 0
    while rows:
        if rows & 1:
            after = _applied(_power(symbol, k), after)
        rows, k = rows >> 1, k + 1
    return after


def matrix(runs: tuple[tuple[int, int], ...]) -> Matrix:
    """The transition of runs (symbol, rows)."""
    out: Matrix = tuple(tuple(0 if i == j else _BIG for j in range(4)) for i in range(4))
    for symbol, rows in runs:
        k = 0
        while rows:
            if rows & 1:
                out = _product(out, _power(symbol, k))
            rows, k = rows >> 1, k + 1
    return out


@lru_cache(100_000)
def _back(symbol: int, after: Vector) -> tuple[Vector, int]:
    """The costs before one row, less their least, and that."""
    own = _applied(_power(symbol, 0), after)
    least = min(own)
    return tuple(x - least for x in own), least


@lru_cache(100_000)
def _choice(symbol: int, state: int, after: Vector) -> tuple[str, int, int]:
    """The letters of the first cheapest edits that use up a row, their cost and the state after them."""
    costs = _applied(_power(symbol, 0), after)
    letters, paid = "", 0
    while True:
        fits = [(letter, cost, to) for letter, cost, to in _steps(symbol)[state] if cost + after[to] == costs[state]]
        first = min(fits)[0] if fits else "~"
        if INSERT + costs[_NEXT[state]] == costs[state] and "I" < first:
            letters, paid, state = letters + "I", paid + INSERT, _NEXT[state]
            continue
        letter, cost, to = min(fits)
        return letters + letter, paid + cost, to


def unroll(runs: tuple[tuple[int, int], ...], end: Vector, state: int, last: bool) -> tuple[str, int, int]:
    """Audit, cost and state after the runs, begun in `state`, where `end` has each state's cost after them; `last`:
    nothing follows, so what is missing is inserted. Short conversations are often alike, so theirs are kept."""
    return (_short if sum(n for _, n in runs) <= 32 else _unroll)(runs, end, state, last)


def _unroll(runs, end, state, last):
    ends, at = [], end
    for symbol, rows in reversed(runs):
        ends.append(at)
        at = _before(symbol, rows, at)
    letters, paid = [], 0
    for (symbol, rows), after in zip(runs, reversed(ends)):
        least = min(after)
        inner = [tuple(x - least for x in after)]
        for _ in range(rows - 1):
            inner.append(_back(symbol, inner[-1])[0])
        for costs in reversed(inner):
            own, cost, state = _choice(symbol, state, costs)
            letters.append(own)
            paid += cost
    while last and _FINAL[state]:
        letters.append("I")
        state, paid = _NEXT[state], paid + INSERT
    return "".join(letters), paid, state


_short = lru_cache(50_000)(_unroll)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes
    its `.!?` away, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    own = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    own = own.withColumn("_kind", F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return own.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_n")).drop("_n")


def _numbered(rows: DataFrame) -> DataFrame:
    """Distinct rows with how often they stand, numbered in order: numbers rise through the partitions of a range."""
    own = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    own = own.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    end = F.rtrim("text", F.lit(SPACES))
    faults = {"blank": end == "", "cut": ~F.right(end, F.lit(1)).isin(".", "!", "?"), "initial": F.substring("role", 1, 1)}
    return own.withColumn("id", F.monotonically_increasing_id()).withColumns(faults)


def _segments(rows: DataFrame) -> DataFrame:
    """conv_id, seg, marks (id, symbol, rows) and counts of faults of each segment of numbered rows."""
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("_text")).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    own = rows.select("conv_id", "id", "n", "blank", "cut", "initial").join(first, "id", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    kind = F.coalesce(F.nullif(F.instr(F.lit(_INITIALS), F.col("initial")), F.lit(0)), F.lit(4))
    kind = F.when(F.col("initial") == "", 4).otherwise(kind)
    symbol = F.when(F.col("blank") | ~F.col("first"), 0).otherwise(1 + 2 * (kind - 1) + F.col("cut").cast("int"))
    counts = {"blank": F.when(F.col("blank"), F.col("n")).otherwise(0), "duplicate": F.when(~F.col("blank"), F.col("n") - F.col("first").cast("long")).otherwise(0), "truncated": (~F.col("blank") & F.col("first") & F.col("cut")).cast("long")}
    own = own.select("conv_id", F.floor(F.col("id") / SEGMENT).cast("long").alias("seg"), F.struct("id", symbol.cast("int").alias("symbol"), "n").alias("m"), *[x.alias(f"_{k}") for k, x in counts.items()])
    return own.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("m")).alias("marks"), *[F.sum(f"_{k}").alias(k) for k in _COUNTS])


def _runs(symbols: list[int], rows: list[int]) -> tuple[tuple[int, int], ...]:
    """Runs of equal symbols; a row that stands n times is itself and n - 1 duplicates."""
    flat = [x for symbol, n in zip(symbols, rows) for x in (((symbol, 1), (0, n - 1)) if symbol and n > 1 else ((symbol, n),))]
    return tuple((symbol, sum(n for _, n in own)) for symbol, own in groupby(flat, key=lambda x: x[0]))


def _each(frame: DataFrame, make, columns: str, keep: list[str]) -> DataFrame:
    """Columns `keep` and what `make(conv_id, seg, runs)` gives for each segment."""
    source = frame.select(*keep, F.col("marks.symbol").alias("_symbols"), F.col("marks.n").alias("_rows"))
    schema = StructType([*frame.select(*keep).schema.fields, *StructType.fromDDL(columns).fields])
    own = to_arrow_schema(StructType.fromDDL(columns))

    def apply(batches):
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("conv_id", "seg")]
            found = [make(*key, _runs(s, n)) for *key, s, n in zip(*keys, batch.column("_symbols").to_pylist(), batch.column("_rows").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([x[i] for x in found], f.type) for i, f in enumerate(own))], schema.names)

    return source.mapInArrow(apply, schema)


def _solved(segments: DataFrame) -> DataFrame:
    """conv_id, seg, audit, cost and counts. Conversations of one segment are solved where they lie; those of several
    in two rounds over their matrices, which have 16 numbers a segment."""
    spark = segments.sparkSession
    several = segments.groupBy("conv_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("conv_id").alias("_c"))
    pieces = written(segments.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi"))
    ends: dict[tuple, Vector] = {}
    starts: dict[tuple, int] = {}
    lasts: set[tuple] = set()
    rows = _each(pieces, lambda c, s, runs: ([x for v in matrix(runs) for x in v],), "matrix array<long>", ["conv_id", "seg"]).collect()
    order = sorted(((r.conv_id, r.seg) for r in rows), key=lambda x: (x[0] is not None, x))
    own = {(r.conv_id, r.seg): tuple(tuple(r.matrix[4 * i : 4 * i + 4]) for i in range(4)) for r in rows}
    after, conversation = _FINAL, object()
    for key in reversed(order):
        if key[0] != conversation:
            after, conversation = _FINAL, key[0]
            lasts.add(key)
        ends[key] = after
        after = _applied(own[key], after)
    if order:
        shared = spark.sparkContext.broadcast(ends)  # the segments of long conversations, 4 numbers each
        to = _each(pieces, lambda c, s, runs: ([unroll(runs, shared.value[c, s], q, False)[2] for q in range(4)],), "states array<long>", ["conv_id", "seg"])
        states = {(r.conv_id, r.seg): r.states for r in to.collect()}
        at, conversation = 0, object()
        for key in order:
            if key[0] != conversation:
                at, conversation = 0, key[0]
            starts[key] = at
            at = states[key][at]
    known = spark.sparkContext.broadcast((ends, starts, lasts))

    def solve(conv_id, seg, runs):
        ends, starts, lasts = known.value
        key = (conv_id, seg)
        return unroll(runs, ends.get(key, _FINAL), starts.get(key, 0), key in lasts or key not in ends)[:2]

    return _each(segments, solve, "audit string, cost long", ["conv_id", "seg", *_COUNTS])


def _streamed(rows: DataFrame, ids: DataFrame, make, schema) -> DataFrame:
    """`make` over each conversation's marker, segments and rows, in order."""
    numbered = written(_numbered(rows))
    solved = _solved(written(_segments(numbered)))
    null = F.lit(None)
    markers = ids.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("id"), F.lit(0).alias("kind"))
    parts = [
        markers,
        solved.select("conv_id", (F.col("seg") * SEGMENT).alias("id"), F.lit(1).alias("kind"), "audit", "cost", *_COUNTS),
        numbered.select("conv_id", "id", F.lit(2).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", "n"),
    ]
    kinds = {"conv_id": None, "id": "long", "kind": "int", "audit": "string", "cost": "long", **dict.fromkeys(_COUNTS, "long"), "turn": "long", "role": "string", "text": "string", "n": "long"}
    out = None
    for part in parts:
        own = part.select(*[F.col(c) if c in part.columns else null.cast(kind).alias(c) for c, kind in kinds.items()])
        out = own if out is None else out.unionByName(own)
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "id", "kind").mapInArrow(make, schema)


def _edits(letters, role: str, text: str, state: int):
    """(edit, role, text, state) of the inserted rows before a row, and of the row."""
    for letter in letters:
        if letter == "D":
            yield letter, role, text, state
            return
        if letter == "K":
            yield letter, role, text, {"s": 1, "u": 2, "a": 3}[role[:1]]
            return
        state = _NEXT[state]
        yield (letter, _ROLE[state], "" if letter == "I" else text, state)
        if letter == "R":
            return


class _Reader:
    """Follows one conversation through its marker, segments and rows."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.place = conv_id, 0, 0
        self.audits: list[str] = []
        self.letters = iter("")
        self.totals = {"cost": 0, **dict.fromkeys(_COUNTS, 0)}

    def segment(self, audit: str, totals: dict) -> list[tuple]:
        left = self.rest()
        self.audits.append(audit)
        self.letters = iter(audit)
        for k, v in totals.items():
            self.totals[k] += v
        return left

    def row(self, role: str, text: str) -> list[tuple]:
        out = list(_edits(self.letters, role, text, self.state))
        self.state = out[-1][-1]
        return out

    def rest(self) -> list[tuple]:
        """What is inserted after the last row."""
        out = list(_edits(self.letters, "", "", self.state))
        if out:
            self.state = out[-1][-1]
        return out


def _read(batches, begin, row, finish, segment):
    """Calls back for each conversation, segment and row; yields what `finish` gives."""
    now = None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i in range(batch.num_rows):
            conv_id, kind = columns["conv_id"][i], columns["kind"][i]
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield from finish(now)
                now = begin(conv_id)
            if kind == 1:
                yield from segment(now, columns["audit"][i], {c: columns[c][i] for c in ("cost", *_COUNTS)})
            elif kind == 2:
                for _ in range(columns["n"][i]):
                    yield from row(now, columns["turn"][i], columns["role"][i], columns["text"][i])
    if now is not None:
        yield from finish(now)


def _batched(rows, schema: pa.Schema, most: int = 4 << 20, size=lambda r: 100):
    held, room = [], most
    for r in rows:
        held.append(r)
        room -= size(r)
        if room <= 0:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, room = [], most
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), turn (null where inserted), role, text."""
    schema = rows.select("conv_id").schema.add("place", "long").add("edit", "string").add("turn", "long").add("role", "string").add("text", "string")

    def out(now, found, turn=None):
        for edit, role, text, _ in found:
            if edit != "D":
                yield {"conv_id": now.conv_id, "place": now.place, "edit": edit, "turn": None if edit == "I" else turn, "role": role, "text": text}
                now.place += 1

    def make(batches):
        kinds = to_arrow_schema(schema)
        read = _read(batches, _Reader, lambda now, turn, role, text: out(now, now.row(role, text), turn), lambda now: out(now, now.rest()), lambda now, audit, totals: out(now, now.segment(audit, totals)))
        yield from _batched(read, kinds, size=lambda r: 100 + 4 * len(r["text"]))

    return _streamed(rows, rows.limit(0), make, schema)


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each conv_id of `ids`: gaps (turns missing between the least and the largest), rows by first fault,
    illegal neighbours (initials other than su, ua, au), cost, audit, and SHA-256 of the repaired `role:text` lines."""
    schema = ids.select("conv_id").schema
    for c in ("gaps", *_COUNTS, "illegal", "cost"):
        schema = schema.add(c, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")

    class Digest(_Reader):
        def __init__(self, conv_id):
            super().__init__(conv_id)
            self.hash, self.before, self.illegal = hashlib.sha256(), None, 0
            self.low = self.high = None
            self.turns = 0

        def add(self, found):
            for edit, role, text, _ in found:
                if edit != "D":
                    self.hash.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
                    self.place += 1
            return ()

        def seen(self, turn, role, text):
            if self.before is not None:
                self.illegal += self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            return self.add(self.row(role, text))

        def finish(self):
            self.add(self.rest())
            gaps = self.high - self.low + 1 - self.turns if self.turns else 0
            yield {"conv_id": self.conv_id, "gaps": gaps, **self.totals, "illegal": self.illegal, "audit": "".join(self.audits), "repaired_sha256": self.hash.hexdigest()}

    def make(batches):
        read = _read(batches, Digest, Digest.seen, Digest.finish, lambda now, audit, totals: now.add(now.segment(audit, totals)))
        yield from _batched(read, to_arrow_schema(schema), size=lambda r: 300 + len(r["audit"]))

    return _streamed(rows, ids, make, schema)
