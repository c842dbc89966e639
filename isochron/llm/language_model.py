"""Language-model scoring: a gated recurrent network with a class-factored output, and a smoothed unigram beside it.

Tokens are runs of non-space characters, A-Z lower-cased, and an end after each text. All training documents are counted,
which gives N tokens, V distinct ones and the unigram's base score. The network's words are the WORDS most frequent; any
other word is one of few shapes (its last mark and its letters beyond ASCII), and within its shape has the smoothed
unigram's probability, so that every text has a probability: log10 P(class | state) + log10 P(word | class, state) for
the network's words, log10 P(shape | state) + log10 ((c + 1) / (N_shape + V_shape + 1)) for others.

Method: a gated recurrent unit in numpy, trained by truncated backpropagation over all training documents, each read once.
Documents lie end to end in LANES lanes of windows of STEPS tokens; the state is carried from window to window and reset
where a document begins. Training goes in rounds over growing shares of the documents: tasks train apart from common
weights, which are then averaged in blocks by Spark, so the driver gets one model a round, however many tasks there are.
Classes are equal bands of the frequency order; the output costs one softmax over classes and one within the class.
For scoring, the state is carried through the whole document.

Counts of the FREQUENT most frequent words (of at most WORD_BYTES bytes) are broadcast; the others' counts come by a join
on the word, so the corpus-wide table has no bound and no frequent word is in the join.

Defined results: null and empty texts are the end alone; documents with a null doc_id are scored but not learned from, and
not held out; repeated rows each count and each get their row; other columns are ignored, whatever their names; without
training documents N and V are 0, each token's base score is 0 and the network stays as it began; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from isochron.llm.store import small_batches, written
from isochron.llm.words import LOWER, SPACE, slices, split_words, text_bytes

#: Classes of the network's words, and words in each.
CLASSES, MEMBERS = 32, 63
WORDS = CLASSES * MEMBERS

#: Shapes of other words: three kinds of last mark, and nine of letters.
SHAPES = 27

STATE, LANES, STEPS = 16, 512, 16

#: Tokens of the documents that are scored side by side: the longer the list, the fewer steps with few documents left.
SIDE_BY_SIDE = 6_000_000

#: Shares of the training documents in the rounds; tokens that a task trains on at least.
ROUNDS, TASK_TOKENS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1), 2_000_000

RATE = 0.1

#: Logits end here, so that their exponentials are finite.
MOST_LOGIT = 60

FREQUENT, WORD_BYTES = 200_000, 64

#: A word of its own, as no other holds a space.
END = "\n"

#: Blocks in which weights travel.
BLOCKS = 16

#: Each token's class (shapes are classes of their own), and its place in it.
_CLASS = np.append(np.repeat(np.arange(CLASSES), MEMBERS), CLASSES + np.arange(SHAPES)).astype(np.uint8)
_MEMBER = np.append(np.tile(np.arange(MEMBERS), CLASSES), np.zeros(SHAPES, int))

#: Rows of the class layer at once, so that its logits stay in the processor's cache.
ROWS = 2048
_ROW = np.arange(ROWS)

_ENDS = np.full(256, 2, np.int64)
_ENDS[list(b".!?")] = 0
_ENDS[list(b",;:")] = 1


def held_out(fold: int = 2, folds: int = 7) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def _split(column: pa.Array):
    """The distinct words of all rows, each token's number among them, where each row's tokens begin, and the words' shapes."""
    data, places = text_bytes(column)
    words, _, _, first = split_words(LOWER[data], places, ~SPACE)
    coded = words.dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    own, places = text_bytes(distinct)
    shapes = np.zeros(0, np.int64)
    if len(distinct):
        extra = np.where((own & 0xC0) == 0x80, (own & 0x3F) // 8 + 1, 0).astype(np.uint8)
        shapes = _ENDS[own[places[1:] - 1]] * 9 + np.maximum.reduceat(extra, places[:-1])
    return distinct, codes, first, shapes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, shape, n) over all texts, the end of each included."""

    def apply(batches):
        held: list[pa.Table] = []

        def merged():
            table = pa.concat_tables(held).group_by(["word", "shape"]).aggregate([("n", "sum")])
            held.clear()
            yield from pa.table({"word": table["word"].cast(pa.string()), "shape": table["shape"], "n": table["n_sum"]}).to_batches()

        for batch in slices(batches, "_text"):
            words, codes, _, shapes = _split(batch.column("_text"))
            held.append(pa.table({"word": words.cast(pa.binary()), "shape": shapes.astype(np.int32), "n": np.bincount(codes, minlength=len(words))}))
            held.append(pa.table({"word": pa.array([END.encode()], pa.binary()), "shape": np.zeros(1, np.int32), "n": np.array([batch.num_rows])}))
            if sum(t.num_rows for t in held) > 150_000:
                yield from merged()
        if held:
            yield from merged()

    source = docs.select(F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(apply, "word string, shape int, n long").groupBy("word").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"))


@dataclass
class Corpus:
    """What is known of the training documents: the frequent words by falling count (the end first), their counts, and
    tokens and distinct tokens in all and of each shape beyond the network's words."""

    words: list[str]
    counts: np.ndarray
    tokens: int
    distinct: int
    shape_tokens: np.ndarray
    shape_distinct: np.ndarray

    @property
    def known(self) -> int:
        """The network's words."""
        return min(WORDS, len(self.words))


def corpus(counts: DataFrame, frequent: int = FREQUENT) -> Corpus:
    """The frequent ones are all words above a count; a histogram of it, with steps of 1/16 of a power of two, tells
    which. Nothing else of the vocabulary goes to the driver."""
    short = counts.filter((F.octet_length("word") <= WORD_BYTES) & (F.col("word") != END))
    step = F.floor(F.log2("n") * 16)
    room, least = frequent, None
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        room -= r.n
        if room < 0:
            break
        least = r.step
    rows = short.filter(step >= least).collect() if least is not None else []
    rows = sorted(rows, key=lambda r: (-r.n, r.word))
    end = counts.filter(F.col("word") == END).first()
    tokens, distinct = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in counts.filter(F.col("word") != END).groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        tokens[r["shape"]], distinct[r["shape"]] = r["n"], r["words"]
    in_all, words = int(tokens.sum()) + (end.n if end else 0), int(distinct.sum()) + bool(end)
    for r in rows[: WORDS - 1]:
        tokens[r["shape"]] -= r.n
        distinct[r["shape"]] -= 1
    return Corpus([END, *(r.word for r in rows)], np.array([end.n if end else 0, *(r.n for r in rows)], np.int64), in_all, words, tokens, distinct)


def encode(docs: DataFrame, known: Corpus) -> DataFrame:
    """row, doc_id, held_out, n_tokens, ids (two bytes a token: a network's word, or WORDS + shape), and for frequent
    words n_known, log_all and log_shape (sums of log10 (c + 1) of all, and of those beyond the network's); other words
    are listed in `rest`."""
    shared = docs.sparkSession.sparkContext.broadcast((known.words, known.counts, known.known))  # FREQUENT words of WORD_BYTES at most

    def apply(batches):
        words, counts, size = shared.value
        table = pa.array([x.encode() for x in words], pa.large_binary())
        logs = np.append(np.log10(counts + 1.0), 0.0)
        for batch in slices(batches, "_text"):
            distinct, codes, first, shapes = _split(batch.column("_text"))
            found = pc.fill_null(pc.index_in(distinct, value_set=table), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = found[codes]
            ids = np.where((found >= 0) & (found < size), found, WORDS + shapes)[codes]
            rows, lengths = batch.num_rows, np.diff(first)
            row = np.repeat(np.arange(rows), lengths)
            flat = np.zeros(len(ids) + rows, np.uint16)  # an end, number 0, follows each
            flat[np.arange(len(ids)) + row] = ids
            places = (first + np.arange(rows + 1)).astype(np.int64) * 2
            total = lambda mask, x: np.bincount(row[mask], x[mask], rows).astype(np.float64)
            gained = logs[at]
            rest = np.flatnonzero(at < 0)
            listed = np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=rows))]).astype(np.int32)
            known_end = int(counts[0] > 0)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(lengths + 1),
                pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(places), pa.py_buffer(flat)]).cast(pa.binary()),
                pa.array(np.bincount(row[at >= 0], minlength=rows) + known_end), pa.array(total(at >= 0, gained) + logs[0]), pa.array(total(at >= size, gained)),
                pa.ListArray.from_arrays(pa.array(listed), distinct.take(pa.array(codes[rest])).cast(pa.binary()).cast(pa.string())),
            ], ["row", "doc_id", "held_out", "n_tokens", "ids", "n_known", "log_all", "log_shape", "rest"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", F.col("text").cast("string").alias("_text"))
    more = StructType.fromDDL("n_tokens long, ids binary, n_known long, log_all double, log_shape double, rest array<string>")
    return source.mapInArrow(apply, StructType([*source.drop("_text").schema.fields, *more.fields]))


class Network:
    """Weights by name: `w` of inputs (the network's words, shapes, and the beginning) to the gates, `u` of the state to
    the gates, `c`/`cb` of the state to the classes, `o`/`ob` to the members of each class."""

    SHAPE = {"w": (WORDS + SHAPES + 1, 3 * STATE), "u": (STATE, 3 * STATE), "c": (STATE, CLASSES + SHAPES), "cb": (CLASSES + SHAPES,), "o": (CLASSES, MEMBERS, STATE), "ob": (CLASSES, MEMBERS)}

    def __init__(self, flat: np.ndarray):
        """Weights, and the sums of their squared gradients, as parts of one array."""
        self.flat, at = flat, 0
        self.weight, self.square = {}, {}
        for part in (self.weight, self.square):
            for name, shape in self.SHAPE.items():
                n = int(np.prod(shape))
                part[name] = flat[at : at + n].reshape(shape)
                at += n

    @classmethod
    def size(cls) -> int:
        return 2 * sum(int(np.prod(x)) for x in cls.SHAPE.values())

    @classmethod
    def begun(cls, known: Corpus) -> Network:
        """Small random weights; the biases say the unigram."""
        own = cls(np.full(cls.size(), 1e-8, np.float32))
        rng = np.random.default_rng(13)
        for name in ("w", "u", "c", "o"):
            own.weight[name][:] = rng.normal(0, 0.1 if name != "u" else 0.25, cls.SHAPE[name])
        counts = np.zeros(WORDS)
        counts[: known.known] = known.counts[: known.known]
        counts = counts.reshape(CLASSES, MEMBERS)
        own.weight["ob"][:] = np.where(counts > 0, np.log(counts + 1), -20.0)
        shapes = known.shape_tokens + 1.0
        in_class = counts.sum(1)
        own.weight["cb"][:CLASSES] = np.where(in_class > 0, np.log(in_class + 1), -20.0)
        own.weight["cb"][CLASSES:] = np.log(shapes)
        own.weight["cb"][:] -= np.log(in_class.sum() + shapes.sum())
        return own

    def states(self, x: np.ndarray, keep: np.ndarray | None, h: np.ndarray, held: list | None = None) -> np.ndarray:
        """The state after each step of x (steps, lanes), `h` before them; keep, if given, is 0 where a document begins."""
        s, kind = STATE, self.flat.dtype.type
        scale = np.repeat([kind(-1), kind(2)], [2 * s, s])  # 1 / (1 + exp(-x)), and tanh x = 1 - 2 / (1 + exp(2x))
        gates, u = (self.weight["w"] * scale).take(x, axis=0), self.weight["u"] * scale
        out = np.empty((*x.shape, s), kind)
        with np.errstate(over="ignore"):  # an infinite exponential is a gate that's shut
            for t in range(len(x)):
                if keep is not None:
                    h = h * keep[t]
                a = h @ u
                zr = a[:, : 2 * s] + gates[t, :, : 2 * s]
                np.exp(zr, out=zr)
                zr += 1
                np.divide(1, zr, out=zr)
                n = zr[:, s:] * a[:, 2 * s :]
                n += gates[t, :, 2 * s :]
                np.exp(n, out=n)
                n += 1
                np.divide(-2, n, out=n)
                n += 1
                if held is not None:
                    held.append((h, a[:, 2 * s :], zr, n))
                h = np.subtract(h, n, out=out[t])
                h *= zr[:, :s]
                h += n
        return out

    @staticmethod
    def _exp(x: np.ndarray) -> np.ndarray:
        """The exponentials of each row, in place (logits end at MOST_LOGIT), and the rows' sums."""
        np.minimum(x, x.dtype.type(MOST_LOGIT), out=x)
        np.exp(x, out=x)
        return x @ np.ones(x.shape[1], x.dtype)

    @staticmethod
    def _members(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The network's words among tokens y in order of their classes, their places in them, and where in that order
        each class lies, at most ROWS at once: (class, from, to)."""
        kind = _CLASS.take(y)
        order = np.argsort(kind, kind="stable")  # by digits, as it's one byte
        ends = np.cumsum(np.bincount(kind, minlength=CLASSES)[:CLASSES]).tolist()
        order = order[: ends[-1]]
        return order, _MEMBER.take(y.take(order)), [(c, at, min(at + ROWS, b)) for c, (a, b) in enumerate(zip([0, *ends], ends)) for at in range(a, b, ROWS)]

    def log10(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 of each token's class, and of the word within it for the network's words."""
        p = self.weight

        def logs(x: np.ndarray, target: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
            own[:] = x[_ROW[: len(x)], target]
            total[:] = self._exp(x)

        def done(own: np.ndarray, total: np.ndarray) -> np.ndarray:
            return np.minimum(own, own.dtype.type(MOST_LOGIT)) - np.log(total)

        kind, own, total = _CLASS.take(y), np.empty(len(y), h.dtype), np.empty(len(y), h.dtype)
        for a in range(0, len(y), ROWS):
            b = min(a + ROWS, len(y))
            x = h[a:b] @ p["c"]
            x += p["cb"]
            logs(x, kind[a:b], own[a:b], total[a:b])
        out = done(own, total).astype(np.float64)
        order, target, parts = self._members(y)
        sorted_h, own, total = h.take(order, axis=0), own[: len(order)], total[: len(order)]
        for c, a, b in parts:
            x = sorted_h[a:b] @ p["o"][c].T
            x += p["ob"][c]
            logs(x, target[a:b], own[a:b], total[a:b])
        out[order] += done(own, total)
        return out / np.log(10)

    def _gradients(self, h: np.ndarray, y: np.ndarray):
        """Of the output's weights and of the states, for the tokens' mean loss."""
        p, scale = self.weight, h.dtype.type(1 / len(y))
        ones = np.ones(ROWS, h.dtype)

        def slope(x: np.ndarray, target: np.ndarray) -> np.ndarray:
            x *= (scale / self._exp(x))[:, None]
            x[_ROW[: len(x)], target] -= scale
            return x

        grads = {name: np.zeros_like(p[name]) for name in ("c", "cb", "o", "ob")}
        kind, dh = _CLASS.take(y), np.empty_like(h)
        for a in range(0, len(y), ROWS):
            b = min(a + ROWS, len(y))
            x = h[a:b] @ p["c"]
            x += p["cb"]
            d = slope(x, kind[a:b])
            grads["c"] += h[a:b].T @ d
            grads["cb"] += ones[: b - a] @ d
            np.matmul(d, p["c"].T, out=dh[a:b])
        order, target, parts = self._members(y)
        sorted_h, sorted_dh = h.take(order, axis=0), np.empty((len(order), STATE), h.dtype)
        for c, a, b in parts:
            own = sorted_h[a:b]
            x = own @ p["o"][c].T
            x += p["ob"][c]
            d = slope(x, target[a:b])
            grads["o"][c] += d.T @ own
            grads["ob"][c] += ones[: b - a] @ d
            np.matmul(d, p["o"][c], out=sorted_dh[a:b])
        dh[order] += sorted_dh
        return grads, dh

    def learn(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window: forward, back through its steps, an adaptive gradient step. Returns the state after it."""
        held, s, u, half = [], STATE, self.weight["u"], self.flat.dtype.type(0.5)  # what the state adds is held doubled
        out = self.states(x, keep, h, held)
        grads, dout = self._gradients(out.reshape(-1, s), y.ravel())
        dout = dout.reshape(out.shape)
        du, dgates, dh = np.zeros_like(u), np.empty((*x.shape, 3 * s), np.float32), np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            before, a, zr, n = held[t]
            z, r = zr[:, :s], zr[:, s:]
            dh = dh + dout[t]
            slope = zr * (1 - zr)
            dn = dh * (1 - z) * (1 - n * n)
            g = dgates[t]
            g[:, :s] = dh * (before - n) * slope[:, :s]
            g[:, s : 2 * s] = dn * a * slope[:, s:] * half
            g[:, 2 * s :] = dn
            da = g.copy()
            da[:, 2 * s :] *= r
            du += before.T @ da
            dh = (dh * z + da @ u.T) * keep[t]
        grads["u"] = du
        for name, g in grads.items():
            self._step(name, slice(None), g)
        flat = x.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")  # by digits, as it's two bytes
        inputs, begins = np.unique(flat[order], return_index=True)
        self._step("w", inputs, np.add.reduceat(dgates.reshape(-1, 3 * s)[order], begins, axis=0))
        return out[-1]

    def _step(self, name: str, rows, g: np.ndarray) -> None:
        square = self.square[name][rows] + g * g
        self.square[name][rows] = square
        self.weight[name][rows] -= np.float32(RATE) * g / np.sqrt(square)


def _stream(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end: each token, what stands before it, and 0 where a text begins."""
    lengths = np.array([len(x) // 2 for x in ids], np.int64)
    y = np.frombuffer(b"".join(ids), np.uint16).astype(np.int64)
    x = np.empty_like(y)
    x[1:] = y[:-1]
    keep = np.ones(len(y), np.float32)
    begins = np.cumsum(lengths) - lengths
    x[begins], keep[begins] = WORDS + SHAPES, 0
    return y, x, keep


def _trained(network: Network, batches) -> int:
    """Trains on all tokens of the batches; returns their number."""
    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        y, x, keep = _stream(batch.column("ids").to_pylist())
        seen += len(y)
        lanes = max(1, min(LANES, len(y) // (4 * STEPS)))
        long = -(-len(y) // lanes)
        y, x, keep = (np.resize(part, lanes * long) for part in (y, x, keep))  # the last lane is filled up from the first
        place = np.arange(lanes) * long
        h = np.zeros((lanes, STATE), np.float32)
        for at in range(0, long, STEPS):
            own = place + np.arange(at, min(at + STEPS, long))[:, None]
            h = network.learn(x[own], keep[own][..., None], y[own], h)
    return seen


def train(coded: DataFrame, known: Corpus, rounds=ROUNDS) -> np.ndarray:
    """The weights after all rounds over coded training documents. Round i takes those whose hash lies in its share of
    [0, 1); every document is in one round."""
    spark = coded.sparkSession
    network = Network.begun(known)
    size = Network.size()
    block = -(-size // BLOCKS)
    share = F.pmod(F.xxhash64("row", F.lit(13)), F.lit(1_000_000)) / 1_000_000
    low = 0.0
    for part in rounds:
        high = min(1.0, low + part)
        rows = coded.filter((share >= low) & (share < high)).select("ids")
        tasks = max(1, round((high - low) * known.tokens / TASK_TOKENS))
        shared = spark.sparkContext.broadcast(network.flat)

        def learn(batches, shared=shared):
            own = Network(shared.value.copy())
            seen = _trained(own, batches)
            if seen:
                for i in range(BLOCKS):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([float(seen)]), pa.array([own.flat[i * block : (i + 1) * block].tobytes()], pa.binary())], ["block", "weight", "flat"])

        def average(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for i, weight, flat in zip(*(batch.column(c).to_pylist() for c in ("block", "weight", "flat"))):
                    own = sums.setdefault(i, [0.0, 0.0])
                    own[0] += weight
                    own[1] = own[1] + weight * np.frombuffer(flat, np.float32).astype(np.float64)
            for i, (weight, flat) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([(flat / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "flat"])

        made = rows.coalesce(tasks).mapInArrow(learn, "block int, weight double, flat binary").repartition(BLOCKS, "block").mapInArrow(average, "block int, flat binary")
        for r in made.collect():  # one model
            network.flat[r.block * block : (r.block + 1) * block] = np.frombuffer(r.flat, np.float32)
        shared.unpersist()
        low = high
    return network.flat


def document_scores(network: Network, ids: list[bytes], steps: int = STEPS) -> np.ndarray:
    """The network's log10 probability of each text; its state goes through the whole text, window by window."""
    lengths = np.array([len(x) // 2 for x in ids], np.int64)
    out = np.zeros(len(ids))
    order = np.argsort(-lengths, kind="stable")
    y, x, _ = _stream(ids)
    for first in range(0, len(ids), LANES):  # texts of like length go together
        group = order[first : first + LANES]
        begins, sizes = (np.cumsum(lengths) - lengths)[group], lengths[group]
        h = np.zeros((len(group), STATE), network.flat.dtype)
        for at in range(0, int(sizes[0]), steps):
            n = int(np.searchsorted(-sizes, -at, "left"))  # longer than at
            place = np.arange(at, min(at + steps, int(sizes[0])))[:, None]
            own = np.minimum(begins[:n] + place, len(y) - 1)
            states = network.states(x[own], None, h[:n])
            h = states[-1].copy()
            if sizes[n - 1] >= at + steps:
                found = network.log10(states.reshape(-1, STATE), y[own].ravel()).reshape(len(own), n).sum(0)
            else:
                inside = place < sizes[:n]
                found = np.bincount(np.nonzero(inside)[1], network.log10(states[inside], y[own[inside]]), n)
            out[group[:n]] += found
    return out


def score(coded: DataFrame, flat: np.ndarray) -> DataFrame:
    """The coded table's columns but ids and rest, with `network`, the network's log10 probability."""
    keep = [c for c in coded.columns if c not in ("ids", "rest")]
    shared = coded.sparkSession.sparkContext.broadcast(flat)

    def apply(batches):
        network = Network(shared.value.copy())
        held: list[pa.RecordBatch] = []
        room = SIDE_BY_SIDE

        def scored():
            ids = [x for batch in held for x in batch.column("ids").to_pylist()]
            found, at = document_scores(network, ids), 0
            for batch in held:
                own = [np.frombuffer(x, np.uint16).astype(np.int64) for x in ids[at : at + batch.num_rows]]
                shapes = [np.bincount(x[x >= WORDS] - WORDS, minlength=SHAPES).tolist() for x in own]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found[at : at + len(own)]), pa.array(shapes, pa.list_(pa.int64()))], [*keep, "network", "shapes"])
                at += len(own)
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                room -= int(pc.sum(pc.binary_length(batch.column("ids"))).as_py()) // 2
            if room < 0:
                yield from scored()
                room = SIDE_BY_SIDE
        if held:
            yield from scored()

    schema = coded.select(*keep).schema.add("network", "double").add("shapes", ArrayType(LongType()))
    return coded.select(*keep, "ids").mapInArrow(apply, schema)


def language_model(docs: DataFrame, fold: int = 2, folds: int = 7, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out(fold, folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = written(word_counts(rows.filter("NOT held_out AND doc_id IS NOT NULL")))
    known = corpus(counts, frequent)
    coded = written(encode(rows, known))
    flat = train(coded.filter("NOT held_out AND doc_id IS NOT NULL"), known)
    rest = coded.select("row", F.explode("rest").alias("word")).join(counts.select("word", "n"), "word")
    rest = rest.groupBy("row").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 1)).alias("_log")).withColumnRenamed("row", "_row")
    out = score(coded, flat)
    out = out.join(rest, F.col("row") == F.col("_row"), "left")
    more = F.coalesce("_log", F.lit(0.0))
    shape = np.log10(known.shape_tokens + known.shape_distinct + 1.0)
    within = F.aggregate(F.zip_with("shapes", F.array(*[F.lit(float(x)) for x in shape]), lambda n, x: n * x), F.lit(0.0), lambda a, x: a + x)
    base = F.col("log_all") + more - F.col("n_tokens") * float(np.log10(known.tokens + known.distinct + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("network") + F.col("log_shape") + more - within).alias("score"),
    )
