"""A gated recurrent language model over words, in NumPy, that scores whole documents.

Counts. Every task counts its words (by 64-bit hash) and the counts meet in buckets. Up to ``COUNT_WORDS`` words above a
common threshold form a table of fixed size that all tasks hold; counts of all others stay in their buckets, and rarer
words of the documents are sent there, so a document's base score knows the exact count of each of its words.

Model. The most frequent words (``MODEL_WORDS``) have an input and an output vector of their own; all others share one
symbol, within which a word weighs what its smoothed count does, so the model is a distribution over all words. A GRU
reads the words; the output softmax is factored into a class (words of similar frequency) and a word in it. Output
biases start at the words' frequencies.

Training. Truncated backpropagation through time over ``WINDOW`` steps, on lanes of whole documents whose state is
carried from window to window and cleared between documents. Every training document is used, once. Documents are dealt to
shards by a hash of id and text, and within a shard they are in the order of it, so the model doesn't depend on how the
table is partitioned. First comes a warm start on one shard of about ``WARM_TOKENS``; then, in ``ROUNDS`` rounds, a copy is
trained from there on each of a round's shards, and the copies are averaged by their numbers of tokens for the next one.
A shard has ``SHARD_TOKENS`` or, where a round would have over ``COPIES`` of them, up to ``MOST_TOKENS``. What is gathered
thus grows with the input, while no sum is larger than one copy. Documents travel as packed symbols, not as text.

Cases: null and empty texts are one end token; without training text the base score is that of an unseen word and the
model is at its start; rows of equal or null id are scored each by itself; equal texts get equal scores up to rounding.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm import textbuf as tb
from orelode.llm.cluster import arrow_map, buckets_for, by_bucket, pieces, stored

HIDDEN, CLASSES, MODEL_WORDS = 16, 64, 8192
COUNT_WORDS = 1 << 20
WINDOW, LANES, SCORE_LANES = 32, 256, 256
ROUNDS, RATE, MEMORY = 4, 0.08, 1.0
WARM_TOKENS, SHARD_TOKENS, MOST_TOKENS, COPIES = 1 << 20, 2 << 20, 256 << 20, 4096
#: Tokens that a task lays out in lanes at once.
TRAIN_TOKENS, SCORE_TOKENS = 4 << 20, 4 << 20
_FLUSH = 1 << 21
#: Words whose softmax is worked out together; a window of few lanes is longer for that, up to so many times.
_WORDS_AT_ONCE, _LONGER = 8192, 4
END = np.uint64(0x0E2D0E2D0E2D0E2D)
_BLOCKS = 128
#: The largest input of a softmax: sums of larger ones would leave a 32-bit float.
_FAR = np.float32(60)
_COUNT = np.dtype([("word", "<u8"), ("n", "<i8")])
_RARE = np.dtype([("word", "<u8"), ("row", "<i8"), ("n", "<i4")])
_SUM = np.dtype([("row", "<i8"), ("log", "<f8"), ("known", "<i8")])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (tb.mix(h.copy()) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _packed(data: np.ndarray, of: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b + 1] > cuts[b]:
            yield b, data[order[cuts[b] : cuts[b + 1]]].tobytes()


def _merge(parts: list[np.ndarray]) -> np.ndarray:
    """Counts of the same word added up; sorted by word."""
    every = np.concatenate(parts) if parts else np.zeros(0, _COUNT)
    words, back = np.unique(every["word"], return_inverse=True)
    out = np.zeros(len(words), _COUNT)
    out["word"], out["n"] = words, np.bincount(back, weights=every["n"], minlength=len(words)).astype(np.int64)
    return out


def _tokens(body: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, in a row; and where each text starts."""
    w = tb.words(body.fill_null("").cast(pa.binary()), tb.FOLDED)
    first = w.first + np.arange(len(w.first))
    return np.insert(w.hashes(), w.first[1:], END), first


def count_words(training: DataFrame, buckets: int) -> DataFrame:
    """``bucket`` and ``counts``: all words (and ends) of the texts in ``_body``, packed and sorted."""

    def run(batches):
        parts, size = [], 0

        def emit():
            every = _merge(parts)
            for b, blob in _packed(every, _bucket(every["word"], buckets), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "counts"])

        for batch in pieces(batches, "_body", 2 << 20):
            words, n = np.unique(_tokens(batch.column("_body"))[0], return_counts=True)
            part = np.zeros(len(words), _COUNT)
            part["word"], part["n"] = words, n
            parts.append(part)
            size += len(part)
            if size > _FLUSH:
                parts = [_merge(parts)]
                size = len(parts[0])
                if size > _FLUSH // 2:
                    yield from emit()
                    parts, size = [], 0
        if size:
            yield from emit()

    def add(bucket, rows):
        every = _merge([np.frombuffer(r["counts"], _COUNT) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([every.tobytes()], pa.binary())], names=["bucket", "counts"])

    return stored(by_bucket(arrow_map(training.select("_body"), run, "bucket int, counts binary"), add, "bucket int, counts binary", buckets))


@dataclass
class Vocabulary:
    """Bounded: words above the threshold with their counts, sorted by hash; the model's words have a symbol, others ``rare``."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    total: int
    distinct: int
    #: Counts of the symbols in order; the last is ``rare``.
    symbol_counts: np.ndarray
    #: Where each class of symbols starts; and one past the last.
    classes: np.ndarray
    end: int

    @property
    def rare(self) -> int:
        return len(self.symbol_counts) - 1

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not in the table) and symbol of each word."""
        first, back = tb.distinct(h)
        unique = h[first]
        at = np.minimum(np.searchsorted(self.words, unique), len(self.words) - 1)
        found = self.words[at] == unique
        return np.where(found, self.counts[at], -1)[back], np.where(found, self.symbols[at], self.rare)[back]


_LEVELS = 16


def _level(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1)) * _LEVELS).astype(np.int64)


def vocabulary(counted: DataFrame, count_words: int = COUNT_WORDS, model_words: int = MODEL_WORDS, classes: int = CLASSES) -> Vocabulary:
    """Totals of all words, and the tables of the frequent ones."""

    def levels(batches):
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                n = np.frombuffer(blob, _COUNT)["n"]
                level, back = np.unique(_level(n), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(np.bincount(back).astype(np.int64)), pa.array(np.bincount(back, weights=n).astype(np.int64))], names=["level", "words", "tokens"])

    rows = sorted((r for r in arrow_map(counted.select("counts"), levels, "level bigint, words bigint, tokens bigint").groupBy("level").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()), reverse=True)
    total, distinct = sum(r.tokens for r in rows), sum(r.words for r in rows)
    least, n = 64 * _LEVELS, 0
    for r in rows:
        n += r.words
        if n > count_words:
            break
        least = r.level

    def above(batches):
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                c = np.frombuffer(blob, _COUNT)
                c = c[(_level(c["n"]) >= least) | (c["word"] == END)]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary())], names=["counts"])

    head = _merge([np.frombuffer(bytes(r.counts), _COUNT) for r in arrow_map(counted.select("counts"), above, "counts binary").collect()])
    if not (head["word"] == END).any():
        head = _merge([head, np.array([(END, 0)], _COUNT)])
    order = np.lexsort((head["word"], -head["n"]))
    # ends are always a symbol; classes hold about equal shares of the square roots of counts, and rare is one of its own
    chosen = order[: model_words - 1]
    if not (head["word"][chosen] == END).any():
        chosen = np.append(chosen[: model_words - 2], np.flatnonzero(head["word"] == END))
    symbols = np.full(len(head), len(chosen), np.int32)
    symbols[chosen] = np.arange(len(chosen))
    own = head["n"][chosen].astype(np.float64)
    share = np.cumsum(np.sqrt(own + 0.5))
    cls = np.minimum((share / share[-1] * (classes - 1)).astype(np.int64), classes - 2)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cls)) + 1, [len(chosen), len(chosen) + 1]])
    counts = np.append(own, max(0.0, total - own.sum()))
    return Vocabulary(head["word"].copy(), head["n"].copy(), symbols, int(total), int(distinct), counts, starts, int(symbols[np.flatnonzero(head["word"] == END)[0]]))


def _exp(x: np.ndarray) -> None:
    np.minimum(x, _FAR, out=x)
    np.exp(x, out=x)


class Model:
    """Parameters in one vector, with named views."""

    def __init__(self, v: Vocabulary, hidden: int = HIDDEN, seed: int = 7):
        n, c = len(v.symbol_counts), len(v.classes) - 1
        self.hidden, self.starts = hidden, v.classes
        self.class_of = np.repeat(np.arange(c), np.diff(v.classes))
        self.shapes = {"enter": (n, 3 * hidden), "recur": (hidden, 3 * hidden), "gate": (3 * hidden,), "cls": (hidden, c), "cls_bias": (c,), "word": (n, hidden), "word_bias": (n,)}
        self.vector = np.zeros(sum(math.prod(s) for s in self.shapes.values()), np.float32)
        self._views()
        rng = np.random.Generator(np.random.PCG64(seed))
        self.enter[:] = rng.normal(0, 0.1, self.enter.shape)
        self.recur[:] = rng.normal(0, 0.5 / math.sqrt(hidden), self.recur.shape)
        self.gate[:hidden] = 1.0  # keeps more of the state
        weight = np.log(v.symbol_counts + 0.5)
        self.word_bias[:] = weight
        self.cls_bias[:] = np.logaddexp.reduceat(weight, v.classes[:-1])
        self.cls_bias -= self.cls_bias.max()
        self.word_bias -= np.repeat(np.maximum.reduceat(weight, v.classes[:-1]), np.diff(v.classes))

    def _views(self) -> None:
        at = 0
        for name, shape in self.shapes.items():
            setattr(self, name, self.vector[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    def load(self, vector: np.ndarray) -> Model:
        self.vector = vector.astype(np.float32)
        self._views()
        return self

    def steps(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step (steps, lanes, hidden), and what backpropagation needs."""
        n, lanes, k = len(x), x.shape[1], self.hidden
        states, saved = np.empty((n, lanes, k), np.float32), []
        entered = self.enter[x] + self.gate
        for t in range(n):
            h = h * keep[t][:, None]
            u = h @ self.recur
            gates = entered[t, :, : 2 * k] + u[:, : 2 * k]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(entered[t, :, 2 * k :] + r * u[:, 2 * k :])
            saved.append((h, z, r, new, u[:, 2 * k :]))
            h = new + z * (h - new)
            states[t] = h
        return states, saved

    def by_class(self, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Classes and the places of their words."""
        cls = self.class_of[y]
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(self.starts)))
        for c in range(len(self.starts) - 1):
            if cuts[c + 1] > cuts[c]:
                yield c, order[cuts[c] : cuts[c + 1]]

    def log_probs(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the symbols ``y``."""
        logits = states @ self.cls
        logits += self.cls_bias
        out = np.minimum(logits[np.arange(len(y)), self.class_of[y]], _FAR)
        _exp(logits)
        total = logits @ np.ones(logits.shape[1], np.float32)
        for c, at in self.by_class(y):
            a, b = int(self.starts[c]), int(self.starts[c + 1])
            if b - a > 1:
                own = states[at] @ self.word[a:b].T
                own += self.word_bias[a:b]
                out[at] += np.minimum(own[np.arange(len(at)), y[at] - a], _FAR)
                _exp(own)
                total[at] *= own @ np.ones(b - a, np.float32)
        return out - np.log(total.astype(np.float64))


class Trainer:
    """Adagrad on the summed loss of each window."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate = model, rate
        self.memory = np.full(len(model.vector), MEMORY, np.float32)
        self.past = Model.__new__(Model)
        self.past.shapes, self.past.vector = model.shapes, self.memory
        self.past._views()

    def _step(self, name: str, grad: np.ndarray, rows: slice | np.ndarray = slice(None)) -> None:
        """``grad``: summed over the window's words."""
        past, own = getattr(self.past, name), getattr(self.model, name)
        past[rows] += grad * grad
        own[rows] -= self.rate * grad / np.sqrt(past[rows])

    def window(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, live: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One update from a window of lanes; returns the lanes' state after it."""
        m, k = self.model, self.model.hidden
        states, saved = m.steps(x, keep, h)
        at = np.flatnonzero(live.ravel())
        if not len(at):
            return states[-1]
        flat, target = states.reshape(-1, k)[at], y.ravel()[at]
        logits = flat @ m.cls
        logits += m.cls_bias
        _exp(logits)
        logits *= (1 / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
        logits[np.arange(len(at)), m.class_of[target]] -= 1
        up = logits @ m.cls.T
        d_cls, d_bias = flat.T @ logits, logits.sum(axis=0)
        for c, own in m.by_class(target):
            a, b = int(m.starts[c]), int(m.starts[c + 1])
            if b - a > 1:
                s = flat[own]
                p = s @ m.word[a:b].T
                p += m.word_bias[a:b]
                _exp(p)
                p *= (1 / (p @ np.ones(b - a, np.float32)))[:, None]
                p[np.arange(len(own)), target[own] - a] -= 1
                up[own] += p @ m.word[a:b]
                self._step("word", p.T @ s, slice(a, b))
                self._step("word_bias", p.sum(axis=0), slice(a, b))
        grad = np.zeros((states.shape[0] * states.shape[1], k), np.float32)
        grad[at] = up
        grad = grad.reshape(states.shape)
        carry = np.zeros_like(h)
        d_enter = np.empty((*x.shape, 3 * k), np.float32)
        d_recur = np.zeros_like(m.recur)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, new, un = saved[t]
            dh = grad[t] + carry
            da = dh * (1 - z) * (1 - new * new)
            d_enter[t, :, :k] = dh * (before - new) * z * (1 - z)
            d_enter[t, :, k : 2 * k] = da * un * r * (1 - r)
            d_enter[t, :, 2 * k :] = da
            g = d_enter[t].copy()
            g[:, 2 * k :] *= r
            d_recur += before.T @ g
            carry = (dh * z + g @ m.recur.T) * keep[t][:, None]
            carry[np.abs(carry) < 1e-15] = 0
        self._step("cls", d_cls)
        self._step("cls_bias", d_bias)
        self._step("recur", d_recur)
        flat_enter, inputs = d_enter.reshape(-1, 3 * k), x.ravel()
        self._step("gate", flat_enter.sum(axis=0))
        order = np.argsort(inputs, kind="stable")
        heads = np.concatenate([[0], np.flatnonzero(np.diff(inputs[order])) + 1])
        self._step("enter", np.add.reduceat(flat_enter[order], heads), inputs[order[heads]])
        return states[-1]


def lanes_of(lens: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest first."""
    n = max(1, min(most, len(lens), int(lens.sum() // max(1, lens.max())) + 1))
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for d in np.argsort(-lens, kind="stable").tolist():
        load, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (load + int(lens[d]), i))
    return out


def layout(symbols: np.ndarray, first: np.ndarray, most: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and keep flags (0 at a document's first word), steps by lanes; and each place's document (-1: none)."""
    lens = np.diff(first)
    lanes = sorted(lanes_of(lens, most), key=lambda lane: -int(lens[lane].sum()))  # the last ones end first
    steps = max(int(lens[lane].sum()) for lane in lanes)
    steps = -(-steps // WINDOW) * WINDOW
    y, doc = np.full((len(lanes), steps), end, np.int32), np.full((len(lanes), steps), -1, np.int32)
    x, keep = np.full((len(lanes), steps), end, np.int32), np.ones((len(lanes), steps), np.float32)
    for i, lane in enumerate(lanes):
        at = 0
        for d in lane:
            n = int(lens[d])
            own = symbols[first[d] : first[d + 1]]
            y[i, at : at + n], doc[i, at : at + n] = own, d
            x[i, at + 1 : at + n] = own[:-1]
            keep[i, at] = 0
            at += n
    return np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.ascontiguousarray(keep.T), np.ascontiguousarray(doc.T)


def train_documents(trainer: Trainer, symbols: np.ndarray, first: np.ndarray, end: int) -> None:
    x, y, keep, doc = layout(symbols, first, LANES, end)
    h = np.zeros((x.shape[1], trainer.model.hidden), np.float32)
    t = 0
    while t < len(x):
        n = max(1, int((doc[t] >= 0).sum()))  # lanes that haven't ended
        steps = WINDOW * min(_LONGER, max(1, _WORDS_AT_ONCE // (WINDOW * n)))
        own = np.s_[t : t + steps, :n]
        h = trainer.window(x[own], y[own], keep[own], doc[own] >= 0, h[:n])
        t += steps


def score_documents(model: Model, symbols: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The natural logarithm of each document's probability (of its symbols)."""
    x, y, keep, doc = layout(symbols, first, SCORE_LANES, end)
    out = np.zeros(len(first) - 1)
    h = np.zeros((x.shape[1], model.hidden), np.float32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for t in range(0, len(x), WINDOW):
        n = int((doc[t] >= 0).sum())
        own = np.s_[t : t + WINDOW, :n]
        states, _ = model.steps(x[own], keep[own], h[:n])
        h = states[-1]
        at = np.flatnonzero(doc[own].ravel() >= 0)
        held.append((states.reshape(-1, model.hidden)[at], y[own].ravel()[at], doc[own].ravel()[at]))
        size += len(at)
        if size >= _WORDS_AT_ONCE or t + WINDOW >= len(x):
            states_, targets, docs = (np.concatenate(c) for c in zip(*held, strict=True))
            out += np.bincount(docs, weights=model.log_probs(states_, targets), minlength=len(out))
            held, size = [], 0
    return out


def _blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches together, with their tokens' hashes and the documents' first tokens, of about ``most`` tokens."""
    held, hashes, firsts, n = [], [], [], 0
    for batch in pieces(batches, column, 1 << 20):
        h, first = _tokens(batch.column(column))
        held.append(batch)
        hashes.append(h)
        firsts.append(first[:-1] + n)
        n += len(h)
        if n >= most:
            yield held, np.concatenate(hashes), np.append(np.concatenate(firsts), n)
            held, hashes, firsts, n = [], [], [], 0
    if held:
        yield held, np.concatenate(hashes), np.append(np.concatenate(firsts), n)


def rounds_of(tokens: int) -> tuple[float, int]:
    """The share of documents that warms up, and the shards of each round, for so many training tokens."""
    warm = min(1.0, WARM_TOKENS / max(1, tokens))
    rest = tokens * (1 - warm) / ROUNDS
    each = min(MOST_TOKENS, max(SHARD_TOKENS, rest / COPIES))
    return warm, math.ceil(rest / each)


def place_of(order: np.ndarray, warm: float, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The round (0: warm start) and the shard of documents by their 64-bit hashes."""
    share = order.view(np.uint64).astype(np.float64) / 2.0**64
    late = (share >= warm) & (shards > 0)
    at = np.clip((share - warm) / max(1 - warm, 1e-12) * (ROUNDS * shards), 0, max(0, ROUNDS * shards - 1)).astype(np.int64)
    return np.where(late, 1 + at // max(1, shards), 0), np.where(late, at % max(1, shards), 0)


def deal(training: DataFrame, v: Vocabulary, sent_v) -> DataFrame:
    """``turn``, ``shard``, ``order`` (hash) and ``symbols`` (packed, 16 or 32 bits each) of each training document."""
    warm, shards = rounds_of(v.total)
    kind = np.dtype("<u2" if len(v.symbol_counts) <= 1 << 16 else "<u4")

    def run(batches):
        v = sent_v.value
        for held, h, first in _blocks(batches, "_body", 1 << 20):
            symbols = v.look_up(h)[1].astype(kind)
            order = pa.chunked_array([b.column("_order") for b in held]).combine_chunks()
            turn, shard = place_of(order.to_numpy(), warm, shards)
            packed = pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer((first * kind.itemsize).astype(np.int32)), pa.py_buffer(symbols.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(shard, pa.int32()), order, packed], names=["turn", "shard", "order", "symbols"])

    rows = training.select("_body", F.xxhash64("_key", "_body").alias("_order"))
    return stored(arrow_map(rows, run, "turn int, shard int, order bigint, symbols binary"), "turn")


def train(training: DataFrame, v: Vocabulary) -> np.ndarray:
    """The parameters after the warm start and all rounds."""
    spark = training.sparkSession
    sent_v = spark.sparkContext.broadcast(v)  # bounded by COUNT_WORDS
    dealt = deal(training, v, sent_v)
    kind = np.dtype("<u2" if len(v.symbol_counts) <= 1 << 16 else "<u4")
    vector = Model(v).vector
    _, shards = rounds_of(v.total)
    for turn in range(ROUNDS + 1 if shards else 1):
        sent = spark.sparkContext.broadcast(vector)

        def run(batches, sent=sent):
            v = sent_v.value
            own, trainer, seen, held, size = None, None, 0, [], 0

            def step():
                lens = np.array([len(x) // kind.itemsize for x in held], np.int64)
                train_documents(trainer, np.frombuffer(b"".join(held), kind).astype(np.int32), np.concatenate([[0], np.cumsum(lens)]), v.end)

            def copy():
                for b, part in enumerate(np.array_split(trainer.model.vector, _BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([own], pa.int32()), pa.array([seen], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["bucket", "shard", "tokens", "part"])

            for batch in batches:
                for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
                    if shard != own or size >= TRAIN_TOKENS:
                        if held:
                            step()
                        held, size = [], 0
                    if shard != own:
                        if trainer is not None:
                            yield from copy()
                        own, trainer, seen = shard, Trainer(Model(v).load(sent.value.copy())), 0
                    held.append(packed)
                    size += len(packed) // kind.itemsize
                    seen += len(packed) // kind.itemsize
            if held:
                step()
                yield from copy()

        def add(batches):
            own, total, weight = None, None, 0

            def mean():
                return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["bucket", "part"])

            for batch in batches:  # one copy's block at a time, in the order of the shards
                for b, n, part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tokens", "part")), strict=True):
                    if b != own:
                        if own is not None:
                            yield mean()
                        own, total, weight = b, 0.0, 0
                    total, weight = total + np.frombuffer(part, np.float32).astype(np.float64) * n, weight + n
            if own is not None:
                yield mean()

        rows = dealt.where(F.col("turn") == turn).select("shard", "order", "symbols")
        rows = rows.repartitionById(shards if turn else 1, "shard").sortWithinPartitions("shard", "order", "symbols")
        copies = arrow_map(rows, run, "bucket int, shard int, tokens bigint, part binary")
        means = arrow_map(copies.repartition(_BLOCKS, "bucket").sortWithinPartitions("bucket", "shard"), add, "bucket int, part binary")
        parts = {r.bucket: bytes(r.part) for r in means.collect()}  # one vector
        if parts:
            vector = np.concatenate([np.frombuffer(parts[b], np.float32) for b in range(_BLOCKS)])
    return vector


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``_key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score``, learning from the documents that aren't held out."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").alias("_key"), held_out.alias("_held"), F.col(f"`{text}`").cast("string").alias("_body"))
    training = source.where(~F.col("_held"))
    buckets = buckets_for(source, 32 << 20, 16)
    counted = count_words(training, buckets)
    v = vocabulary(counted)
    vector = train(training, v)
    sent = spark.sparkContext.broadcast((v, vector))
    key_type = source.schema["_key"].dataType.simpleString()
    ln10 = math.log(10)
    base_log = math.log10(v.total + 0.5 * (v.distinct + 1))
    n_rare, v_rare = v.symbol_counts[-1], v.distinct - int((v.symbol_counts[:-1] > 0).sum())
    rare_log = math.log10(n_rare + 0.5 * (v_rare + 1))

    def run(batches):
        from pyspark import TaskContext

        v, vector = sent.value
        model = Model(v).load(vector)
        row0 = TaskContext.get().partitionId() << 33
        schema, rare, size = None, [], 0

        def emit():
            every = np.concatenate(rare)
            for b, blob in _packed(every, _bucket(every["word"], buckets), buckets):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in schema][:-2], pa.array([b], pa.int32()), pa.array([blob], pa.binary())], schema=schema)

        for held, h, first in _blocks(batches, "_body", SCORE_TOKENS):
            schema = schema or pa.schema([("_row", pa.int64()), ("_key", held[0].schema.field("_key").type), ("_held", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("log", pa.float64()), ("model", pa.float64()), ("n_rare", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary())])
            n_docs = len(first) - 1
            doc = np.repeat(np.arange(n_docs), np.diff(first))
            counts, symbols = v.look_up(h)
            there = counts >= 0
            logs = np.log10(np.maximum(counts, 0) + 0.5)
            sums = lambda w: np.bincount(doc, weights=w, minlength=n_docs)
            in_rare = symbols == v.rare
            model_score = score_documents(model, symbols, first, v.end) / ln10 + sums(np.where(in_rare & there, logs, 0.0)) - rare_log * sums(in_rare)
            rows = row0 + np.arange(n_docs)
            row0 += n_docs
            columns = [pa.array(rows), pa.chunked_array([b.column("_key") for b in held]).combine_chunks(), pa.chunked_array([b.column("_held") for b in held]).combine_chunks(), pa.array(np.diff(first)), pa.array(sums(counts > 0).astype(np.int64)), pa.array(sums(np.where(there, logs, 0.0))), pa.array(model_score), pa.array(sums(~there).astype(np.int64)), pa.nulls(n_docs, pa.int32()), pa.nulls(n_docs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            away = np.flatnonzero(~there)
            if len(away):
                part = np.zeros(len(away), _RARE)
                part["word"], part["row"], part["n"] = h[away], rows[doc[away]], 1
                rare.append(part)
                size += len(part)
            if size > _FLUSH:
                yield from emit()
                rare, size = [], 0
        if rare:
            yield from emit()

    fields = f"_row bigint, _key {key_type}, _held boolean, n bigint, known bigint, log double, model double, n_rare bigint, bucket int, packed binary"
    found = stored(arrow_map(source, run, fields))

    def join(bucket, rows):
        counts = np.concatenate([np.zeros(0, _COUNT), *[np.frombuffer(r["counts"], _COUNT) for r in rows if r["counts"] is not None]])
        for r in rows:
            if r["packed"] is None:
                continue
            rare = np.frombuffer(r["packed"], _RARE)
            n = np.zeros(len(rare), np.int64)
            if len(counts):
                at = np.minimum(np.searchsorted(counts["word"], rare["word"]), len(counts) - 1)
                n = np.where(counts["word"][at] == rare["word"], counts["n"][at], 0)
            docs_, back = np.unique(rare["row"], return_inverse=True)
            out = np.zeros(len(docs_), _SUM)
            out["row"], out["log"], out["known"] = docs_, np.bincount(back, weights=np.log10(n + 0.5)), np.bincount(back, weights=n > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(docs_[0] >> 33)], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["part", "sums"])

    rare_rows = found.where("bucket is not null").select("bucket", F.lit(None).cast("binary").alias("counts"), "packed")
    both = rare_rows.unionByName(counted.select("bucket", "counts", F.lit(None).cast("binary").alias("packed")))
    sums = by_bucket(both, join, "part bigint, sums binary", buckets)

    def add(bucket, rows):
        every = np.concatenate([np.frombuffer(r["sums"], _SUM) for r in rows])
        docs_, back = np.unique(every["row"], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(docs_), pa.array(np.bincount(back, weights=every["log"])), pa.array(np.bincount(back, weights=every["known"]).astype(np.int64))], names=["_row", "rare_log", "rare_known"])

    totals = by_bucket(sums.withColumnRenamed("part", "bucket"), add, "_row bigint, rare_log double, rare_known bigint", buckets)
    own = found.where("bucket is null").join(totals, "_row", "left")
    more = F.coalesce("rare_log", F.lit(0.0))
    return own.select("_key", F.col("_held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"), (F.col("log") + more - F.lit(base_log) * F.col("n")).alias("base_score"), (F.col("model") + more).alias("score"))


def score_digest(docs: DataFrame) -> DataFrame:
    """The rows of query op1."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(True))
    return score(docs, held).withColumnRenamed("_key", "doc_id")
