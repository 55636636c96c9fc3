"""Benchmark decontamination with a generalised suffix automaton over the words of normalised test items.

The automaton of a block of items is built on the driver, packed into flat arrays and sent to the executors. Documents
stream through it: at each word it knows the longest suffix that occurs in some item. Where that reaches ``window``
words, a window of an item ends; a shorter item counts where it is matched as a whole. Before that, a table of the
items' word pairs (sixteen places for each) leaves only those runs of a document that can hold a window, so most words
never enter the Python loop.

A block holds items of about ``block_bytes``, and at least one. Usually that is all of them, and the documents are
read once. If there are more, items are dealt into blocks by hash, and each block makes a table of the texts that it hits,
by their MD5; in the end the documents meet these tables' sum once, so no block rewrites a text.

Cases: a null or empty text has no words and no hits; null items and items without words have no window; a null item_id
hits but is not listed; repeated items or ids count once; equal texts get equal rows. The docs' own columns never meet the
operator's.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm import textbuf as tb
from orelode.llm.cluster import arrow_map, join_spread, original_columns, other_columns, pieces, stored

BLOCK_BYTES = 2 << 20


class _Build:
    """The automaton while items are added: a table of arcs for each state, 0 the root."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur


class SuffixAutomaton:
    """All substrings (of words) of the items, in flat arrays: sorted arcs, suffix links, lengths, and what states report.

    A state reports if it holds a window (its longest string has ``window`` words, its link's hasn't) or a whole shorter
    item (which is its longest string). ``names`` are the items' ids; ``reported[first[s]:first[s + 1]]`` those of state s.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        sequences = [(key, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for key, ws in items if ws]
        self.least = min([min(len(s), window) for _, s in sequences], default=0)
        built = _Build()
        for _, seq in sequences:
            last = 0
            for c in seq:
                last = built.extend(last, c)
        arcs = sorted((state << 32 | c, to) for state, nxt in enumerate(built.next) for c, to in nxt.items())
        self.arcs, self.to = array("q", [k for k, _ in arcs]), array("i", [t for _, t in arcs])
        self.link, self.length = built.link, built.length
        n = len(self.length)
        del built, arcs
        self.names = sorted({key for key, _ in sequences if key is not None})
        number = {key: i for i, key in enumerate(self.names)}
        #: 1: holds a window; 2: is a whole short item.
        self.kind = bytearray(n)
        found: set[int] = set()
        for key, seq in sequences:
            state = matched = 0
            for c in seq:
                state, matched = self._step(state, c), matched + 1
                if matched >= window:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    matched = window  # what is longer makes no other window
                    self.kind[state] = 1
                    if key is not None:
                        found.add(state << 32 | number[key])
            if len(seq) < window:
                self.kind[state] = 2
                if key is not None:
                    found.add(state << 32 | number[key])
        ordered = np.sort(np.fromiter(found, np.int64, len(found)))
        self.first = array("i", np.searchsorted(ordered, np.arange(n + 1) << 32).tolist())
        self.reported = array("i", (ordered & 0xFFFFFFFF).tolist())
        # the next state up the links, itself left out, that reports
        self.up = array("i", bytes(4 * n))
        for state in sorted(range(1, n), key=self.length.__getitem__):
            link = self.link[state]
            self.up[state] = link if link > 0 and self.kind[link] else self.up[link] if link > 0 else 0

    def _step(self, state: int, c: int) -> int:
        """The state after a word, 0 if there is none."""
        key = state << 32 | c
        i = bisect_left(self.arcs, key)
        return self.to[i] if i < len(self.arcs) and self.arcs[i] == key else 0

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, array]]:
        """(first word, one past the last, numbers of items) of each window that ends at a word, in order of the words."""
        state, matched = 0, 0
        window, length, kind, first = self.window, self.length, self.kind, self.first
        for i, w in enumerate(words):
            c = self.ids.get(w)
            if c is None:
                state = matched = 0
                continue
            while not (to := self._step(state, c)) and state:
                state = self.link[state]
                matched = length[state]
            state, matched = (to, matched + 1) if to else (0, 0)
            up, n = state, matched
            while up:
                if kind[up] == 1 and n >= window:
                    yield i - window + 1, i + 1, self.reported[first[up] : first[up + 1]]
                elif kind[up] == 2 and n >= length[up]:
                    yield i - length[up] + 1, i + 1, self.reported[first[up] : first[up + 1]]
                up = self.up[up]
                n = length[up]


def _pair_table(automaton: SuffixAutomaton, sequences: list[list[bytes]]) -> np.ndarray:
    """A table, by hash, of the items' word pairs (of single words if an item has but one)."""
    bits = max(16, (16 * sum(map(len, sequences))).bit_length())
    table = np.zeros(1 << bits, bool)
    for seq in sequences:
        if seq:
            w = tb.words(pa.array([b" ".join(seq)], pa.binary()), tb.PLAIN)
            h = w.hashes()
            table[(tb.windows(h, 2) if automaton.least > 1 else h) >> np.uint64(64 - bits)] = True
    return table


def _scan(automaton: SuffixAutomaton, table: np.ndarray, w: tb.Words) -> Iterator[tuple[int, int, int, array]]:
    """(document, first word, one past the last word, items) of all windows, words counted over the batch."""
    h = w.hashes()
    pairs = automaton.least > 1
    good = table[(tb.windows(h, 2) if pairs else h) >> np.uint64(65 - len(table).bit_length())]
    if pairs:
        good &= tb.inside_doc(w, 2)
    change = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
    begins, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = stops - begins >= automaton.least - pairs
    begins, stops = begins[long], stops[long] + pairs
    docs = np.searchsorted(w.first, begins, "right") - 1
    data, starts, ends = w.mapped.tobytes(), w.starts, w.ends
    for doc, a, b in zip(docs.tolist(), begins.tolist(), stops.tolist(), strict=True):
        b = max(b, a)
        run = [data[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        if pairs:
            for first, last, items in automaton.stream(run):
                yield doc, a + first, a + last, items
        else:  # runs of single words may cross documents
            for part in range(doc, int(np.searchsorted(w.first, b, "left"))):
                lo, hi = max(a, int(w.first[part])), min(b, int(w.first[part + 1]))
                for first, last, items in automaton.stream(run[lo - a : hi - a]):
                    yield part, lo + first, lo + last, items


_SPAN = "array<struct<start:bigint,end:bigint>>"
_HITS = f"hit_words {_SPAN}, hit_bytes {_SPAN}, hit_items array<string>"


def _automaton(items: list[tuple[str | None, bytes]], window: int) -> tuple[SuffixAutomaton, np.ndarray]:
    """Of a block of items, with its table of pairs."""
    sequences = []
    for key, text in items:
        w = tb.words(pa.array([text], pa.binary()), tb.ALNUM_FOLDED)
        data = w.mapped.tobytes()
        sequences.append((key, [data[x:y] for x, y in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]))
    automaton = SuffixAutomaton(sequences, window)
    return automaton, _pair_table(automaton, [s for _, s in sequences])


def _hits(automaton: SuffixAutomaton, table: np.ndarray, w: tb.Words) -> Iterator[tuple[int, list[dict], list[dict], list[str]]]:
    """(document, spans in words, spans in bytes, items) of the documents that are hit."""
    spans: dict[int, list[tuple[int, int]]] = {}
    found: dict[int, set[int]] = {}
    for doc, first, last, items in _scan(automaton, table, w) if automaton.least else ():
        own = spans.setdefault(doc, [])
        while own and first <= own[-1][1]:
            x, y = own.pop()
            first, last = min(x, first), max(y, last)
        own.append((first, last))
        found.setdefault(doc, set()).update(items)
    for d, own in spans.items():
        base, origin = int(w.first[d]), int(w.bounds[d])
        in_bytes = [{"start": int(w.starts[a]) - origin, "end": int(w.ends[b - 1]) - origin} for a, b in own]
        yield d, [{"start": a - base, "end": b - base} for a, b in own], in_bytes, [automaton.names[i] for i in sorted(found[d])]


def _joined(parts: list[list[dict]]) -> list[dict]:
    """Spans of several blocks as disjoint ones."""
    out: list[dict] = []
    for s in sorted((s for p in parts for s in p), key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _texts_hit(texts: DataFrame, items: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    """``_md5`` and the hits of a block of items, of each text that it hits."""
    sent = texts.sparkSession.sparkContext.broadcast(_automaton(items, window))  # bounded by the block

    def run(batches):
        automaton, table = sent.value
        for batch in pieces(batches, "_body"):
            rows = list(_hits(automaton, table, tb.words(batch.column("_body").cast(pa.binary()), tb.ALNUM_FOLDED)))
            if rows:
                md5 = batch.column("_md5").take(pa.array([r[0] for r in rows]))
                yield pa.RecordBatch.from_arrays([md5, *[pa.array([r[i] for r in rows], batch_type) for i, batch_type in ((1, _ARROW_SPAN), (2, _ARROW_SPAN), (3, pa.list_(pa.string())))]], names=["_md5", "hit_words", "hit_bytes", "hit_items"])

    out = stored(arrow_map(texts, run, f"_md5 binary, {_HITS}").dropDuplicates(["_md5"]))
    sent.destroy()
    return out


_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, keys: list[str], window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: the ``keys`` columns, ``_body`` (the text), ``n_words``, ``hit_words`` and ``hit_bytes``
    (disjoint spans of hit words, in words and in UTF-8 bytes of the text) and ``hit_items`` (sorted ids as strings)."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("k"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length(F.coalesce("k", F.lit(""))) + 8)).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    source = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("_body"))
    own_names = source.columns
    fields = source.schema.simpleString().removeprefix("struct<").removesuffix(">")
    block = lambda b: [(r.k, r.t.encode()) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(n_blocks)) == b).collect()]  # noqa: E731  bounded

    def columns(batch, n_words, words, bytes_, names):
        own = [batch.column(c) for c in own_names]
        return pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(words, _ARROW_SPAN), pa.array(bytes_, _ARROW_SPAN), pa.array(names, pa.list_(pa.string()))], names=[*own_names, "n_words", "hit_words", "hit_bytes", "hit_items"])

    if n_blocks == 1:
        sent = docs.sparkSession.sparkContext.broadcast(_automaton(block(0), window))

        def run(batches):
            automaton, table = sent.value
            for batch in pieces(batches, "_body"):
                w = tb.words(batch.column("_body").cast(pa.binary()), tb.ALNUM_FOLDED)
                words, bytes_, names = ([[] for _ in range(batch.num_rows)] for _ in range(3))
                for d, *own in _hits(automaton, table, w):
                    words[d], bytes_[d], names[d] = own
                yield columns(batch, w.counts, words, bytes_, names)

        return arrow_map(source, run, f"{fields}, n_words bigint, {_HITS}")

    items = stored(items)
    md5 = F.unhex(F.md5(F.col("_body").cast("binary")))
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("_body")).where("_body is not null").withColumn("_md5", md5)
    every = None
    for b in range(n_blocks):
        found = _texts_hit(texts, block(b), window)
        every = found if every is None else every.unionByName(found)
    # a row a block at most for each text
    by_text = every.groupBy("_md5").agg(*[F.collect_list(c).alias(c) for c in ("hit_words", "hit_bytes", "hit_items")])
    joined = join_spread(source.withColumn("_md5", F.coalesce(md5, F.lit(b""))), by_text, "_md5").drop("_md5")

    def merge(batches):
        for batch in pieces(batches, "_body"):
            n_words = tb.words(batch.column("_body").cast(pa.binary()), tb.ALNUM_FOLDED).counts
            words, bytes_ = ([_joined(x) if x else [] for x in batch.column(c).to_pylist()] for c in ("hit_words", "hit_bytes"))
            yield columns(batch, n_words, words, bytes_, [sorted({n for p in x for n in p}) if x else [] for x in batch.column("hit_items").to_pylist()])

    return arrow_map(joined, merge, f"{fields}, n_words bigint, {_HITS}")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_cover: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without their contaminated spans; documents with more than ``max_cover`` of their words hit go whole.

    All columns of ``docs`` stay; only the text changes (and ``n_chars``, if there is one, follows it).
    """
    packed = docs.select(other_columns(docs, text).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    found = find_contamination(packed, benchmark, ["_row"], window, text="_text")
    found = found.withColumn("_hit", F.expr("aggregate(hit_words, 0L, (a, s) -> a + s.end - s.start)"))
    found = found.where(F.col("_hit") <= max_cover * F.col("n_words"))
    raw = F.encode("_body", "UTF-8")
    pieces_ = F.expr("concat(array(named_struct('start', 0L, 'end', 0L)), hit_bytes)")
    gaps = F.transform(pieces_, lambda s, i: F.struct(s["end"].alias("a"), F.coalesce(F.try_element_at("hit_bytes", (i + 1).cast("int"))["start"], F.octet_length("_body").cast("bigint")).alias("b")))
    kept = F.array_join(F.transform(gaps, lambda g: F.decode(F.substring(raw, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")), "UTF-8")), "")
    clean = F.when(F.size("hit_bytes") == 0, F.col("_body")).otherwise(kept)
    return found.select("_row", clean.alias("_clean")).select(*original_columns(docs, text, "_clean"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of query op4: counts, and the hash of the items found."""
    found = find_contamination(docs, benchmark, ["doc_id"], window)
    hit = F.expr("aggregate(hit_words, 0L, (a, s) -> a + s.end - s.start)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))
