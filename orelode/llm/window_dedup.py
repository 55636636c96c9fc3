"""Substring deduplication by super-k-mer partitioning, over windows of ``k`` words.

The minimiser of a window is its smallest hashed run of ``m`` words. Equal windows have equal minimisers, and consecutive
windows mostly share one, so a run of windows that share theirs travels as one packed string (a slice of the text) to
the minimiser's bucket, where the windows are sorted by a 128-bit hash and counted. A window that occurs twice or more,
in the same text or in any other, is repeated; every word in a repeated window is removed.

Most runs needn't travel: a window can only be repeated if its minimiser occurs in two runs (or twice in one, which the
task itself sees). So minimisers are counted first, bucket by bucket; those that occur twice are put into a bit table of
fixed size, and only runs that pass it are sent. A full table would cost time, never results.

A run's string and its places go different ways. Of each string a task sends one copy, with how often it has seen it, and
these are added up before the bucket is sorted, so a bucket holds each string once however many texts share it. The
bucket says which words of which strings are repeated; places (string, first word, text) then meet those by the string's
hash, and texts their spans; neither the places of a hot string nor the copies of a hot text gather in one task
(``join_spread``). Copies of a text send a place once for each task, and those are made distinct by a key that spreads
them. Texts are known by their MD5, never by an id.

Cases: null and empty texts have no words; texts of fewer than ``k`` words have no window; a text that occurs twice
loses all words if it has a window; null or repeated ids don't matter, nor do the docs' other columns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm import textbuf as tb
from orelode.llm.cluster import arrow_map, buckets_for, by_bucket, join_spread, original_columns, other_columns, pieces, stored

WORDS, MINIMISER = 35, 8
#: Bits in the table of minimisers that occur twice: 16 MB, whatever the input.
TABLE_BITS = 27
_FLUSH = 1 << 21


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` consecutive values."""
    size, out = 1, x
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == n else np.minimum(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1])


class Runs:
    """The super-k-mers of a batch: ``start`` (first window, which is its first word), ``n`` windows and ``minimiser``."""

    def __init__(self, w: tb.Words, k: int, m: int):
        h = w.hashes()
        own = tb.inside_doc(w, k)
        self.window_hash = tb.windows(h, k)
        least = _sliding_min(tb.windows(h, m), k - m + 1) if len(h) >= k else np.zeros(0, np.uint64)
        doc = w.doc[: len(own)]
        new = own.copy()
        new[1:] &= ~own[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        self.start = np.flatnonzero(new)
        inside = np.cumsum(own)
        ends = np.concatenate([self.start[1:], [len(own)]]) if len(self.start) else self.start
        self.n = inside[ends - 1] - inside[self.start] + 1 if len(self.start) else ends
        self.minimiser = least[self.start]
        self.doc = doc[self.start]
        self.own = own


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)


def _texts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(*[F.col(f"`{k}`") for k in keys], body.alias("_body"), F.unhex(F.md5(body.cast("binary"))).alias("_md5"))


def _minimisers(source: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """Minimisers by bucket: ``once`` and ``twice`` hold those that a task has seen once and more often, as 64-bit integers."""

    def emit(parts: list[np.ndarray], again: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        if again:
            counts[np.isin(keys, np.concatenate(again))] = 2
        of = _bucket(keys, buckets)
        for a, b in _ranges(of):
            once = counts[a:b] == 1
            yield pa.RecordBatch.from_arrays([pa.array([int(of[a])], pa.int32()), pa.array([keys[a:b][once].tobytes()], pa.binary()), pa.array([keys[a:b][~once].tobytes()], pa.binary())], names=["bucket", "once", "twice"])

    def run(batches):
        parts, again, size = [], [], 0
        for batch in pieces(batches, "_body"):
            w = tb.words(batch.column("_body").cast(pa.binary()), tb.PLAIN)
            r = Runs(w, k, m)
            parts.append(r.minimiser)
            size += len(r.minimiser)
            # windows that are repeated in this batch: their runs count twice
            at = np.flatnonzero(r.own)
            keys = r.window_hash[at]
            order = np.argsort(keys)
            same = order[1:][keys[order[1:]] == keys[order[:-1]]]
            if len(same):
                again.append(r.minimiser[np.searchsorted(r.start, at[same], "right") - 1])
            if size > _FLUSH:
                yield from emit(parts, again)
                parts, again, size = [], [], 0
        if size:
            yield from emit(parts, again)

    return arrow_map(source.select("_body"), run, "bucket int, once binary, twice binary")


def _ranges(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where a sorted array's equal values lie."""
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    return zip(cuts[:-1], cuts[1:], strict=True) if len(of) else iter(())


def _repeated_table(source: DataFrame, k: int, m: int) -> np.ndarray:
    """The bit table (as bytes of 8 bits) of minimisers that occur twice or more."""
    buckets = min(buckets_for(source, 32 << 20), 1 << 12)
    each = (1 << TABLE_BITS) // buckets

    def fn(bucket, rows):
        once = np.concatenate([np.frombuffer(r["once"], np.uint64) for r in rows])
        keys, counts = np.unique(once, return_counts=True)
        twice = np.concatenate([keys[counts > 1], *[np.frombuffer(r["twice"], np.uint64) for r in rows]])
        bits = np.zeros(each, bool)
        bits[(twice >> np.uint64(64 - TABLE_BITS)).astype(np.int64) - bucket * each] = True
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bucket", "bits"])

    table = np.zeros((buckets, each // 8), np.uint8)
    for row in by_bucket(_minimisers(source, k, m, buckets), fn, "bucket int, bits binary", buckets).collect():
        table[row.bucket] = np.frombuffer(zlib.decompress(bytes(row.bits)), np.uint8)
    return table.reshape(-1)


def _runs(source: DataFrame, table: np.ndarray, k: int, m: int, buckets: int) -> DataFrame:
    """Of runs that may hold a repeated window: rows of strings (``bucket``, ``run``: the string's hash, ``string``, ``n``: 1, or
    2 for more) and rows of places (``run``, ``at``: the first word, ``text``; ``bucket`` null)."""
    import xxhash

    sent = source.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bits = sent.value
        known: dict[bytes, list] = {}  # by hash: bucket, string, how often
        size = 0

        def emit():
            rows = [(b, h, s, min(n, 2)) for h, (b, s, n) in known.items()]
            for a in range(0, len(rows), 2000):
                bucket, name, string, n = zip(*rows[a : a + 2000], strict=True)
                none = len(bucket)
                yield _batch(pa.array(bucket, pa.int32()), pa.array(name, pa.binary()), pa.array(string, pa.binary()), pa.array(n, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()))

        def _batch(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(columns), names=["bucket", "run", "string", "n", "at", "text"])

        for batch in pieces(batches, "_body"):
            w = tb.words(batch.column("_body").cast(pa.binary()), tb.PLAIN)
            r = Runs(w, k, m)
            place = r.minimiser >> np.uint64(64 - TABLE_BITS)
            keep = np.flatnonzero(bits[(place >> np.uint64(3)).astype(np.int64)] & (np.uint8(128) >> (place & np.uint64(7)).astype(np.uint8)))
            if not len(keep):
                continue
            start, n = r.start[keep], r.n[keep]
            data, md5 = w.raw.tobytes(), batch.column("_md5").to_pylist()
            bucket, texts, names = _bucket(r.minimiser[keep], buckets).tolist(), [md5[d] for d in r.doc[keep].tolist()], []
            for b, x, y in zip(bucket, w.starts[start].tolist(), w.ends[start + n + k - 2].tolist(), strict=True):
                string = data[x:y]
                names.append(xxhash.xxh3_128_digest(string))
                own = known.setdefault(names[-1], [b, string, 0])
                own[2] += 1
                size += (len(string) + 64) * (own[2] == 1)
            at, none = (start - w.first[r.doc[keep]]).astype(np.int32), len(keep)
            yield _batch(pa.nulls(none, pa.int32()), pa.array(names, pa.binary()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.int32()), pa.array(at), pa.array(texts, pa.binary()))
            if size > 48 << 20:
                yield from emit()
                known.clear()
                size = 0
        yield from emit()

    return arrow_map(source.select("_body", "_md5"), run, "bucket int, run binary, string binary, n int, at int, text binary")


def _count_bucket(names: list[bytes], strings: list[bytes], counts: list[int], k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(run, word spans to remove, from its first word) of a bucket's strings that hold a repeated window."""
    w = tb.words(pa.array(strings, pa.binary()), tb.PLAIN)
    h = w.hashes()
    own = np.flatnonzero(tb.inside_doc(w, k))
    run = w.doc[own]
    one, two = tb.windows(h, k)[own], tb.windows(h, k, 1)[own]
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=np.array(counts, np.int64)[run[order]])
    repeated = np.zeros(len(order), bool)
    repeated[order] = total[group] > 1
    # stretches of repeated windows; no run ends within one of another
    edge = np.zeros(len(w) + 2, np.int8)
    edge[1 + own[repeated]] = 1
    change = np.diff(edge)
    begins, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + k - 1
    of = np.searchsorted(w.first, begins, "right") - 1
    spans = np.stack([begins - w.first[of], stops - w.first[of]], axis=1).astype(np.int32)
    cuts = np.searchsorted(of, np.arange(len(names) + 1))
    for i in np.unique(of).tolist():
        yield names[i], spans[cuts[i] : cuts[i + 1]]


def repeated_spans(source: DataFrame, k: int = WORDS, m: int = MINIMISER) -> DataFrame:
    """``_md5`` of a text and ``spans``: the words to remove, as packed pairs (first, one past the last) of 32-bit integers."""
    table = _repeated_table(source, k, m)
    buckets = buckets_for(source, 1 << 20)
    found = stored(_runs(source, table, k, m, buckets))
    strings = found.where("bucket is not null").select("bucket", "run", "string", "n")
    tasks = max(2, min(buckets, max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 16)))
    # equal strings are in one bucket, so they are added up where they arrive
    added = strings.repartition(tasks, "bucket").groupBy("bucket", "run").agg(F.min("string").alias("string"), F.sum("n").alias("n"))

    def count(batches):
        current, rows = None, []

        def spans() -> Iterator[pa.RecordBatch]:
            out = list(_count_bucket(*(list(c) for c in zip(*rows, strict=True)), k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.binary()), pa.array([s.tobytes() for _, s in out], pa.binary())], names=["run", "spans"])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "run", "string", "n")), strict=True):
                if bucket != current and rows:
                    yield from spans()
                    rows = []
                current = bucket
                rows.append(row)
        if rows:
            yield from spans()

    spans = stored(arrow_map(added.sortWithinPartitions("bucket"), count, "run binary, spans binary"))
    places = found.where("bucket is null").select("run", "at", "text")
    every = join_spread(places, spans, "run").where("spans is not null").select("text", "at", "spans").distinct()

    def shift(batches):
        for batch in batches:
            at = np.array(batch.column("at").to_pylist(), np.int32)
            out = [(np.frombuffer(s, np.int32) + a).tobytes() for s, a in zip(batch.column("spans").to_pylist(), at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(out, pa.binary())], names=["_md5", "spans"])

    return stored(arrow_map(every, shift, "_md5 binary, spans binary").groupBy("_md5").agg(F.collect_list("spans").alias("spans")))


def _removed(spans: list[bytes] | None, n: int) -> np.ndarray:
    """Which of ``n`` words the spans cover."""
    change = np.zeros(n + 1, np.int32)
    if spans:
        pairs = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def dedup_digest(docs: DataFrame, k: int = WORDS, m: int = MINIMISER) -> DataFrame:
    """The rows of query op8."""
    source = _texts(docs, ["doc_id"], "text")
    joined = join_spread(source, repeated_spans(source, k, m), "_md5").select("doc_id", "_body", "spans")
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "_body"):
            n_words, n_removed, digest = [], [], []
            for body, spans in zip(batch.column("_body").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = body.split()  # at the six ASCII white-space bytes
                gone = _removed(spans, len(words)) if spans else None
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return arrow_map(joined, run, f"doc_id {key}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, k: int = WORDS, m: int = MINIMISER, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from their texts (white space after a removed word goes with it).

    Documents that had words and lose them all go; all other rows and columns stay (``n_chars``, if any, follows the text).
    """
    packed = docs.select(other_columns(docs, text).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    body = F.coalesce("_text", F.lit(""))
    source = packed.withColumns({"_body": body, "_md5": F.unhex(F.md5(body.cast("binary")))})
    joined = join_spread(source.select("_row", "_text", "_md5"), repeated_spans(source, k, m), "_md5").select("_row", "_text", "spans")

    def run(batches):
        for batch in pieces(batches, "_text"):
            rows, texts = [], []
            spans = batch.column("spans").to_pylist()
            w = tb.words(batch.column("_text").cast(pa.binary()), tb.PLAIN)
            data = w.raw.tobytes()
            original = batch.column("_text").to_pylist()
            for d in range(batch.num_rows):
                new = original[d]
                if spans[d]:
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    gone = _removed(spans[d], b - a)
                    if gone.all():
                        continue
                    nexts = np.concatenate([w.starts[a + 1 : b], [w.bounds[d + 1]]]).tolist()
                    kept = [data[x:y] for x, y, g in zip(w.starts[a:b].tolist(), nexts, gone.tolist(), strict=True) if not g]
                    new = (data[int(w.bounds[d]) : int(w.starts[a])] + b"".join(kept)).decode()
                rows.append(d)
                texts.append(new)
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["_row", "_clean"])

    row = joined.schema["_row"].dataType.simpleString()
    out = arrow_map(joined, run, f"_row {row}, _clean string")
    return out.select(*original_columns(docs, text, "_clean"))
