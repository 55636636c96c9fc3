"""Language identification with string kernels.

The kernel of two texts is the blended spectrum in its presence form: how many byte n-grams (orders 1 to 3, hashed to
``DIMENSIONS`` places) occur in both, over the geometric mean of how many each has. Nyström landmarks stand for the
training texts, kernel ridge regression gives one machine per language (one against the rest), and texts are scored in
blocks: a presence matrix times the landmarks' matrix, times the machines' weights.

A bounded sample of labelled rows fits the machines: ``per_language`` texts of each language, those of smallest hash
(``per_language`` is the documented bound). Every text is scored as a whole; only its bytes are an input.

A machine's score only says which language is nearest: it is about 0.5 for a text that resembles no landmark. Whether a
text is like its language at all is told by coverage, the share of its n-grams that are usual in that language's sample
(they occur in at least two of its texts and a hundredth of them). It falls to 0 for other scripts, other languages and
gibberish of any length; the least that is taken as alike is a share of the median that the sample's own texts reach,
each measured without itself.

Cases: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing is labelled;
equal texts get equal predictions; of equal scores the alphabetically first language wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.llm import textbuf as tb
from orelode.llm.cluster import arrow_map, original_columns, other_columns, pieces, text_of

DIMENSIONS = 1 << 15
PER_LANGUAGE = 500
LANDMARKS = 160
RIDGE = 1e-2
#: Of the median coverage in a language's sample, the share that a text like it reaches at least.
LIKE = 2 / 3
_BLOCK = 64
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def presence(texts: pa.Array) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed n-grams occur in it."""
    raw, bounds = tb.raw_bytes(texts.cast(pa.binary()))
    folded = _FOLD[raw]
    capital = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    folded[capital] += 0x20
    code = folded.astype(np.uint32)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    hashed = []
    for order in (1, 2, 3):
        hashed.append(((code + np.uint32(order << 28)) * np.uint32(2654435761)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1))
        code = (code[:-1] << np.uint32(8)) | folded[order:]
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for order, h in enumerate(hashed):
            out[d, h[a : max(a, b - order)]] = 1
    return out


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1) * np.maximum(landmarks.sum(axis=1), 1))
    return (x @ landmarks.T) / norm


@dataclass
class Machines:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    usual: np.ndarray
    least: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _kernel(x, self.landmarks) @ self.weights

    def alike(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether presence rows are covered as texts of the languages ``own`` (by number) are."""
        return _coverage(x, self.usual)[np.arange(len(own)), own] >= self.least[own]


def _coverage(x: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The share of each row's n-grams that are usual in each language."""
    return (x @ usual.T) / np.maximum(x.sum(axis=1, keepdims=True), 1)


def _usual(bits: np.ndarray) -> tuple[np.ndarray, float]:
    """Which n-grams are usual in a language's presence rows (packed bits), and the least coverage of a text like them."""
    blocks = [bits[a : a + _BLOCK] for a in range(0, len(bits), _BLOCK)]
    n = sum(np.unpackbits(b, axis=1).sum(axis=0, dtype=np.int32) for b in blocks)
    often = max(2, math.ceil(len(bits) / 100))
    # a text is measured without itself: what is left has to be usual
    others = (n > often).astype(np.float32)[None]
    reached = np.concatenate([_coverage(np.unpackbits(b, axis=1).astype(np.float32), others)[:, 0] for b in blocks])
    return (n >= often).astype(np.float32), LIKE * float(np.median(reached))


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Machines | None:
    """Ridge regression on Nyström features of presence rows (packed bits); landmarks are the first rows of each language."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([[1.0 if lang == own else -1.0 for lang in languages] for own in labels])
    each = max(2, landmarks // len(languages))
    of = np.array(labels)
    marks = np.unpackbits(bits[np.concatenate([np.flatnonzero(of == lang)[:each] for lang in languages])], axis=1).astype(np.float32)
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = np.concatenate([_kernel(np.unpackbits(bits[a : a + _BLOCK], axis=1).astype(np.float32), marks) for a in range(0, len(bits), _BLOCK)]) @ root
    weight = np.array([1.0 / (of == own).sum() for own in labels])[:, None]  # languages count alike
    solved = np.linalg.solve(z.T @ (z * weight) + ridge * np.eye(z.shape[1]), z.T @ (y * weight))
    usual, least = zip(*[_usual(bits[of == lang]) for lang in languages], strict=True)
    return Machines(languages, marks, (root @ solved).astype(np.float32), np.stack(usual), np.array(least))


def _has_letter(texts: pa.Array) -> np.ndarray:
    raw, bounds = tb.raw_bytes(texts.cast(pa.binary()))
    ascii_ = np.diff(np.concatenate([[0], np.cumsum(_LETTER[raw])])[bounds]) > 0
    for d in np.flatnonzero(~ascii_):
        ascii_[d] = any(map(str.isalpha, texts[int(d)].as_py() or ""))
    return ascii_


def train(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Machines | None:
    """Machines fitted to a bounded sample of the rows that ``where`` admits."""
    body = F.col(f"`{text}`").cast("string")
    rows = docs.where(where & F.col(f"`{lang}`").isNotNull() & body.isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("_lang"), body.alias("_body"), F.xxhash64(body).alias("_hash"))
    # the hash up to which a language's texts are taken: hashes fall evenly, so about twice as many as are wanted lie below a
    # bound that follows from how many there are, and only those are put in order (of a small language all)
    hashes = rows.select("_lang", "_hash")
    counts = hashes.groupBy("_lang").agg(F.approx_count_distinct("_hash").alias("n")).collect()  # a line for each language
    bound = {r._lang: min(2**63 - 1, int(-(2**63) + 2**64 * 2 * per_language / max(1, r.n))) for r in counts}
    if not bound:
        return None
    upto = F.create_map(*[F.lit(x) for pair in sorted(bound.items()) for x in pair])
    hashes = hashes.where(F.col("_hash") <= F.try_element_at(upto, F.col("_lang"))).distinct()
    hashes = hashes.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))).where(F.col("_n") <= per_language).drop("_n")
    cut = {r._lang: r.cut for r in hashes.groupBy("_lang").agg(F.max("_hash").alias("cut")).collect()}  # a line for each language
    if not cut:
        return None
    limit = F.create_map(*[F.lit(x) for pair in sorted(cut.items()) for x in pair])
    sample = rows.where(F.col("_hash") <= F.try_element_at(limit, F.col("_lang"))).groupBy("_lang", "_hash").agg(F.min("_body").alias("_body")).drop("_hash")

    def run(batches):
        for batch in pieces(batches, "_body", 1 << 19):
            body = batch.column("_body")
            bits = np.packbits(presence(body).astype(bool), axis=1)
            own = _has_letter(body)
            yield pa.RecordBatch.from_arrays([batch.column("_lang").filter(pa.array(own)), pa.array([b.tobytes() for b, o in zip(bits, own, strict=True) if o], pa.binary())], names=["_lang", "bits"])

    found = sorted((r.lang, bytes(r.bits)) for r in arrow_map(sample, run, "_lang string, bits binary").select(F.col("_lang").alias("lang"), "bits").collect())
    if not found:
        return None
    # an order that doesn't depend on the tasks, and not that of the bits
    found.sort(key=lambda r: (r[0], hash_of(r[1])))
    return fit(np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(len(found), -1), [lang for lang, _ in found])


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def predict(docs: DataFrame, machines: Machines | None, keys: list[str], text: str = "text", keep_text: bool = False) -> DataFrame:
    """The ``keys`` columns, ``lang_pred``, ``score`` (0 to 1) and ``alike`` (whether the text is like that language at all) of
    each row's whole text; with ``keep_text`` the text as ``_body``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(machines)  # bounded: landmarks x dimensions
    source = text_of(docs, *keys, text=text, text_as="_body")
    fields = (source if keep_text else source.drop("_body")).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches):
        m = sent.value
        for batch in pieces(batches, "_body", 1 << 18):
            body = batch.column("_body").fill_null("")
            names, scores, alike = ["und"] * len(body), np.zeros(len(body)), np.zeros(len(body), bool)
            letters = _has_letter(body)
            for a in range(0, len(body) if m else 0, _BLOCK):
                x = presence(body.slice(a, _BLOCK))
                f = m.scores(x)
                best = f.argmax(axis=1)
                alike[a : a + len(best)] = m.alike(x, best) & letters[a : a + len(best)]
                for i, b in enumerate(best.tolist()):
                    if letters[a + i]:
                        names[a + i] = m.languages[b]
                        scores[a + i] = min(1.0, max(0.0, (float(f[i, b]) + 1) / 2))
            kept = {f.name: c for c, f in zip(batch.columns, batch.schema, strict=True) if keep_text or f.name != "_body"}
            yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(names), pa.array(scores), pa.array(alike)], names=[*kept, "lang_pred", "score", "alike"])

    return arrow_map(source, run, f"{fields}, lang_pred string, score double, alike boolean")


def held_out(key: str, parts: int, which: int) -> Column:
    """Whether crc32 of the key as text falls to the held-out part; rows without a key are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == which, F.lit(True))


def language_digest(docs: DataFrame) -> DataFrame:
    """The rows of query op9."""
    machines = train(docs, ~held_out("doc_id", 4, 2))
    return predict(docs, machines, ["doc_id"]).withColumn("held_out", held_out("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.35, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns, unchanged) whose language is identified with at least ``least_score`` and that are like that language."""
    machines = train(docs, F.lit(True), text=text, lang=lang)
    packed = docs.select(other_columns(docs, text).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    found = predict(packed, machines, ["_row"], text="_text", keep_text=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score) & F.col("alike")).select(*original_columns(docs, text, "_body"))
