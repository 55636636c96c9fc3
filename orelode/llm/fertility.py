"""Quality rules from tokeniser fertility: how a public vocabulary takes a text to pieces.

Prose costs few tokens a character, hardly needs byte fallback and uses many different pieces; symbol soup, pasted
codes and loops don't. For each text the SentencePiece vocabulary gives characters per token, the share of byte-fallback
tokens and the entropy of its tokens; a text outside the band of its dominant script is rejected. Plain counts (words,
symbols, repeated lines and words) come from the same pass, as array operations over whole batches.

The bands are parameters, set by hand; nothing is fitted when a query runs. Where they come from: of 1,500 documents of
sf0.1 those that pass the base rule have 1.80 to 2.93 characters per token (invented Latin prose; real English has 4 to 5)
and a byte share of at most 0.05, and the lowest entropies stand out as repeated lines and pasted junk: the tenth
percentile is 5.4 bits for 64 to 127 tokens, 5.8 for 128 to 255, 6.2 for 256 to 511, 6.3 and more beyond, near which
``LEAST_ENTROPY`` lies (it rejects about one in fifteen). The other scripts' bands are wide ones around running text of
some fifty words each in Greek (1.0 characters per token, 4.5 bits), Russian (2.6, 6.4), Chinese (1.0, 5.1) and Arabic
(1.1, 4.4; script ``other``), which the tests hold them to; give ``in_band`` others for a corpus of its own.

Cases: null and empty texts have no words and no tokens, and fail the base rule; texts of equal content get equal rows;
a script without a band of its own takes that of ``other``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm import textbuf as tb
from orelode.llm.cluster import arrow_map, pieces, text_of, tokenizer_file

#: By script: least and most characters per token, most byte-fallback share, and bits that its entropy may lie lower.
BANDS = {
    "latin": (1.9, 8.0, 0.10, 0.0),
    "greek": (0.8, 4.0, 0.20, 1.5),
    "cyrillic": (1.2, 6.0, 0.20, 1.0),
    "cjk": (0.3, 2.5, 0.60, 1.5),
    "other": (0.2, 8.0, 0.80, 2.0),
}
#: Least entropy (bits) of the tokens of Latin prose by their number; between the points linear in its logarithm.
LEAST_ENTROPY = ((1, 0.0), (64, 4.9), (128, 5.4), (256, 5.8), (512, 6.1), (1024, 6.33), (2048, 6.45))
SCRIPTS = tuple(BANDS)

#: The script of a character, from the first byte of its UTF-8 form; -1: of no script (digits, signs, later bytes).
_SCRIPT = np.full(256, -1, np.int8)
_SCRIPT[0x41:0x5B] = _SCRIPT[0x61:0x7B] = 0
_SCRIPT[0xC3:0xCA] = 0
_SCRIPT[0xCD:0xD0] = 1
_SCRIPT[0xD0:0xD4] = 2
_SCRIPT[0xE3:0xEE] = 3
_SCRIPT[0xD4:0xE0] = 4
_SCRIPT[[0xE0, 0xE1]] = 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, script string"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    return lib, np.array([lib.is_byte(i) for i in range(lib.get_piece_size())])


def _totals(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[bounds])


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are equal to an earlier one, and which to any other."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def _of_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return tb.mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def base_counts(texts: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    w = tb.words(texts.cast(pa.binary()), tb.PLAIN)
    n_docs = len(texts)
    raw, bounds = w.raw, w.bounds
    lead = (raw & 0xC0) != 0x80
    out = {"n_words": w.counts, "word_chars": _totals(lead & (w.mapped != 0), bounds), "n_symbols": _totals(_SYMBOL[raw], bounds), "n_chars": _totals(lead, bounds)}
    # lines with a word: those in which some word starts
    newline = np.flatnonzero(raw == 10)
    begins = np.unique(np.concatenate([bounds[:-1], newline + 1]))
    begins = begins[begins < len(raw)]
    stops = np.concatenate([begins[1:], [len(raw)]]) if len(begins) else begins
    ends = np.where(raw[stops - 1] == 10, stops - 1, stops) if len(begins) else stops
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
    begins, ends = begins[full], ends[full]
    doc = np.searchsorted(bounds, begins, "right") - 1
    later, _ = _twice(_of_doc(tb.span_hashes(raw, begins, ends), doc))
    out["n_dup_lines"] = np.bincount(doc[later], minlength=n_docs)
    word_doc = w.doc
    own = np.flatnonzero(tb.inside_doc(w, window))
    _, again = _twice(_of_doc(tb.windows(w.hashes(), window)[own], word_doc[own]))
    flags = np.zeros(max(0, len(w) - window + 1), bool)
    flags[own[again]] = True
    out["n_repeat_words"] = np.bincount(word_doc[tb.covered(flags, window, len(w))], minlength=n_docs)
    scripts = np.stack([_totals(_SCRIPT[raw] == s, bounds) for s in range(len(SCRIPTS))])
    out["script"] = np.where(scripts.sum(axis=0) > 0, scripts.argmax(axis=0), len(SCRIPTS) - 1)
    return out


def fertility_counts(texts: list[str], path: str) -> dict[str, np.ndarray]:
    """Tokens, byte-fallback tokens and the entropy of the tokens in bits, of whole texts."""
    lib, is_byte = _model(path)
    ids = lib.encode(texts, num_threads=1)
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
    bounds = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(texts)), n)
    keys, counts = np.unique(doc * len(is_byte) + flat, return_counts=True)
    doc_of, share = keys // len(is_byte), counts / n[keys // len(is_byte)]
    entropy = np.bincount(doc_of, weights=-share * np.log2(share), minlength=len(texts))
    return {"n_tokens": n, "n_byte": _totals(is_byte[flat], bounds), "entropy": np.maximum(entropy, 0.0)}


def measure(docs: DataFrame, keys: list[str], tokenizer: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """The ``keys`` columns, and ``COLUMNS`` of each row's whole text; ratios of texts without tokens are null."""
    path = tokenizer_file(tokenizer)
    source = text_of(docs, *keys, text=text, text_as="_body")
    fields = source.drop("_body").schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches):
        for batch in pieces(batches, "_body"):
            body = batch.column("_body").fill_null("")
            base, fert = base_counts(body), fertility_counts(body.to_pylist(), path)
            n = fert["n_tokens"]
            none, some = n == 0, np.maximum(n, 1)
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "_body"]
            columns += [pa.array(base[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns += [pa.array(n), *[pa.array(x, pa.float64(), mask=none) for x in (base["n_chars"] / some, fert["n_byte"] / some, fert["entropy"])]]
            columns.append(pa.array([SCRIPTS[s] for s in base["script"]]))
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in batch.schema if f.name != "_body"], *[c.split()[0] for c in COLUMNS.split(", ")]])

    return arrow_map(source, run, f"{fields}, {COLUMNS}")


def least_entropy():
    """``LEAST_ENTROPY`` at a row's number of tokens."""
    bits = F.log2(F.greatest(F.lit(1), "n_tokens"))
    out = F.lit(LEAST_ENTROPY[-1][1])
    for (a, x), (b, y) in reversed(list(zip(LEAST_ENTROPY, LEAST_ENTROPY[1:], strict=False))):
        out = F.when(F.col("n_tokens") < b, x + (bits - math.log2(a)) * ((y - x) / (math.log2(b) - math.log2(a)))).otherwise(out)
    return out


def in_band(bands: dict[str, tuple[float, float, float, float]] = BANDS):
    """Whether a row of ``measure`` lies in the band of its script."""
    verdict = F.lit(False)
    for script, (low, high, byte_share, relief) in bands.items():
        good = F.col("chars_per_token").between(low, high) & (F.col("byte_share") <= byte_share) & (F.col("token_entropy") >= least_entropy() - relief)
        verdict = F.when(F.col("script") == script, good).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def quality_digest(docs: DataFrame) -> DataFrame:
    """The rows of query op3."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measure(docs, ["doc_id"]).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & in_band())
