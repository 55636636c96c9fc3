"""Token counts of whole texts; huge documents in overlapping chunks that are spliced where the encoding has resynchronised.

A text of over ``chunk`` characters is cut into chunks of that size which overlap. Two neighbouring encodings (with
offsets) are spliced at a character where both start a token and where the tokenizer provably splits whatever lies on
either side, since no pre-token or piece runs across it: a space before a character that is not white space (with
SentencePiece, after one too) and, for byte-level vocabularies, a line's end, tab or CJK stop after a letter. The overlap
is as wide as it takes to hold the last such place, and is doubled while the encodings don't meet there. If a chunk has no
such place, it grows up to the next one in the text; if the text has none any more, its rest is encoded at once. So each
character is encoded a few times at most, and counts are always exact.

Cases: null and empty texts have no tokens; a tokenizer whose settings don't allow the proof is never chunked; equal texts
have equal counts; the docs' other columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.cluster import arrow_map, pieces, text_of, tokenizer_file

CHUNK, OVERLAP = 8192, 256
#: Letters (in every version of Unicode that a library may know) and signs that are never in one pre-token with them.
_LETTERS, _STOPS = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "\n\r\t\u3001\u3002\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_AFTER_LETTER = re.compile(f"[{_LETTERS}][{_STOPS}]")
_PLACES = re.compile(f"[ {_STOPS}]")


class Encoder:
    """A public tokenizer: ids of texts, and starts of tokens; both as the library gives them by default."""

    def __init__(self, path: str):
        self.path, self.model = path, path.endswith(".model")
        if self.model:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces_ = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
            self.splits = not any("▁" in p[1:] and p.strip("▁") for p in pieces_)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            self.lib.no_truncation()
            self.lib.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            plain = all(_PLACES.search(t["content"] + "x") is None and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
            self.splits = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and plain

    def counts(self, texts: list[str]) -> list[int]:
        if self.model:
            return [len(x) for x in self.lib.encode(texts, num_threads=1)]
        return [len(x) for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, text: str) -> list[int]:
        """The character at which each token starts."""
        if self.model:
            lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
            character = np.cumsum(lead) - 1  # of each byte: the library counts bytes
            return [int(character[min(p.begin, len(lead) - 1)]) for p in self.lib.encode(text, out_type="proto").pieces]
        return [a for a, _ in self.lib.encode(text, add_special_tokens=False).offsets]

    def splits_at(self, text: str, i: int) -> bool:
        """Whether this tokenizer provably splits before character ``i``."""
        if not 0 < i < len(text) - 1:
            return False
        if text[i] == " ":
            return not text[i + 1].isspace() and not (self.model and text[i - 1].isspace())
        return not self.model and _AFTER_LETTER.match(text, i - 1) is not None

    def next_place(self, text: str, start: int) -> int | None:
        """The first character from ``start`` on before which this tokenizer provably splits."""
        for m in _PLACES.finditer(text, start):
            if self.splits_at(text, m.start()):
                return m.start()
        return None

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, encode: Callable[[str], list[int]] | None = None) -> int:
        encode = encode or self.starts

        def part(a: int, b: int) -> list[int]:
            if self.model and a and self.splits_at(text, a):  # the model puts a space before the part by itself
                return [a, *[a + 1 + x for x in encode(text[a + 1 : b])[1:]]]
            return [a + x for x in encode(text[a:b])]

        total, begin, end = 0, 0, min(chunk, len(text))
        starts = part(begin, end)
        while end < len(text):
            # a chunk's edges may cut a word or hide what follows: only places away from them are compared
            place = next((x for x in reversed(starts) if begin < x < end - 1 and self.splits_at(text, x)), None)
            wide = overlap
            while place is not None and end - wide >= place:
                wide *= 2
            ahead, at = min(len(text), end + chunk), None
            while place is not None and at is None:
                back = max(begin, end - wide)
                new = part(back, ahead)
                at = max((b for b in set(starts).intersection(new) if back < b < end - 1 and self.splits_at(text, b)), default=None)
                if back == begin:
                    break
                wide *= 2
            if at is not None:
                total += sum(1 for x in starts if x < at)
                starts, begin, end = [x for x in new if x >= at], at, ahead
                continue
            ahead = self.next_place(text, end - 1)
            if ahead is None:  # no place to splice any more
                if self.model and begin:
                    return total + len(part(begin, len(text)))
                return total + self.counts([text[begin:]])[0]
            end = min(len(text), ahead + max(overlap, 2))
            starts = part(begin, end)
        return total + len(starts)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(docs: DataFrame, tokenizer: str, keys: list[str], text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ``keys`` columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text."""
    path = tokenizer_file(tokenizer)
    source = text_of(docs, *keys, text=text, text_as="_body").withColumn("n_bytes", F.coalesce(F.octet_length("_body"), F.lit(0)).cast("bigint"))
    wanted = source.drop("_body").withColumn("n_tokens", F.lit(0).cast("bigint"))

    def run(batches):
        enc = encoder(path)
        for batch in pieces(batches, "_body"):
            texts = [x or "" for x in batch.column("_body").to_pylist()]
            huge = [enc.splits and len(x) > chunk for x in texts]
            n = iter(enc.counts([x for x, h in zip(texts, huge, strict=True) if not h]))
            counts = [enc.count_huge(x, chunk, overlap) if h else next(n) for x, h in zip(texts, huge, strict=True)]
            kept = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "_body"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], names=[*[f.name for f in batch.schema if f.name != "_body"], "n_tokens"])

    return arrow_map(source, run, wanted.schema.simpleString().removeprefix("struct<").removesuffix(">"))


def count_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """The rows of query op7."""
    return count_tokens(docs, tokenizer, ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > limit)
