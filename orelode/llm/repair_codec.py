"""Token ids in grammar-compressed shards (Re-Pair), with random access.

Per shard, frequent pairs of neighbouring symbols are replaced by new symbols, over and over, until no pair occurs
``LEAST`` times (from there a rule would take more bytes than it saves). A round replaces up to ``PAIRS`` of the most
frequent pairs at once (overlapping places are settled from the left), which keeps each round a handful of array
operations on the places that still count; no pair crosses the end of a document. Symbols are stored as 16 bits and a bit
plane for each further bit. A shard file holds the rules, how many ids each symbol expands to, and the documents' places,
so any span of ids is decoded without the rest of the sequence.

Ids come from a public tokenizer, which sees each distinct word once while a bounded table holds its ids (words are known by
64-bit hashes): the vocabulary's pre-tokeniser drops white space and never joins across it, so ids of a text are those of
its words in turn. Words of letters of ASCII and Latin-1 go through the same model without normaliser and expressions.

Cases: null and empty texts have only the end id; documents are in ascending order of their ids (whole numbers, or any
other type as text in order of its code points), null ids first, and rows of equal id in order of their ids' checksum; an
empty table makes no shard; a word may have any number of tokens.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.llm import textbuf as tb
from orelode.llm.cluster import arrow_map, pieces, plan_bytes, shared_dir, stored, text_of, tokenizer_file
from orelode.llm.files import open_file, write_file

MAGIC, _HEAD = b"RPG2", "<4sIIQQQB"
END_ID = 2
SHARD_TOKENS = 8 << 20
#: Parts of the list whose sizes are added up together.
_GROUP = 4096
#: Pairs that a round replaces, and how often a pair occurs at least: a rule takes 12 bytes, and each use saves about two.
PAIRS, LEAST = 8192, 8
#: Words, and their ids, beyond which a worker's cache starts anew; places that its table has at first.
_CACHE, _CACHE_IDS, _PLACES = 1_000_000, 1 << 24, 1 << 16
#: Bytes of texts that are encoded at once, small enough for a processor's cache (one longer text goes alone).
_TEXTS = 1 << 19
#: Words of more bytes are hashed byte by byte.
_LONG = 64
#: Signs after a letter that are looked through for it.
_TAIL = 8
#: Bits of the hash of a pair by which its places are found.
_BINS = 20
#: Bytes that aren't ASCII signs, and ASCII letters.
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: Second bytes, after 0xC3, of the letters of Latin-1, all but two of U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: A pre-tokeniser by which letters in a row are one pre-token.
_LETTERS_STAY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each (not empty) span of ``data``, which has 8 more bytes behind the last span."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()  # the 8 bytes from each place on
    lens = ends - starts
    salt = lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = tb.mix(eights[starts] & _LOW_BYTES[np.minimum(lens, 8)] ^ salt)
    more, at = np.flatnonzero((lens > 8) & (lens <= _LONG)), 8
    while len(more):
        h[more] = tb.mix(h[more] + (eights[starts[more] + at] & _LOW_BYTES[np.minimum(lens[more] - at, 8)]))
        at += 8
        more = more[lens[more] > at]
    long = np.flatnonzero(lens > _LONG)
    if len(long):
        h[long] = tb.span_hashes(data, starts[long], ends[long])
    return np.maximum(h, np.uint64(1))


class WordTable:
    """Numbers by 64-bit hashes that aren't 0, of many at a time: open addressing, at most half full."""

    def __init__(self, places: int = _PLACES):
        self.keys, self.values, self.used = np.zeros(places, np.uint64), np.zeros(places, np.int64), 0

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        place = self._place(h)
        key, out = self.keys[place], self.values[place]
        rest = np.flatnonzero(key != h)
        key, place = key[rest], place[rest]
        while len(rest):
            out[rest[key == 0]] = -1
            rest, place = rest[key != 0], (place[key != 0] + 1) & (len(self.keys) - 1)
            key = self.keys[place]
            found = key == h[rest]
            out[rest[found]] = self.values[place[found]]
            rest, place, key = rest[~found], place[~found], key[~found]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Numbers of distinct hashes that aren't there yet."""
        if 2 * (self.used + len(h)) > len(self.keys):
            old, there = self, np.flatnonzero(self.keys)
            larger = WordTable(1 << (2 * (self.used + len(h))).bit_length())
            larger.add(old.keys[there], old.values[there])
            self.keys, self.values = larger.keys, larger.values
        self.used += len(h)
        place = self._place(h)
        while len(h):
            free = self.keys[place] == 0
            self.keys[place[free]] = h[free]  # of several that come to one place, the last stays
            own = self.keys[place] == h
            self.values[place[own]] = values[own]
            h, values, place = h[~own], values[~own], (place[~own] + 1) & (len(self.keys) - 1)


class WordEncoder:
    """Ids of words, from a library that is asked once for each (while the bounded cache holds it)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lowers = any(s["type"] == "Lowercase" for s in steps)
        if not any(s["type"] == "Replace" and s["content"] == " " for s in steps) or not self._drops_space(spec):
            raise ValueError("this tokenizer doesn't drop white space; its words can't be encoded one by one")
        self.mark = self.specials[0]
        self.mark_id = self.lib.token_to_id(self.mark)
        self.ends = np.array([(self.lib.id_to_token(i) or "").endswith("</w>") for i in range(self.lib.get_vocab_size())])
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters_lib = Tokenizer.from_str(json.dumps(plain)) if (plain := self._for_letters(spec)) else None
        self._forget()

    def _forget(self) -> None:
        """An empty cache: of each word's hash, where its ids start in ``known``, times 2^32, plus how many they are."""
        self.cache = WordTable()
        self.known, self.used = np.zeros(1 << 20, self.kind), 0

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and r"[^\s\p{L}\p{N}]+" in s["pattern"].get("Regex", "") for s in steps)

    @staticmethod
    def _for_letters(spec: dict) -> dict | None:
        """The same tokenizer, for words of lower-case letters of ASCII and Latin-1 with spaces between: normalisers leave
        those as they are and each is one pre-token, so neither takes its expressions. None for a tokenizer of other steps."""
        steps = spec["normalizer"]["normalizers"]
        kept = [s for s in steps if s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"}]
        split, *after = spec["pre_tokenizer"]["pretokenizers"]
        if kept != steps or split["pattern"] != {"Regex": _LETTERS_STAY} or [s["type"] for s in after] != ["ByteLevel"] or after[0]["use_regex"] or after[0]["add_prefix_space"]:
            return None
        return spec | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *after]}}

    def _ids(self, lib, text: str) -> np.ndarray:
        return np.array(lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        """Distinct spans of ``data``, which has a byte behind the last one, and their hashes into the cache."""
        rest = np.arange(len(h))
        if self.letters_lib and self.ends.any():
            lens = end - begin
            flat = tb.pick(data, begin, lens)
            two = (flat[:-1] == 0xC3) & _LATIN[flat[1:]]
            good = _LETTER[flat]
            good[:-1] |= two
            good[1:] |= two
            good = np.logical_and.reduceat(good, np.cumsum(lens) - lens)
            if good.any():
                flat = tb.pick(data, begin[good], lens[good] + 1)
                flat[np.cumsum(lens[good] + 1) - 1] = 0x20
                text = flat.tobytes().decode()
                # a word's last id alone is marked as an end
                if self._keep_ended(h[good], self._ids(self.letters_lib, text.lower() if self.lowers else text)):
                    rest = np.flatnonzero(~good)
        if not len(rest):
            return
        raw = data.tobytes()
        text = [raw[a:b].decode() for a, b in zip(begin[rest].tolist(), end[rest].tolist(), strict=True)]
        # words of letters alone are one pre-token each: a space keeps them apart
        letters = [i for i, w in enumerate(text) if w.isalpha()] if self.ends.any() else []
        if letters and not self._keep_ended(h[rest[letters]], self._ids(self.lib, " ".join([text[i] for i in letters]))):
            letters = []
        known = set(letters)
        plain = [i for i in range(len(text)) if i not in known and "<|" not in text[i]]
        if plain:
            # others by a mark between them, itself a token of the vocabulary
            ids = self._ids(self.lib, self.mark.join([text[i] for i in plain]))
            marks = np.flatnonzero(ids == self.mark_id)
            self._keep(h[rest[plain]], ids, np.concatenate([[0], marks + 1]), np.concatenate([marks, [len(ids)]]))
        for i, w in enumerate(text):
            if "<|" in w:
                ids = np.array(self.lib.encode(w, add_special_tokens=False).ids, self.kind)
                self._keep(h[rest[[i]]], ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def _keep_ended(self, h: np.ndarray, ids: np.ndarray) -> bool:
        """Into the cache, if there are as many ends of words as words."""
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(h):
            return False
        self._keep(h, ids, np.concatenate([[0], stops[:-1]]), stops)
        return True

    def _keep(self, h: np.ndarray, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Words' ids, from ``starts`` to ``stops``, into the cache."""
        if len(starts) != len(h):
            raise ValueError("the tokenizer's ids can't be told apart by words")
        at = self.used
        while at + len(ids) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[at : at + len(ids)] = ids
        self.used += len(ids)
        self.cache.add(h, (starts.astype(np.int64) + at) << 32 | (stops - starts))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if self.cache.used > _CACHE or self.used > _CACHE_IDS:
            self._forget()
        texts = texts.cast(pa.binary())
        raw, _ = tb.raw_bytes(texts)
        special = b"<|" in raw.tobytes()  # special strings are matched before letters are lowered, and may hold signs
        w = tb.words(texts, tb.FOLDED if self.lowers and not special else tb.PLAIN)
        if not len(w):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        data = np.concatenate([w.mapped, np.zeros(8, np.uint8)])
        data[data == 0xFF] = 0
        begin, end, first = w.starts, w.ends, w.first
        if not special:
            begin, end, first = self._cut_tails(data, begin, end, first)
        h = _word_hashes(data, begin, end)
        found = self.cache.get(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = missing[tb.distinct(h[missing])[0]]
            self._learn(data, begin[new], end[new], h[new])
            found[missing] = self.cache.get(h[missing])
        lens = found & 0xFFFFFFFF
        return tb.pick(self.known, found >> 32, lens), np.diff(np.concatenate([[0], np.cumsum(lens)])[first])

    @staticmethod
    def _cut_tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A few signs after a letter (of ASCII or Latin-1) are tokens of their own: cut off, they leave fewer distinct words."""
        cut = np.flatnonzero(~_SOLID[data[ends - 1]])
        at = ends[cut] - 1
        for _ in range(_TAIL):
            at -= ~_SOLID[data[at]] & (at > starts[cut])
        tail = _LETTER[data[at]] | (data[at - 1] == 0xC3) & _LATIN[data[at]]
        cut, at = cut[tail], at[tail] + 1
        return np.insert(starts, cut + 1, at), np.insert(ends, cut, at), first + np.searchsorted(cut, first)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def compress(ids: np.ndarray, lens: np.ndarray, terminals: int, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, symbols per document) of documents of ``lens`` ids; symbol ``terminals + r`` stands for ``rules[r]``.

    The sequence is a linked list. Only live places are looked at: those whose pair may occur ``least`` times. A pair that
    a round makes anew holds a new symbol, so all its occurrences are beside replaced ones, and those become live again;
    other pairs only get rarer, so a place that was dropped never has to come back by itself.
    """
    n = len(ids)
    seq = ids.astype(np.int32)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last, there = np.zeros(n, bool), np.ones(n, bool)
    last[np.cumsum(lens)[lens > 0] - 1] = True
    live = ~last
    rules: list[np.ndarray] = []
    bound = terminals
    slot = np.full(1 << _BINS, -1, np.int32)
    while len(at := np.flatnonzero(live)):
        code = seq[at].astype(np.int64) << 32 | seq[after[at]]
        ordered = np.sort(code)
        heads = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
        times = np.diff(heads)
        often = np.flatnonzero(times >= least)
        if not len(often):
            break
        often = often[np.argsort(-times[often], kind="stable")]
        frequent = ordered[heads[often]]
        chosen = frequent[:pairs]
        # by bins: -1 for those without a frequent pair (places there are dropped); of the others some hold a chosen one, the
        # most frequent if several share it, and the rest wait for another round
        own, any_ = _bin(chosen), _bin(frequent)
        slot[any_] = -2
        slot[own[::-1]] = np.arange(len(chosen))[::-1]
        first = slot[own] == np.arange(len(chosen))
        rank = slot[_bin(code)]
        slot[any_] = -1
        live[at[rank == -1]] = False
        hit = np.flatnonzero(rank >= 0)
        hit = hit[chosen[rank[hit]] == code[hit]]
        here, rank = at[hit], (np.cumsum(first) - 1)[rank[hit]]
        chosen = chosen[first]
        # of places in a row every other one, from the left
        beside = np.flatnonzero(after[here[:-1]] == here[1:]) + 1
        if len(beside):
            begins = np.concatenate([[True], beside[1:] != beside[:-1] + 1])
            keep = np.ones(len(here), bool)
            keep[beside] = (beside - beside[begins][np.cumsum(begins) - 1]) % 2 == 1
            here, rank = here[keep], rank[keep]
        used = np.zeros(len(chosen), bool)
        used[rank] = True  # a pair whose places all went to others gets no rule
        chosen, rank = chosen[used], (np.cumsum(used) - 1)[rank]
        gone = after[here]
        seq[here] = bound + rank
        last[here], after[here] = last[gone], after[gone]
        there[gone] = live[gone] = False
        follow = after[here]
        before[follow[follow < n]] = here[follow < n]
        live[here] = ~last[here]
        left = before[here]
        left = left[left >= 0]
        live[left[~last[left]]] = True
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1))
        bound += len(chosen)
    seq, last = seq[there].astype(np.int64), last[there]
    symbols = np.zeros(len(lens), np.int64)
    symbols[lens > 0] = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
    return seq, (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), symbols


def _bin(code: np.ndarray) -> np.ndarray:
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BINS)).astype(np.int64)


class Shard:
    """A shard file's contents; also decodes any span of it. ``ids``: the documents' ids, 64-bit integers or text."""

    def __init__(self, terminals: int, rules: np.ndarray, seq: np.ndarray, symbols: np.ndarray, lens: np.ndarray, ids: pa.Array):
        self.terminals, self.rules, self.seq, self.symbols, self.lens, self.ids = terminals, rules, seq, symbols, lens, ids
        expands = [1] * terminals
        for a, b in rules.tolist():
            expands.append(expands[a] + expands[b])
        self.expands = np.array(expands, np.int64)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """What all symbols expand to, in a row, and where each one's ids start."""
        plain = np.arange(self.terminals, dtype="<u4").tobytes()
        parts = [plain[i : i + 4] for i in range(0, len(plain), 4)]
        for a, b in self.rules.tolist():
            parts.append(parts[a] + parts[b])
        return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(self.expands) - self.expands

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        flat, heads = self.table
        return tb.pick(flat, heads[symbols], self.expands[symbols])

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard: only the symbols that cover them are expanded."""
        ends = np.cumsum(self.expands[self.seq])
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.decode(self.seq[a:b])[start - before : stop - before]

    def to_bytes(self) -> bytes:
        planes = max(0, (self.terminals + len(self.rules) - 1).bit_length() - 16)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", self.ids.type)])) as out:
            out.write(pa.RecordBatch.from_arrays([self.ids], names=["id"]))
        names = sink.getvalue().to_pybytes()
        parts = [self.rules.astype("<u4"), self.expands[self.terminals :].astype("<u4"), self.symbols.astype("<u4"), self.lens.astype("<u4"), self.seq.astype("<u2")]
        parts += [np.packbits(self.seq >> (16 + i) & 1) for i in range(planes)]
        head = struct.pack(_HEAD, MAGIC, self.terminals, len(self.rules), len(self.lens), len(self.seq), len(names), planes)
        body = head + names + b"".join(p.tobytes() for p in parts)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, terminals, n_rules, n_docs, n_seq, n_names, planes = struct.unpack_from(_HEAD, data)
        if magic != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("not a shard file, or a damaged one")
        at, parts = struct.calcsize(_HEAD), []
        ids = pa.ipc.open_stream(data[at : at + n_names]).read_all().column(0).combine_chunks()
        at += n_names
        for kind, n in (("<u4", 2 * n_rules), ("<u4", n_rules), ("<u4", n_docs), ("<u4", n_docs), ("<u2", n_seq), *[("u1", (n_seq + 7) // 8)] * planes):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        rules, expands, symbols, lens, low, *high = parts
        seq = low.astype(np.int64)
        for i, plane in enumerate(high):
            seq |= np.unpackbits(plane, count=n_seq).astype(np.int64) << (16 + i)
        shard = cls(terminals, rules.reshape(-1, 2).astype(np.int64), seq, symbols.astype(np.int64), lens.astype(np.int64), ids)
        if (shard.expands[terminals:] != expands).any():
            raise ValueError("expansion lengths don't fit the rules")
        return shard


def _key_type(docs: DataFrame, key: str) -> str:
    """Ids are kept as whole numbers or as text."""
    return "bigint" if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``_key``, ``check`` (crc32 of the ids) and ``ids`` (packed little-endian, 16 bits each if they fit) of each row."""
    path, kind_of_key = tokenizer_file(tokenizer), _key_type(docs, key)
    source = text_of(docs.withColumn(key, F.col(f"`{key}`").cast(kind_of_key)), key, text=text, text_as="_body")

    def run(batches):
        enc = word_encoder(path)
        for batch in pieces(batches, "_body", _TEXTS):
            flat, lens = enc(batch.column("_body").fill_null(""))
            ends = np.cumsum(lens)
            every = np.insert(flat, ends, end_id)
            bounds = (np.concatenate([[0], ends]) + np.arange(len(lens) + 1)) * every.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(every.tobytes())])
            data = memoryview(every.tobytes())
            check = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(check, pa.int64()), packed], names=["_key", "check", "ids"])

    return arrow_map(source, run, f"_key {kind_of_key}, check bigint, ids binary")


def write_shards(encoded: DataFrame, tokenizer: str, folder: str, shards: int) -> DataFrame:
    """Shard files of ``encoded`` in ascending order; returns their list: ``part``, ``seq``, ``path``, ``n_docs``, ``n_tokens``."""
    path = tokenizer_file(tokenizer)
    key_type = pa.int64() if encoded.schema["_key"].dataType.typeName() == "long" else pa.string()

    def run(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        size = word_encoder(path).lib.get_vocab_size()
        kind = "<u2" if size <= 1 << 16 else "<u4"
        keys, texts, n = [], [], 0

        def flush() -> pa.RecordBatch:
            lens = np.array([len(t) for t in texts], np.int64) // np.dtype(kind).itemsize
            seq, rules, symbols = compress(np.frombuffer(b"".join(texts), kind), lens, size)
            shard = Shard(size, rules, seq, symbols, lens, pa.array(keys, key_type))
            out = write_file(folder, ".rpg", shard.to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([done]), pa.array([out]), pa.array([len(keys)]), pa.array([int(lens.sum())])], names=["part", "seq", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for k, t in zip(batch.column("_key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                keys.append(k)
                texts.append(t)
                n += len(t) // np.dtype(kind).itemsize
                if n >= SHARD_TOKENS:
                    yield flush()
                    keys, texts, n, done = [], [], 0, done + 1
        if keys:
            yield flush()

    order = [F.col("_key").asc_nulls_first(), F.col("check")]
    ranged = encoded.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return stored(arrow_map(ranged, run, "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint"))


def first_places(listed: DataFrame) -> DataFrame:
    """The list of shards with ``first``: the ids of all shards before each. Sums of ``_GROUP`` parts each are added up
    first, so the one task that sees the whole order sees a row for each of those; nothing goes to the driver."""
    grouped = listed.withColumn("_group", F.floor(F.col("part") / _GROUP))
    sums = grouped.groupBy("_group").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))).select("_group", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_group").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return grouped.join(before, "_group").withColumn("first", F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_group", "_before")


def read_shards(listed: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Documents of the listed files, in the files' order: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    tasks = max(int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")), listed.count() // 4)
    files = first_places(listed).select("path", "first").repartition(tasks, "path")

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with open_file(path) as f:
                    shard = Shard.from_bytes(f.read())
                starts = np.cumsum(shard.lens) - shard.lens
                heads = np.cumsum(shard.symbols) - shard.symbols
                checks = []
                # some documents at a time
                for a in range(0, len(shard.lens), 512):
                    b = min(a + 512, len(shard.lens))
                    part = shard.decode(shard.seq[heads[a] : heads[b - 1] + shard.symbols[b - 1]]).astype("<u4").tobytes()
                    cuts = 4 * (np.concatenate([starts[a:b], [starts[b - 1] + shard.lens[b - 1]]]) - starts[a])
                    view = memoryview(part)
                    checks += [zlib.crc32(view[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([shard.ids, pa.array(starts + first), pa.array(shard.lens), pa.array(checks, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(files, run, f"doc_id {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def shard_digest(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The rows of query op6."""
    spark = docs.sparkSession
    encoded = stored(encode(docs, tokenizer))
    shards = max(4, plan_bytes(encoded) // (8 << 20))
    found = read_shards(write_shards(encoded, tokenizer, shared_dir(spark) + "/shards", shards), _key_type(docs, "doc_id"))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
