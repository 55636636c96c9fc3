"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into one transducer, normaliser and pieces and byte fallback composed beforehand. Its states
are the prefixes of the pieces, as integers; an arc reads a character of the raw text (the normaliser's arcs read a space
or U+2581 and write the word mark; its epsilon arc writes the dummy prefix) and leads on in the prefix; a state that is a
whole piece has an arc back to the start that writes the piece's id. A character that is no piece has a path of its UTF-8
bytes' ids. A text is composed with it, place by place, and the tropical-semiring shortest path is read off. Where no
piece can cross a place (before a run of spaces, or between two characters that no piece has side by side), the
composition falls apart, so each distinct stretch between such places is solved once and remembered.

Weights: a unigram model's piece arcs weigh minus the score, whatever came before. A BPE model's segmentation isn't the
least sum of any weights of single pieces; it is the only one in which every piece, and every two neighbouring pieces,
come out of the merges unchanged. So a BPE transducer's start is split by the last piece, and a piece arc weighs nothing
after a piece that it stands next to in an encoding and infinity after any other; these weights are found when a pair
first occurs. The path of finite weight is the library's encoding. A text without one is an error.

Cases: null and empty texts have no pieces; U+2581 in a text is a space, as in the library, and then doesn't survive;
equal texts get equal pieces; the docs' other columns don't matter.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orelode.llm import textbuf as tb
from orelode.llm.cluster import arrow_map, pieces, text_of, tokenizer_file

MARK = "▁"
NORMAL, CONTROL, USER, BYTE = 1, 3, 4, 6
UNIGRAM, BPE = 1, 2
_INFINITY = float("inf")
#: Of a worker: bytes of remembered stretches with their ids, longest stretch that is remembered, weights of pairs, and ends
#: of stretches of up to ``_SHORT`` characters.
_CACHE_BYTES, _CACHE_LONGEST, _PAIRS, _RESTS, _SHORT = 64 << 20, 1 << 10, 250_000, 250_000, 48
_UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Transducer:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        normaliser = dict(_fields(next((v for k, v in model if k == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be compiled")
        if normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only the identity normaliser that keeps all spaces can be compiled")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_: dict[int, int] = {}
        self.out: list[bytes] = []
        for i, value in enumerate(v for k, v in model if k == 1):
            spec = dict(_fields(value))
            piece, kind = spec.get(1, b"").decode(), spec.get(3, NORMAL)
            text = b""
            if kind in (NORMAL, USER):
                self.ids[piece] = i
                self.scores[piece] = float(np.frombuffer(spec.get(2, b"\0\0\0\0"), "<f4")[0])
                text = piece.replace(MARK, " ").encode()
            elif kind == BYTE:
                self.bytes_[int(piece[3:5], 16)] = i
                text = bytes([int(piece[3:5], 16)])
            self.out.append(text)
        if len(self.bytes_) != 256:
            raise ValueError("the model has no byte fallback")
        self._compile()
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        alone = [b < 0x80 and chr(b) not in inner and b != 0x20 for b in range(256)]
        # by two neighbouring bytes (a space for the mark), whether some piece may cross between them
        self.joined = np.zeros((256, 256), bool)
        self.joined[0x80:, 0x80:] = True
        self.joined[0x80:, :0x80] = ~np.array(alone[:0x80])
        self.joined[:0x80, 0x80:] = ~np.array(alone[:0x80])[:, None]
        self.joined[0x80:, 0x20] = False
        for p in self.ids:
            for a, b in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:], strict=False):
                if a < "\x80" and b < "\x80":
                    self.joined[ord(a), ord(b)] = True
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece runs across words")
        self.least = min(self.scores.values(), default=0.0) - _UNKNOWN_PENALTY
        self.pairs: dict[int, float] = {}
        self.rests: dict[tuple[int | None, str], tuple[int, ...] | None] = {}
        self.courses: dict[int, tuple[bool, list[float], list[str], list[str]]] = {}
        self._forget()
        lens = np.array([len(x) for x in self.out], np.int64)
        self.is_byte = np.zeros(len(self.out), bool)
        self.is_byte[list(self.bytes_.values())] = True
        self.out_lens, self.out_heads, self.out_flat = lens, np.cumsum(lens) - lens, np.frombuffer(b"".join(self.out), np.uint8)

    # the transducer

    def _compile(self) -> None:
        """``arcs``: (state, character of the raw text) to state, in one integer key; ``writes``: the piece that a state is, or
        -1. State 0 is the start."""
        self.arcs: dict[int, int] = {}
        self.writes = [-1]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                if key not in self.arcs:
                    self.arcs[key] = len(self.writes)
                    self.writes.append(-1)
                state = self.arcs[key]
            self.writes[state] = i
        mark = ord(MARK)
        for key, state in [(k, v) for k, v in self.arcs.items() if k & 0x1FFFFF == mark]:
            self.arcs[key - mark + 0x20] = state  # the normaliser: a space is read as the mark
        self.pieces = {i: p for p, i in self.ids.items()}

    def fallback(self, c: str) -> int:
        """What stands for a character that is no piece: a symbol of its own, which writes the ids of its bytes."""
        return -ord(MARK if c == " " else c) - 2

    def _spelled(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol >= 0 else chr(-symbol - 2)

    def course(self, symbol: int) -> tuple[bool, list[float], list[str], list[str]]:
        """How a piece comes about: whether the merges of its characters, the best score first and of equal ones the
        leftmost, end in it; the merges' scores; and the first and last part before and after each merge."""
        found = self.courses.get(symbol)
        if found is None:
            parts = list(self._spelled(symbol))
            scores, firsts, lasts = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, where = None, -1
                for i in range(len(parts) - 1):
                    score = self.scores.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, where = score, i
                if best is None:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
                scores.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            found = self.courses[symbol] = (len(parts) == 1, [*scores, -_INFINITY], firsts, lasts)
        return found

    def stands_next(self, left: int | None, right: int) -> bool:
        """Whether two pieces stand side by side in an encoding (None: the text's start).

        Both come about side by side, each step the better of their next merges; they are an encoding if a merge across
        their border is never better than both.
        """
        whole, after, firsts, _ = self.course(right)
        if left is None:
            return whole
        left_whole, before, _, lasts = self.course(left)
        if not (whole and left_whole):
            return False
        i = j = 0
        while True:
            across = self.scores.get(lasts[i] + firsts[j])
            if across is not None and across > before[i] and across >= after[j]:  # of equal merges the left one is first
                return False
            if before[i] >= after[j]:
                if before[i] == -_INFINITY:
                    return True
                i += 1
            else:
                j += 1

    def weight(self, left: int | None, right: int) -> float:
        """Of the arc that writes ``right`` after ``left``."""
        if self.kind == UNIGRAM:
            return -self.scores.get(self._spelled(right), self.least)
        key = ((-1 << 24 if left is None else left) << 32) + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > _PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = 0.0 if self.stands_next(left, right) else _INFINITY
        return found

    # composition with a text, and its shortest path

    def arcs_at(self, text: str, at: int = 0) -> list[tuple[int, int]]:
        """(symbol, place after it) of the arcs that write something for the characters from a place on, the longest last."""
        out, arcs, writes, state = [], self.arcs, self.writes, 0
        for end in range(at, len(text)):
            state = arcs.get(state << 21 | ord(text[end]))
            if state is None:
                break
            if writes[state] >= 0:
                out.append((writes[state], end + 1))
        if not out or out[0][1] > at + 1:
            out.insert(0, (self.fallback(text[at]), at + 1))
        return out

    def path(self, text: str) -> list[int]:
        """The symbols (pieces, or characters for byte fallback) on the shortest path through ``text``."""
        found = self._in_order(text) if self.kind == UNIGRAM else self._rest(None, text) if len(text) <= _SHORT else self._best_first(text)
        if found is None:
            raise ValueError("the transducer has no path through a text")
        return list(found)

    def _in_order(self, text: str) -> list[int] | None:
        """Places in order; the state is the place alone, as weights don't look back."""
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(_INFINITY, 0, -1)] * len(text)
        for at in range(len(text)):
            for symbol, end in self.arcs_at(text, at):
                total = best[at][0] + self.weight(None, symbol)
                if total < best[end][0]:
                    best[end] = (total, symbol, at)
        out, at = [], len(text)
        while at > 0:
            _, symbol, at = best[at]
            out.append(symbol)
        return out[::-1] if at == 0 else None

    def _best_first(self, text: str) -> list[int] | None:
        """The least weight first and of equal ones the farthest place; finite weights are all zero here, so that is a
        stack. The state is the place and the last symbol; those without a way on are remembered."""
        path: list[int | None] = [None]
        open_ = [self.arcs_at(text)]
        ends, dead = [0], set()
        while ends[-1] < len(text):
            while open_[-1]:
                symbol, end = open_[-1].pop()
                if (end, symbol) not in dead and self.weight(path[-1], symbol) < _INFINITY:
                    path.append(symbol)
                    ends.append(end)
                    open_.append(self.arcs_at(text, end) if end < len(text) else [])
                    break
            else:
                dead.add((ends.pop(), path.pop()))
                open_.pop()
                if not ends:
                    return None
        return path[1:]

    def _rest(self, last: int | None, text: str) -> tuple[int, ...] | None:
        """The same for a short text after a symbol. Many words end alike, so what follows a state is remembered."""
        key = (last, text)
        found = self.rests.get(key, ())
        if found != ():
            return found
        found, pairs, before = None, self.pairs, (-1 << 24 if last is None else last) << 32
        arcs = self.arcs_at(text)
        while arcs:
            symbol, end = arcs.pop()
            weight = pairs.get(before + symbol)
            if (self.weight(last, symbol) if weight is None else weight) == 0.0:
                if end == len(text):
                    found = (symbol,)
                    break
                after = self._rest(symbol, text[end:])
                if after is not None:
                    found = (symbol, *after)
                    break
        if last is not None:
            if len(self.rests) > _RESTS:
                self.rests.clear()
            self.rests[key] = found
        return found

    def solve(self, stretch: bytes) -> np.ndarray:
        ids: list[int] = []
        for symbol in self.path(stretch.decode()):
            if symbol >= 0:
                ids.append(symbol)
            else:
                ids += [self.bytes_[b] for b in self._spelled(symbol).replace(MARK, " ").encode()]
        return np.array(ids, np.uint32)

    def _forget(self) -> None:
        self.cache: dict[bytes, np.ndarray] = {}
        self.held = 0

    def _solved(self, stretch: bytes) -> np.ndarray:
        """``solve``, remembered if the stretch is short."""
        ids = self.solve(stretch)
        if len(stretch) <= _CACHE_LONGEST:
            self.cache[stretch] = ids
            self.held += len(stretch) + ids.nbytes + 240  # with what Python itself needs for both
        return ids

    # batches

    def normalised(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes with dummy prefixes (word marks as spaces), and their bounds."""
        raw, bounds = tb.raw_bytes(texts.cast(pa.binary()))
        if MARK.encode() in raw.tobytes():
            data = [x.replace(MARK.encode(), b" ") for x in texts.cast(pa.binary()).to_pylist()]
            raw, bounds = tb.raw_bytes(pa.array(data, pa.binary()))
        if not self.dummy_prefix:
            return raw, bounds
        full = np.diff(bounds) > 0
        out = np.insert(raw, bounds[:-1][full], 0x20)
        return out, np.concatenate([[0], np.cumsum(np.diff(bounds) + full)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        return self._encode(*self.normalised(texts))

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(bounds) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joined.reshape(-1)[data[:-1].astype(np.int64) << 8 | data[1:]]
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate([starts[1:], [len(data)]])
        of = np.searchsorted(bounds, starts, "right") - 1
        first, back = tb.distinct(tb.span_hashes(data, starts, ends))
        text = data.tobytes()
        stretches = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if self.held > _CACHE_BYTES:
            self._forget()
        found = list(map(self.cache.get, stretches))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self._solved(stretches[i])
        lens = np.fromiter(map(len, found), np.int64, len(found))
        heads = np.cumsum(lens) - lens
        flat = np.concatenate(found)
        return tb.pick(flat, heads[back], lens[back]), np.bincount(of, weights=lens[back], minlength=n).astype(np.int64)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return tb.pick(self.out_flat, self.out_heads[ids], self.out_lens[ids])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the dummy prefix."""
        data = self.decode_bytes(np.asarray(ids, np.int64)).tobytes()
        return (data[1:] if self.dummy_prefix and data[:1] == b" " else data).decode(errors="replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_texts(docs: DataFrame, keys: list[str], tokenizer: str = "piece_bpe_32k.model", text: str = "text", with_ids: bool = True) -> DataFrame:
    """The ``keys`` columns, ``n_pieces``, ``n_byte_pieces``, ``ids_crc32`` (of the ids as little-endian 32-bit integers),
    ``round_trip`` (whether decoding gives the text again) and, ``with_ids``, the ``ids``."""
    path = tokenizer_file(tokenizer)
    source = text_of(docs, *keys, text=text, text_as="_body")
    fields = source.drop("_body").schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches):
        fst = transducer(path)
        for batch in pieces(batches, "_body", 2 << 20):
            body = batch.column("_body").fill_null("")
            data, bounds = fst.normalised(body)
            ids, lens = fst._encode(data, bounds)
            ends = np.cumsum(lens)
            starts = ends - lens
            decoded = fst.decode_bytes(ids)
            decoded_ends = np.concatenate([[0], np.cumsum(fst.out_lens[ids])])
            if len(decoded) == len(data) and (decoded_ends[np.concatenate([[0], ends])] == bounds).all():
                wrong = np.concatenate([[0], np.cumsum(decoded != data)])[bounds]
                same = np.diff(wrong) == 0
            else:
                same = np.array([bytes(data[a:b]) == bytes(fst.decode_bytes(ids[x:y])) for a, b, x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), starts.tolist(), ends.tolist(), strict=True)], bool)
            raw, _ = tb.raw_bytes(body.cast(pa.binary()))
            if MARK.encode() in raw.tobytes():
                same &= np.array([MARK not in t for t in body.to_pylist()])
            packed = memoryview(ids.astype("<u4").tobytes())
            checks = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n_bytes = np.diff(np.concatenate([[0], np.cumsum(fst.is_byte[ids])])[np.concatenate([[0], ends])])
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "_body"]
            names = [f.name for f in batch.schema if f.name != "_body"]
            columns += [pa.array(lens), pa.array(n_bytes.astype(np.int64)), pa.array(checks, pa.int64()), pa.array(same)]
            names += ["n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(source, run, f"{fields}, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * with_ids)


def piece_digest(docs: DataFrame) -> DataFrame:
    """The rows of query op10."""
    return encode_texts(docs, ["doc_id"], with_ids=False)
