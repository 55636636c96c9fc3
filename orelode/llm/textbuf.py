"""Words of whole Arrow batches without a Python loop: boundaries, 64-bit hashes and windows as NumPy arrays.

A byte table says which bytes belong to words and what they count as (folding A-Z is part of it). All classes in use
split at ASCII bytes only, so work on UTF-8 bytes equals work on code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from orelode.llm.cluster import offsets_of

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def byte_table(separators: np.ndarray, fold: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if fold:
        table[0x41:0x5B] += 0x20
    table[separators] = 0
    return table


#: Words ``[^\x20\x09-\x0D]+``; a NUL byte is a word byte there, so byte 0 counts as 0xFF, which UTF-8 never uses.
PLAIN = byte_table(_SPACE, False)
FOLDED = byte_table(_SPACE, True)
PLAIN[0] = FOLDED[0] = 0xFF
_ALNUM = np.ones(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x41:0x5B] = _ALNUM[0x80:] = False
#: After folding, words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_FOLDED = byte_table(_ALNUM, True)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]), dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """``starts``/``ends``: bytes in ``raw``; ``first``: index of each document's first word, and one past the last."""

    raw: np.ndarray
    mapped: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.mapped, self.starts, self.ends)

    def left(self) -> np.ndarray:
        """Words from each one to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (not empty, ordered, disjoint) span of ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    heads = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(heads, lens)
    values = _BYTE[data[within + np.repeat(starts, lens)]]
    values *= _power(int(lens.max()))[within]
    return mix(np.add.reduceat(values, heads) ^ (lens.astype(np.uint64) * _STEP))


def raw_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array's values in one piece, and each value's bounds therein."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) else b"")
    bounds = offsets_of(arr)
    if not len(arr) or arr.buffers()[2] is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(arr.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(arr: pa.Array, table: np.ndarray = PLAIN) -> Words:
    raw, bounds = raw_bytes(arr)
    mapped = table[raw]
    inside = mapped != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    begins, stops = inside.copy(), inside.copy()
    if len(raw):
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return Words(raw, mapped, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, bounds), bounds)


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of ``k`` values (whatever documents they cross); ``len(h) - k + 1`` of them.

    Built by doubling: a window of 2n is the window of n times a constant plus the next window of n.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    step = mix(np.array([salt * 2 + 0x5851F42D4C957F2D], np.uint64)) | np.uint64(1)  # arrays of one: these wrap
    block, size, factor = h.astype(np.uint64), 1, step  # block: windows of ``size``; factor: step ** size
    out, done, rest = None, 0, k
    while True:
        if rest & 1:
            if out is None:
                out = block.copy()
            else:
                n = len(h) - done - size + 1
                out = out[:n] * factor + block[done : done + n]
            done += size
        rest >>= 1
        if not rest:
            return mix(out[: len(h) - k + 1])
        n = len(block) - size
        block = block[:n] * factor + block[size:]
        factor = factor * factor
        size *= 2


def inside_doc(w: Words, k: int) -> np.ndarray:
    """Which of the ``windows(…, k)`` lie within one document."""
    return w.left()[: max(0, len(w) - k + 1)] >= k


def covered(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a flagged window of ``k``; ``flags`` may be shorter than ``n``."""
    change = np.zeros(n + 1, np.int32)
    change[: len(flags)] += flags
    change[k : k + len(flags)] -= flags
    return np.cumsum(change[:n]) > 0


def pick(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of ``data[s : s + n]``."""
    heads = np.cumsum(lens) - lens
    return data[np.arange(int(lens.sum())) - np.repeat(heads - starts, lens)]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, in order of the values; and which of them each value is."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[order[1:]], h[order[:-1]], out=new[1:])
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back
