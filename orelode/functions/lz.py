"""Dictionary codecs: bytes to bytes, or None if the input isn't sound.

Most formats are groups of eight steps behind a byte of flags, a step being a literal byte or a (distance, length) copy.
``expand`` finds the flags and copies of a whole stream and reads them as arrays; then one loop over the copies is left,
with slices for literals in a row. ``pack_groups`` finds for each place the last one with the same three bytes by a sort,
and how far both go on, before it parses. Formats that are stored backwards are read on the reversed bytes.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np

MIB = 1 << 20
LZ_LIMIT, YAZ0_LIMIT, LEVEL5_LIMIT, CRILAYLA_LIMIT = 50 * MIB, 50 * MIB, 32 * MIB, 64 * MIB


#: By a byte of flags (1: a copy): how many copies it has, and how many literals stand before each of them and after the last.
_COPIES = bytes(f.bit_count() for f in range(256))


def _runs_between(flags: int) -> tuple[tuple[int, ...], int]:
    before, run = [], 0
    for bit in range(7, -1, -1):
        if flags >> bit & 1:
            before.append(run)
            run = 0
        else:
            run += 1
    return tuple(before), run


_RUNS = [_runs_between(f) for f in range(256)]


class Copies:
    """How a format writes copies: the bytes of each by the high half of its first one, and what they mean."""

    def __init__(self, used: tuple[int, ...], read, copy_bit: int = 1):
        self.used, self.read, self.turn = used, read, 0 if copy_bit else 0xFF


def _word(bits: int, add: int, least: int) -> Copies:
    """Two bytes: a length above ``bits`` of a distance."""
    return Copies((2,) * 16, lambda w, used: ((w & (1 << bits) - 1) + add, (w >> bits) + least))


def _read_lz11(w: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three lengths of codes, told apart by the first four bits."""
    length = np.select([used == 3, used == 4], [(w >> 12 & 0xFF) + 0x11, (w >> 12 & 0xFFFF) + 0x111], (w >> 12 & 0xF) + 1)
    return (w & 0xFFF) + 1, length


def _read_yaz0(w: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length stands in the first four bits, or in a third byte."""
    return np.where(used == 3, w >> 8 & 0xFFF, w & 0xFFF) + 1, np.where(used == 3, (w & 0xFF) + 0x12, (w >> 12) + 2)


LZ10, LZ11, YAZ0 = _word(12, 1, 3), Copies((3, 4) + (2,) * 14, _read_lz11), Copies((3,) + (2,) * 15, _read_yaz0, copy_bit=0)
BLZ, CRILAYLA = _word(12, 3, 3), _word(11, 1, 3)


def _layout(data: bytes, at: int, form: Copies) -> tuple[list[int], list[int] | None]:
    """Where a stream's flags stand, and (None if all are two bytes) its copies."""
    n, turn, flags = len(data), form.turn, []
    if set(form.used) == {2}:
        while at < n:
            flags.append(at)
            at += 9 + _COPIES[data[at] ^ turn]
        return flags, None
    copies, used = [], form.used
    while at < n:
        flags.append(at)
        before, after = _RUNS[data[at] ^ turn]
        at += 1
        for run in before:
            at += run
            if at >= n:
                break
            copies.append(at)
            at += used[data[at] >> 4]
        at += after
    return flags, copies


def expand(data: bytes, at: int, size: int, form: Copies) -> bytes:
    """At most ``size`` bytes of what a stream's steps make; places before the start count as zero bytes."""
    if at >= len(data) or size <= 0:
        return b""
    found, copies = _layout(data, at, form)
    n, heads = len(data), np.array(found, np.int64)
    raw = np.frombuffer(data + bytes(4), np.uint8)
    if copies is None:
        flags = np.unpackbits(raw[heads] ^ np.uint8(form.turn)).reshape(-1, 8)
        place = heads[:, None] + 1 + np.cumsum(1 + flags.astype(np.int64), axis=1) - 1 - flags
        starts = place[flags == 1]
    else:
        starts = np.array(copies, np.int64)
    starts = starts[starts < n]
    used = np.array(form.used, np.int64)[raw[starts] >> 4]
    # what is neither flags nor copies is literal; a step that the data ends in is the end
    whole = starts + used <= n
    end = n if whole.all() else int(starts[np.argmin(whole)])
    starts, used = starts[whole], used[whole]
    step = np.zeros(end, bool)
    step[at:] = True
    step[heads[heads < end]] = False
    for i in range(1, 4):
        inner = starts[used > i] + i
        step[inner] = False
    places = np.flatnonzero(step)
    word = np.zeros(len(starts), np.int64)
    for i in range(4):
        word = np.where(used > i, word << 8 | raw[starts + i], word)
    distance, length = form.read(word, used)
    which = np.searchsorted(places, starts)
    plain = np.ones(len(places), bool)
    plain[which] = False
    literal = raw[places[plain]].tobytes()
    runs = np.diff(which, prepend=-1) - 1
    out, done, at = bytearray(), 0, 0
    for run, back, n in zip(runs.tolist(), distance.tolist(), length.tolist(), strict=True):
        if run:
            out += literal[at : at + run]
            at += run
            done += run
        place = done - back
        if place < 0:
            zeros = min(n, -place)
            out += bytes(zeros)
            done += zeros
            place, n = done - back, n - zeros
        if back >= n:
            out += out[place : place + n]
        else:
            seed = out[place:]
            out += (seed * (n // back + 1))[:n]
        done += n
        if done >= size:
            break
    else:
        out += literal[at:]
    return bytes(out[:size])


# LZ10, LZ11, LZ13


def lz_header(data: bytes) -> tuple[int, int] | None:
    """(size of the output, where the stream starts); a size of 0 in the first word stands in the next."""
    if len(data) < 4:
        return None
    size, start = int.from_bytes(data[1:4], "little"), 4
    if not size and len(data) >= 8:
        size, start = int.from_bytes(data[4:8], "little"), 8
    return (size, start) if 0 < size <= LZ_LIMIT else None


def is_lz(data: bytes, path: str = "") -> bool:
    """LZ by its first byte, a sound size and, without a telling extension, a likely ratio."""
    head = lz_header(data) if data[:1] in (b"\x10", b"\x11", b"\x13") else None
    if not head:
        return False
    if "." in path and path.rsplit(".", 1)[1].lower() in ("lz", "cmp"):
        return True
    return len(data) >= 5 and len(data) <= 2 * head[0] and head[0] <= 20 * len(data)


def unpack_lz(data: bytes) -> bytes | None:
    head = lz_header(data)
    if not head or data[0] not in (0x10, 0x11, 0x13):
        return None
    size, start = head
    if data[0] == 0x13:
        inner = data[start:]
        if len(inner) >= 4 and inner[0] == 0x11:
            return unpack_lz(inner)
        out = expand(inner[::-1], 0, size, LZ11)
        return out[::-1] if len(out) == size else None
    out = expand(data, start, size, LZ10 if data[0] == 0x10 else LZ11)
    return out if len(out) == size else None


# Yaz0, zlib, gzip behind a size


def unpack_yaz0(data: bytes) -> bytes | None:
    if len(data) < 16 or data[:4] != b"Yaz0":
        return None
    size = int.from_bytes(data[4:8], "big")
    return expand(data, 16, size, YAZ0) if size <= YAZ0_LIMIT else None


def unpack_zlib(data: bytes) -> bytes | None:
    if data[:1] != b"\x78" or data[1:2] not in (b"\x01", b"\x5e", b"\x9c", b"\xda"):
        return None
    try:
        return zlib.decompressobj().decompress(data, LZ_LIMIT)
    except zlib.error:
        return None


def unpack_sized_gzip(data: bytes) -> bytes | None:
    if data[4:6] != b"\x1f\x8b":
        return None
    try:
        return gzip.decompress(data[4:])
    except (OSError, EOFError, zlib.error):
        return None


# BLZ and CRILAYLA, read from their ends


def blz_footer(data: bytes) -> tuple[int, int, int] | None:
    """(packed bytes, footer bytes, growth)."""
    if len(data) < 12:
        return None
    packed, footer, grows = int.from_bytes(data[-8:-5], "little"), data[-5], struct.unpack("<i", data[-4:])[0]
    sound = footer in (8, 11) and footer < packed <= len(data) and 0 < grows <= 5 * len(data) and len(data) + grows <= LZ_LIMIT
    return (packed, footer, grows) if sound else None


def unpack_blz(data: bytes) -> bytes | None:
    foot = blz_footer(data)
    if not foot:
        return None
    packed, footer, grows = foot
    plain = len(data) - packed
    size = packed + grows
    tail = expand(data[plain : len(data) - footer][::-1], 0, size, BLZ)
    return data[:plain] + tail[::-1] if len(tail) == size else None


def unpack_crilayla(data: bytes) -> bytes | None:
    """What follows the packed bytes is the start of the file, as it is."""
    if len(data) < 16 or data[:8] != b"CRILAYLA":
        return None
    size, packed = struct.unpack("<II", data[8:16])
    if size > CRILAYLA_LIMIT:
        return None
    body = expand(data[16 : 16 + packed][::-1], 0, size, CRILAYLA)
    return data[16 + packed :] + bytes(size - len(body)) + body[::-1]


# Level-5: five methods behind one word


def unpack_level5(data: bytes) -> bytes | None:
    if len(data) < 8:
        return None
    word = int.from_bytes(data[:4], "little")
    method, size = word & 7, word >> 3
    if not 0 < size <= LEVEL5_LIMIT:
        return None
    body = data[4:]
    if method == 0:
        return body[:size]
    if method == 1:
        out = expand(body, 0, size, LZ10)
    elif method in (2, 3):
        out = _huffman(body, size, 4 if method == 2 else 8)
    elif method == 4:
        out = b"".join(_runs(body))[:size]
    else:
        return None
    return out if out and len(out) >= size // 2 else None


def _runs(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        n = data[at] & 0x7F
        if data[at] & 0x80:
            if at + 1 >= len(data):
                return
            yield data[at + 1 : at + 2] * (n + 3)
            at += 2
        else:
            yield data[at + 1 : at + 2 + n]
            at += 2 + n


def _huffman(data: bytes, size: int, width: int) -> bytes | None:
    """A tree of nodes (offset of the children, whether they are leaves), then words of bits, high bit first."""
    if len(data) < 5:
        return None
    start = (1 + 2 * (data[0] + 1) + 3) & ~3
    if start >= len(data):
        return None
    words = data[start : start + (len(data) - start) // 4 * 4]
    bits = "".join(f"{w:032b}" for (w,) in struct.iter_unpack("<I", words))
    out, at, node, half = bytearray(), 0, 1, None
    for bit in bits:
        if len(out) >= size or node >= start:
            break
        child = ((node - 1) & ~1) + 1 + (data[node] & 0x3F) + 2 + (bit == "1")
        if data[node] & (0x40 if bit == "1" else 0x80):
            if child >= start:
                break
            value, node = data[child], 1
            if width == 8:
                out.append(value)
            elif half is None:
                half = value & 15
            else:
                out.append((value & 15) << 4 | half)
                half = None
        else:
            node = child
        at += 1
    return bytes(out[:size])


# packers


#: Bytes of a match that are compared for all places at once; longer ones are followed where they are used.
_AT_ONCE = 64


def _matches(data: bytes, reach: int, most: int, nearest: int) -> tuple[list[int], list[int]]:
    """For each place the last one before it with the same three bytes, and for how many bytes both go on (0: none)."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    length = np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    if n > 3:
        wide = raw.astype(np.int64)
        key = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) << 32 | np.arange(n - 2)
        key.sort()
        place = key & 0xFFFFFFFF
        same = key[1:] >> 32 == key[:-1] >> 32
        before[place[1:][same]] = place[:-1][same]
        here = np.arange(n)
        while len(close := np.flatnonzero((before >= 0) & (here - before < nearest))):
            before[close] = before[before[close]]
        live = np.flatnonzero((before >= 0) & (here - before <= reach))
        length[live] = 3
        for k in range(3, min(most, _AT_ONCE)):
            live = live[live + k < n]
            live = live[raw[live + k] == raw[before[live] + k]]
            if not len(live):
                break
            length[live] = k + 1
    return before.tolist(), length.tolist()


def pack_groups(data: bytes, reach: int, most: int, code, copy_bit: int = 1, nearest: int = 1) -> bytes:
    """Groups of a greedy parse: copies of 3 to ``most`` bytes from up to ``reach`` back (and ``nearest`` at least);
    ``code(distances, lengths)`` gives what they are written as, big-endian, and in how many bytes."""
    n = len(data)
    if not n:
        return b""
    before, length = _matches(data, reach, most, nearest)
    places, lengths, at = [], [], 0
    while at < n:
        here = length[at]
        if here == _AT_ONCE:
            other = before[at]
            while here < most and at + here < n and data[other + here] == data[at + here]:
                here += 1
        places.append(at)
        lengths.append(here)
        at += here or 1
    place, size = np.array(places), np.array(lengths)
    copied = size > 0
    value = np.frombuffer(data, np.uint8)[place].astype(np.int64)
    used = np.ones(len(place), np.int64)
    value[copied], used[copied] = code(place[copied] - np.array(before)[place[copied]], size[copied])
    start = np.arange(len(place)) // 8 + 1 + np.cumsum(used) - used
    out = np.zeros(-(-len(place) // 8) + int(used.sum()), np.uint8)
    for i in range(4):
        more = used > i
        out[start[more] + i] = value[more] >> 8 * (used[more] - 1 - i) & 0xFF
    out[start[::8] - 1] = np.packbits(copied if copy_bit else ~copied)
    return out.tobytes()


def _sized(kind: int, size: int) -> bytes:
    return bytes([kind]) + (size.to_bytes(3, "little") if 0 < size < 1 << 24 else bytes(3) + size.to_bytes(4, "little"))


def pack_lz10(data: bytes) -> bytes:
    return _sized(0x10, len(data)) + pack_groups(data, 4096, 18, lambda d, n: ((n - 3) << 12 | d - 1, 2))


def _code_lz11(d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short, middle = n <= 0x10, n <= 0x110
    value = np.select([short, middle], [n - 1 << 12, n - 0x11 << 12], 1 << 28 | n - 0x111 << 12) | d - 1
    return value, np.select([short, middle], [2, 3], 4)


def _code_yaz0(d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(n <= 17, n - 2 << 12 | d - 1, d - 1 << 8 | n - 0x12), np.where(n <= 17, 2, 3)


def pack_lz11(data: bytes) -> bytes:
    return _sized(0x11, len(data)) + pack_groups(data, 4096, 0x10110, _code_lz11)


def pack_lz13(data: bytes) -> bytes:
    return _sized(0x13, len(data)) + pack_lz11(data)


def pack_yaz0(data: bytes) -> bytes:
    return b"Yaz0" + len(data).to_bytes(4, "big") + bytes(8) + pack_groups(data, 4096, 0x111, _code_yaz0, copy_bit=0)


def pack_zlib(data: bytes) -> bytes:
    return zlib.compress(data, 6)


def pack_sized_gzip(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + gzip.compress(data, 6, mtime=0)


def pack_blz(data: bytes) -> bytes | None:
    """None if the data doesn't get smaller, which the format can't say."""
    body = pack_groups(data[::-1], 4098, 18, lambda d, n: ((n - 3) << 12 | d - 3, 2), nearest=3)[::-1]
    packed = len(body) + 8
    grows = len(data) - packed
    return body + packed.to_bytes(3, "little") + b"\x08" + grows.to_bytes(4, "little") if 0 < grows <= 5 * packed and packed < 1 << 24 else None


def pack_crilayla(data: bytes, prefix: int = 256) -> bytes:
    head, tail = data[:prefix], data[prefix:]
    body = pack_groups(tail[::-1], 2048, 34, lambda d, n: ((n - 3) << 11 | d - 1, 2))[::-1]
    return b"CRILAYLA" + struct.pack("<II", len(tail), len(body)) + body + head


def pack_level5_runs(data: bytes) -> bytes:
    out, at = bytearray(((len(data) << 3) | 4).to_bytes(4, "little")), 0
    while at < len(data):
        n = 1
        while n < 130 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n >= 3:
            out += bytes([0x80 | n - 3, data[at]])
        else:
            n = 1
            while n < 128 and at + n < len(data) and not data[at + n : at + n + 1] * 3 == data[at + n : at + n + 3]:
                n += 1
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out.ljust(8, b"\0"))  # a stream has eight bytes at least


#: name: (packer, unpacker)
CODECS = {
    "lz10": (pack_lz10, unpack_lz),
    "lz11": (pack_lz11, unpack_lz),
    "lz13": (pack_lz13, unpack_lz),
    "yaz0": (pack_yaz0, unpack_yaz0),
    "zlib": (pack_zlib, unpack_zlib),
    "gzip": (pack_sized_gzip, unpack_sized_gzip),
    "blz": (pack_blz, unpack_blz),
    "crilayla": (pack_crilayla, unpack_crilayla),
    "level5_runs": (pack_level5_runs, unpack_level5),
}
