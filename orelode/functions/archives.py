"""Archives: bytes to (name, payload) entries, and packers that write small ones for round trips.

Readers take a ``View``, whose reads raise ``Broken`` outside the data. A reader is a generator: what it has found before
a broken entry stays found.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from orelode.functions.lz import CRILAYLA_LIMIT, lz_header, unpack_crilayla, unpack_level5, unpack_lz

Entry = tuple[str, bytes]
MAX_ENTRIES = 100_000
MAX_ENTRY = 50 << 20
#: Fixed values of the formats.
TEX_EXTENSION_HASH = 0x241F5DEB
CPK_SKIP = ("acb", "awb", "bcstm", "bcsnd", "bcsar", "moflex", "txt", "csv", "xml", "lua", "shbin", "msbt", "msbp", "mp4", "adx", "hca", "usm")


class Broken(ValueError):
    """A read outside the data, or a value that the format rules out."""


class View:
    def __init__(self, data: bytes, order: str = "<"):
        self.data, self.order = data, order

    def ints(self, at: int, layout: str) -> tuple[int, ...]:
        try:
            return struct.unpack_from(self.order + layout, self.data, at)
        except struct.error as e:
            raise Broken(str(e)) from e

    def int(self, at: int, kind: str = "I") -> int:
        return self.ints(at, kind)[0]

    def expect(self, at: int, magic: bytes) -> None:
        if self.data[at : at + len(magic)] != magic:
            raise Broken(f"no {magic!r} at {at}")

    def text(self, at: int, most: int, encoding: str = "ascii") -> str:
        raw = self.data[at : at + most] if at >= 0 else b""
        return raw.split(b"\0", 1)[0].decode(encoding, "replace")

    def cut(self, start: int, end: int) -> bytes | None:
        return self.data[start:end] if 0 <= start < end <= len(self.data) else None


def guess_extension(data: bytes) -> str:
    return {b"CGFX": ".cgfx", b"BCH\0": ".bch", b"CTPK": ".ctpk", b"SARC": ".sarc"}.get(data[:4], ".bin")


def read_garc(data: bytes) -> Iterator[Entry]:
    v = View(data)
    v.expect(0, b"CRAG")
    head, mark, base = v.int(4), v.int(8, "H"), v.int(16)
    if mark not in (0xFEFF, 0xFFFE):
        raise Broken("byte order mark")
    v.expect(head, b"OTAF")
    table = head + v.int(head + 4)
    v.expect(table, b"BTAF")
    count = v.int(table + 8)
    if count > MAX_ENTRIES:
        raise Broken("entries")
    for i in range(count):
        _, start, end, _ = v.ints(table + 12 + 16 * i, "4I")
        payload = v.cut(base + start, base + end)
        if payload:
            yield f"{i:04d}{guess_extension(payload)}", payload


def read_sarc(data: bytes) -> Iterator[Entry]:
    v = View(data, ">" if data[6:8] == b"\xfe\xff" else "<")
    v.expect(0, b"SARC")
    nodes, base = v.int(4, "H"), v.int(12)
    v.expect(nodes, b"SFAT")
    head, count = v.ints(nodes + 4, "2H")
    first = nodes + head
    names = first + 16 * count
    v.expect(names, b"SFNT")
    names += v.int(names + 4, "H")
    for i in range(count):
        _, attributes, start, end = v.ints(first + 16 * i, "4I")
        name = v.text(names + 4 * (attributes & 0xFFFFFF), 512, "utf-8") if attributes >> 24 & 1 and names + 4 * (attributes & 0xFFFFFF) < len(data) else f"file_{i:04d}"
        if base + start <= len(data):
            yield name, data[base + start : min(base + end, len(data))]


def read_narc(data: bytes) -> Iterator[Entry]:
    v = View(data, "<" if data[4:6] == b"\xfe\xff" else ">")
    v.expect(0, b"NARC")
    v.expect(16, b"BTAF")
    size, count = v.ints(20, "2I")
    if not 0 < count <= MAX_ENTRIES:
        raise Broken("entries")
    names = 16 + size
    v.expect(names, b"BTNF")
    image = names + v.int(names + 4)
    v.expect(image, b"GMIF")
    for i in range(count):
        start, end = v.ints(28 + 8 * i, "2I")
        payload = v.cut(image + 8 + start, image + 8 + end)
        if payload:
            yield f"{i:04d}", payload


def read_darc(data: bytes) -> Iterator[Entry]:
    v = View(data)
    v.expect(0, b"darc\xff\xfe")
    table = v.int(6, "H")
    count = v.int(table + 8)
    if not 1 <= count <= MAX_ENTRIES:
        raise Broken("entries")
    names = table + 12 * count
    for i in range(1, count):
        name, start, size = v.ints(table + 12 * i, "3I")
        if name >> 24 == 1:  # a folder
            continue
        at = names + (name & 0xFFFFFF)
        end = at
        while end + 1 < len(data) and data[end : end + 2] != b"\0\0":
            end += 2
        payload = v.cut(start, start + size)
        if payload:
            yield data[at:end].decode("utf-16-le", "replace") or f"darc_{i:04d}", payload


def read_zar(data: bytes) -> Iterator[Entry]:
    """Payloads lie one after the other; there are only sizes."""
    v = View(data)
    v.expect(0, b"ZAR\x01")
    count, _, table, at = v.int(10, "H"), v.int(12), v.int(16), v.int(20)
    if not 0 < count <= 10_000 or len(data) > 100 << 20:
        raise Broken("entries")
    for i in range(count):
        size, name = v.ints(table + 8 * i, "2I")
        if at + size > len(data):
            return
        if size:
            yield (v.text(name, 256) if name < len(data) else "") or f"{i:04d}.bin", data[at : at + size]
        at += size


def read_gar(data: bytes) -> Iterator[Entry]:
    """Members announce themselves: a magic at a multiple of four, then their size."""
    v = View(data)
    v.expect(0, b"GAR")
    at = i = 0
    while at < len(data) - 8:
        kind = {b"ctxb": "ctxb", b"cmb ": "cmb"}.get(data[at : at + 4])
        size = v.int(at + 4) if kind else 0
        if 8 < size <= len(data) - at:
            yield f"gar_{kind}_{i:04d}.{kind}", data[at : at + size]
            at, i = at + size, i + 1
        else:
            at += 4


def read_capcom_arc(data: bytes, wanted: int = TEX_EXTENSION_HASH) -> Iterator[Entry]:
    """Sizes stand in an entry's own fields or in those of the entry before; the first texture that isn't first tells."""
    v = View(data)
    v.expect(0, b"ARC\0")
    entries = []
    for i in range(v.int(6, "H")):
        at = 8 + 80 * i
        if at + 80 > len(data):
            break
        entries.append((*v.ints(at + 0x44, "3I"), v.int(at), data[at + 4 : at + 68].split(b"\0", 1)[0].decode("latin-1")))

    def payload(i: int, own: bool) -> bytes | None:
        _, size, info = entries[i if own else i - 1][:3]
        raw = v.cut(entries[i][3], entries[i][3] + size)
        if raw is not None and info & (0x40000000 if own else 0x20000000):
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                return None
        return raw if raw and raw[:4] == b"TEX\0" else None

    textures = [i for i, e in enumerate(entries) if e[0] == wanted and e[3]]
    telling = next((i for i in textures if i), None)
    own = telling is None or payload(telling, True) is not None or payload(telling, False) is None
    for i in textures:
        found = payload(i, own or not i)
        if found is not None:
            yield entries[i][4], found


def read_fe_arc(data: bytes) -> Iterator[Entry]:
    v = View(data)
    if len(data) < 0x28 or v.int(0) != len(data) or not {data[0x20], data[0x24]} & {0x10, 0x11, 0x13}:
        raise Broken("not an archive of this kind")
    count, i = v.int(8), 0
    if not 1 <= count <= 64:
        raise Broken("entries")
    for at in range(0x20, min(0x24 + 4 * count, len(data) - 3), 4):
        found = unpack_lz(data[at:]) if data[at] in (0x10, 0x11, 0x13) else None
        kind = {b"CTPK": "ctpk", b"CGFX": "cgfx", b"BCH\0": "bch"}.get((found or b"")[:4])
        if kind:
            yield f"fe_arc_{kind}_{i:04d}.{kind}", found
            i += 1


def read_gfac(data: bytes) -> Iterator[Entry]:
    v = View(data)
    v.expect(0, b"GFAC")
    count = v.int(0x2C)
    if not 0 < count <= 10_000:
        raise Broken("entries")
    table = []
    for i in range(count):
        if 0x40 + 16 * i > len(data):
            break
        table.append(v.ints(0x34 + 16 * i, "3I"))
    for (name, size, start), after in zip(table, [*[t[2] for t in table[1:]], len(data)], strict=False):
        if start >= len(data):
            continue
        if name >> 31:
            payload = _gfcp(v, start, size)
        else:
            stop = after if start < after <= len(data) else len(data)
            payload = data[start : min(start + size, stop)]
        if len(payload) >= 4:
            yield v.text(name & 0x7FFFFFFF, 128), payload


def _gfcp(v: View, at: int, size: int) -> bytes:
    if v.data[at : at + 4] != b"GFCP":
        return v.data[at : at + size]
    whole, packed = v.ints(at + 12, "2I")
    stream = v.data[at + 20 : at + 20 + packed]
    head = whole.to_bytes(3, "little") if whole < 1 << 24 else bytes(3) + whole.to_bytes(4, "little")
    return next((out for kind in (b"\x10", b"\x11") if stream and whole and (out := unpack_lz(kind + head + stream))), b"")


def read_offset_table(data: bytes) -> Iterator[Entry]:
    """A count, a zero word and offsets; each member ends where the next one starts."""
    v = View(data)
    count, zero, first = v.ints(0, "3I")
    if zero or not 10 <= count <= 200_000 or not 8 + 4 * count <= first < len(data):
        raise Broken("not an offset table")
    offsets = [*v.ints(8, f"{count}I"), len(data)]
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        if 0 < b - a <= MAX_ENTRY and a < len(data):
            yield f"entry_{i:05d}.bin", data[a:b]


# CPK: two self-describing tables

#: Kinds of @UTF values: struct code; strings and blobs are offsets.
UTF_KINDS = "BbHhIiQqfd"


def read_utf(data: bytes, at: int) -> list[dict[str, object]]:
    v = View(data, ">")
    v.expect(at, b"@UTF")
    base = at + 8
    rows, strings, blobs = (base + x for x in v.ints(base, "3I"))
    n_columns, width, n_rows = v.ints(base + 16, "HHI")

    def value(kind: int, where: int) -> tuple[object, int]:
        if kind == 10:
            return v.text(strings + v.int(where), 1024), 4
        if kind == 11:
            start, size = v.ints(where, "2I")
            return data[blobs + start : blobs + start + size], 8
        if kind >= len(UTF_KINDS):
            return 0, 0
        return v.int(where, UTF_KINDS[kind]), struct.calcsize(">" + UTF_KINDS[kind])

    where, columns = base + 24, []
    for _ in range(n_columns):
        flags, name = v.ints(where, "BI")
        where, constant = where + 5, 0
        if flags >> 5 == 1:
            constant, used = value(flags & 15, where)
            where += used
        columns.append((v.text(strings + name, 1024), flags & 15, flags >> 5, constant))
    out = []
    for r in range(n_rows):
        where, row = rows + r * width, {}
        for name, kind, storage, constant in columns:
            row[name] = constant
            if storage > 1:
                row[name], used = value(kind, where)
                where += used
        out.append(row)
    return out


#: Kinds of models' and images' files that a packed stream may hold, and bytes that may follow it in a group; extensions of
#: the members between which streams are looked for. Fixed values.
CPK_KINDS = (b"CTPK", b"CGFX", b"BCH\0", b"SARC", b"darc")
GROUP_HEADS = (256, 128, 512, 0, 1024, 2048)
CPK_MODELS = ("ctpk", "bch", "bcres", "cgfx")
#: Streams before a member that are tried, and those that end before it, at most.
LOOK_BACK, LOOK_MISSES = 200, 8


class PackedStreams:
    """CRILAYLA streams of a CPK file: where they are, and what a member is that one of them holds."""

    def __init__(self, data: bytes, start: int, end: int):
        self.data, self.found = data, []
        at = data.find(b"CRILAYLA", start, end)
        while at >= 0:
            if at + 16 <= len(data):
                whole, packed = struct.unpack_from("<II", data, at + 8)
                if whole and packed and whole < CRILAYLA_LIMIT:
                    self.found.append((at, whole, packed))
            at = data.find(b"CRILAYLA", at + 1, end)
        self.places = [at for at, _, _ in self.found]
        self.known: dict[int, bytes] = {}
        self.tried: set[tuple[int, int]] = set()

    def member(self, at: int, size: int) -> bytes | None:
        """What the stream at ``at`` makes, for a member of ``size`` bytes: with the plain bytes behind it that are missing; or,
        of a stream for several members, whatever length of them makes it a known kind of file."""
        if self.data[at : at + 8] != b"CRILAYLA" or at + 16 > len(self.data):
            return None
        whole, packed = struct.unpack_from("<II", self.data, at + 8)
        if whole <= size:
            return unpack_crilayla(self.data[at : at + 16 + packed + size - whole])
        for head in GROUP_HEADS:
            if at + 16 + packed + head <= len(self.data):
                out = unpack_crilayla(self.data[at : at + 16 + packed + head])
                if out and out[:4] in CPK_KINDS:
                    return out
        return None

    def before(self, at: int, size: int) -> bytes | None:
        """The same for the nearest stream at or before a place that makes a known kind of file."""
        last, misses = bisect_right(self.places, at) - 1, 0
        for i in range(last, max(last - LOOK_BACK + 1, -1), -1):
            place, whole, packed = self.found[i]
            if whole > 8 * size and whole > 1 << 20:
                continue
            if place in self.known:
                return self.known[place]
            if (place, size) not in self.tried:
                out = self.member(place, size)
                if out and out[:4] in CPK_KINDS:
                    self.known[place] = out
                    return out
                self.tried.add((place, size))
            misses += place + 16 + packed < at
            if misses > LOOK_MISSES:
                break
        return None


def read_cpk(data: bytes, allowed: frozenset[str] | None = None) -> Iterator[Entry]:
    """Members by the table of contents, without sounds, films and scripts; packed ones are unpacked, also those that
    share a stream with others or stand behind a plain head."""
    v = View(data)
    v.expect(0, b"CPK ")
    head = read_utf(data, 16)[0]
    toc = int(head.get("TocOffset") or 0)
    if not toc:
        return
    base = int(head.get("ContentOffset") or 0) or toc
    members = []
    for row in read_utf(data, toc + 16 if data[toc : toc + 4] == b"TOC " else toc):
        name = str(row.get("FileName") or "")
        extension = name.rpartition(".")[2].lower() if "." in name else ""
        start, size = int(row.get("FileOffset") or 0), int(row.get("FileSize") or 0)
        members.append((f"{row['DirName']}/{name}" if row.get("DirName") else name, extension, start, size, int(row.get("ExtractSize") or 0) or size))
    spans = [(base + start, base + start + size) for _, extension, start, size, _ in members if extension in CPK_MODELS]
    streams = PackedStreams(data, min(spans)[0], min(len(data), max(b for _, b in spans) + (1 << 16))) if spans else PackedStreams(data, 0, 0)
    for name, extension, start, size, whole in members:
        if not name.rpartition("/")[2] or extension in CPK_SKIP or (allowed is not None and extension and extension not in allowed):
            continue
        at = base + start if v.cut(base + start, base + start + size) else toc + start
        payload = v.cut(at, at + size)
        if payload:
            yield name, _cpk_member(streams, payload, at, whole)


def _cpk_member(streams: PackedStreams, payload: bytes, at: int, whole: int) -> bytes:
    if payload[:8] == b"CRILAYLA" and len(payload) >= 16:
        return streams.member(at, whole) or payload
    if whole <= len(payload):
        return payload
    inner = payload.find(b"CRILAYLA")
    if inner > 0 and (made := streams.member(at + inner, whole)) is not None:
        both = payload[:inner] + made
        kinds = [both[i:] for i in (both.find(kind) for kind in CPK_KINDS) if 0 <= i < len(both) - 16]
        payload = kinds[0] if kinds else made
    return payload if payload[:4] in CPK_KINDS else streams.before(at, whole) or payload


# archives without a table that can be read: their contents are found by what they start with

#: Kinds that are looked for, where their own header says how long they are, and what may come on top.
SCANNED = ((b"BCH\0", 0x14, 8 << 20, 512 << 10), (b"CGFX", 8, 0x100, 4 << 20), (b"CTPK", 8, 0x100, 4 << 20), (b"IMGC", 0x3C, 0x148, 512 << 10))
LEAST_SCANNED = 64


def _said_size(data: bytes, at: int, field: int, more: int, otherwise: int) -> int:
    """How much of what stands at a place belongs to it: as its header says, if that is possible."""
    left = len(data) - at
    said = int.from_bytes(data[at + field : at + field + 4], "little") if left >= field + 4 else 0
    return min(said + more if 0 < said < left else otherwise, left)


def read_scanned(data: bytes) -> Iterator[Entry]:
    """ARC0 and XFSA: files of known kinds in the data, and packed ones near the start of each XPCK part."""
    v = View(data)
    if data[:4] not in (b"ARC0", b"XFSA"):
        raise Broken("no ARC0 or XFSA")
    start = v.int(0x14)
    start = start if 0 < start < len(data) else v.int(4)
    for magic, field, more, otherwise in SCANNED:
        at = data.find(magic, start)
        while at >= 0:
            size = _said_size(data, at, field, more, otherwise)
            if size >= LEAST_SCANNED:
                yield f"arc0@0x{at:X}[{magic.decode().strip(chr(0))}]", data[at : at + size]
            at = data.find(magic, at + max(4, size))
    at = data.find(b"XPCK", start)
    while at >= 0:
        after = data.find(b"XPCK", at + 4)
        part = data[at : after if after >= 0 else len(data)]
        for inner in range(16, min(len(part) - 4, 256), 4):
            word = int.from_bytes(part[inner : inner + 4], "little")
            if word & 7 == 1 and 256 < word >> 3 < 4 << 20:
                made = unpack_level5(part[inner:])
                if made and len(made) == word >> 3 and any(made.startswith(magic) for magic, *_ in SCANNED):
                    yield f"arc0>xpck@0x{at:X}+0x{inner:X}[lz10][{made[:4].decode().strip(chr(0))}]", made
        at = after


def embedded(data: bytes) -> Iterator[Entry]:
    """Textures' containers anywhere inside other data, kind by kind in order of their places; a slice is at most 4 MiB, or as
    long as the header of a register file says."""
    for magic, kind in ((b"CTPK", "ctpk"), (b"BCH\0", "bch"), (b"CGFX", "cgfx")):
        at = data.find(magic)
        while at >= 0:
            size = _said_size(data, at, 0x14, 8 << 20, 512 << 10) if kind == "bch" else 4 << 20
            yield f"{kind}@embedded+0x{at:X}", data[at : at + size]
            at = data.find(magic, at + 4)


READERS = {"garc": read_garc, "sarc": read_sarc, "narc": read_narc, "darc": read_darc, "zar": read_zar, "gar": read_gar, "capcom_arc": read_capcom_arc, "fe_arc": read_fe_arc, "gfac": read_gfac, "l5_flat": read_offset_table, "cpk": read_cpk, "arc0": read_scanned}


def expand(kind: str, data: bytes) -> tuple[list[Entry], str | None]:
    """All entries that can be read, and what stopped the reader, if anything did."""
    out: list[Entry] = []
    try:
        for entry in READERS[kind](data):
            out.append(entry)
            if len(out) > MAX_ENTRIES:
                return out, "too many entries"
    except (ValueError, struct.error, IndexError, OverflowError, TypeError) as e:  # Broken is a ValueError
        return out, str(e)
    return out, None


# packers


def _laid(payloads: list[bytes], base: int = 0) -> list[tuple[int, int]]:
    spans, at = [], base
    for p in payloads:
        spans.append((at, at + len(p)))
        at += len(p)
    return spans


def pack_garc(entries: list[Entry]) -> bytes:
    payloads = [p for _, p in entries]
    fato = b"OTAF" + struct.pack("<IHH", 12 + 4 * len(payloads), len(payloads), 0xFFFF) + b"".join(struct.pack("<I", 16 * i) for i in range(len(payloads)))
    fatb = b"BTAF" + struct.pack("<II", 12 + 16 * len(payloads), len(payloads)) + b"".join(struct.pack("<4I", 1, a, b, b - a) for a, b in _laid(payloads))
    base = 0x1C + len(fato) + len(fatb)
    return b"CRAG" + struct.pack("<IHHIIII", 0x1C, 0xFEFF, 0x400, 2, base, base + sum(map(len, payloads)), 0) + fato + fatb + b"".join(payloads)


def pack_sarc(entries: list[Entry], order: str = "<") -> bytes:
    names, offsets = b"", []
    for name, _ in entries:
        offsets.append(len(names) // 4)
        raw = name.encode() + b"\0"
        names += raw + bytes(-len(raw) % 4)
    nodes = b"".join(struct.pack(order + "4I", 0, 1 << 24 | o, a, b) for o, (a, b) in zip(offsets, _laid([p for _, p in entries]), strict=True))
    body = b"SFAT" + struct.pack(order + "HHI", 12, len(entries), 0x65) + nodes + b"SFNT" + struct.pack(order + "HH", 8, 0) + names
    base = 0x14 + len(body)
    mark = b"\xff\xfe" if order == "<" else b"\xfe\xff"
    return b"SARC" + struct.pack(order + "H", 0x14) + mark + struct.pack(order + "IIHH", base + sum(len(p) for _, p in entries), base, 0x100, 0) + body + b"".join(p for _, p in entries)


def pack_narc(entries: list[Entry]) -> bytes:
    payloads = [p for _, p in entries]
    table = b"BTAF" + struct.pack("<II", 12 + 8 * len(payloads), len(payloads)) + b"".join(struct.pack("<II", *s) for s in _laid(payloads))
    image = b"".join(payloads)
    return b"NARC\xfe\xff" + struct.pack("<HIHH", 0x100, 16 + len(table) + 16 + 8 + len(image), 16, 3) + table + b"BTNF" + struct.pack("<III", 16, 4, 0x10000) + b"GMIF" + struct.pack("<I", 8 + len(image)) + image


def pack_darc(entries: list[Entry]) -> bytes:
    names, offsets = b"\0\0", []
    for name, _ in entries:
        offsets.append(len(names))
        names += name.encode("utf-16-le") + b"\0\0"
    head, count = 28, len(entries) + 1
    base = head + 12 * count + len(names)
    table = struct.pack("<3I", 1 << 24, 0, count) + b"".join(struct.pack("<3I", o, a, b - a) for o, (a, b) in zip(offsets, _laid([p for _, p in entries], base), strict=True))
    return b"darc\xff\xfe" + struct.pack("<HIIIII", head, 0x1000000, base, head, 12 * count + len(names), base) + table + names + b"".join(p for _, p in entries)


def pack_zar(entries: list[Entry]) -> bytes:
    table = 0x18
    names, at, rows = b"", table + 8 * len(entries), []
    for name, payload in entries:
        rows.append(struct.pack("<II", len(payload), at + len(names)))
        names += name.encode("ascii", "replace") + b"\0"
    base = at + len(names)
    return b"ZAR\x01" + struct.pack("<IHHIII", base + sum(len(p) for _, p in entries), 1, len(entries), table, table, base) + b"".join(rows) + names + b"".join(p for _, p in entries)


def pack_gar(entries: list[Entry]) -> bytes:
    out = bytearray(b"GAR\x02" + bytes(0x1C))
    for _, payload in entries:
        padded = payload + bytes(-len(payload) % 4)  # the next magic is looked for at a multiple of four
        out += b"ctxb" + struct.pack("<I", 8 + len(padded)) + padded
    return bytes(out + bytes(8))


def pack_capcom_arc(entries: list[Entry], own: bool = True) -> bytes:
    packed = [zlib.compress(b"TEX\0" + p) for _, p in entries]
    names = [n.encode("ascii", "replace")[:63] for n, _ in entries]
    spans = _laid(packed, 8 + 80 * (len(entries) + (not own)))
    sizes = [(b - a, len(p) + 4) for (a, b), (_, p) in zip(spans, entries, strict=True)]
    rows = []
    if own:
        for name, (a, _), (size, whole) in zip(names, spans, sizes, strict=True):
            rows.append(struct.pack("<I64s3I", a, name, TEX_EXTENSION_HASH, size, whole | 0x40000000))
    else:
        ahead = [(0, b"", 0, 0), *[(a, n, TEX_EXTENSION_HASH, 0) for n, (a, _) in zip(names, spans, strict=True)]]
        after = [*[(s, w | 0x20000000) for s, w in sizes], (0, 0)]
        rows = [struct.pack("<I64s3I", a, n, h, s, w) for (a, n, h, _), (s, w) in zip(ahead, after, strict=True)]
    return b"ARC\0" + struct.pack("<HH", 0x10 if own else 0x13, len(rows)) + b"".join(rows) + b"".join(packed)


def pack_fe_arc(entries: list[Entry]) -> bytes:
    """One entry, packed, in the second place where one may stand."""
    from orelode.functions.lz import pack_lz11

    ((_, payload),) = entries
    stream = pack_lz11(payload)
    return struct.pack("<III", 0x24 + len(stream), 0, 1).ljust(0x24, b"\0") + stream


def pack_gfac(entries: list[Entry]) -> bytes:
    from orelode.functions.lz import pack_lz10

    names, at, rows, blocks = b"", 0x30 + 16 * len(entries), [], []
    name_at = []
    for name, _ in entries:
        name_at.append(at + len(names))
        names += name.encode("ascii", "replace") + b"\0"
    base = at + len(names)
    for i, ((_, payload), where) in enumerate(zip(entries, name_at, strict=True)):
        if i % 2 and payload:
            stream = pack_lz10(payload)
            stream = stream[lz_header(stream)[1] :]
            block = b"GFCP" + struct.pack("<4I", 1, 3, len(payload), len(stream)) + stream
            where |= 1 << 31
        else:
            block = payload
        rows.append(struct.pack("<4I", i, where, len(payload), base))
        blocks.append(block)
        base += len(block)
    return b"GFAC" + bytes(0x28) + struct.pack("<I", len(entries)) + b"".join(rows) + names + b"".join(blocks)


def pack_offset_table(entries: list[Entry]) -> bytes:
    payloads = [p for _, p in entries]
    return struct.pack("<II", len(payloads), 0) + b"".join(struct.pack("<I", a) for a, _ in _laid(payloads, 8 + 4 * len(payloads))) + b"".join(payloads)


def pack_utf(name: str, columns: list[tuple[str, int]], rows: list[list[object]]) -> bytes:
    strings: dict[str, int] = {}
    pool = bytearray()

    def string(text: str) -> int:
        if text not in strings:
            strings[text] = len(pool)
            pool.extend(text.encode("ascii", "replace") + b"\0")
        return strings[text]

    string(name)
    fields = b"".join(struct.pack(">BI", 2 << 5 | kind, string(column)) for column, kind in columns)
    width = sum(4 if kind == 10 else struct.calcsize(">" + UTF_KINDS[kind]) for _, kind in columns)
    body = b"".join(struct.pack(">I", string(str(x))) if kind == 10 else struct.pack(">" + UTF_KINDS[kind], x) for row in rows for x, (_, kind) in zip(row, columns, strict=True))
    at = 24 + len(fields)
    head = struct.pack(">4IHHI", at, at + len(body), at + len(body) + len(pool), 0, len(columns), width, len(rows))
    whole = head + fields + body + bytes(pool)
    return b"@UTF" + struct.pack(">I", len(whole)) + whole


def pack_cpk(entries: list[Entry], whole: list[int] | None = None) -> bytes:
    """``whole``: the members' sizes once they are unpacked, if they are packed."""
    sizes = whole or [len(p) for _, p in entries]
    toc_rows = [["dir", name, len(p), n, a] for (name, p), n, (a, _) in zip(entries, sizes, _laid([p for _, p in entries]), strict=True)]
    toc = b"TOC " + bytes(12) + pack_utf("CpkTocInfo", [("DirName", 10), ("FileName", 10), ("FileSize", 4), ("ExtractSize", 4), ("FileOffset", 6)], toc_rows)
    head = lambda t, c: pack_utf("CpkHeader", [("TocOffset", 6), ("ContentOffset", 6)], [[t, c]])
    start = 16 + len(head(0, 0))
    return b"CPK " + bytes(12) + head(start, start + len(toc)) + toc + b"".join(p for _, p in entries)


PACKERS = {"garc": pack_garc, "sarc": pack_sarc, "narc": pack_narc, "darc": pack_darc, "zar": pack_zar, "gar": pack_gar, "capcom_arc": pack_capcom_arc, "gfac": pack_gfac, "l5_flat": pack_offset_table, "cpk": pack_cpk}
