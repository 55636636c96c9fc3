"""Register files of models: textures that the file lists, that its commands set up, and that its words look like.

A listed texture has a descriptor (three blocks of commands, one for each texture unit, and a name). Without a list each
write of a texture's size among the commands tells one. Beside both, neighbouring words that could be a size, with a
format and a place nearby, count as guesses where nothing that was told lies; if nothing was told, tables of sections are
probed for sizes too. Words are searched as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from orelode.functions.archives import View
from orelode.functions.pixels import BITS, NAMES, n_bytes
from orelode.functions.texture_types import Texture, sized

#: Registers of the three texture units: size, kind and place. Fixed values of the hardware.
UNITS = ((0x82, 0x8E, 0x85), (0x92, 0x96, 0x95), (0x9A, 0x9E, 0x9D))
UNIT_SIZE, UNIT_KIND, UNIT_PLACE = UNITS[0]
#: Words around a pair of sizes that may be its format, and its place, in the order in which they are tried.
FORMAT_NEAR, PLACE_NEAR = (2, 3, -1, -2, 4), (3, 4, 5, -2, -3)
#: Where a table of sections may stand, after the main header; and the sizes of its entries.
SECTION_AT, ENTRY_SIZES = (0x24, 0x28, 0x2C, 0x30, 0x34, 0x38, 0x20, 0x1C, 0x18), (24, 16, 32, 20)
#: Textures of one list, and entries of one section, at most.
MOST_LISTED, MOST_ENTRIES = 500, 1000
_BITS = np.array([BITS[n] for n in NAMES], np.int64)


def read_bch(data: bytes) -> Iterator[Texture]:
    v = View(data)
    v.expect(0, b"BCH\0")
    v.ints(8, "6I")
    told = list(listed(v)) or list(commanded(v))
    places = {place for place, _ in told}
    yield from (t for _, t in told)
    if not told:
        yield from probed(v)
    for place, texture in paired(v):
        if not told or place not in places:
            places.add(place)
            yield texture


def _cut(v: View, name: str, code: int, width: int, height: int, place: int) -> tuple[int, Texture] | None:
    """The texture whose pixels stand at ``place`` after the file's data, or from its start; and where that is."""
    need = n_bytes(width, height, NAMES[code])
    base = v.int(0x14)
    for start in (base + place, place):
        if need and start + need <= len(v.data) and (start == base + place or place):
            return start, Texture(name, NAMES[code], width, height, v.data[start : start + need], "bch", "medium")
    return None


def _unit(registers: dict[int, int], unit: tuple[int, int, int], least: int) -> tuple[int, int, int, int] | None:
    """(width, height, format, place) that a unit's registers hold."""
    size, kind, place = unit
    if size not in registers:
        return None
    width, height, code = registers[size] >> 16 & 0x7FF, registers[size] & 0x7FF, registers.get(kind, 0) & 15
    good = least <= width and least <= height and sized(width, height) and code < len(NAMES)
    return (width, height, code, registers.get(place, 0)) if good else None


def registers_after(v: View, at: int, end: int) -> dict[int, int]:
    """What a run of commands leaves in the registers; a command is a value, a head and more values."""
    out: dict[int, int] = {}
    while at + 8 <= end:
        value, head = v.ints(at, "II")
        register, extra = head & 0xFFFF, head >> 20 & 0xFF
        out[register] = value
        more = v.ints(at + 8, f"{max(0, min(extra, (end - at - 8) // 4))}I")
        if not head >> 31:
            out.update({register + 1 + i: x for i, x in enumerate(more)})
        at += 8 + 4 * len(more)
        at += 4 if at % 8 else 0
    return out


def listed(v: View) -> Iterator[tuple[int, Texture]]:
    """Textures of the content table's list, each place once."""
    content, strings, commands, base = v.ints(8, "4I")
    size = len(v.data)
    if content + 48 > size or not 0 < commands < size or not 0 < base < size:
        return
    table, count, tree = v.ints(content + 36, "III")
    if not 0 < count <= MOST_LISTED or not table or content + table + 4 * count > size:
        return
    names, seen = _tree_names(v, content + tree, strings) if tree else {}, set()
    for i, descriptor in enumerate(v.ints(content + table, f"{count}I")):
        at = content + descriptor
        if at + 32 > size:
            continue
        *blocks, _, name = v.ints(at, "8I")
        found = None
        for unit, start, words in zip(UNITS, blocks[::2], blocks[1::2], strict=True):
            if words and commands + start + 8 <= size:
                found = found or _unit(registers_after(v, commands + start, min(commands + start + 4 * words, size)), unit, 4)
        if found is None:
            continue
        width, height, code, place = found
        cut = _cut(v, _string(v, strings + name) or names.get(i) or f"bch_tex_{i:04d}", code, width, height, place)
        if cut and cut[0] not in seen:
            seen.add(cut[0])
            yield cut


def _string(v: View, at: int) -> str:
    end = v.data.find(b"\0", at)
    return v.data[at:end].decode("ascii", "replace") if 0 < end - at <= 256 else ""


def _tree_names(v: View, at: int, strings: int) -> dict[int, str]:
    """Names of a tree's entries by their number; the first node is the root."""
    if at + 8 > len(v.data):
        return {}
    count = next((n for n in (v.int(at + 4), v.int(at)) if 0 < n <= MOST_LISTED), 0)
    nodes = [at + 8 + 16 * (i + 1) for i in range(count)]
    return {i: _string(v, strings + v.int(node + 8)) for i, node in enumerate(nodes) if node + 16 <= len(v.data)}


def commanded(v: View) -> Iterator[tuple[int, Texture]]:
    """Textures that the commands set up in the first unit, each setting once."""
    commands, base = v.ints(0x10, "II")
    if not 0 < commands < len(v.data):
        return
    end = min(base if base > commands else commands + 0x20000, len(v.data))
    at, seen, n = commands, set(), 0
    while at + 8 <= end:
        _, head = v.ints(at, "II")
        extra = head >> 20 & 0xFF
        if head & 0xFFFF == UNIT_SIZE:
            found = _unit(registers_after(v, at, min(at + 4 * (2 + extra) + 256, end)), UNITS[0], 8)
            if found and found not in seen:
                seen.add(found)
                width, height, code, place = found
                need = n_bytes(width, height, NAMES[code])
                start = next((s for s in (base + place, place) if s + need <= len(v.data)), None)
                if start is not None:
                    yield start, Texture(f"bch_tex_{n:04d}", NAMES[code], width, height, v.data[start : start + need], "bch", "medium")
                    n += 1
        at += 8 + 4 * extra + 4 * (extra % 2)


def _powers(words: np.ndarray, least: int) -> np.ndarray:
    return (words >= least) & (words <= 2048) & (words & (words - 1) == 0)


def paired(v: View) -> Iterator[tuple[int, Texture]]:
    """Guesses: two neighbouring words that are powers of two, a format near them, and a place that leaves room."""
    words = np.frombuffer(v.data, "<u4", len(v.data) // 4).astype(np.int64)
    if len(words) < 8:
        return
    base, size = v.int(0x14), len(v.data)
    power = _powers(words, 8)
    at = np.flatnonzero(power[:-1] & power[1:])
    at = at[4 * at + 16 <= size]

    def near(steps: tuple[int, ...], rows: np.ndarray, good) -> np.ndarray:
        """The first word in reach that is good, of each row (-1: none)."""
        value = np.full(len(rows), -1, np.int64)
        for step in steps:
            where = rows + step
            inside = (where >= 0) & (where < len(words)) & (value < 0)
            word = words[np.clip(where, 0, len(words) - 1)]
            take = inside & good(word)
            value[take] = word[take]
        return value

    code = near(FORMAT_NEAR, at, lambda w: w < len(NAMES))
    at, code = at[code >= 0], code[code >= 0]
    need = (words[at] * words[at + 1] * _BITS[code] + 7) // 8
    at, code, need = at[need < size], code[need < size], need[need < size]
    place = near(PLACE_NEAR, at, lambda w: (w + base + need <= size) & (w < size))
    n = 0
    for i, c, m, p in zip(at[place >= 0].tolist(), code[place >= 0].tolist(), need[place >= 0].tolist(), place[place >= 0].tolist(), strict=True):
        yield base + p, Texture(f"bch_tex_{n:04d}", NAMES[c], int(words[i]), int(words[i + 1]), v.data[base + p : base + p + m], "bch", "medium")
        n += 1


def probed(v: View) -> Iterator[Texture]:
    """Guesses from tables of sections: of each entry the last pair of sizes, and the last word that may be its format."""
    main, base, size, n = v.int(8), v.int(0x14), len(v.data), 0
    for at in (main + x for x in SECTION_AT):
        if at + 8 > size:
            continue
        start, count = v.ints(at, "II")
        if not 0 < count <= MOST_ENTRIES or not 0 < start < size:
            continue
        for entry in ENTRY_SIZES:
            rows = min(count, (size - start) // entry)
            found = _last_pairs(np.frombuffer(v.data, "<u4", rows * entry // 4, start).astype(np.int64).reshape(rows, entry // 4)) if rows > 0 else []
            for width, height, code in found:
                need = n_bytes(width, height, NAMES[code])
                if base < size:
                    yield Texture(f"bch_tex_{n:04d}", NAMES[code], width, height, v.data[base : base + need], "bch", "medium")
                n += 1
            if found and len(found) >= count // 2:
                return


def _last_pairs(entries: np.ndarray) -> list[tuple[int, int, int]]:
    """(width, height, format) of the entries that have them; formats stand two words before a pair at the earliest."""
    n, wide = entries.shape
    power, place = _powers(entries, 4), np.arange(wide)
    last_format = np.where(entries < len(NAMES), place, -1).max(axis=1)
    pair = power[:, : wide - 2] & power[:, 1 : wide - 1] & (last_format[:, None] >= np.maximum(place[: wide - 2] - 2, 0))
    last_pair = np.where(pair, place[: wide - 2], -1).max(axis=1)
    rows = np.flatnonzero(last_pair >= 0)
    return [(int(entries[r, last_pair[r] + 1]), int(entries[r, last_pair[r]]), int(entries[r, last_format[r]])) for r in rows.tolist()]
