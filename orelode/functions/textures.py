"""Texture headers: bytes to descriptors. One reader for each kind, all on the same checked reads.

A reader yields textures and may stop with ``Broken``; what it found before stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np

from orelode.functions.archives import Broken, View
from orelode.functions.bch import read_bch
from orelode.functions.capcom import read_capcom_tex
from orelode.functions.lz import unpack_level5, unpack_lz
from orelode.functions.pixels import BITS, NAMES, decode, n_bytes
from orelode.functions.texture_types import Texture, plain_code, sized

# Which pixel format a header's code stands for.
BFLIM_CODES = {0: "L8", 1: "A8", 2: "LA4", 3: "LA8", 4: "HILO8", 5: "RGB565", 6: "RGB8", 7: "RGBA5551", 8: "RGBA4", 9: "RGBA8", 10: "ETC1", 11: "ETC1A4", 12: "L4", 13: "A8", 18: "ETC1", 19: "ETC1A4"}
DMP_CODES = {0x6750: "RGBA8", 0x6751: "RGB8", 0x6752: "RGBA5551", 0x6753: "RGB565", 0x6754: "RGBA4", 0x6755: "LA8", 0x6756: "HILO8", 0x6757: "L8", 0x6758: "A8", 0x6759: "LA4", 0x675A: "ETC1", 0x675B: "ETC1A4"}
STEX_CODES = {0x6750: "RGBA8", 0x6751: "RGB8", 0x6752: "RGBA8", 0x6753: "RGB565", 0x6754: "RGB8", 0x6755: "LA8", 0x6756: "RGBA5551", 0x6757: "L8", 0x6758: "RGB565", 0x6759: "LA4", 0x675A: "ETC1", 0x675B: "ETC1A4"}
JIMG_CODES = {0: "RGBA8", 1: "RGB8", 2: "RGBA5551", 3: "RGB565", 4: "RGBA4", 5: "LA8", 7: "L8", 8: "ETC1", 9: "LA4", 10: "L4", 11: "RGBA4", 12: "A8", 13: "ETC1A4", 14: "ETC1", 15: "ETC1", 16: "ETC1A4"}
IMGC_CODES = {0: "RGBA8", 1: "RGB8", 2: "RGBA5551", 3: "RGB565", 4: "RGBA4", 5: "LA8", 7: "L8", 8: "A8", 9: "LA4", 10: "L4", 11: "A4", 12: "ETC1", 13: "ETC1A4"}

def read_ctpk(data: bytes) -> Iterator[Texture]:
    v = View(data)
    v.expect(0, b"CTPK")
    count, base = v.int(6, "H"), v.int(8)
    if not 0 < count <= 10_000:
        raise Broken("textures")
    for i in range(count):
        name, size, start, code, width, height, mips = v.ints(0x20 + 0x20 * i, "IIIIHHB")
        if sized(width, height) and code < len(NAMES):
            yield Texture(v.text(name, 256) if 0 < name < len(data) else "", NAMES[code], width, height, data[base + start : base + start + size], "ctpk", mips=max(1, mips))


def read_cgfx(data: bytes) -> Iterator[Texture]:
    """Objects announce themselves; places are relative to the fields that hold them."""
    v = View(data)
    v.expect(0, b"CGFX")
    at, i = data.find(b"TXOB"), 0
    while at >= 0:
        if at + 0x48 <= len(data) and data[at + 0x40 : at + 0x44] != b"SHDR":
            height, width = v.ints(at + 0x14, "II")
            code, size, start = v.int(at + 0x30), *v.ints(at + 0x40, "II")
            start += at + 0x44
            powers = all(4 <= x <= 2048 and x & (x - 1) == 0 for x in (width, height))
            if powers and code < len(NAMES) and size and start + size <= len(data):
                name = v.int(at + 8)
                yield Texture((v.text(at + 8 + name, 256) if name else "") or f"cgfx_tex_{i:04d}", NAMES[code], width, height, data[start : start + size], "cgfx")
                i += 1
        at = data.find(b"TXOB", at + 1)


def _chunk_entries(v: View, first: int, count: int, base: int, kind: str) -> Iterator[Texture]:
    """Entries of 0x24 bytes, as both chunked kinds have them."""
    for i in range(count):
        at = first + 0x24 * i
        if at + 0x24 > len(v.data):
            return
        length, width, height, code, start = v.int(at), *v.ints(at + 8, "HHH"), v.int(at + 16)
        start += base
        if code in DMP_CODES and sized(width, height) and start < len(v.data):
            end = start + length if length else len(v.data)
            yield Texture(v.text(at + 20, 16) or f"{kind}_tex_{i:04d}", DMP_CODES[code], width, height, v.data[start:end], kind)


def read_ctxb(data: bytes) -> Iterator[Texture]:
    v = View(data)
    v.expect(0, b"ctxb")
    chunk, base = v.ints(0x10, "II")
    v.expect(chunk, b"tex ")
    count = v.int(chunk + 8)
    if not 0 < count <= 1000:
        raise Broken("textures")
    yield from _chunk_entries(v, chunk + 12, count, base, "ctxb")


def read_cmb(data: bytes) -> Iterator[Texture]:
    start = data.find(b"cmb ")
    v = View(data)
    v.expect(start, b"cmb ")
    sections = v.int(start + 8)
    chunk = data.find(b"tex ", start)
    if not 1 <= sections <= 20 or chunk < 0:
        raise Broken("sections")
    count = v.int(chunk + 8)
    if not 0 < count <= 500:
        raise Broken("textures")
    yield from _chunk_entries(v, chunk + 12, count, v.ints(start + 0x20, f"{sections}I")[-1], "cmb")


def read_bflim(data: bytes) -> Iterator[Texture]:
    """The header stands at the end; the image is stored in powers of two and cropped."""
    foot = len(data) - 0x28
    if foot < 0 or data[foot : foot + 4] not in (b"FLIM", b"CLIM"):
        raise Broken("no footer")
    v = View(data, "<" if data[foot + 4 : foot + 6] == b"\xff\xfe" else ">")
    image = data.find(b"imag", foot + 16)
    if image < 0:
        raise Broken("no imag")
    width, height = v.ints(image + 8, "HH")
    code = v.int(image + 12) if data[foot : foot + 1] == b"C" else data[image + 14]
    if code not in BFLIM_CODES or not width or not height:
        raise Broken(f"format {code}")
    name = BFLIM_CODES[code]
    up = lambda x: max(8, 1 << (x - 1).bit_length())
    stored = up(width), up(height)
    if foot < n_bytes(*stored, name) and foot >= n_bytes(width, height, name):
        stored = width, height
    yield Texture("", name, *stored, data[:foot], "bflim", crop=(width, height))


def read_stex(data: bytes) -> Iterator[Texture]:
    v = View(data)
    v.expect(0, b"STEX")
    width, height = v.ints(0x0C, "II")
    code, size, start = v.ints(0x18, "III")
    if not sized(width, height, 4096) or not 0 < start < len(data) or not 0 < size <= len(data) + 1024 - start:
        raise Broken("header")
    name = v.text(0x28, start - 0x28) if start >= 0x30 else ""
    yield Texture(name or "stex_texture", STEX_CODES.get(code) or plain_code(code), width, height, data[start : start + size], "stex", "low")


def read_jimg(data: bytes) -> Iterator[Texture]:
    v = View(data)
    v.expect(0, b"jIMG")
    width, height, code = v.ints(8, "HHB")
    pixels = data[0x80:]
    if not sized(width, height, 4096) or len(pixels) < 4:
        raise Broken("header")
    fits = [n for n in NAMES if n_bytes(width, height, n) == len(pixels)]
    stated = JIMG_CODES.get(code)
    name = stated if stated in fits else next((n for n in ("ETC1A4", "ETC1", *fits) if n in fits), None)
    if name is None:
        raise Broken("no format has this size")
    yield Texture("", name, width, height, pixels, "jimg")


def read_shinen(data: bytes) -> Iterator[Texture]:
    if data[:4] == b"CMPR":
        data = unpack_lz(data[4:]) or b""
    v = View(data)
    v.expect(0, b"TEX CTR ")
    width, height, code = v.ints(12, "HHI")
    start, more = v.ints(0x18, "II")
    start = start or 0x80
    if not sized(width, height) or start >= len(data):
        raise Broken("header")
    yield Texture("", plain_code(code & 0xFF), width, height, data[start:], "shinen_tex", mips=more + 1)


def read_imgc(data: bytes) -> Iterator[Texture]:
    """A map of tile numbers and the tiles, both packed; number 0xFFFF is an empty tile."""
    v = View(data)
    v.expect(0, b"IMGC")
    width, height = v.ints(0x10, "HH")
    code = v.int(0x20)
    map_size, _, whole = v.ints(0x34, "III")
    if not sized(width, height) or code not in IMGC_CODES:
        raise Broken("header")
    numbers, tiles = unpack_level5(data[0x48 : 0x58 + map_size]), unpack_level5(data[0x48 + map_size : 0x58 + whole])
    if numbers is None or tiles is None:
        raise Broken("packed parts")
    name = IMGC_CODES[code]
    across, down, size = -(-width // 8), -(-height // 8), 8 * BITS[name]
    own = memoryview(numbers[: len(numbers) // 2 * 2]).cast("H") if len(numbers) > 1 else []
    out = bytearray(across * down * size)
    for i, number in enumerate(own[: across * down]):
        tile = tiles[number * size : (number + 1) * size] if number != 0xFFFF else b""
        if len(tile) == size:
            out[i * size : (i + 1) * size] = tile
    yield Texture(f"imgc_{width}x{height}", name, across * 8, down * 8, bytes(out), "imgc", "low")


def read_gdb1(header: bytes, pixels: bytes) -> Iterator[Texture]:
    """A header file and the file of its pixels; the format is the first whose size fits."""
    v = View(header)
    v.expect(0, b"GDB1")
    nodes = [v.int(0x54 + 16 * i) for i in range(12) if 0x58 + 16 * i <= len(header)]
    if len(nodes) < 7:
        raise Broken("nodes")
    width, height, start, size = nodes[0], nodes[1], nodes[5], nodes[6]
    name = next((n for n in NAMES if width and height and n_bytes(width, height, n) == size), None)
    if name is None or len(pixels[start : start + size]) != size:
        raise Broken("size")
    yield Texture("", name, width, height, pixels[start : start + size], "gdb1", "medium")


READERS = {"ctpk": read_ctpk, "cgfx": read_cgfx, "ctxb": read_ctxb, "cmb": read_cmb, "bflim": read_bflim, "stex": read_stex, "jimg": read_jimg, "shinen_tex": read_shinen, "imgc": read_imgc, "capcom_tex": read_capcom_tex, "bch": read_bch}


#: Formats by the code of a sectioned model's texture: fixed values.
SECTION_CODES = {3: "RGB8", 4: "RGBA8", 22: "RGBA5551", 35: "RGB565", 37: "ETC1A4", 40: "ETC1"}


def sectioned(data: bytes) -> Iterator[Texture]:
    """Textures among the sections of a model of a later version; none of anything else."""
    v = View(data)
    if data[:2] not in (b"PC", b"PT", b"MM") or len(data) < 16 or not 2 <= data[2] <= 30 or 8 + 4 * data[2] > len(data):
        return
    bounds = v.ints(4, f"{data[2] + 1}I")
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if a + 0x80 > len(data) or not a + 0x80 < b <= len(data) or data[a + 8 : a + 32].split(b"\0", 1)[0] != b"texture" or b"\0" not in data[a + 8 : a + 32]:
            continue
        width, height, code = v.ints(a + 0x68, "HHH")
        if sized(width, height) and code in SECTION_CODES:
            name = data[a + 0x28 : a + 0x60]
            yield Texture((name.split(b"\0", 1)[0].decode("ascii", "replace") if b"\0" in name else "") or f"tex_{i}", SECTION_CODES[code], width, height, data[a + 0x80 : b], "pokemon_pc_v5")


#: Sides of images that raw pixels are taken for, and bytes by which their size may differ.
RAW_SIDES, RAW_SLACK = tuple(1 << p for p in range(3, 11)), 256


def guessed(data: bytes) -> Texture | None:
    """Bytes without any header as the first format and size that fit and show more than noise-free colour."""
    for name in NAMES:
        for width in RAW_SIDES:
            for height in RAW_SIDES:
                need = n_bytes(width, height, name)
                if abs(len(data) - need) <= RAW_SLACK:
                    colours = decode(name, width, height, data[:need])[..., :3].reshape(-1, 3).astype(np.float32)
                    if (colours.std(axis=0) > 5.0).any():
                        return Texture(f"raw_{name}_{width}x{height}", name, width, height, data[:need], "raw_heuristic", "low")
    return None


def textures(kind: str, data: bytes, title_id: str | None = None) -> tuple[list[Texture], str | None]:
    """All textures that can be read, and what stopped the reader, if anything did; some kinds differ by title."""
    out: list[Texture] = []
    try:
        for t in READERS[kind](data, title_id) if kind == "capcom_tex" else READERS[kind](data):
            out.append(replace(t, data=bytes(t.data)))
    except (ValueError, IndexError, OverflowError, TypeError) as e:
        return out, str(e)
    return out, None
