"""Small texture files of each kind, for round trips: an image of L8 pixels behind the kind's header."""

from __future__ import annotations

import struct

from orelode.functions.bch import UNIT_KIND, UNIT_PLACE, UNIT_SIZE, UNITS

WIDTH = 128


def image_of(data: bytes) -> tuple[int, int, bytes]:
    """Width, height (a multiple of 8) and the padded pixels of bytes taken as L8."""
    height = max(8, -(-len(data) // (8 * WIDTH)) * 8)
    return WIDTH, height, data.ljust(WIDTH * height, b"\0")


def build_ctpk(w: int, h: int, px: bytes) -> bytes:
    return b"CTPK" + struct.pack("<HHII", 1, 1, 0x48, len(px)) + bytes(16) + struct.pack("<IIIIHHB", 0x40, len(px), 0, 7, w, h, 1) + bytes(11) + b"texture\0" + px


def build_cgfx(w: int, h: int, px: bytes) -> bytes:
    body = bytearray(0x48)
    body[0:4] = b"TXOB"
    struct.pack_into("<II", body, 0x14, h, w)
    struct.pack_into("<I", body, 0x30, 7)
    struct.pack_into("<II", body, 0x40, len(px), 4)
    return b"CGFX" + bytes(0x1C) + bytes(body) + px


def _chunk(w: int, h: int, px: bytes) -> bytes:
    return b"tex " + struct.pack("<II", 0x30, 1) + struct.pack("<IIHHHHI16s", len(px), 0, w, h, 0x6757, 0x1401, 0, b"chunk")


def build_ctxb(w: int, h: int, px: bytes) -> bytes:
    chunk = _chunk(w, h, px)
    return b"ctxb" + struct.pack("<IIIII", 0x18 + len(chunk) + len(px), 1, 0, 0x18, 0x18 + len(chunk)) + chunk + px


def build_cmb(w: int, h: int, px: bytes) -> bytes:
    chunk = _chunk(w, h, px)
    head = b"cmb " + struct.pack("<II", 0, 2) + bytes(0x14) + struct.pack("<II", 0x28, 0x28 + len(chunk))
    return head + chunk + px


def build_bflim(w: int, h: int, px: bytes) -> bytes:
    return px + b"FLIM\xff\xfe" + struct.pack("<HIIHH", 0x14, 0x07020000, len(px) + 0x28, 1, 0) + b"imag" + struct.pack("<IHHHBBI", 16, w, h, 0x80, 0, 0, len(px))


def build_stex(w: int, h: int, px: bytes) -> bytes:
    return b"STEX" + bytes(8) + struct.pack("<IIIIII", w, h, 0, 0x6757, len(px), 0x80) + bytes(4) + b"stex".ljust(0x58, b"\0") + px


def build_jimg(w: int, h: int, px: bytes) -> bytes:
    return (b"jIMG" + bytes(4) + struct.pack("<HHB", w, h, 7)).ljust(0x80, b"\0") + px


def build_shinen(w: int, h: int, px: bytes) -> bytes:
    return (b"TEX CTR " + bytes(4) + struct.pack("<HHIIII", w, h, 7, 0, 0x80, 0)).ljust(0x80, b"\0") + px


def build_imgc(w: int, h: int, px: bytes) -> bytes:
    tiles = len(px) // 64
    raw = lambda b: struct.pack("<I", len(b) << 3) + b  # noqa: E731  stored as it is
    numbers, pixels = raw(struct.pack(f"<{tiles}H", *range(tiles))), raw(px)
    head = bytearray(0x48)
    head[0:4] = b"IMGC"
    struct.pack_into("<HH", head, 0x10, w, h)
    struct.pack_into("<I", head, 0x20, 7)
    struct.pack_into("<III", head, 0x34, len(numbers), len(pixels), len(numbers) + len(pixels))
    return bytes(head) + numbers + pixels


def build_capcom(w: int, h: int, px: bytes) -> bytes:
    return b"TEX\0" + struct.pack("<HHHBBI", 1, w, h, 1, 7, 16) + px


def build_bch(w: int, h: int, px: bytes) -> bytes:
    command = lambda register, value: struct.pack("<II", value, 0xF << 16 | register)
    commands = command(UNIT_SIZE, w << 16 | h) + command(UNIT_PLACE, 0) + command(UNIT_KIND, 7)
    base = 0x40 + len(commands)
    return (b"BCH\0" + struct.pack("<IIIIIII", 0, 0, 0, 0x40, base, 0, 0)).ljust(0x40, b"\0") + commands + px


def build_bch_list(textures: list[tuple[str, int, int, bytes]], unit: int = 0) -> bytes:
    """A register file that lists textures (name, width, height and L8 pixels), set up in one of the three units."""
    size, kind, place = UNITS[unit]
    command = lambda register, value: struct.pack("<II", value, 0xF << 16 | register)
    n = len(textures)
    content, table = 0x40, 132
    descriptors = table + 4 * n
    strings = content + descriptors + 32 * n
    names, pool = [], b"\0"
    for name, *_ in textures:
        names.append(len(pool))
        pool += name.encode() + b"\0"
    pool += bytes(-len(pool) % 8)
    commands = strings + len(pool)
    base = commands + 24 * n
    blocks, pixels = b"", b""
    for _, w, h, px in textures:
        blocks += command(size, w << 16 | h) + command(place, len(pixels)) + command(kind, 7)
        pixels += px
    body = b"".join(struct.pack("<8I", *[x for u in range(3) for x in ((24 * i, 6) if u == unit else (0, 0))], 0, names[i]) for i in range(n))
    head = b"BCH\0" + struct.pack("<7I", 0x2A01, content, strings, commands, base, 0, 0)
    sections = bytes(36) + struct.pack("<III", table, n, 0) + bytes(84)
    return head.ljust(content, b"\0") + sections + struct.pack(f"<{n}I", *[descriptors + 32 * i for i in range(n)]) + body + pool + blocks + pixels


def build_gdb1(w: int, h: int, px: bytes) -> tuple[bytes, bytes]:
    values = [w, h, 0, 0, 0, 0, len(px)]
    return (b"GDB1").ljust(0x48, b"\0") + b"".join(bytes(12) + struct.pack("<I", v) for v in values), px


BUILDERS = {"ctpk": build_ctpk, "cgfx": build_cgfx, "ctxb": build_ctxb, "cmb": build_cmb, "bflim": build_bflim, "stex": build_stex, "jimg": build_jimg, "shinen_tex": build_shinen, "imgc": build_imgc, "capcom_tex": build_capcom, "bch": build_bch}
