"""What a blob inside another one is: the same ordered rules as the column form, on bytes in memory."""

from __future__ import annotations

from orelode.functions.lz import blz_footer, is_lz

# Fixed values, in the order in which they are tried.
MAGICS_FIRST = ((b"CRAG", "garc"), (b"SARC", "sarc"), (b"NARC", "narc"), (b"ZAR\x01", "zar"), (b"GAR", "gar"), (b"darc\xff\xfe", "darc"), (b"ARC\0", "capcom_arc"))
MAGICS_NEXT = ((b"ctxb", "ctxb"), (b"CTPK", "ctpk"), (b"BCH\0", "bch"), (b"CGFX", "cgfx"))
MAGICS_LAST = ((b"jIMG", "jimg"), (b"IMGC", "imgc"), (b"STEX", "stex"), (b"CPK ", "cpk"), (b"ARC0", "arc0"), (b"XFSA", "arc0"))
ZLIB_STARTS = (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
BY_EXTENSION = {"tex": "capcom_tex", "bch": "bch", "bcres": "bch", "bflim": "bflim", "ctpk": "ctpk", "arc": "sarc", "sarc": "sarc", "zar": "zar", "gar": "gar", "lzs": "gar", "ctxb": "ctxb", "cmb": "cmb", "stex": "stex", "fa": "arc0"}


def _first(data: bytes, table) -> str | None:
    return next((kind for magic, kind in table if data.startswith(magic)), None)


def identify(data: bytes, path: str = "") -> str | None:
    if len(data) < 4:
        return None
    if data.startswith(b"Yaz0") and len(data) >= 16:
        return "yaz0"
    if is_lz(data, path):
        return "nintendo_lz"
    if kind := _first(data, MAGICS_FIRST):
        return kind
    if len(data) >= 0x28 and int.from_bytes(data[:4], "little") == len(data) and {data[0x20], data[0x24]} & {0x10, 0x11, 0x13} and 1 <= int.from_bytes(data[8:12], "little") <= 64:
        return "fe_arc"
    if blz_footer(data):
        return "blz"
    if data[:2] in ZLIB_STARTS:
        return "zlib"
    if kind := _first(data, MAGICS_NEXT):
        return kind
    if data[-0x28:-0x24] in (b"FLIM", b"CLIM"):
        return "bflim"
    if data.startswith(b"TEX CTR ") or (data.startswith(b"CMPR") and data[4:5] in (b"\x10", b"\x11", b"\x13")):
        return "shinen_tex"
    if data[:4] in (b"TEX\0", b"\0XET") and len(data) >= 16:
        return "capcom_tex"
    if data[4:6] == b"\x1f\x8b":
        return "gzip_container"
    extension = path.rpartition(".")[2].lower() if "." in path else ""
    kind = BY_EXTENSION.get(extension) or _first(data, MAGICS_LAST)
    if kind:
        return kind
    count = int.from_bytes(data[:4], "little")
    if data[4:8] == bytes(4) and 10 <= count <= 200_000 and 8 + 4 * count <= int.from_bytes(data[8:12], "little") < len(data):
        return "l5_flat"
    return "gfac" if data.startswith(b"GFAC") and len(data) >= 0x30 else None
