"""What a file is and whether it is worth opening, as column expressions.

``head`` and ``tail`` are the first and last bytes of a file (binary columns): enough for every rule, so that files are
judged before their contents are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, folders and magics that decide without a look at the contents.
SKIP_EXTENSIONS = (".bcstm", ".bcwav", ".bcsnd", ".bcsar", ".bgm", ".brsar", ".bfsar", ".bfstm", ".moflex", ".mods", ".msbt", ".bmg", ".bfttf", ".bcfnt", ".shbin", ".bcsv", ".txt", ".xml", ".json", ".lua", ".db", ".sav", ".mp4", ".aac", ".ogg", ".wav", ".ips", ".bps")
OPEN_EXTENSIONS = (".tex", ".bch", ".bcres", ".bflim", ".bclim", ".ctpk", ".cptk", ".ctxb", ".cmb", ".cgfx", ".bcmdl", ".bctex", ".bcmcla", ".szs", ".zar", ".zsi", ".bccam", ".bcsdr", ".bcptl", ".bhres", ".bhtex", ".cbres", ".lz", ".cmp", ".chres", ".chtex", ".stex", ".gar", ".lzs", ".zrc", ".fs", ".texturegdb", ".bin", ".raw", ".dat", ".img", ".arc", ".sarc", ".garc", ".narc", ".nwmdl", ".nwtex", ".pmnweffb", ".nwenv", ".nwlyt", ".fa", ".cpk", ".jtex", ".jarc", ".data", ".gfa")
OPEN_FOLDERS = ("/tex/", "/texture/", "/textures/", "/gui/", "/effect/", "/model/", "/chr/", "/bg/", "/ui/", "/font/", "/a/", "/kart/", "/course/", "/driver/", "/menu", "/actor/", "/scene/", "/kankyo/", "/ending/", "/misc/")
OPEN_MAGICS = (b"CRAG", b"SARC", b"NARC", b"darc", b"Yaz0", b"CGFX", b"BCH\0", b"CTPK", b"CTXB", b"ctxb", b"ARC\0", b"ARC0", b"CPK ", b"ZAR\x01", b"GAR2", b"GAR\x02", b"jIMG", b"GDB1", b"3DST", b"GFAC", b"XFSA")
SKIP_MAGICS = (b"BKHD", b"AKPK", b"CSAR", b"NUS3", b"RIFF")
FOOTERS = (b"FLIM", b"CLIM")
LZ_EXTENSIONS = (".lz", ".cmp", ".chres", ".chtex", ".zrc")


def hex_of(c: Column, at: int, n: int) -> Column:
    return F.hex(F.substring(c, at + 1, n))


def magic_is(head: Column, *magics: bytes) -> Column:
    by_size: dict[int, list[str]] = {}
    for m in magics:
        by_size.setdefault(len(m), []).append(m.hex().upper())
    return reduce(Column.__or__, [hex_of(head, 0, n).isin(x) for n, x in by_size.items()])


def footer_is(tail: Column) -> Column:
    """The magic stands 0x28 bytes before the end of the file."""
    return F.coalesce((F.octet_length(tail) >= 0x28) & F.hex(F.substring(tail, -0x28, 4)).isin([m.hex().upper() for m in FOOTERS]), F.lit(False))


def extension(path: Column) -> Column:
    """From the last dot on, in lower case; the dot may be in a folder's name."""
    return F.when(F.instr(path, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise("")


def u16(c: Column, at: int, big: bool = False) -> Column:
    return _integer(c, at, 2, big)


def u32(c: Column, at: int, big: bool = False) -> Column:
    return _integer(c, at, 4, big)


def _integer(c: Column, at: int, n: int, big: bool) -> Column:
    part = F.substring(c, at + 1, n)
    digits = F.hex(part) if big else F.concat(*[hex_of(c, at + i, 1) for i in reversed(range(n))])
    return F.when(F.octet_length(part) == n, F.conv(digits, 16, 10).cast("bigint"))


def worth_opening(path: Column, head: Column, tail: Column) -> Column:
    """The rules in their order: extension, folder, magic, LZ byte, gzip behind a size, footer."""
    ext, low = extension(path), F.lower(path)
    first = F.substring(head, 1, 1)
    by_bytes = (F.octet_length(head) >= 4) & (magic_is(head, *OPEN_MAGICS) | F.hex(first).isin("10", "11", "13") | (hex_of(head, 4, 2) == "1F8B") | footer_is(tail))
    folder = reduce(Column.__or__, [low.contains(d) for d in OPEN_FOLDERS])
    return F.when(ext.isin(*SKIP_EXTENSIONS), False).when(ext.isin(*OPEN_EXTENSIONS), True).when(folder, True).otherwise(F.coalesce(by_bytes, F.lit(False)))


def lz_size(head: Column) -> Column:
    """Size that an LZ header promises, if it is sound."""
    small = F.shiftrightunsigned(u32(head, 0), 8)
    size = F.when(small == 0, u32(head, 4)).otherwise(small)
    return F.when(hex_of(head, 0, 1).isin("10", "11", "13") & size.between(1, 50 << 20), size)


def looks_lz(path: Column, head: Column, size: Column) -> Column:
    promised = lz_size(head)
    likely = (size >= 5) & (2 * promised >= size) & (promised <= 20 * size)
    return F.coalesce(promised.isNotNull() & (extension(path).isin(".lz", ".cmp") | likely), F.lit(False))


def looks_blz(tail: Column, size: Column) -> Column:
    """A footer of eight bytes at the very end: packed size, footer size, growth."""
    packed = F.conv(F.concat(*[F.hex(F.substring(tail, -8 + i, 1)) for i in (2, 1, 0)]), 16, 10).cast("bigint")
    footer = F.conv(F.hex(F.substring(tail, -5, 1)), 16, 10).cast("bigint")
    grows = F.conv(F.concat(*[F.hex(F.substring(tail, -4 + i, 1)) for i in (3, 2, 1)] + [F.hex(F.substring(tail, -4, 1))]), 16, 10).cast("bigint")
    sound = footer.isin(8, 11) & (packed > footer) & (packed <= size) & grows.between(1, 0x7FFFFFFF) & (grows <= 5 * size) & (size + grows <= 50 << 20)
    return F.coalesce((F.octet_length(tail) >= 12) & sound, F.lit(False))


def looks_offset_table(head: Column, size: Column) -> Column:
    count = u32(head, 0)
    return F.coalesce((u32(head, 4) == 0) & count.between(10, 200_000) & (u32(head, 8) >= 8 + 4 * count) & (u32(head, 8) < size), F.lit(False))


def looks_fe_arc(head: Column, size: Column) -> Column:
    lz = ("10", "11", "13")
    return F.coalesce((size >= 0x28) & (u32(head, 0) == size) & (hex_of(head, 0x20, 1).isin(*lz) | hex_of(head, 0x24, 1).isin(*lz)) & u32(head, 8).between(1, 64), F.lit(False))


def fingerprint(path: Column, head: Column, tail: Column, size: Column) -> Column:
    """A struct of ``detected_type`` (null: none) and ``confidence``; the first rule that holds decides.

    Rules are (type, confidence, condition); ``head`` needs 48 bytes, ``tail`` 48.
    """
    ext = extension(path)
    m = lambda *x: magic_is(head, *x)
    rules = [
        ("yaz0", "high", m(b"Yaz0") & (size >= 16)),
        ("nintendo_lz", F.when(ext.isin(*LZ_EXTENSIONS), "high").otherwise("medium"), looks_lz(path, head, size)),
        ("garc", "high", m(b"CRAG") & (size >= 0x1C)),
        ("sarc", "high", m(b"SARC") & (size >= 0x14)),
        ("narc", "high", m(b"NARC") & (size >= 16)),
        ("zar", "high", m(b"ZAR\x01") & (size >= 0x18)),
        ("gar", "high", m(b"GAR")),
        ("darc", "high", m(b"darc\xff\xfe") & (size >= 8)),
        ("capcom_arc", "high", m(b"ARC\0") & (size >= 8)),
        ("fe_arc", "high", looks_fe_arc(head, size)),
        ("blz", "high", looks_blz(tail, size)),
        ("zlib", "medium", m(b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")),
        ("ctxb", "high", m(b"ctxb")),
        ("ctpk", "high", m(b"CTPK")),
        ("bch", "high", m(b"BCH\0")),
        ("cgfx", "high", m(b"CGFX")),
        ("bflim", "high", footer_is(tail)),
        ("shinen_tex", "high", m(b"TEX CTR ") | (m(b"CMPR") & hex_of(head, 4, 1).isin("10", "11", "13"))),
        ("capcom_tex", "high", m(b"TEX\0", b"\0XET") & (size >= 16)),
        ("capcom_tex", "medium", ext == ".tex"),
        ("bch", "medium", ext.isin(".bch", ".bcres")),
        ("bflim", "medium", ext == ".bflim"),
        ("gzip_container", "medium", hex_of(head, 4, 2) == "1F8B"),
        ("ctpk", "medium", ext == ".ctpk"),
        ("sarc", "medium", ext.isin(".arc", ".sarc")),
        ("zar", "medium", ext == ".zar"),
        ("gar", "medium", ext.isin(".gar", ".lzs")),
        ("ctxb", "medium", ext == ".ctxb"),
        ("cmb", "medium", ext == ".cmb"),
        ("gdb1", F.when(m(b"GDB1"), "high").otherwise("medium"), m(b"GDB1") | (ext == ".texturegdb")),
        ("jimg", "high", m(b"jIMG")),
        ("imgc", "high", m(b"IMGC")),
        ("stex", "high", m(b"STEX")),
        ("cpk", "high", m(b"CPK ")),
        ("arc0", "high", m(b"ARC0", b"XFSA")),
        ("l5_flat", "medium", looks_offset_table(head, size)),
        ("gfac", "high", m(b"GFAC") & (size >= 0x30)),
        ("stex", "medium", ext == ".stex"),
        ("arc0", "medium", ext == ".fa"),
    ]
    out = F.struct(F.lit(None).cast("string").alias("detected_type"), F.lit("low").alias("confidence"))
    for kind, confidence, rule in reversed(rules):
        value = F.struct(F.lit(kind).alias("detected_type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))
        out = F.when((size >= 4) & F.coalesce(rule, F.lit(False)), value).otherwise(out)
    return out
