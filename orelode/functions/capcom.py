"""TEX files of one engine, whose headers differ by game and version.

Ways to read one are tried in order: by the size of what follows the header (of games whose formats are known, or of the
version that shares their layout), then three fixed layouts, then any size that fits. Where only sizes are known, pairs of
powers of two that fill the payload exactly are ranked: square ones first, then flat shapes, then usual sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from orelode.functions.archives import Broken, View
from orelode.functions.pixels import BITS, NAMES, n_bytes
from orelode.functions.texture_types import Texture

MAGICS = (b"TEX\0", b"\0XET")
#: Formats by the code in the header, in general and in two families of games; and those games' title ids.
CODES = {1: "RGBA8", 2: "RGB8", 3: "RGB565", 4: "RGBA5551", 5: "RGBA4", 6: "LA8", 7: "L8", 8: "A8", 9: "LA4", 10: "L4", 11: "ETC1", 12: "ETC1A4", 13: "HILO8", 0: "RGBA8"}
FIRST_FAMILY = {0x0B: "RGB8", 0x0C: "ETC1A4", 0x11: "ETC1"}
SECOND_FAMILY = {0x0C: "ETC1", 0x0D: "ETC1A4", 0x0B: "ETC1", 0x11: "ETC1"}
TITLES = {
    **dict.fromkeys(("0004000000060200", "0004000000035D00", "0004000000060100", "0004000000035900", "0004000000060300"), FIRST_FAMILY),
    **dict.fromkeys(("00040000000AE400", "0004000000187000", "0004000000126300", "000400000016D200", "000400000016E400"), SECOND_FAMILY),
}
#: Sizes of headers in the order in which they are tried, the place of the format's code, and the version that shares the layout.
HEADERS, CODE_AT, SHARED_VERSION = (0x14, 0x10, 0x18, 0x20), 0x0D, 0xA5


@dataclass
class Fit:
    width: int
    height: int
    format: str
    score: int
    way: str
    mips: int = 1


def _score(width: int, height: int) -> int:
    shape = 2 if width == height else 1 if max(width, height) <= 4 * min(width, height) else 0
    return 1 + shape + (32 <= min(width, height) and max(width, height) <= 512)


def exact_sizes(payload: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(width, height, score) of powers of two, 4 to 1024, that fill ``payload`` bytes exactly."""
    pixels, rest = divmod(8 * payload, bits)
    if rest or pixels <= 0 or pixels & (pixels - 1):
        return
    for power in range(2, 11):
        width, height = 1 << power, pixels >> power
        if 4 <= height <= 1024:
            yield width, height, _score(width, height)


def chained_sizes(payload: int, bits: int) -> list[tuple[int, int, int, int]]:
    """(width, height, levels, score) of images that fill ``payload`` with some of their halved levels; best first."""
    out = []
    for width in (1 << p for p in range(3, 11)):
        for height in (1 << p for p in range(3, 11)):
            total, level = 0, 0
            while min(width, height) >> level >= 4 and total < payload:
                total += ((width >> level) * (height >> level) * bits + 7) // 8
                level += 1
            if total == payload and level:
                out.append((width, height, level, _score(width, height) + (level >= 3)))
    return sorted(out, key=lambda x: -x[3])


def _best(payload: int, stated: str | None, own: dict[int, str]) -> Fit | None:
    """The best fit of the first way that has any: the stated format, the game's formats, all, and then with levels."""
    single = lambda name, way: [Fit(w, h, name, s, way) for w, h, s in exact_sizes(payload, BITS[name])]
    chain = lambda name, way: [Fit(w, h, name, s, f"{way}_{n}", n) for w, h, n, s in chained_sizes(payload, BITS[name])]
    for names, make, way in (([stated] if stated else [], single, "profile_fmt"), (own.values(), single, "profile_scan"), (NAMES, single, "pica_scan"), ([stated] if stated else [], chain, "mipchain"), (NAMES, chain, "mipchain_scan")):
        fits = [f for name in names for f in make(name, way)]
        if fits:
            return max(fits, key=lambda f: f.score)  # the first of equal ones
    return None


def _by_payload(v: View, own: dict[int, str], headers: tuple[int, ...]) -> Texture | None:
    size = len(v.data)
    if size < 0x18:
        return None
    stated = own.get(v.data[CODE_AT]) or CODES.get(v.data[CODE_AT])

    def fit(payload: int, start: int, way: str) -> Texture | None:
        found = _best(payload, stated, own) if payload > 0 else None
        if found is None:
            return None
        sure = found.score >= 3
        confidence = {"profile_fmt": "high" if sure else "medium", "profile_scan": "medium" if sure else "low"}.get(found.way, "low")
        n = n_bytes(found.width, found.height, found.format) if found.way.startswith("mipchain") else payload
        return Texture("", found.format, found.width, found.height, v.data[start : start + n], f"capcom_tex/rer_payload/{way}/{found.way}", confidence, found.mips)

    for head in headers:
        if found := fit(size - head, head, f"full_payload/hdr=0x{head:X}"):
            return found
    # the first level's size, in a table of levels behind the header
    first = v.int(0x14)
    if not 0 < first < size - headers[0]:
        return None
    entries = 0
    while entries < 16 and 0x18 + 4 * entries <= size and 0 < v.int(0x14 + 4 * entries) <= size:
        entries += 1
    start = headers[0] + 4 * entries
    found = fit(first, start, f"mip_table/entries={entries}") if start + first <= size else None
    return found or (fit(first, 0x18, "mip_table/fixed_0x18") if 0x18 + first <= size else None)


def _laid_out(v: View, own: dict[int, str], fields: str, at: int, start_at: int | None, plain: int, share: tuple[int, int] | None, variant: str) -> Texture | None:
    """A fixed layout: ``fields`` from ``at`` on hold w(idth), h(eight), m(ips) and c(ode)."""
    if len(v.data) < max(16, at + 6 + (4 if start_at else 0)):
        return None
    read, where = {}, at
    for f in fields:
        read[f] = v.int(where, "H" if f in "wh" else "B")
        where += 2 if f in "wh" else 1
    width, height, code = read["w"], read["h"], read["c"]
    name = {**CODES, **own}.get(code) or (NAMES[code] if code < len(NAMES) else None)
    if name is None or not all(4 <= x <= 1024 and x % 4 == 0 for x in (width, height)):
        return None
    start = v.int(start_at) if start_at else plain
    start = start if 0 < start < len(v.data) else plain
    need, there = n_bytes(width, height, name), len(v.data) - start
    if share is None:
        good = there >= need * 3 // 4
        return Texture("", name, width, height, v.data[start : start + need] if good else v.data[start:], f"capcom_tex/{variant}", "high" if good else "low", max(1, read["m"]))
    if there < need * share[0] // share[1] or (variant == "mt_mobile" and not 0 < read["m"] <= 16):
        return None
    return Texture("", name, width, height, v.data[start : start + need], f"capcom_tex/{variant}", "medium", max(1, read["m"]))


def _any_size(v: View) -> Texture | None:
    for head in HEADERS:
        payload = len(v.data) - head
        fits = [Fit(w, h, name, s + (name in ("ETC1", "ETC1A4")), "") for name in NAMES for w, h, s in exact_sizes(payload, BITS[name])] if payload > 0 else []
        if fits:
            best = max(fits, key=lambda f: f.score)
            return Texture("", best.format, best.width, best.height, v.data[head:], f"capcom_tex/payload_bruteforce/hdr=0x{head:X}", "low")
    return None


def read_capcom_tex(data: bytes, title_id: str | None = None) -> Iterator[Texture]:
    v, magic = View(data), data[:4] in MAGICS
    if len(data) < 12:
        raise Broken("too small")
    own = TITLES.get((title_id or "").strip().upper().replace("0X", "").zfill(16))
    found = None
    if magic and own:
        found = _by_payload(v, own, HEADERS)
    elif magic and data[4] == SHARED_VERSION:
        found = _by_payload(v, CODES, HEADERS[:1])
    own = own or {}
    if magic:
        found = found or _laid_out(v, own, "whmc", 6, 0x0C, 0x10, None, "standard_tex")
    found = found or _laid_out(v, own, "cmwh", 4, None, 0x10, (1, 2), "mt_mobile")
    if magic:
        found = found or _laid_out(v, own, "whmc", 0x0A, 0x10, 0x14, (1, 2), "shifted_tex") or _any_size(v)
    if found is None:
        raise Broken("no layout fits")
    yield found
