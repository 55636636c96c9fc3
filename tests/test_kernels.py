"""Byte kernels: known answers, round trips, damaged input."""

import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orelode.functions import archives, lz, pixels, png, texture_builders, textures
from orelode.functions.identify import identify


@pytest.mark.parametrize("name", lz.CODECS)
@settings(max_examples=60, deadline=None)
@given(data=st.one_of(st.binary(min_size=8, max_size=600), st.lists(st.sampled_from([b"abc", b"aaaa", b"xyz", b"\0\0"]), min_size=3, max_size=300).map(b"".join)))
def test_codec_round_trip(name, data):
    pack, unpack = lz.CODECS[name]
    packed = pack(data)
    assert packed is None or unpack(packed) == data


@pytest.mark.parametrize("name", lz.CODECS)
def test_codec_damage(name):
    rng = random.Random(5)
    pack, unpack = lz.CODECS[name]
    good = pack(b"hello hello hello world " * 30)
    for _ in range(400):
        bad = bytearray(good)
        bad[rng.randrange(len(bad))] = rng.randrange(256)
        unpack(bytes(bad[: rng.randrange(len(bad) + 1)]))  # gives something or None, never fails


def test_lz_reaches_before_the_start():
    assert lz.unpack_lz(b"\x10\x04\x00\x00" + b"\x80\x10\x03") == bytes(4)


def test_lz_looks():
    assert lz.is_lz(lz.pack_lz10(b"ab" * 50))
    assert not lz.is_lz(b"\x10\x00\x00\x00")
    assert not lz.is_lz(b"\x10\xff\xff\xff" + bytes(10))  # too large a ratio
    assert lz.is_lz(b"\x10\xff\x00\x00\0\0\0\0", "a/b.lz")


ENTRIES = [(f"n{i}.bin", bytes([i] * (5 + i))) for i in range(12)]


@pytest.mark.parametrize("kind", archives.PACKERS)
def test_archive_round_trip(kind):
    found, error = archives.expand(kind, archives.PACKERS[kind](ENTRIES))
    assert error is None
    want = [p for _, p in ENTRIES]
    if kind == "gar":
        assert [p[8 : 8 + len(w)] for (_, p), w in zip(found, want, strict=True)] == want
    else:
        assert [p for _, p in found] == ([b"TEX\0" + p for p in want] if kind == "capcom_arc" else want)


@pytest.mark.parametrize("kind", archives.READERS)
def test_archive_damage(kind):
    rng = random.Random(9)
    good = archives.PACKERS.get(kind, archives.pack_sarc)(ENTRIES)
    for _ in range(500):
        bad = bytearray(good)
        for _ in range(4):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        archives.expand(kind, bytes(bad[: rng.randrange(len(bad) + 1)]))


def test_capcom_sizes_in_the_entry_before():
    found, _ = archives.expand("capcom_arc", archives.pack_capcom_arc(ENTRIES, own=False))
    assert [p[4:] for _, p in found] == [p for _, p in ENTRIES]


def test_big_endian_sarc():
    assert [p for _, p in archives.expand("sarc", archives.pack_sarc(ENTRIES, ">"))[0]] == [p for _, p in ENTRIES]


@pytest.mark.parametrize("kind", texture_builders.BUILDERS)
def test_texture_header(kind):
    w, h, px = 128, 128, os.urandom(128 * 128)
    blob = texture_builders.BUILDERS[kind](w, h, px)
    (t,), error = textures.textures(kind, blob)
    assert error is None and (t.format, t.width, t.height, t.data) == ("L8", w, h, px)
    if kind != "cmb":
        assert identify(blob) == kind


def test_gdb1():
    (t,) = textures.read_gdb1(*texture_builders.build_gdb1(16, 8, bytes(range(128))))
    assert (t.width, t.height, t.format) == (16, 8, "L8")


def _scalar(name, data, x, y):
    """One pixel, from the rules written out by hand."""
    k = (x & 1) | (y & 1) << 1 | (x & 2) << 1 | (y & 2) << 2 | (x & 4) << 2 | (y & 4) << 3
    bits = pixels.BITS[name]
    if bits == 4:
        v = data[k // 2] >> (4 * (k % 2)) & 15
    else:
        v = int.from_bytes(data[k * bits // 8 : (k + 1) * bits // 8], "little")
    five, six = lambda q: q << 3 | q >> 2, lambda q: q << 2 | q >> 4
    return {
        "RGBA8": lambda: (v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255),
        "RGB8": lambda: (v >> 16, v >> 8 & 255, v & 255, 255),
        "RGBA5551": lambda: (five(v >> 11), five(v >> 6 & 31), five(v >> 1 & 31), 255 * (v & 1)),
        "RGB565": lambda: (five(v >> 11), six(v >> 5 & 63), five(v & 31), 255),
        "RGBA4": lambda: tuple(17 * (v >> s & 15) for s in (12, 8, 4, 0)),
        "LA8": lambda: (v >> 8,) * 3 + (v & 255,),
        "HILO8": lambda: (v & 255, v >> 8, 255, 255),
        "L8": lambda: (v, v, v, 255),
        "A8": lambda: (255, 255, 255, v),
        "LA4": lambda: (17 * (v >> 4),) * 3 + (17 * (v & 15),),
        "L4": lambda: (17 * v,) * 3 + (255,),
        "A4": lambda: (255, 255, 255, 17 * v),
    }[name]()


@pytest.mark.parametrize("name", [n for n in pixels.NAMES if not n.startswith("ETC1")])
def test_pixels_against_scalar_rules(name):
    data = os.urandom(pixels.n_bytes(8, 8, name))
    image = pixels.decode(name, 8, 8, data)
    for y in range(8):
        for x in range(8):
            assert tuple(int(c) for c in image[y, x]) == _scalar(name, data, x, y)


def _etc1_pixel(word, x, y):
    high = word >> 32
    part = (y >= 2) if high & 1 else (x >= 2)
    colour = []
    for shift in (27, 19, 11):
        if high & 2:
            base = high >> shift & 31
            step = high >> (shift - 3) & 7
            if part:
                base = max(0, min(31, base + (step - 8 if step > 3 else step)))
            colour.append(base << 3 | base >> 2)
        else:
            colour.append(17 * (high >> (shift - 3 if part else shift + 1) & 15))
    k = x * 4 + y
    table = high >> (2 if part else 5) & 7
    step = int(pixels.ETC1_STEPS[table][word >> k & 1]) * (-1 if word >> (k + 16) & 1 else 1)
    return tuple(max(0, min(255, c + step)) for c in colour)


@pytest.mark.parametrize("alpha", [False, True])
def test_etc1_against_scalar_rules(alpha):
    data = os.urandom(64 if alpha else 32)
    image = pixels.decode("ETC1A4" if alpha else "ETC1", 8, 8, data)
    size = 16 if alpha else 8
    for block in range(4):
        raw = data[block * size : (block + 1) * size]
        word = int.from_bytes(raw[-8:], "little")
        for y in range(4):
            for x in range(4):
                got = tuple(int(c) for c in image[4 * (block // 2) + y, 4 * (block % 2) + x])
                a = 17 * (int.from_bytes(raw[:8], "little") >> 4 * (4 * x + y) & 15) if alpha else 255
                assert got == (*_etc1_pixel(word, x, y), a)


def test_short_and_cropped_input():
    assert (pixels.decode("L8", 8, 8, b"")[..., 0] == 0).all()
    assert (pixels.decode("L8", 8, 8, b"")[..., 3] == 255).all()
    assert pixels.decode("RGBA8", 20, 12, os.urandom(5000)).shape == (12, 20, 4)


def test_metrics():
    m = pixels.metrics(np.full((32, 32, 4), 255, np.uint8))
    assert m["pct_dominant_color"] == 100.0 and m["stddev"] == 0.0 and m["mean_luminance"] == 255.0


def test_png_has_its_chunks():
    data = png.encode_png(np.zeros((3, 5, 4), np.uint8))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (5, 3) and data.endswith(b"IEND\xaeB`\x82")


def test_streams_of_packed_members():
    """The nearest stream before a member counts, if it makes a known kind of file; others are tried a bounded number of times."""
    whole = [b"CTPK" + bytes([i]) * 600 for i in range(3)]
    packed = [lz.pack_crilayla(w) for w in whole]
    data = b"".join(p + b"pad!" * 8 for p in packed) + lz.pack_crilayla(b"none" + bytes(600)) + bytes(64)
    streams = archives.PackedStreams(data, 0, len(data))
    assert len(streams.found) == 4 and streams.before(len(data) - 10, 604) == whole[2]
    assert streams.before(len(packed[0]) + 8, 604) == whole[0] and streams.member(0, 300) == whole[0]
    assert streams.member(5, 300) is None and archives.PackedStreams(data, 0, 0).before(99, 604) is None


@pytest.mark.parametrize("name", ["lz10", "lz11", "yaz0", "blz", "crilayla"])
def test_copies_before_the_start_and_short_streams(name):
    """Copies from before the start are zeros; a stream may end inside a step; what follows the last byte doesn't matter."""
    form = {"lz10": lz.LZ10, "lz11": lz.LZ11, "yaz0": lz.YAZ0, "blz": lz.BLZ, "crilayla": lz.CRILAYLA}[name]
    flags = 0x40 if form.turn == 0 else 0xBF  # a literal, a copy, literals
    code = {"lz10": b"\x20\x04", "lz11": b"\x40\x04", "yaz0": b"\x30\x04", "blz": b"\x20\x02", "crilayla": b"\x10\x04"}[name]
    out = lz.expand(bytes([flags]) + b"a" + code + b"bcdefg", 0, 100, form)
    assert out == b"a" + bytes(4) + b"a" + b"bcdefg"[: len(out) - 6] and lz.expand(bytes([flags]) + b"a" + code[:1], 0, 100, form) == b"a"
    assert lz.expand(bytes([flags]) + b"a" + code + b"bcdefg", 0, 3, form) == b"a\0\0" and lz.expand(b"", 0, 3, form) == b""
