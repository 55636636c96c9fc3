"""GPU pixel formats: packed tiles to rows of RGBA bytes, as array operations.

Images are stored in tiles of 8x8 pixels whose order interleaves the bits of x and y (Morton order). Short input counts
as continued with zero bytes; what is left over is ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Code, name and bits per pixel: fixed values of the hardware.
FORMATS = (("RGBA8", 32), ("RGB8", 24), ("RGBA5551", 16), ("RGB565", 16), ("RGBA4", 16), ("LA8", 16), ("HILO8", 16), ("L8", 8), ("A8", 8), ("LA4", 8), ("L4", 4), ("A4", 4), ("ETC1", 4), ("ETC1A4", 8))
NAMES = tuple(name for name, _ in FORMATS)
BITS = dict(FORMATS)
#: Pixels of which colours are counted in large images; the sample's seed is fixed.
SAMPLE = 4096
#: Brightness steps (small, large) of the eight ETC1 tables: fixed values.
ETC1_STEPS = np.array([(2, 8), (5, 17), (9, 29), (13, 42), (18, 60), (24, 80), (33, 106), (47, 183)], np.int32)


def n_bytes(width: int, height: int, name: str) -> int:
    return (width * height * BITS[name] + 7) // 8


def _deinterleave(k: np.ndarray) -> np.ndarray:
    return (k & 1) | (k >> 1 & 2) | (k >> 2 & 4)


@lru_cache(maxsize=64)
def raster(width: int, height: int) -> np.ndarray:
    """For each stored pixel its place (row by row) in an image of whole tiles."""
    across = -(-width // 8)
    k = np.arange(across * 8 * -(-height // 8) * 8)
    tile, inner = k >> 6, k & 63
    x, y = _deinterleave(inner), _deinterleave(inner >> 1)
    return ((tile // across) * 8 + y) * across * 8 + (tile % across) * 8 + x


def _spread(v: np.ndarray, bits: int) -> np.ndarray:
    """``bits``-bit values over the whole of a byte, by repeating their first bits."""
    v = v.astype(np.uint16)
    if bits == 1:
        return v * 255
    return v * 17 if bits == 4 else (v << (8 - bits)) | (v >> (2 * bits - 8))


def _fields(word: np.ndarray, *layout: tuple[int, int]) -> list[np.ndarray]:
    """(shift, bits) of each channel."""
    return [_spread(word >> s & ((1 << b) - 1), b) for s, b in layout]


def _channels(name: str, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Red, green, blue and alpha of the stored pixels, in their stored order."""
    full = 255
    if name == "RGBA8":
        a, b, g, r = data.reshape(-1, 4).T
    elif name == "RGB8":
        (b, g, r), a = data.reshape(-1, 3).T, full
    elif name in ("RGBA5551", "RGB565", "RGBA4"):
        word = data.view("<u2").astype(np.uint32)
        if name == "RGBA5551":
            r, g, b, a = _fields(word, (11, 5), (6, 5), (1, 5), (0, 1))
        elif name == "RGB565":
            (r, g, b), a = _fields(word, (11, 5), (5, 6), (0, 5)), full
        else:
            r, g, b, a = _fields(word, (12, 4), (8, 4), (4, 4), (0, 4))
    elif name == "LA8":
        a, r = data.reshape(-1, 2).T
        g = b = r
    elif name == "HILO8":
        (r, g), b, a = data.reshape(-1, 2).T, full, full
    elif name == "L8":
        r = g = b = data
        a = full
    elif name == "A8":
        r = g = b = full
        a = data
    elif name == "LA4":
        r, a = _fields(data, (4, 4), (0, 4))
        g = b = r
    else:
        half = _spread(np.stack([data & 15, data >> 4], axis=1).ravel(), 4)  # the low half is the first pixel
        r = g = b = half if name == "L4" else full
        a = full if name == "L4" else half
    return r, g, b, a


def _etc1(words: np.ndarray) -> np.ndarray:
    """Blocks of 4x4 pixels (block, y, x, channel) of 64-bit words."""
    w = words.astype(np.uint64)
    bits = lambda shift, n: (w >> np.uint64(shift) & np.uint64((1 << n) - 1)).astype(np.int32)
    differs, flipped = bits(33, 1).astype(bool), bits(32, 1).astype(bool)
    base = np.empty((len(w), 2, 3), np.int32)
    for c, top in enumerate((59, 51, 43)):
        first, step = bits(top, 5), bits(top - 3, 3)
        second = np.clip(first + np.where(step > 3, step - 8, step), 0, 31)
        apart = bits(top + 1, 4) * 17, bits(top - 3, 4) * 17
        for i, value in enumerate((first, second)):
            base[:, i, c] = np.where(differs, (value << 3) | (value >> 2), apart[i])
    table = np.stack([bits(37, 3), bits(34, 3)], axis=1)
    y, x = np.divmod(np.arange(16), 4)
    k = (x * 4 + y).astype(np.uint64)
    large = (w[:, None] >> k & np.uint64(1)).astype(np.int32)
    minus = (w[:, None] >> (k + np.uint64(16)) & np.uint64(1)).astype(np.int32)
    half = np.where(flipped[:, None], y >= 2, x >= 2).astype(np.int32)
    step = ETC1_STEPS[np.take_along_axis(table, half, axis=1), large] * (1 - 2 * minus)
    colour = np.take_along_axis(base, half[:, :, None].repeat(3, axis=2), axis=1) + step[:, :, None]
    return np.clip(colour, 0, 255).astype(np.uint8).reshape(-1, 4, 4, 3)


def _etc1_image(name: str, width: int, height: int, data: np.ndarray) -> np.ndarray:
    words = data.view("<u8")
    alpha = None
    if name == "ETC1A4":
        alpha, words = words[0::2], words[1::2]
    blocks = np.full((len(words), 4, 4, 4), 255, np.uint8)
    blocks[..., :3] = _etc1(words)
    if alpha is not None:
        y, x = np.divmod(np.arange(16), 4)
        nibble = alpha[:, None] >> (4 * (x * 4 + y)).astype(np.uint64) & np.uint64(15)
        blocks[..., 3] = (nibble * np.uint64(17)).astype(np.uint8).reshape(-1, 4, 4)
    across, down = -(-width // 8), -(-height // 8)
    # four blocks make a tile: two in the upper row, two in the lower
    return blocks.reshape(down, across, 2, 2, 4, 4, 4).transpose(0, 2, 4, 1, 3, 5, 6).reshape(down * 8, across * 8, 4)


def decode(name: str, width: int, height: int, data: bytes) -> np.ndarray:
    """An array (height, width, 4) of bytes."""
    whole = -(-width // 8) * 8, -(-height // 8) * 8
    need = n_bytes(*whole, name)
    raw = np.frombuffer(data[:need] + bytes(max(0, need - len(data))), np.uint8)
    if name.startswith("ETC1"):
        image = _etc1_image(name, width, height, raw)
    else:
        image = np.empty((whole[0] * whole[1], 4), np.uint8)
        at = raster(width, height)
        for c, values in enumerate(_channels(name, raw)):
            image[at, c] = values
        image = image.reshape(whole[1], whole[0], 4)
    return image[:height, :width]


def metrics(image: np.ndarray) -> dict[str, float]:
    """Quality numbers of an image, rounded as Python rounds."""
    height, width = image.shape[:2]
    rgb, alpha = image[..., :3].astype(np.float64), image[..., 3]
    n = height * width
    if not n:
        return {"pct_transparent": 0.0, "variance_score": 0.0, "stddev": 0.0, "mean_luminance": 0.0, "unique_colors_sampled": 0, "pct_dominant_color": 100.0}
    packed = np.ascontiguousarray(image).view(np.uint32).ravel()
    sample = packed if n <= SAMPLE else packed[np.random.RandomState(42).choice(n, SAMPLE, replace=False)]
    colours, counts = np.unique(sample, return_counts=True)
    variance = round(float(rgb.var(axis=(0, 1)).mean()), 1)
    return {
        "pct_transparent": round(float((alpha == 0).mean() * 100), 1),
        "variance_score": variance,
        "stddev": round(math.sqrt(max(variance, 0)), 2),
        "mean_luminance": round(float((rgb @ [0.299, 0.587, 0.114]).mean()), 1),
        "unique_colors_sampled": len(colours),
        "pct_dominant_color": round(float(counts.max() / len(sample) * 100), 1),
    }
