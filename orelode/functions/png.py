"""PNG files from pixel arrays, with the standard library alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode_png(image: np.ndarray) -> bytes:
    """RGBA rows; alpha is left out if it is full everywhere. Grey stands for a plane of one colour under a varied alpha."""
    rgb, alpha = image[..., :3], image[..., 3]
    if rgb.size and rgb.astype(np.float64).std() < 5 and alpha.astype(np.float64).std() > 10:
        image = np.dstack([np.repeat(alpha[..., None], 3, axis=2), np.full(alpha.shape, 255, np.uint8)])
        alpha = image[..., 3]
    full = bool((alpha == 255).all())
    pixels = np.ascontiguousarray(image[..., :3] if full else image)
    height, width = pixels.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if full else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")
