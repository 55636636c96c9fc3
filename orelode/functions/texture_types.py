"""What a texture's header says, and checks that all readers of headers share."""

from __future__ import annotations

from dataclasses import dataclass

from orelode.functions.archives import Broken
from orelode.functions.pixels import NAMES


@dataclass
class Texture:
    name: str
    format: str
    width: int
    height: int
    data: bytes
    parser: str
    confidence: str = "high"
    mips: int = 1
    crop: tuple[int, int] | None = None


def plain_code(code: int) -> str:
    if code >= len(NAMES):
        raise Broken(f"format {code}")
    return NAMES[code]


def sized(width: int, height: int, most: int = 2048) -> bool:
    return 0 < width <= most and 0 < height <= most
