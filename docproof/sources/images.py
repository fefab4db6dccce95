"""What the bytes of PNG, JPEG and WebP files say of a picture: type, size, frames, and whether the file is whole.

Each format is a sequence of records with their lengths in front, which are walked from one to the next; pixels are
not decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEADER = StructType().add("media_type", "string").add("width", "integer").add("height", "integer").add("frames", "integer").add("complete", "boolean")
#: First bytes of the formats, and markers of JPEG frames.
PNG, JPEG, RIFF, WEBP = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"RIFF", b"WEBP"
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def _number(data: bytes, at: int, size: int, order: str = "big") -> int:
    return int.from_bytes(data[at : at + size], order)


def _png(data: bytes) -> tuple:
    width = height = None
    frames, at, last = 1, len(PNG), b""
    while at + 12 <= len(data):
        size, last = _number(data, at, 4), data[at + 4 : at + 8]
        if last == b"IHDR":
            width, height = _number(data, at + 8, 4), _number(data, at + 12, 4)
        elif last == b"acTL":
            frames = _number(data, at + 8, 4)
        at += 12 + size
        if last == b"IEND":
            break
    return "image/png", width, height, frames, last == b"IEND" and at <= len(data)


def _jpeg(data: bytes) -> tuple:
    width = height = None
    at, scan = 2, False
    while at + 4 <= len(data) and not scan:
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:  # fill bytes and markers without a length
            at += 1 if marker == 0xFF else 2
            continue
        if marker in FRAMES:
            height, width = _number(data, at + 5, 2), _number(data, at + 7, 2)
        scan = marker == 0xDA
        at += 2 + _number(data, at + 2, 2)
    return "image/jpeg", width, height, 1, scan and data.find(b"\xff\xd9", at) >= 0


def _chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = 12
    while at + 8 <= len(data):
        size = _number(data, at + 4, 4, "little")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def _webp(data: bytes) -> tuple:
    width = height = None
    frames, moving, pictures, end = 0, False, 0, 12
    for kind, at, size in _chunks(data):
        end = at + size
        if kind == b"VP8X":
            moving = bool(data[at] & 2) if at < len(data) else False
            width, height = _number(data, at + 4, 3, "little") + 1, _number(data, at + 7, 3, "little") + 1
        elif kind == b"ANMF":
            frames += 1
        elif kind == b"VP8 ":
            pictures += 1
            own = _number(data, at + 6, 2, "little") & 0x3FFF, _number(data, at + 8, 2, "little") & 0x3FFF
            width, height = (width, height) if width else own
        elif kind == b"VP8L":
            pictures += 1
            bits = _number(data, at + 1, 4, "little")
            own = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            width, height = (width, height) if width else own
    whole = (pictures > 0 or frames > 0) and end <= len(data) and _number(data, 4, 4, "little") + 8 <= len(data) + 1
    return "image/webp", width, height, max(frames, 2) if moving else 1, whole


def header_of(data: bytes | None) -> tuple:
    """(media_type, width, height, frames, complete); all null for other bytes."""
    if data and data.startswith(PNG):
        return _png(data)
    if data and data.startswith(JPEG):
        return _jpeg(data)
    if data and data.startswith(RIFF) and data[8:12] == WEBP:
        return _webp(data)
    return None, None, None, None, None


@F.pandas_udf(HEADER)
def image_header(content: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([header_of(None if c is None else bytes(c)) for c in content], columns=HEADER.names)
    return rows.astype({"width": "Int32", "height": "Int32", "frames": "Int32", "complete": "boolean"})
