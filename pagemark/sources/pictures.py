"""What the first bytes of a picture tell: its kind, size and orientation, without decoding it."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = "kind string, width int, height int, orientation int"
# A PNG's first bytes; JPEG markers of a frame, of markers without a length; the number of EXIF's orientation.
PNG, FRAMES, BARE, TURNED = b"\x89PNG\r\n\x1a\n", {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}, {0x01, *range(0xD0, 0xD8)}, 0x0112

Header = tuple[str, int, int, int]


def _png(data: bytes) -> Header | None:
    """Chunks up to the first with pixels; a picture begins with a header that is whole, and has pixels."""
    at, size, turn = 8, None, 1
    while at + 12 <= len(data):
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + length]
        if size is None:
            if kind != b"IHDR" or length != 13 or data[at + 21 : at + 25] != struct.pack(">I", zlib.crc32(kind + body)):
                return None
            size = struct.unpack_from(">II", body)
        elif kind == b"eXIf":
            turn = _orientation(body) or turn
        elif kind == b"IDAT":
            return ("png", *size, turn) if min(size) > 0 and max(size) < 1 << 31 else None
        elif kind == b"IEND":
            return None
        at += 12 + length
    return None


def _jpeg(data: bytes) -> Header | None:
    """Segments up to the scan; a picture has a frame before it."""
    at, size, turn = 2, None, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # filling
            at += 1
            continue
        if marker in BARE:
            at += 2
            continue
        (length,) = struct.unpack_from(">H", data, at + 2)
        if length < 2 or marker == 0xD9:
            return None
        body = data[at + 4 : at + 2 + length]
        if marker in FRAMES and len(body) >= 6:
            size = struct.unpack_from(">HH", body, 1)
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            turn = _orientation(body[6:]) or turn
        elif marker == 0xDA:
            return ("jpeg", size[1], size[0], turn) if size is not None and min(size) > 0 else None
        at += 2 + length
    return None


def _orientation(tiff: bytes) -> int | None:
    """1 to 8 from the first directory of EXIF data."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        start = struct.unpack_from(order + "I", tiff, 4)[0] if order else 0
        for k in range(struct.unpack_from(order + "H", tiff, start)[0] if order else 0):
            tag, kind, n, value = struct.unpack_from(order + "HHIH", tiff, start + 2 + 12 * k)
            if (tag, kind, n) == (TURNED, 3, 1) and 1 <= value <= 8:
                return value
    except struct.error:
        pass
    return None


def _bitmap(data: bytes) -> Header | None:
    if len(data) < 54:
        return None
    width, height = struct.unpack_from("<ii", data, 18)
    return ("bmp", width, abs(height), 1) if width > 0 and height else None


def header(data: bytes | None) -> Header | None:
    """kind, width, height and orientation of a picture's bytes; null for what is none."""
    for start, walk in ((PNG, _png), (b"\xff\xd8", _jpeg), (b"BM", _bitmap)):
        if data and data.startswith(start):
            return walk(data)
    return None


def picture_header(data: Column) -> Column:
    """The header of a binary column's pictures, as a struct (HEADER); its kind is null for what is none."""

    def walk(values: pd.Series) -> pd.DataFrame:
        rows = [header(bytes(x)) if x is not None else None for x in values]
        return pd.DataFrame([r or (None,) * 4 for r in rows], columns=["kind", "width", "height", "orientation"]).astype({c: "Int32" for c in ("width", "height", "orientation")})

    return F.pandas_udf(walk, HEADER)(data)


def upright_size(told: Column) -> Column:
    """width and height of a header once the picture is turned as it says."""
    lies = told["orientation"] >= 5
    return F.struct(F.when(lies, told["height"]).otherwise(told["width"]).alias("width"), F.when(lies, told["width"]).otherwise(told["height"]).alias("height"))
