"""What turns pictures of Spark's image column into pictures, in numpy inside tasks, and reader providers. What is measured on them is in `capture` and `ink`.

An undecodable picture has height -1. Pictures are expected upright (no EXIF rotation).
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .capture import GRAY, page_corners, pixel_rows

# A reader's tries and pause.
TRIES, PAUSE = 2, 1.5


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """height x width x 3, blue first."""
    out = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(out, 3, axis=2) if channels == 1 else out[:, :, :3]


def gray(picture: np.ndarray) -> np.ndarray:
    return ((picture.astype(np.int64) @ np.array(GRAY) + (1 << 13)) >> 14).astype(np.uint8)


def warped(picture: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral (from the top left, clockwise) as a rectangle of its longer sides (nearest pixels)."""
    sides = np.hypot(*(np.roll(corners, -1, axis=0) - corners).T)  # top, right, bottom, left
    w, h = (int(max(sides[k], sides[k + 2])) for k in (0, 1))
    if w < 2 or h < 2:
        return picture
    to = np.array([(0, 0), (1, 0), (1, 1), (0, 1)]) * np.array([w - 1.0, h - 1.0])
    rows, right = [], []
    for (u, v), (x, y) in zip(to, corners, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    v, u = np.mgrid[0:h, 0:w]
    x, y, z = np.einsum("ij,jhw->ihw", m, np.stack([u, v, np.ones_like(u)]))
    xi = np.clip(np.rint(x / z), 0, picture.shape[1] - 1).astype(int)
    yi = np.clip(np.rint(y / z), 0, picture.shape[0] - 1).astype(int)
    return picture[yi, xi]


def contrasted(g: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited histogram equalisation on a grid of tiles, bilinear between them."""
    h, w = g.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = g[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(clip * part.size / 256, 1)
            extra = np.maximum(n - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(n, limit) + extra / 256) * 255 / max(part.size, 1)
    fy, fx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    i0, j0 = np.minimum(fy.astype(int), tiles - 2 if tiles > 1 else 0), np.minimum(fx.astype(int), tiles - 2 if tiles > 1 else 0)
    dy, dx = (fy - i0)[:, None], (fx - j0)[None, :]
    at = lambda a, b: maps[np.minimum(i0 + a, tiles - 1)[:, None], np.minimum(j0 + b, tiles - 1)[None, :], g]
    out = (1 - dy) * ((1 - dx) * at(0, 0) + dx * at(0, 1)) + dy * ((1 - dx) * at(1, 0) + dx * at(1, 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def straightened(images: DataFrame, corners: DataFrame | None = None) -> DataFrame:
    """path, height, width, colour (blue first), gray (contrast-normalised) of pictures (path, image), straightened where corners (img_id, corners) are known.

    corners as of `capture.page_corners`; that is looked up if none are given.
    """
    if corners is None:
        corners = page_corners(pixel_rows(images))
    given = images.select("path", *(F.col(f"image.{x}") for x in ("height", "width", "nChannels", "data"))).where("height > 0 AND width > 0")
    both = given.join(corners.select(F.col("img_id").alias("path"), "corners"), "path", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                picture = pixels(x["height"], x["width"], x["nChannels"], x["data"])
                if x["corners"] is not None:
                    picture = warped(picture, np.array([(c["x"], c["y"]) for c in x["corners"]], float))
                yield pa.RecordBatch.from_pylist([{"path": x["path"], "height": picture.shape[0], "width": picture.shape[1], "colour": picture.tobytes(), "gray": contrasted(gray(picture)).tobytes()}], _STRAIGHT)

    return both.mapInArrow(work, "path string, height int, width int, colour binary, gray binary")


_STRAIGHT = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("colour", pa.binary()), ("gray", pa.binary())])


def crops(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """img_id, question_no, height, width, data (blue first) of each block; the bytes join only here."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                part = pixels(r.height, r.width, r.nChannels, r.data)[max(0, r.y1) : r.y2, max(0, r.x1) : r.x2]
                out.append((r.img_id, r.question_no, part.shape[0], part.shape[1], part.tobytes()))
            yield pd.DataFrame(out, columns=["img_id", "question_no", "height", "width", "data"])

    given = blocks.join(images.select(F.col("path").alias("img_id"), "image.height", "image.width", "image.nChannels", "image.data"), "img_id").where("height > 0")
    return given.mapInPandas(work, "img_id string, question_no string, height int, width int, data binary")


Reader = Callable[[list[bytes], str], list[str | None]]
READERS: dict[str, Reader] = {}


def register_reader(name: str, reader: Reader) -> None:
    """A reader turns pictures and a kind (page, mcq, math) into raw replies; null where it has none."""
    READERS[name] = reader


def read_images(requests: DataFrame, reader: Reader | str, tasks: int, calls: int = 1) -> DataFrame:
    """model_reads of requests (img_id, kind, question_no, data): at most tasks at a time, tried TRIES times, never raising.

    reader: a reader or the name of one that is registered; a name that is not gives no replies, with a warning.
    Write the result before using it twice: a reader is costly, and its replies may differ.
    """
    if isinstance(reader, str):
        if reader not in READERS:
            warnings.warn(f"no reader is registered as {reader!r}; there are no replies", stacklevel=2)
        reader = READERS.get(reader, lambda pictures, kind: [None] * len(pictures))

    def tried(data: bytes, kind: str) -> str | None:
        for k in range(TRIES):
            try:
                return reader([data], kind)[0]
            except Exception:  # noqa: BLE001  any failure of a reader is a missing reply
                if k + 1 < TRIES:
                    time.sleep(PAUSE)
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x | {"call_no": n, "raw": tried(x["data"], x["kind"])} for x in batch.to_pylist() for n in range(calls)]
            kinds = pa.schema([("img_id", pa.string()), ("kind", pa.string()), ("question_no", pa.string()), ("call_no", pa.int32()), ("raw", pa.string())])
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in kinds.names} for r in rows], kinds)

    return requests.repartition(tasks).mapInArrow(work, "img_id string, kind string, question_no string, call_no int, raw string")
