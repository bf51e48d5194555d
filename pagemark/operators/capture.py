"""The gate of captured pictures, and a page's corners, as relations over pixels (img_id, y, x, v).

Stencils are neighbours of windows along rows and columns, mirrored at the edges without the edge's own pixel; thresholds come
from histograms of 256 values. Whole numbers up to the last division, so scores do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ink import COLUMN, ROW, labelled, measured, runs

# Least blur score and bright share of a capture, share of a page's region, slack of its outline as a share of its length.
BLUR, PAGE, OUTLINE, SLACK = 60.0, 0.30, 0.30, 0.02
UNREADABLE, BLURRED, NO_PAGE, FINE = "unreadable picture", "too blurred", "no page found", "ok"
# Shares of blue, green and red in a gray value, of 2**14; binomial weights of a 5 x 5 filter.
GRAY, BINOMIAL = (1868, 9617, 4899), (1, 4, 6, 4, 1)


def pixel_rows(images: DataFrame) -> DataFrame:
    """img_id, y, x, v (gray) of pictures (path, image: Spark's image column); none for one that can't be read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, h, w, c, data in zip(*(batch[k].to_pylist() for k in ("path", "height", "width", "nChannels", "data")), strict=True):
                if h is None or h <= 0 or w <= 0:
                    continue
                cells = np.frombuffer(data, np.uint8).reshape(h * w, c)
                v = cells[:, 0].astype(np.int32) if c == 1 else (cells[:, :3].astype(np.int64) @ np.array(GRAY) + (1 << 13)) >> 14
                for at in range(0, h * w, 1 << 16):  # some rows at a time
                    some = np.arange(at, min(at + (1 << 16), h * w))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array(some // w, pa.int32()), pa.array(some % w, pa.int32()), pa.array(v[some], pa.int32())], ["img_id", "y", "x", "v"])

    given = images.select("path", *(F.col(f"image.{x}") for x in ("height", "width", "nChannels", "data")))
    return given.mapInArrow(work, "img_id string, y int, x int, v int")


def _beside(value: str, line: Window, k: int) -> tuple[Column, Column]:
    """The values k places before and after, mirrored at the ends; a line too short to mirror has its own."""
    before, after = F.lag(value, k).over(line), F.lead(value, k).over(line)
    if k == 1:
        return F.coalesce(before, after, F.col(value)), F.coalesce(after, before, F.col(value))
    own = F.col(value)
    ends = lambda near: F.when(F.lag(value, 1).over(line).isNotNull() if near else F.lead(value, 1).over(line).isNotNull(), own)
    return F.coalesce(before, ends(True), after, own), F.coalesce(after, ends(False), before, own)


def laplacians(picture: DataFrame) -> DataFrame:
    """picture with lap: the four neighbours less four times the pixel."""
    x, y = Window.partitionBy(*ROW).orderBy("x"), Window.partitionBy(*COLUMN).orderBy("y")
    across = picture.withColumn("_lx", sum(_beside("v", x, 1), F.lit(0)))
    return across.withColumn("lap", F.col("_lx") + sum(_beside("v", y, 1), F.lit(0)) - 4 * F.col("v")).drop("_lx")


def smoothed(picture: DataFrame) -> DataFrame:
    """picture with s: the 5 x 5 binomial mean, rounded."""

    def along(df: DataFrame, value: str, line: Window, out: str) -> DataFrame:
        (a1, b1), (a2, b2) = _beside(value, line, 1), _beside(value, line, 2)
        return df.withColumn(out, 6 * F.col(value) + 4 * (a1 + b1) + a2 + b2)

    both = along(along(picture, "v", Window.partitionBy(*ROW).orderBy("x"), "_h"), "_h", Window.partitionBy(*COLUMN).orderBy("y"), "_hv")
    return both.withColumn("s", F.floor((F.col("_hv") + 128) / 256).cast("int")).drop("_h", "_hv")


def otsu(picture: DataFrame, value: str = "s") -> DataFrame:
    """img_id, t: the threshold with the largest variance between both sides; of equal ones the smallest. Null for a picture of one value."""
    n = picture.groupBy("img_id", F.col(value).alias("t")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("img_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img_id")
    mass = F.col("n") * F.col("t")
    told = n.select("img_id", "t", F.sum("n").over(upto).alias("low"), F.sum(mass).over(upto).alias("m"), F.sum("n").over(whole).alias("n"), F.sum(mass).over(whole).alias("mt"))
    off = (F.col("mt").cast("double") * F.col("low") - F.col("m").cast("double") * F.col("n"))
    between = F.when(F.col("low") < F.col("n"), off * off / (F.col("low").cast("double") * (F.col("n") - F.col("low"))))
    return told.groupBy("img_id").agg(F.min_by("t", F.when(between.isNotNull(), F.struct(-between, F.col("t")))).alias("t"))


def bright(picture: DataFrame) -> DataFrame:
    """picture with s and bright: is a smoothed pixel on the bright side? A picture of one value is bright unless it is black."""
    s = smoothed(picture)
    told = otsu(s).withColumnRenamed("img_id", "_img")
    return s.join(told, s["img_id"] == told["_img"], "left").withColumn("bright", F.coalesce(F.col("s") > F.col("t"), F.col("s") > 0)).drop("_img", "t")


def scores(picture: DataFrame) -> DataFrame:
    """img_id, blur (population variance of the Laplacian), page (share of bright pixels)."""
    lap = F.col("lap").cast("double")
    n = F.count("*")
    blur = laplacians(picture).groupBy("img_id").agg(((F.sum(lap * lap) - F.sum(lap) * F.sum(lap) / n) / n).alias("blur"))
    page = bright(picture).groupBy("img_id").agg(F.avg(F.col("bright").cast("double")).alias("page"))
    return blur.join(page, "img_id")


def gate(known: DataFrame, scored: DataFrame, key: str = "path") -> DataFrame:
    """known (pictures by key) with ok and reason: unreadable without scores, else too blurred or without a page, else fine."""
    told = scored.withColumnRenamed("img_id", "_img")
    reason = F.when(F.col("blur").isNull(), UNREADABLE).when(F.col("blur") < BLUR, BLURRED).when(F.col("page") < PAGE, NO_PAGE).otherwise(FINE)
    rows = known.join(told, known[key] == told["_img"], "left")
    return rows.select(*(known[c] for c in known.columns), (reason == FINE).alias("ok"), reason.alias("reason"))


def capture_check(images: DataFrame) -> DataFrame:
    """path, ok, reason of each picture (path, image)."""
    return gate(images.select("path"), scores(pixel_rows(images)))


# ---------------------------------------------------------------- corners

Point = tuple[int, int]


def _turn(o: Point, a: Point, b: Point) -> int:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: list[Point]) -> list[Point]:
    """Corners of the convex hull of sorted points, around it from the first: the monotone chain, there and back."""
    if len(points) < 3:
        return list(points)
    sides = []
    for way in (points, points[::-1]):
        side: list[Point] = []
        for p in way:
            while len(side) > 1 and _turn(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        sides += side[:-1]
    return sides


def simplified(ring: list[Point], slack: float) -> list[Point]:
    """The corners of a ring that are needed so that none is farther than slack from it: halves between two points that are far apart, split where they are farthest off."""
    if len(ring) < 3:
        return ring
    farthest = lambda o: max(range(len(ring)), key=lambda k: (ring[k][0] - o[0]) ** 2 + (ring[k][1] - o[1]) ** 2)
    start = farthest(ring[0])
    ring = ring[start:] + ring[:start]
    first = farthest(ring[0])
    keep, todo = {0, first}, [(0, first), (first, len(ring))]
    while todo:
        i, j = todo.pop()
        a, b = ring[i], ring[j % len(ring)]
        long = max(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5, 1e-9)
        far, k = max(((abs(_turn(a, b, ring[k])) / long, -k) for k in range(i + 1, j)), default=(0.0, 0))
        if far > slack:
            keep.add(-k)
            todo += [(i, -k), (-k, j)]
    return [ring[k] for k in sorted(keep)]


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring: corners (x, y) of the hull of each group's points. Of each row of pixels only the outermost go on."""
    ends = points.groupBy(*keys, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    listed = ends.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array(F.struct(F.col("a").alias("x"), "y"), F.struct(F.col("b").alias("x"), "y")))))).alias("_p"))
    kind = "array<struct<x:long,y:long>>"

    def around(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in hull([(int(p["x"]), int(p["y"])) for p in one])] for one in lists])

    return listed.select(*keys, F.pandas_udf(around, kind)("_p").alias("ring"))


def page_corners(picture: DataFrame) -> DataFrame:
    """img_id, corners (x, y; top left, top right, bottom right, bottom left) of the largest bright region, if it fills OUTLINE of the picture and its outline
    has four corners within SLACK of its length; no row otherwise.
    """
    named = kept(labelled(runs(bright(picture).where("bright").select("img_id", "y", "x"))))
    size = picture.groupBy("img_id").agg(F.count("*").alias("_n"))
    first = Window.partitionBy("img_id").orderBy(F.desc("area"), "label_y", "label_x")
    largest = measured(named).withColumn("_k", F.row_number().over(first)).where("_k = 1").join(size, "img_id").where(F.col("area") >= OUTLINE * F.col("_n"))
    inside = named.join(largest.select("img_id", "label_y", "label_x"), ["img_id", "label_y", "label_x"], "left_semi")
    ends = inside.select("img_id", "y", F.explode(F.array("a", "b")).alias("x"))
    kind = "array<struct<x:long,y:long>>"

    def corners(rings: pd.Series) -> pd.Series:
        out = []
        for ring in rings:
            points = [(p["x"], p["y"]) for p in ring]
            around = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(points, points[1:] + points[:1], strict=True))
            four = simplified(points, SLACK * around)
            out.append([{"x": x, "y": y} for x, y in ordered(four)] if len(four) == 4 else None)
        return pd.Series(out)

    found = hulls(ends, ["img_id"])
    return found.select("img_id", F.pandas_udf(corners, kind)("ring").alias("corners")).where("corners IS NOT NULL")


def ordered(points: list[Point]) -> list[Point]:
    """Top left, top right, bottom right, bottom left of four points."""
    total, slope = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    return [min(points, key=total), min(points, key=slope), max(points, key=total), max(points, key=slope)]
