from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemark.operators import capture, vision
from pagemark.sources.answers import images
from pagemark.streaming.session import Metrics, finish, page_results, start_session


def png(path, picture):
    h, w = picture.shape
    raw = b"".join(b"\0" + row.tobytes() for row in picture)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    page = np.full((400, 300), 255, np.uint8)
    rng = np.random.default_rng(1)
    for y in range(40, 360, 24):
        page[y : y + 8, 40:260] = rng.integers(0, 2, (8, 220)) * 255
    png(tmp_path / "in" / "good.png", page)
    png(tmp_path / "in" / "flat.PNG", np.full((400, 300), 255, np.uint8))
    (tmp_path / "in" / "broken.jpg").write_bytes(b"no picture")
    (tmp_path / "in" / "notes.txt").write_text("skip")
    return tmp_path


def test_gate(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: (r.ok, r.reason) for r in capture.capture_check(images(spark, str(folder / "in"))).collect()}
    assert got == {"good.png": (True, capture.FINE), "flat.PNG": (False, capture.BLURRED), "broken.jpg": (False, capture.UNREADABLE)}


@pytest.mark.parametrize("fails", [False, True])
def test_session(spark, folder, fails):
    def gate(paths):
        return capture.capture_check(images(spark, str(folder / "in"))).join(paths.select(F.regexp_replace("path", "^file:/+", "/").alias("_p")), F.regexp_replace("path", "^file:/+", "/") == F.col("_p")).drop("_p")

    def grade(paths):
        if fails:
            raise RuntimeError("reader gone")
        return paths.select(F.col("path").alias("img_id"), F.lit("1").alias("page_no"), F.lit("").alias("hold_reason"), F.lit(1).cast("long").alias("O"), F.lit(0).cast("long").alias("X"), F.lit(0).cast("long").alias("HOLD"))

    out, told, metrics = [str(folder / x) for x in ("checkpoint", "accepted", "rejected")], [], Metrics()
    query = start_session(spark, str(folder / "in"), out[0], gate, grade, out[1], out[2], on_result=lambda pages: told.extend(pages.collect()), metrics=metrics)
    query.awaitTermination()
    assert finish(spark, query, out[1]).first().O == (0 if fails else 1)
    assert spark.read.parquet(out[2]).count() == 2
    figures = metrics.summary(0.0)
    assert [figures[x] for x in ("pages", "accepted", "rejected", "held")] == [3, 1, 2, int(fails)] and 0 < figures["mean_seconds"] <= figures["max_seconds"] < figures["wait"]
    pages = page_results(spark, out[1]).collect()
    assert ("reader gone" in pages[0].hold_reason) == fails and sorted(told) == sorted(pages)


def test_a_page_that_fails_is_held_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "abcd":
        (tmp_path / "in" / f"{name}.png").write_bytes(b"x")

    def grade(paths):
        if any("b.png" in r.path for r in paths.collect()):
            raise RuntimeError("b is broken")
        return paths.select(F.col("path").alias("img_id"), F.lit("1").alias("page_no"), F.lit("").alias("hold_reason"), *(F.lit(int(c == "O")).cast("long").alias(c) for c in ("O", "X", "HOLD")))

    out = [str(tmp_path / x) for x in ("checkpoint", "accepted", "rejected")]
    query = start_session(spark, str(tmp_path / "in"), out[0], lambda rows: rows.withColumn("ok", F.lit(True)).withColumn("reason", F.lit("")), grade, out[1], out[2])
    query.awaitTermination()
    got = {r.img_id.rsplit("/", 1)[1]: (r.O, "b is broken" in r.hold_reason) for r in page_results(spark, out[1]).collect()}
    assert got == {"a.png": (1, False), "b.png": (0, True), "c.png": (1, False), "d.png": (1, False)}


def test_reader_never_raises(spark):
    calls = spark.createDataFrame([("a", "math", "1", b"x"), ("b", "math", "1", b"y")], "img_id string, kind string, question_no string, data binary")

    def reader(pictures, kind):
        if pictures[0] == b"y":
            raise RuntimeError
        return ["7"]

    vision_pause, vision.PAUSE = vision.PAUSE, 0.0
    got = {(r.img_id, r.call_no): r.raw for r in vision.read_images(calls, reader, 1, calls=2).collect()}
    vision.PAUSE = vision_pause
    assert got == {("a", 0): "7", ("a", 1): "7", ("b", 0): None, ("b", 1): None}
