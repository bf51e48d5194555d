"""Picture headers, providers' replies, and label files."""

from __future__ import annotations

import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pagemark.operators import providers, vision
from pagemark.sources import labels, pictures


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


IHDR = chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0))
EXIF = lambda order, turn: struct.pack(order + "2sHIHHHIHH", b"II" if order == "<" else b"MM", 42, 8, 1, 0x0112, 3, 1, turn, 0)
FRAME = segment(0xC2, struct.pack(">BHHB", 8, 9, 7, 1) + b"\1\x11\0")
CASES = [
    (pictures.PNG + IHDR + chunk(b"IDAT", b"x"), ("png", 7, 9, 1)),
    (pictures.PNG + IHDR + chunk(b"tEXt", b"a" * 70_000) + chunk(b"eXIf", EXIF("<", 6)) + chunk(b"IDAT", b""), ("png", 7, 9, 6)),
    (pictures.PNG + IHDR + chunk(b"IEND", b""), None), (pictures.PNG + IHDR, None), (pictures.PNG, None), (pictures.PNG + chunk(b"IDAT", b"x") + IHDR, None),
    (pictures.PNG + IHDR[:-1] + b"\0" + chunk(b"IDAT", b"x"), None),
    (b"\xff\xd8" + segment(0xE0, b"JFIF") + FRAME + segment(0xDA, b"\1"), ("jpeg", 7, 9, 1)),
    (b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + EXIF(">", 8)) + b"\xff\xff" + FRAME + segment(0xC4, b"t") + segment(0xDA, b"\1"), ("jpeg", 7, 9, 8)),
    (b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + EXIF(">", 9)) + FRAME + segment(0xDA, b"\1"), ("jpeg", 7, 9, 1)),
    (b"\xff\xd8" + segment(0xE1, b"Exif\0\0MM") + FRAME + segment(0xDA, b"\1"), ("jpeg", 7, 9, 1)),
    (b"\xff\xd8" + FRAME, None), (b"\xff\xd8" + segment(0xDA, b"\1"), None), (b"\xff\xd8\xff\xd9", None), (b"\xff\xd8\0\0\0\0", None), (b"\xff\xd8" + b"\xff\xc0\0\1" + b"x" * 9, None),
    (b"BM" + bytes(16) + struct.pack("<ii", 7, -9) + bytes(28), ("bmp", 7, 9, 1)), (b"BM", None), (b"", None), (None, None), (b"GIF89a", None),
]


def test_headers(spark):
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, (d, _) in enumerate(CASES)], "i int, data binary").repartition(2)
    told = df.withColumn("h", pictures.picture_header(F.col("data"))).withColumn("u", pictures.upright_size(F.col("h")))
    for r in told.collect():
        want = CASES[r.i][1]
        assert tuple(r.h) == (want or (None,) * 4)
        assert tuple(r.u) == ((None, None) if want is None else (want[2], want[1]) if want[3] >= 5 else want[1:3])


def said(*texts):
    return json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": t} for t in texts]}]})


CHAT = json.dumps({"choices": [{"message": {"content": "from chat"}}]})
GEMINI = json.dumps({"candidates": [{"content": {"parts": [{"text": "g"}]}}]})
REFUSED = json.dumps({"stop_reason": "refusal", "content": [{"type": "text", "text": "no"}]})
#: provider, attempts (try, endpoint, status, body), reply, calls
RUNS = [
    ("openai", [(1, "responses", 200, said("```a```", "b"))], "a", 1),
    ("openai", [(1, "responses", 400, None), (1, "chat/completions", 200, CHAT)], "from chat", 2),
    ("openai", [(1, "responses", 404, None), (1, "chat/completions", 500, CHAT), (2, "responses", 200, said("again"))], "again", 3),
    ("openai", [(1, "responses", None, None), (1, "chat/completions", 200, CHAT), (2, "responses", 200, said("late"))], "late", 2),
    ("openai", [(1, "responses", 200, said()), (2, "responses", 200, said("never"))], None, 1),
    ("openai", [(1, "responses", 200, "{}"), (2, "responses", 200, said("never"))], None, 1),
    ("openai", [(k, e, 500, None) for k in (1, 2, 3) for e in ("responses", "chat/completions")], None, 4),
    ("openai", [(2, "responses", 200, said("only the second is there"))], "only the second is there", 1),
    ("gemini", [(1, "", 200, '{"candidates": []}'), (2, "", 200, GEMINI)], "g", 2),
    ("gemini", [(1, "", 429, GEMINI), (2, "", 399, GEMINI)], "g", 2),
    ("anthropic", [(1, "", 200, REFUSED), (2, "", 200, REFUSED)], None, 1),
    ("anthropic", [(1, "", 200, '{"content": [{"type": "text", "text": " `x=1` "}]}')], "x=1", 1),
    ("anthropic", [(1, "", 200, "[1"), (2, "", 200, "")], None, 2),
    ("another", [(1, "responses", 200, said("x"))], None, 0),
]


def test_providers(spark):
    rows = [(i, p, *a) for i, (p, attempts, _, _) in enumerate(RUNS) for a in attempts]
    df = spark.createDataFrame(rows, "i int, provider string, try int, endpoint string, status int, body string").repartition(3)
    assert {r.i: (r.reply, r.calls) for r in providers.replies(df, ["i"]).collect()} == {i: x[2:] for i, x in enumerate(RUNS)}


def test_readers_by_name(spark):
    calls = spark.createDataFrame([("a", "math", "1", bytearray(b"x"))], "img_id string, kind string, question_no string, data binary")
    vision.register_reader("seven", lambda pictures, kind: ["7"] * len(pictures))
    assert [r.raw for r in vision.read_images(calls, "seven", 1).collect()] == ["7"]
    with pytest.warns(UserWarning, match="no reader"):
        assert [r.raw for r in vision.read_images(calls, "nobody", 1).collect()] == [None]


def test_label_files(spark, tmp_path):
    rows = [(f"p/{i % 7}", i % 3, float(i), 2.0, float(i + 4), 8.0, 100.0, 50.0) for i in range(40)]
    df = spark.createDataFrame(rows, "img_id string, class_id int, x1 double, y1 double, x2 double, y2 double, w double, h double").repartition(5)
    folder = str(tmp_path / "out")
    labels.write_labels(df, folder, ["a", "-"], "val")
    assert sorted(os.listdir(folder)) == ["data.yaml", "labels"] and sorted(os.listdir(f"{folder}/labels/val")) == [f"p_{k}.txt" for k in range(7)]
    with open(f"{folder}/labels/val/p_3.txt") as file:
        assert file.read().split("\n")[0] == "0 0.050000 0.100000 0.040000 0.120000"
    with open(f"{folder}/data.yaml") as file:
        assert file.read().endswith('nc: 2\nnames:\n  0: "a"\n  1: "-"\n')
    got = sorted((r.split, r.img_id, r.class_id, round(r.cx * 100, 3)) for r in labels.read_labels(spark, folder).collect())
    assert got == sorted(("val", f"p_{i % 7}", i % 3, i + 2.0) for i in range(40))
    # a job that fails leaves what was there, and nothing of its own
    bad = df.withColumn("class_id", F.when(F.col("x1") == 39.0, F.raise_error(F.lit("spoilt")).cast("int")).otherwise(F.col("class_id")))
    with pytest.raises(Exception, match="spoilt"):
        labels.write_labels(bad, folder, ["a"], "val")
    assert sorted(os.listdir(folder)) == ["data.yaml", "labels"] and labels.read_labels(spark, folder).count() == 40
    labels.write_labels(df.limit(0), folder, ["a"])
    assert labels.read_labels(spark, folder).count() == 0


def test_tasks_of_many_label_files(monkeypatch, tmp_path):
    """However many files there are, TASKS tasks read them at most, and each file once."""
    monkeypatch.setattr(labels, "FILES", 2)
    monkeypatch.setattr(labels, "TASKS", 4, raising=False)
    (tmp_path / "labels/val").mkdir(parents=True)
    for k in range(33):
        (tmp_path / f"labels/val/{k}.txt").write_text("")
    parts = labels._Reader(str(tmp_path)).partitions()
    assert len(parts) <= 4 and len({f for p in parts for f in p.files}) == sum(len(p.files) for p in parts) == 33
