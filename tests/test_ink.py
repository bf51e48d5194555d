"""Ink and captures against plain loops over small pictures."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemark.operators import capture, ink, vision

INK = "img_id int, y int, x int"


def pixels(pictures):
    return [(i, y, x, int(v)) for i, p in enumerate(pictures) for (y, x), v in np.ndenumerate(p)]


def rows(spark, pictures):
    return spark.createDataFrame(pixels(pictures), f"{INK}, v int").repartition(3)


def pieces(points):
    """Areas and boxes of sets of points that touch."""
    left, out = set(points), set()
    while left:
        todo, seen = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                seen.add(p)
                todo += [(p[0] + a, p[1] + b) for a, b in itertools.product((-1, 0, 1), repeat=2)]
        first = min(seen)
        ys, xs = zip(*seen, strict=True)
        out.add((*first, min(xs), min(ys), max(xs), max(ys), len(seen)))
    return out


def spiral(n):
    """One winding stroke with a gap of a pixel."""
    points, y, x, d, step = {(0, 0)}, 0, 0, 0, n
    while step > 0:
        for _ in range(2 if step < n else 3):
            for _ in range(step):
                y, x = y + (0, 1, 0, -1)[d], x + (1, 0, -1, 0)[d]
                points.add((y, x))
            d = (d + 1) % 4
        step -= 2
    return points


@pytest.mark.parametrize("density", [0.05, 0.3, 0.5])
def test_components(spark, density):
    rng = random.Random(density)
    pictures = [{(y, x) for y in range(30) for x in range(90) if rng.random() < density} for _ in range(3)] + [spiral(14), {(5, 5)}, set()]
    df = spark.createDataFrame([(i, *p) for i, some in enumerate(pictures) for p in some], INK)
    for least in (1, 4):
        got = {tuple(r) for r in ink.components(ink.runs(df.unionAll(df)), least).collect()}
        assert got == {(i, *p) for i, some in enumerate(pictures) for p in pieces(some) if p[-1] >= least}
    assert ink.components(ink.runs(df.limit(0)), 1).count() == 0


def test_print_is_taken_away(spark):
    rng = random.Random(2)
    spans = [(rng.randrange(2), rng.randrange(6), a := rng.randrange(40), a + rng.randrange(9)) for _ in range(80)]
    masks = [(rng.randrange(2), x := rng.randrange(40), y := rng.randrange(6), x + rng.randrange(8), y + rng.randrange(3)) for _ in range(12)] + [(0, 9, 3, 5, 3)]
    got = ink.without(ink.united(spark.createDataFrame(spans, "img_id int, y int, a int, b int")), spark.createDataFrame(masks, "img_id int, x1 int, y1 int, x2 int, y2 int")).collect()
    want = {(i, y, x) for i, y, a, b in spans for x in range(a, b + 1) if not any(m[0] == i and m[2] <= y <= m[4] and m[1] <= x <= m[3] for m in masks)}
    found = [(r.img_id, r.y, x) for r in got for x in range(r.a, r.b + 1)]
    assert len(found) == len(set(found)) and set(found) == want
    assert not any((r.img_id, r.y, r.b + 1) in want for r in got)  # runs are as long as can be


@pytest.mark.parametrize("block", [3, 9, 31])
def test_adaptive_ink(spark, block):
    rng = np.random.default_rng(block)
    pictures = [rng.integers(0, 256, (12, 40)), np.full((3, 1), 200), np.zeros((1, 1), int)]
    r = block // 2
    for row in ink.adaptive_ink(rows(spark, pictures), block).collect():
        around = pictures[row.img_id][max(0, row.y - r) : row.y + r + 1, max(0, row.x - r) : row.x + r + 1]
        assert (row.n, row.total) == (around.size, around.sum()) and row.ink == (row.v + ink.DARKER < around.mean())


def test_lines_are_found(spark):
    rng = random.Random(5)
    drawn = [(0, y, 30) for y in range(60)] + [(1, k, k) for k in range(60)] + [(2, k // 2, k) for k in range(60)]
    noise = [(i, rng.randrange(60), rng.randrange(60)) for i in range(3) for _ in range(60)]
    found = {}
    for r in ink.lines(spark.createDataFrame(list(set(drawn + noise)), INK), 30).collect():
        found.setdefault(r.img_id, []).append(r)
    best = {i: max(some, key=lambda r: r.votes) for i, some in found.items()}
    assert (best[0].angle, best[0].distance) == (0, 30)
    assert abs(best[1].angle - 135) <= 1 and abs(best[1].distance) <= 1 and abs(best[2].angle - 117) <= 2
    told = {r.angle: r.c for r in spark.createDataFrame([(a,) for a in (0, 60, 90, 135, 150, 179)], "angle int").select("angle", ink.is_check(F.col("angle")).alias("c")).collect()}
    assert told == {0: False, 60: True, 90: False, 135: True, 150: True, 179: False}


def test_scores_of_choices(spark):
    choice = spark.createDataFrame([(1, True, False, False), (1, False, False, True), (2, True, True, False)], "n int, ink boolean, outline boolean, stroke boolean")
    got = {r.n: r.score for r in ink.mark_score(choice, ["n"], "ink", F.col("outline"), F.col("stroke")).collect()}
    assert got == {1: pytest.approx(0.5 + ink.W_STROKE), 2: pytest.approx(1 + ink.W_OUTLINE)}


def test_distances_to_edges(spark):
    rng = np.random.default_rng(3)
    pictures = [rng.random((14, 17)) < p for p in (0.5, 0.9, 0.99)] + [np.ones((2, 3), bool), np.zeros((2, 2), bool)]
    df = rows(spark, pictures).withColumn("ink", F.col("v") == 1)
    found = ink.edge_distances(df)
    got = {(r.img_id, r.y, r.x): r.d2 for r in found.collect()}
    want = {}
    for i, p in enumerate(pictures):
        free = np.argwhere(~p)
        for y, x in np.argwhere(p):
            want[i, int(y), int(x)] = int(((free - (y, x)) ** 2).sum(1).min()) if len(free) else None
    assert got == want
    spread = {r.img_id: r.spread for r in ink.stroke_spread(found, ["img_id"]).collect()}
    for i in range(3):
        assert spread[i] == pytest.approx(np.std([math.sqrt(d) for (j, _, _), d in want.items() if j == i]))
    assert spread[3] == 0 and 4 not in spread


def plain_scores(p):
    """blur and page share by loops."""
    h, w = p.shape
    at = lambda q, y, x: int(q[_mirror(y, h), _mirror(x, w)])
    lap = [at(p, y - 1, x) + at(p, y + 1, x) + at(p, y, x - 1) + at(p, y, x + 1) - 4 * at(p, y, x) for y in range(h) for x in range(w)]
    k = (1, 4, 6, 4, 1)
    s = [[(sum(a * b * at(p, y + i - 2, x + j - 2) for i, a in enumerate(k) for j, b in enumerate(k)) + 128) // 256 for x in range(w)] for y in range(h)]
    flat = sorted(v for row in s for v in row)
    best, t = -1.0, None
    for v in sorted(set(flat))[:-1]:
        low, high = [x for x in flat if x <= v], [x for x in flat if x > v]
        between = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
        if between > best * (1 + 1e-12):
            best, t = between, v
    return np.var(lap), float(np.mean([v > t for v in flat])) if t is not None else float(flat[0] > 0)


def _mirror(k, n):
    return -k if k < 0 else 2 * n - 2 - k if k >= n else k


def test_capture_scores(spark):
    rng = np.random.default_rng(8)
    pictures = [rng.integers(0, 256, (9, 11)), rng.integers(100, 110, (5, 5)), np.full((4, 4), 7), np.zeros((3, 3), int)]
    got = {r.img_id: (r.blur, r.page) for r in capture.scores(rows(spark, pictures)).collect()}
    for i, p in enumerate(pictures):
        assert got[i] == (pytest.approx(plain_scores(p)[0]), pytest.approx(plain_scores(p)[1]))
    tiny = {r.img_id for r in capture.scores(rows(spark, [np.full((1, 1), 9), np.full((1, 2), 9), np.full((2, 1), 9)])).collect()}
    assert tiny == {0, 1, 2}
    told = spark.createDataFrame([(1, 59.9, 1.0), (2, 60.0, 0.29), (3, 60.0, 0.3)], "img_id int, blur double, page double")
    reasons = {r.k: (r.ok, r.reason) for r in capture.gate(spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "k int"), told, "k").collect()}
    assert reasons == {1: (False, capture.BLURRED), 2: (False, capture.NO_PAGE), 3: (True, capture.FINE), 4: (False, capture.UNREADABLE)}


def test_hulls():
    rng = random.Random(9)
    for n in (1, 2, 3, 4, 9, 40):
        for wide in (2, 6, 50):
            points = sorted({(rng.randrange(wide), rng.randrange(wide)) for _ in range(n)})
            ring = capture.hull(points)
            assert set(ring) <= set(points) and len(set(ring)) == len(ring)
            if len(ring) > 2:
                for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                    assert all(capture._turn(a, b, p) >= 0 for p in points)
                assert all(capture._turn(a, b, c) > 0 for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True))
    square = [(0, 0), (50, 1), (100, 0), (100, 100), (0, 100)]
    assert set(capture.simplified(square, 2)) == {(0, 0), (100, 0), (100, 100), (0, 100)} and set(capture.simplified(square, 0.5)) == set(square)


def test_page_corners(spark):
    def quad(points, shape=(90, 80), extra=None):
        y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
        inside = np.ones(shape, bool)
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
        out = np.where(inside, 230, 40)
        if extra is not None:
            out[extra] = 230
        return out

    tilted = [(15, 8), (70, 14), (64, 80), (8, 74)]
    y, x = np.mgrid[0:90, 0:80]
    round_ = np.where((x - 40) ** 2 + (y - 45) ** 2 < 38**2, 230, 40)
    pictures = [quad(tilted), quad(tilted, extra=np.s_[84:90, 70:80]), quad([(30, 30), (50, 30), (50, 50), (30, 50)]), round_]
    got = {r.img_id: [(c.x, c.y) for c in r.corners] for r in capture.page_corners(rows(spark, pictures)).collect()}
    assert set(got) == {0, 1}
    for i in (0, 1):
        assert max(math.dist(a, b) for a, b in zip(got[i], tilted, strict=True)) <= 3


def test_straightened(spark):
    picture = np.zeros((60, 60, 3), np.uint8)
    picture[5:55, 10:50] = 255
    schema = "path string, image struct<height:int,width:int,nChannels:int,data:binary>"
    df = spark.createDataFrame([("a", (60, 60, 3, bytearray(picture.tobytes()))), ("b", (-1, -1, 0, bytearray()))], schema)
    got = vision.straightened(df).collect()
    assert [r.path for r in got] == ["a"] and abs(got[0].height - 50) < 5 and abs(got[0].width - 40) < 5 and len(got[0].gray) * 3 == len(got[0].colour)
    plain = vision.straightened(df, spark.createDataFrame([], "img_id string, corners array<struct<x:long,y:long>>")).first()
    assert (plain.height, plain.width) == (60, 60)


def test_rows_of_a_task(spark, monkeypatch):
    """More runs are more tasks, and overlapping runs need not be united before masks are taken away."""
    monkeypatch.setattr(ink, "SPANS", 5)
    spans = spark.createDataFrame([("p", y, a, a + 6) for y in range(50) for a in (0, 4)], "img_id string, y long, a long, b long")
    masks = spark.createDataFrame([("p", 3, 0, 5, 49)], "img_id string, x1 long, y1 long, x2 long, y2 long")
    left = ink.without(spans, masks)
    assert left.rdd.getNumPartitions() >= 20
    assert {(r.y, r.a, r.b) for r in left.collect()} == {(y, *ab) for y in range(50) for ab in ((0, 2), (6, 10))}


def test_weak_lines_are_left_before_neighbours_are_met(spark):
    """Votes of lines under the least are gone before the window: no row of theirs is multiplied."""
    found = ink.lines(spark.createDataFrame([(1, y, 5) for y in range(9)], INK), 9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (votes#" in plan[plan.index("Generate") :]
    assert (0, 5, 9) in {(r.angle, r.distance, r.votes) for r in found.collect()}
