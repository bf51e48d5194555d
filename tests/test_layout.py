from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagemark.operators import layout, marks

BOXES = [("1.", 60, 100, 40), ("text of it", 110, 100, 250), ("3", 200, 160, 40), ("2.", 60, 600, 40), ("[3]", 380, 600, 40), ("3.", 620, 100, 40), ("4.", 620, 700, 40), ("1)", 750, 200, 40), ("12", 80, 1350, 40)]
SCHEMA = "img_id string, box_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([("p", i, t, 0.95, float(x), float(y), float(x + w), float(y + 20)) for i, (t, x, y, w) in enumerate(rows)], SCHEMA)


def analysed(spark, rows, numbers=("1", "2", "3", "4"), page="12", hint=None):
    dims = spark.createDataFrame([("p", 1400, 1000)], "img_id string, img_h int, img_w int")
    key = spark.createDataFrame([("b", page, i, q) for i, q in enumerate(numbers)], "book_key string, page string, ord int, question_no string")
    asked = spark.createDataFrame([("p", "B", hint)], "img_id string, book string, page_hint string")
    blocks, holds = layout.analyze_layout(boxes(spark, rows), dims, key, asked)
    h = holds.first()
    return (h.page_no, h.hold_reason), {r.question_no: (r.x1, r.y1, r.x2, r.y2) for r in blocks.collect()}


FULL = {"1": (0, 100, 519, 600), "2": (0, 600, 519, 1400), "3": (519, 100, 1000, 700), "4": (519, 700, 1000, 1400)}


def changed(old, new):
    return [(new if t == old else t, *rest) for t, *rest in BOXES]


@pytest.mark.parametrize(
    ("rows", "page", "expected"),
    [
        (BOXES, "12", (("12", ""), FULL)),
        (BOXES, "99", (("", layout.NO_PAGE), {})),
        ([b for b in BOXES if b[0] != "2."], "12", (("12", layout.MISMATCH), {})),
        ([*BOXES, ("9.", 60, 900, 40)], "12", (("12", ""), FULL)),
        (changed("2.", "8."), "12", (("12", ""), FULL)),
        ([b for b in BOXES if b[0] == "12"], "12", (("12", layout.MISMATCH), {})),
    ],
)
def test_pages(spark, rows, page, expected):
    assert analysed(spark, rows, page=page) == expected


def test_one_stray_anchor_mends_one_gap_only(spark):
    rows = [("1.", 60, 100, 40), ("8.", 60, 600, 40), ("4.", 60, 900, 40), ("12", 80, 1350, 40)]
    assert analysed(spark, rows) == (("12", layout.MISMATCH), {})


def test_hint_is_trusted(spark):
    assert analysed(spark, BOXES, hint="12")[1] == FULL
    assert analysed(spark, BOXES, hint="77") == (("77", layout.UNKNOWN_PAGE), {})


def slow_chain(items):
    best = []
    for i, e in items:
        before = []
        for chain in best:
            if chain[-1][1] < e and len(chain) > len(before):
                before = chain
        best.append([*before, (i, e)])
    return max(best, key=len) if best else []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=9), min_size=1, max_size=6))
def test_chains(spark, groups):
    rows = [(g, i, e) for g, values in enumerate(groups) for i, e in enumerate(values)]
    got: dict = {}
    for r in layout.match_in_order(spark.createDataFrame(rows, "g int, i int, e int"), ["g"]).collect():
        got.setdefault(r.g, []).append((r.i, r.e))
    assert {g: sorted(v) for g, v in got.items()} == {g: slow_chain(list(enumerate(v))) for g, v in enumerate(groups)}


def test_marks(spark):
    z = marks.robust_z(spark.createDataFrame([("q", i, s) for i, s in enumerate([0.1, 0.1, 0.9, 0.1, 0.12], 1)], "q string, n int, s double"), ["q"], "n", "s")
    got = {r.n: r.z for r in z.collect()}
    assert got[3] == pytest.approx((0.9 - 0.1) / 0.02) and got[1] == pytest.approx((0.1 - 0.11) / 0.02)
    row = marks.marked_choices(z, ["q"], "n").first()
    assert row.marked == [3] and row.top == 3 and row.gap > 1


@pytest.mark.parametrize(
    ("marked", "gap", "answer", "stray", "expected"),
    [([3], 9.0, [3], False, "O"), ([3], 0.9, [3], False, "HOLD"), ([2, 3], 5.0, [3], False, "HOLD"), ([2, 3], 5.0, [3, 2], False, "O"), ([3], 1.0, [2], False, "X"), ([], 0.0, [2], True, "HOLD")],
)
def test_mark_verdicts(spark, marked, gap, answer, stray, expected):
    df = spark.createDataFrame([(marked, gap, answer, stray)], "m array<int>, g double, a array<int>, s boolean")
    assert df.select(marks.mark_verdict(df.m, df.g, df.a, df.s).alias("v")).first().v.verdict == expected


@pytest.mark.parametrize(("text", "spans"), [("① 3x+1", [(1, 0, 1)]), ("(3)", [(3, 0, 3)]), ("5)", [(5, 0, 2)]), ("[3점]", []), ("a (2) b 4)", [(2, 2, 5), (4, 8, 10)]), ("", [])])
def test_marker_spans(spark, text, spans):
    df = spark.createDataFrame([(text, 5)], "t string, n int")
    assert [tuple(x) for x in df.select(marks.marker_spans(df.t, df.n).alias("s")).first().s] == spans


def test_markers_on_a_grid(spark):
    rows = [("p", "1", n, 100.0 * n, 10.0, 100.0 * n + 10, 20.0) for n in (1, 2, 4, 5)]
    markers = spark.createDataFrame(rows, "img_id string, question_no string, n int, x1 double, y1 double, x2 double, y2 double")
    choices = spark.createDataFrame([("p", "1", 5)], "img_id string, question_no string, num_choices int")
    got = {r.n: (r.x1, r.y1) for r in marks.extrapolate_markers(markers, choices).collect()}
    assert got[3] == pytest.approx((300.0, 10.0)) and len(got) == 5


def test_assembly_and_rectangles(spark):
    df = spark.createDataFrame([("a", 50, "5", 0.9), ("a", 10, "2", 0.8), ("a", 30, "/", 0.6), ("b", 1, "pi", 0.9)], "k string, x int, s string, c double")
    assert {r.k: (r.text, r.conf) for r in marks.assemble(df, ["k"], "x", "s", "c").collect()} == {"a": ("2/5", 0.6), "b": ("π", 0.9)}
    rects = spark.createDataFrame([("a", 0, 0, 10, 10), ("a", 35, 0, 60, 10), ("a", 85, 5, 90, 10), ("a", 500, 500, 505, 530)], "k string, x1 int, y1 int, x2 int, y2 int")
    merged = marks.merge_rects(rects, ["k"])
    assert sorted(tuple(r)[1:] for r in merged.collect()) == [(0, 0, 90, 10), (500, 500, 505, 530)]
    assert tuple(marks.answer_area(rects, ["k"], 5).first())[1:] == (0, 0, 505, 530)


def test_templates(spark):
    crops = spark.createDataFrame([("a", [200, 200 - 10 * i, 0 if i == 4 else 200]) for i in range(5)] + [("b", [1, 2, 3])], "k string, pixels array<int>")
    template = marks.median_template(crops, ["k"])
    assert [(r.k, r.template) for r in template.collect()] == [("a", [200.0, 180.0, 200.0])]
    shares = crops.join(template, "k", "left").select("k", marks.extra_ink(crops.pixels, template.template).alias("s"))
    assert sorted(round(r.s, 3) for r in shares.collect()) == [0.0, 0.0, 0.0, 0.0, 0.0, 0.333]


def test_print_masks(spark):
    df = spark.createDataFrame([("p", 0, "a", 0.75, 10.0, 10.0, 20.0, 20.0), ("p", 1, "b", 0.74, 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    assert [tuple(r) for r in marks.print_masks(df).collect()] == [("p", 0, 6.0, 6.0, 24.0, 24.0)]


def test_pages_of_a_book_for_all_its_images(spark):
    """The pages are those of a book, named once, not once for each image."""
    rows = [(f"p{i}", 0, f"{i} | unit", 0.9, 10.0, 1300.0, 50.0, 1320.0) for i in range(6)]
    dims = spark.createDataFrame([(f"p{i}", "ab"[i % 2], 1400, 1000) for i in range(6)], "img_id string, book_key string, img_h int, img_w int")
    pages = spark.createDataFrame([("a", "0"), ("a", "4"), ("b", "1"), ("b", "2")], "book_key string, page string")
    got = {(r.img_id, r.page_no) for r in layout.read_page_number(spark.createDataFrame(rows, SCHEMA), dims, pages).collect()}
    assert got == {("p0", "0"), ("p4", "4"), ("p1", "1")}


def test_images_of_a_task(spark, monkeypatch):
    """More images are more tasks, each of as many images, and no image is lost."""
    monkeypatch.setattr(layout, "IMAGES", 5)
    rows = [(f"p{i}", 0, "7", 0.9, 10.0, 1300.0, 50.0, 1320.0) for i in range(60)] + [(f"p{i}", 1, "1.", 0.9, 60.0, 100.0, 100.0, 120.0) for i in range(60)]
    dims = spark.createDataFrame([(f"p{i}", 1400, 1000) for i in range(60)], "img_id string, img_h int, img_w int")
    key = spark.createDataFrame([("b", "7", 0, "1")], "book_key string, page string, ord int, question_no string")
    asked = spark.createDataFrame([(f"p{i}", "B", None) for i in range(60)], "img_id string, book string, page_hint string")
    blocks, holds = layout.analyze_layout(spark.createDataFrame(rows, SCHEMA), dims, key, asked)
    assert holds.rdd.getNumPartitions() >= 12
    assert {r.hold_reason for r in holds.collect()} == {""} and holds.count() == blocks.count() == 60


def test_marker_grid_moves_each_table_once(spark):
    markers = spark.createDataFrame([("p", "1", n, 100.0 * n, 0.0, 100.0 * n + 20, 10.0) for n in (1, 2, 4)], "img_id string, question_no string, n int, x1 double, y1 double, x2 double, y2 double")
    choices = spark.createDataFrame([("p", "1", 5), ("p", "2", 5)], "img_id string, question_no string, num_choices int")
    made = marks.extrapolate_markers(markers, choices)
    assert {(r.n, r.x1, r.y1) for r in made.collect()} == {(n, 100.0 * n, 0.0) for n in range(1, 6)}
    assert made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


def slow_merge(rects, near):
    rects = set(rects)
    while True:
        for a in rects:
            b = next((b for b in rects if b != a and a[0] - near <= b[2] and b[0] - near <= a[2] and a[1] - near <= b[3] and b[1] - near <= a[3]), None)
            if b:
                rects = rects - {a, b} | {(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))}
                break
        else:
            return rects


def test_rectangles_of_many_shapes(spark):
    import random

    rnd = random.Random(5)
    groups = {g: [(x := rnd.randrange(400), y := rnd.randrange(400), x + rnd.randrange(1, 90), y + rnd.randrange(1, 90)) for _ in range(rnd.randrange(1, 14))] for g in range(60)}
    rows = [(g, *r) for g, rects in groups.items() for r in rects]
    got: dict = {}
    for r in marks.merge_rects(spark.createDataFrame(rows, "k int, x1 int, y1 int, x2 int, y2 int"), ["k"], 8).collect():
        got.setdefault(r.k, set()).add((r.x1, r.y1, r.x2, r.y2))
    assert got == {g: slow_merge(rects, 8) for g, rects in groups.items()}


def test_rows_of_rectangles_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(marks, "_merged", None)
    rects = spark.createDataFrame([("p", x, 1000 * b, x + 20, 1000 * b + 40) for x in (0, 40, 300) for b in (0, 1)], "k string, x1 int, y1 int, x2 int, y2 int")
    assert {(r.x1, r.y1, r.x2, r.y2) for r in marks.merge_rects(rects, ["k"]).collect()} == {(0, 0, 60, 40), (0, 1000, 60, 1040), (300, 0, 320, 40), (300, 1000, 320, 1040)}
