"""Marks on printed choices and pieces of handwriting, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import HOLD, RIGHT, WRONG
from ..sources.shared import kept, tasks

# Least spread of scores, z of a mark, gap to the runner-up, space between pieces, least side and confidence.
FLOOR, MARK, GAP, NEAR, SIDE, SURE = 0.02, 2.5, 1.0, 30, 12, 0.5
# Samples of a template, darker steps that count as ink, padding and confidence of a print mask.
SAMPLES, DARKER, MASK_PAD, PRINTED = 5, 40, 4, 0.75
# Printed choice markers.
CIRCLED, BRACKETED = "①②③④⑤⑥⑦⑧⑨⑩", r"\(?[1-9]\)"
#: Questions, and rectangles, that a task works on.
QUESTIONS, RECTS = 50_000, 500_000
# Names of symbols.
SYMBOLS = {"pi": "π"}


def _middle_without(values: Column, n: Column, place: Column) -> Column:
    """Median of a sorted array of n values without the one at place (from 0)."""
    at = lambda k: F.get(values, k + F.when(k >= place, 1).otherwise(0))
    low, high = F.floor((n - 2) / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return (at(low) + at(high)) / 2


def robust_z(scores: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """keys, item, score, z: distance from the median of the others, in their median absolute deviations (FLOOR at least).

    A group is the choices of one question, gathered once and sorted; the medians of the others follow from places. An item
    without others, or without a score, has no row.
    """
    some = F.collect_list(F.struct(F.col(score).alias("s"), F.col(item).alias("i")))
    group = scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.sort_array(some).alias("_items"))
    each = group.where(F.size("_items") > 1).select(*keys, F.col("_items.s").cast("array<double>").alias("_all"), F.size("_items").alias("_n"), F.posexplode("_items").alias("_k", "_x"))
    told = each.withColumn("_m", _middle_without(F.col("_all"), F.col("_n"), F.col("_k")))
    off = told.withColumn("_off", F.sort_array(F.transform("_all", lambda x: F.abs(x - F.col("_m")))))
    own = (F.array_position("_off", F.abs(F.col("_x.s").cast("double") - F.col("_m"))) - 1).cast("int")
    spread = off.withColumn("_own", own).withColumn("_d", _middle_without(F.col("_off"), F.col("_n"), F.col("_own")))
    z = (F.col("_x.s") - F.col("_m")) / F.greatest("_d", F.lit(FLOOR))
    return spread.select(*keys, F.col("_x.i").alias(item), F.col("_x.s").alias(score), z.alias("z"))


def marked_choices(z: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, marked (sorted items with z of MARK or more), top, gap (z of the first less that of the second)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("z"), item)
    ranked = z.withColumn("_k", F.row_number().over(order))
    first, second = (F.max(F.when(F.col("_k") == k, F.col("z"))) for k in (1, 2))
    return ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("z") >= MARK, F.col(item)))).alias("marked"), F.min_by(item, "_k").alias("top"), (first - second).alias("gap")
    )


def mark_verdict(marked: Column, gap: Column, answer: Column, stray: Column) -> Column:
    """verdict, student_answer and detail: several marks only count against a key of several answers; one needs a gap."""
    n = F.size(marked)
    said = F.array_join(marked.cast("array<string>"), ",")
    right = F.when(marked == F.array_sort(answer), F.lit(RIGHT)).otherwise(F.lit(WRONG))
    made = lambda v, s, d: F.struct(v.alias("verdict"), s.alias("student_answer"), F.lit(d).alias("detail"))
    hold, none = F.lit(HOLD), F.lit("")
    return (
        F.when((n >= 2) & (F.size(answer) >= 2), made(right, said, "several marks"))
        .when(n >= 2, made(hold, none, "more than one mark"))
        .when((n == 1) & (gap < GAP), made(hold, none, "too close to the next"))
        .when(n == 1, made(right, said, "mark found"))
        .when(stray, made(hold, none, "a number may be written"))
        .otherwise(made(hold, none, "no mark"))
    )


def marker_spans(text: Column, num_choices: Column) -> Column:
    """Array of (n, from, to): printed choice markers in a text, circled digits or else (1) and 1)."""
    spots = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: F.struct(F.instr(F.lit(CIRCLED), F.substring(text, k, F.lit(1))).alias("n"), (k - 1).alias("from"), k.alias("to")))
    circled = F.filter(spots, lambda s: (s["n"] > 0) & (s["n"] <= num_choices) & (s["to"] <= F.length(text)))
    found = F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(0))
    parts = F.split(text, BRACKETED)

    def place(k: Column) -> Column:
        """Characters before the k-th match, counted from 0."""
        before = F.aggregate(F.slice(parts, 1, k + 1), F.lit(0), lambda n, p: n + F.length(p))
        return before + F.aggregate(F.slice(found, 1, k), F.lit(0), lambda n, p: n + F.length(p))

    indexed = F.transform(found, lambda m, k: F.struct(F.regexp_extract(m, "[1-9]", 0).cast("int").alias("n"), place(k).alias("from"), (place(k) + F.length(m)).alias("to")))
    plain = F.filter(indexed, lambda s: s["n"] <= num_choices)
    return F.when(F.size(circled) > 0, circled).otherwise(plain)


def find_markers(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """img_id, question_no, n, x1, y1, x2, y2: markers in each block (with num_choices), the first of each number."""
    inside = boxes.alias("b").join(blocks.alias("k"), F.expr("b.img_id = k.img_id AND (b.x1 + b.x2) / 2 >= k.x1 AND (b.x1 + b.x2) / 2 < k.x2 AND (b.y1 + b.y2) / 2 >= k.y1 AND (b.y1 + b.y2) / 2 < k.y2"))
    spans = inside.where("b.text <> ''").select("b.img_id", "k.question_no", "b.box_id", "b.text", "b.x1", "b.y1", "b.x2", "b.y2", F.posexplode(marker_spans(F.col("b.text"), F.col("k.num_choices"))).alias("pos", "s"))
    wide = (F.col("x2") - F.col("x1")) / F.greatest(F.lit(1), F.length("text"))
    rects = spans.select("img_id", "question_no", F.col("s.n").alias("n"), "box_id", "pos", (F.col("x1") + wide * F.col("s.from")).alias("x1"), "y1", (F.col("x1") + wide * F.col("s.to")).alias("x2"), "y2")
    return rects.groupBy("img_id", "question_no", "n").agg(F.min_by(F.struct("x1", "y1", "x2", "y2"), F.struct("box_id", "pos")).alias("r")).select("img_id", "question_no", "n", "r.x1", "r.y1", "r.x2", "r.y2")


def _middle(values: Column) -> Column:
    """Median of an array that is not empty."""
    v = F.sort_array(values)
    return (F.get(v, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(values) / 2).cast("int"))) / 2


def extrapolate_markers(markers: DataFrame, choices: DataFrame) -> DataFrame:
    """Markers (img_id, question_no, n, x1..y2) with missing numbers put on the grid that fits best.

    choices: img_id, question_no, num_choices. For each number of columns, column and row fit the
    centres in straight lines; the residue may be a marker's height at most. A question is one row with an array of its
    markers, so both tables are shuffled once and the fits are not.
    """
    keys, sides = ["img_id", "question_no"], ("x1", "y1", "x2", "y2")
    kind = dict(markers.dtypes)["n"]
    marker = F.struct("n", *(F.col(c).cast("double").alias(c) for c in sides))
    asked = F.lit(None).cast(dict(choices.dtypes)["num_choices"])
    rows = markers.select(*keys, marker.alias("m"), asked.alias("num_choices")).unionByName(choices.select(*keys, "num_choices"), allowMissingColumns=True)
    each = rows.repartition(tasks(choices, QUESTIONS), *keys).groupBy(*keys).agg(F.collect_list("m").alias("_ms"), F.max("num_choices").alias("_num"))

    numbers = F.when((F.col("_num") >= 1) & (F.size("_ms") > 0), F.sequence(F.lit(1), F.col("_num").cast("int")))
    need = F.filter(numbers, lambda n: ~F.exists("_ms", lambda m: m["n"] == n))
    spot = lambda n, cols: (((n - 1) % cols).cast("double").alias("c"), F.floor((n - 1) / cols).cast("double").alias("r"))
    point = lambda m, cols: F.struct(*spot(m["n"], cols), ((m["x1"] + m["x2"]) / 2).alias("x"), ((m["y1"] + m["y2"]) / 2).alias("y"))
    mean = lambda p, a: F.aggregate(p, F.lit(0.0), lambda t, q: t + q[a]) / F.size(p)
    product = lambda g, a, b: F.aggregate(g["p"], F.lit(0.0), lambda t, q: t + (q[a] - g[f"m{a}"]) * (q[b] - g[f"m{b}"]))
    placed = F.transform(numbers, lambda cols: F.struct(cols.alias("cols"), F.transform("_ms", lambda m: point(m, cols)).alias("p")))
    centred = F.transform(placed, lambda g: F.struct(g["cols"].alias("cols"), g["p"].alias("p"), *(mean(g["p"], a).alias(f"m{a}") for a in "crxy")))
    summed = F.transform(centred, lambda g: F.struct(g.alias("g"), product(g, "c", "c").alias("cc"), product(g, "c", "x").alias("cx"), product(g, "r", "r").alias("rr"), product(g, "r", "y").alias("ry")))

    def line(s: Column, x: str, y: str) -> tuple[Column, Column]:
        """Slope and start of y along x; flat where all stand at one x."""
        g, flat = s["g"], s[x + x] == 0
        slope = F.when(flat, 0.0).otherwise(s[x + y] / s[x + x])
        return slope.alias(f"a{y}"), F.when(flat, _middle(F.transform(g["p"], lambda q: q[y]))).otherwise(g[f"m{y}"] - slope * g[f"m{x}"]).alias(f"b{y}")

    fitted = F.transform(summed, lambda s: F.struct(s["g"]["cols"].alias("cols"), s["g"]["p"].alias("p"), *line(s, "c", "x"), *line(s, "r", "y"), (s["cc"] == 0).alias("one_c"), (s["rr"] == 0).alias("one_r")))
    away = lambda f, q: F.greatest(F.abs(f["ax"] * q["c"] + f["bx"] - q["x"]), F.abs(f["ay"] * q["r"] + f["by"] - q["y"]))
    # what is equal but for rounding is a tie
    told = lambda f: F.struct(F.round(F.array_max(F.transform(f["p"], lambda q: away(f, q))), 9).alias("residue"), *(f[c].alias(c) for c in ("cols", "ax", "bx", "ay", "by")))

    def reached(f: Column, n: Column) -> Column:
        """A lone column or row says nothing of others."""
        c, r = spot(n, f["cols"])
        return (~f["one_c"] | (c == f["p"][0]["c"])) & (~f["one_r"] | (r == f["p"][0]["r"]))

    usable = F.filter(F.col("_fits"), lambda f: F.forall("_need", lambda n: reached(f, n)))
    best = F.array_min(F.filter(F.transform(usable, told), lambda t: t["residue"] <= F.col("_h")))
    rows = each.select(*keys, "_ms", need.alias("_need"), fitted.alias("_fits"), *(F.when(F.size("_ms") > 0, _middle(F.transform("_ms", lambda m: m[b] - m[a]))).alias(f"_{c}") for c, a, b in (("w", "x1", "x2"), ("h", "y1", "y2"))))
    rows = rows.withColumn("_best", F.when(F.size("_need") > 0, best))

    def made(n: Column) -> Column:
        (c, r), t = spot(n, F.col("_best.cols")), F.col("_best")
        x, y, w, h = t["ax"] * c + t["bx"], t["ay"] * r + t["by"], F.col("_w") / 2, F.col("_h") / 2
        return F.struct(n.cast(kind).alias("n"), (x - w).alias("x1"), (y - h).alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))

    every = F.when(F.col("_best").isNotNull(), F.concat("_ms", F.transform("_need", made))).otherwise(F.col("_ms"))
    return rows.select(*keys, F.explode(every).alias("m")).select(*keys, "m.*")


def assemble(detections: DataFrame, keys: list[str], x: str, label: str, conf: str) -> DataFrame:
    """keys, text (labels by x, names of symbols as symbols), conf (the least)."""
    symbol = F.coalesce(F.create_map(*(F.lit(s) for kv in SYMBOLS.items() for s in kv))[F.col(label)], F.col(label))
    listed = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), symbol.alias("s")))).alias("l"), F.coalesce(F.min(conf), F.lit(0.0)).alias("conf"))
    return listed.select(*keys, F.array_join(F.col("l.s"), "").alias("text"), "conf")


def reviewed(text: Column, conf: Column, want: Column) -> Column:
    """Verdict of an assembled text: HOLD if empty or less sure than SURE."""
    return F.when((text == "") | (conf < SURE), F.lit(HOLD)).when(text == want, F.lit(RIGHT)).otherwise(F.lit(WRONG))


def char_accuracy(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """exact (share of equal texts), chars (equal characters at the same place, over the longer lengths)."""
    letters = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    same = F.aggregate(F.zip_with(letters(truth), letters(guess), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, k: n + F.coalesce(k, F.lit(0)))
    return pairs.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("exact"), (F.sum(same) / F.sum(F.greatest(F.length(truth), F.length(guess)))).alias("chars"))


def ink_box(pixels: DataFrame, keys: list[str], pad: int = 30, least: int = 50) -> DataFrame:
    """keys, x1, y1, x2, y2: between the 2nd and 98th percentile of ink pixels (x, y), padded; none for less than least pixels."""
    edge = lambda c, p: F.percentile(c, F.lit(p)).cast("int")
    cut = pixels.groupBy(*keys).agg(F.count("*").alias("n"), edge("x", 0.02).alias("a"), edge("y", 0.02).alias("b"), edge("x", 0.98).alias("c"), edge("y", 0.98).alias("d"))
    return cut.where(F.col("n") >= least).select(*keys, F.greatest(F.lit(0), F.col("a") - pad).alias("x1"), F.greatest(F.lit(0), F.col("b") - pad).alias("y1"), (F.col("c") + pad).alias("x2"), (F.col("d") + pad).alias("y2"))


def merge_spans(spans: DataFrame, keys: list[str], near: int = NEAR) -> DataFrame:
    """keys, a, b: spans whose gap is near at most become one, to the last."""
    before = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_new", F.when(F.col("a") <= F.max("b").over(before) + near, 0).otherwise(1))
    order = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_g", F.sum("_new").over(order)).groupBy(*keys, "_g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_g")


def _islands(rects: DataFrame, by: list[str], low: str, high: str, near: int, name: str) -> DataFrame:
    """rects with name: the number of its island along one direction; between islands the gap is more than near."""
    order = Window.partitionBy(*by).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rects.withColumn(name, F.when(F.col(low) <= before + near, 0).otherwise(1))
    return marked.withColumn(name, F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def merge_rects(rects: DataFrame, keys: list[str], near: int = NEAR) -> DataFrame:
    """keys, x1, y1, x2, y2: rectangles that are near each other in both directions become their hull, until none are.

    A group falls into islands, by rows, columns, rows and columns again, which nothing merges across. Where all of an island are near each other in
    height they are one hull, as columns leave no gap between them; only the rest are compared.
    """
    sides, own = ("x1", "y1", "x2", "y2"), ["_i1", "_i2", "_i3", "_i4"]
    now = rects.select(*keys, *sides).repartition(tasks(rects, RECTS), *keys).distinct()
    for k, name in enumerate(own):
        now = _islands(now, [*keys, *own[:k]], *(("y1", "y2") if k % 2 == 0 else ("x1", "x2")), near, name)
    island = Window.partitionBy(*keys, *own)
    now = now.withColumn("_one", F.max("y1").over(island) - near <= F.min("y2").over(island))
    done = now.where("_one").groupBy(*keys, *own).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    rest = kept(now.where("NOT _one").drop("_one"))
    if rest.isEmpty():
        return done.drop(*own)
    return done.unionByName(_merged(rest, [*keys, *own], near)).drop(*own)


def _merged(rects: DataFrame, keys: list[str], near: int = NEAR) -> DataFrame:
    """keys, x1, y1, x2, y2, by rounds.

    Only rectangles that touch the same cell of a grid, as wide as the largest of the group, are compared.
    """
    sides = ("x1", "y1", "x2", "y2")
    now = rects.select(*keys, *sides).distinct()
    while True:
        now = kept(now)
        wide = now.groupBy(*keys).agg(F.greatest(F.lit(near), F.max(F.col("x2") - F.col("x1")), F.max(F.col("y2") - F.col("y1"))).alias("_w"))
        touched = lambda a, b, pad: F.sequence(F.floor((F.col(a) - pad) / F.col("_w")), F.floor((F.col(b) + pad) / F.col("_w")))
        cells = lambda df, pad: df.join(wide, keys).withColumn("_cx", F.explode(touched("x1", "x2", pad))).withColumn("_cy", F.explode(touched("y1", "y2", pad))).drop("_w")
        other = cells(now, 0).select(*keys, "_cx", "_cy", *(F.col(c).alias(f"o{c}") for c in sides))
        close = (F.col("x1") - near <= F.col("ox2")) & (F.col("ox1") - near <= F.col("x2")) & (F.col("y1") - near <= F.col("oy2")) & (F.col("oy1") - near <= F.col("y2"))
        met = cells(now, near).join(other, [*keys, "_cx", "_cy"]).where(close)
        hull = met.groupBy(*keys, *sides).agg(F.min("ox1").alias("a"), F.min("oy1").alias("b"), F.max("ox2").alias("c"), F.max("oy2").alias("d"))
        grown = hull.select(*keys, *(F.col(x).alias(y) for x, y in zip("abcd", sides, strict=True)), (F.struct(*"abcd") != F.struct(*sides)).alias("_grew"))
        more = grown.where("_grew").limit(1).count() > 0
        if not more:
            return now
        now = grown.drop("_grew").distinct()


def answer_area(rects: DataFrame, keys: list[str], least: int = SIDE) -> DataFrame:
    """keys, x1, y1, x2, y2: hull of all merged pieces with sides of least or more."""
    big = rects.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))
    return big.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def yolo_boxes(boxes: DataFrame) -> DataFrame:
    """label_line of boxes (class_id, x1, y1, x2, y2, w, h): class, centre and size as shares of the picture."""
    parts = [F.col("class_id"), (F.col("x1") + F.col("x2")) / 2 / F.col("w"), (F.col("y1") + F.col("y2")) / 2 / F.col("h"), (F.col("x2") - F.col("x1")) / F.col("w"), (F.col("y2") - F.col("y1")) / F.col("h")]
    return boxes.select("*", F.format_string("%d %.6f %.6f %.6f %.6f", *parts).alias("label_line"))


def median_template(crops: DataFrame, keys: list[str], least: int = SAMPLES) -> DataFrame:
    """keys, template: the median of each pixel over crops (keys, pixels: arrays of one length); none for fewer crops than least."""
    each = crops.select(*keys, F.posexplode("pixels").alias("_p", "_v"))
    middle = each.groupBy(*keys, "_p").agg(F.median("_v").alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return middle.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_m")))["_m"].alias("template"))


def extra_ink(pixels: Column, template: Column) -> Column:
    """Share of the pixels that are darker than the template by more than DARKER; 0 without a template."""
    darker = F.filter(F.zip_with(template, pixels, lambda t, p: t - p), lambda d: d > DARKER)
    return F.when(template.isNotNull() & (F.size(pixels) > 0), F.size(darker) / F.size(pixels)).otherwise(F.lit(0.0))


def print_masks(boxes: DataFrame) -> DataFrame:
    """Padded rectangles of boxes that are sure enough to be print."""
    return boxes.where(F.col("conf") >= PRINTED).select("img_id", "box_id", (F.col("x1") - MASK_PAD).alias("x1"), (F.col("y1") - MASK_PAD).alias("y1"), (F.col("x2") + MASK_PAD).alias("x2"), (F.col("y2") + MASK_PAD).alias("y2"))


def repeat_agreement(reads: DataFrame, expected: DataFrame, by: str = "name") -> DataFrame:
    """For repeated reads (name, answer, seconds) of crops and what is expected: one row.

    crops, repeated_alike (crops whose reads are all the same), matches (reads that are as expected, spaces
    left out), reads, mean_seconds, max_seconds. expected: by, want, by a file's name or its stem; the name goes first.
    """
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    told = with_expected(reads, expected, by)
    crop = told.groupBy("name").agg(
        (F.count_distinct(F.coalesce("answer", F.lit(""))) == 1).cast("long").alias("alike"), F.count_if(F.col("want").isNotNull() & (plain(F.col("answer")) == plain(F.col("want")))).alias("matches"),
        F.count("*").alias("n"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"),
    )
    return crop.agg(
        F.count("*").alias("crops"), F.coalesce(F.sum("alike"), F.lit(0)).alias("repeated_alike"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.coalesce(F.sum("n"), F.lit(0)).alias("reads"),
        (F.sum("seconds") / F.sum("n")).alias("mean_seconds"), F.max("longest").alias("max_seconds"),
    )


def stem(path: Column) -> Column:
    """A file's name without folders and its last ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def with_expected(crops: DataFrame, expected: DataFrame, by: str = "name") -> DataFrame:
    """crops (name) with want: what is expected (by, want) of the file's name, or else of its stem."""
    known = expected.select(F.col(by).alias("_by"), "want")
    named = crops.join(known.withColumnsRenamed({"_by": "_full", "want": "_of_name"}), crops["name"] == F.col("_full"), "left")
    both = named.join(known.withColumnsRenamed({"_by": "_stem", "want": "_of_stem"}), stem(crops["name"]) == F.col("_stem"), "left")
    return both.select(*(crops[c] for c in crops.columns), F.coalesce("_of_name", "_of_stem").alias("want"))


def paired(truths: DataFrame, guesses: DataFrame, path: str = "path") -> DataFrame:
    """stem, truth, guess: what files of two folders (path, text) with the same stem say; files without a partner are left out."""
    said = lambda df, name: df.select(stem(F.col(path)).alias("stem"), F.col("text").alias(name))
    return said(truths, "truth").join(said(guesses, "guess"), "stem")
