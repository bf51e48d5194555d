"""Driver queries for marks, markers, templates, rectangles and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import marks
from ..sources import labels
from .registry import own_folder, query, table

_LINES = "SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CAST(round(l_tax * 100) AS INT) AS t, l_suppkey AS s, l_partkey AS p FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, i, t, s, p: an order's lines, numbered."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("k"), F.row_number().over(order).alias("i"), F.round(F.col("l_tax") * 100).cast("int").alias("t"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))


@query(f"""
WITH l AS ({_LINES}),
s AS (SELECT k, i, CAST(CASE WHEN s % 4 = 0 THEN 4 ELSE t % 2 END AS DOUBLE) / 4 AS z FROM l),
o AS (SELECT a.k, a.i, a.z, b.z AS r FROM s a JOIN s b ON a.k = b.k AND a.i <> b.i),
m AS (SELECT k, i, z, median(r) AS m FROM o GROUP BY 1, 2, 3),
d AS (SELECT o.k, o.i, (o.z - m.m) / greatest(median(abs(o.r - m.m)), 0.02) AS z FROM o JOIN m USING (k, i) GROUP BY o.k, o.i, o.z, m.m),
r AS (SELECT k, i, z, row_number() OVER (PARTITION BY k ORDER BY z DESC, i) AS n FROM d),
g AS (SELECT k, coalesce(list(i ORDER BY i) FILTER (WHERE z >= 2.5), []) AS marked, max(z) FILTER (WHERE n = 1) - max(z) FILTER (WHERE n = 2) AS gap FROM r GROUP BY k),
a AS (SELECT *, CASE WHEN k % 3 = 0 THEN [1, 2] ELSE [1 + k % 3] END AS answer FROM g)
SELECT k, array_to_string(marked, ',') AS marked, round(gap, 6) AS gap,
  CASE WHEN len(marked) >= 2 AND len(answer) >= 2 OR len(marked) = 1 AND gap >= 1 THEN CASE WHEN marked = list_sort(answer) THEN 'O' ELSE 'X' END ELSE 'HOLD' END AS verdict,
  CASE WHEN len(marked) >= 2 AND len(answer) >= 2 THEN 'several marks' WHEN len(marked) >= 2 THEN 'more than one mark' WHEN len(marked) = 1 AND gap < 1 THEN 'too close to the next'
       WHEN len(marked) = 1 THEN 'mark found' WHEN k % 2 = 0 THEN 'a number may be written' ELSE 'no mark' END AS detail
FROM a WHERE gap IS NOT NULL""")
def marked_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by their distance from the other choices, and what they say of an answer."""
    score = F.when(F.col("s") % 4 == 0, 4).otherwise(F.col("t") % 2).cast("double") / 4
    z = marks.robust_z(_lines(spark, sf_dir).withColumn("score", score), ["k"], "i", "score")
    told = marks.marked_choices(z, ["k"], "i")
    answer = F.when(F.col("k") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array((1 + F.col("k") % 3).cast("int")))
    said = told.withColumn("v", marks.mark_verdict(F.col("marked"), F.col("gap"), answer, F.col("k") % 2 == 0))
    return said.select("k", F.array_join(F.col("marked").cast("array<string>"), ",").alias("marked"), F.round("gap", 6).alias("gap"), "v.verdict", "v.detail")


@query(f"""
WITH l AS ({_LINES}),
x AS (SELECT k, i, n, (s * n + t * 7) % 200 AS v FROM l, unnest([1, 2, 3, 4]) u(n)),
m AS (SELECT k, n, median(v) AS m FROM x GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT x.k, CAST(i AS INT) AS i, round(coalesce(avg(CASE WHEN m.m - v > 40 THEN 1.0 ELSE 0.0 END) FILTER (WHERE m.m IS NOT NULL), 0), 6) AS share FROM x LEFT JOIN m USING (k, n) GROUP BY 1, 2""")
def extra_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink beyond the median of a question's crops, where there are five or more."""
    pixels = F.array(*((F.col("s") * n + F.col("t") * 7) % 200 for n in (1, 2, 3, 4)))
    crops = _lines(spark, sf_dir).select("k", "i", pixels.alias("pixels"))
    both = crops.join(marks.median_template(crops, ["k"]), "k", "left")
    return both.select("k", "i", F.round(marks.extra_ink(F.col("pixels"), F.col("template")), 6).alias("share"))


@query("""
WITH p AS (SELECT CAST(floor(sqrt(l_partkey)) AS BIGINT) AS k, l_suppkey * 7 % 700 AS x, l_orderkey % 900 AS y FROM lineitem),
c AS (SELECT k, count(*) AS n, trunc(quantile_cont(x, 0.02)) AS a, trunc(quantile_cont(y, 0.02)) AS b, trunc(quantile_cont(x, 0.98)) AS c, trunc(quantile_cont(y, 0.98)) AS d FROM p GROUP BY k)
SELECT k, CAST(greatest(0, a - 30) AS INT) AS x1, CAST(greatest(0, b - 30) AS INT) AS y1, CAST(c + 30 AS INT) AS x2, CAST(d + 30 AS INT) AS y2 FROM c WHERE n >= 50""")
def ink_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops between the percentiles of ink."""
    # parts' numbers between squares: the first of these groups has too little ink
    pixels = table(spark, sf_dir, "lineitem").select(F.floor(F.sqrt("l_partkey")).alias("k"), (F.col("l_suppkey") * 7 % 700).alias("x"), (F.col("l_orderkey") % 900).alias("y"))
    return marks.ink_box(pixels, ["k"])


@query("""
SELECT o_orderkey AS img_id, CAST(o_custkey % 1000 - 4 AS DOUBLE) AS x1, CAST(o_custkey % 300 - 4 AS DOUBLE) AS y1, CAST(o_custkey % 1000 + 44 AS DOUBLE) AS x2, CAST(o_custkey % 300 + 24 AS DOUBLE) AS y2
FROM orders WHERE o_orderkey % 8 / 8.0 >= 0.75""")
def print_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of what is surely print."""
    x, y = (F.col("o_custkey") % 1000).cast("double"), (F.col("o_custkey") % 300).cast("double")
    boxes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("img_id"), F.lit(0).alias("box_id"), F.lit("t").alias("text"), (F.col("o_orderkey") % 8 / 8.0).alias("conf"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 20).alias("y2"))
    return marks.print_masks(boxes).drop("box_id")


@query("""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 2 AS INT) AS plain, CAST(o_custkey % 4 + 1 AS INT) AS a, CAST(o_custkey % 3 + 3 AS INT) AS b, o_orderkey % 5 = 0 AS below FROM orders),
m AS (SELECT k, 0 AS box, a AS n, plain, 2 AS spot, 0 AS y FROM o UNION ALL SELECT k, 0, b, plain, CASE plain WHEN 1 THEN 7 ELSE 5 END, 0 FROM o UNION ALL SELECT k, 1, a, plain, 0, 100 FROM o WHERE NOT below),
w AS (SELECT k, n, box, spot, y, CASE plain WHEN 1 THEN 3 ELSE 1 END AS wide, CASE WHEN box = 1 THEN CASE plain WHEN 1 THEN 3 ELSE 1 END ELSE CASE plain WHEN 1 THEN 10 ELSE 6 END END AS len FROM m WHERE n <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY k, n ORDER BY box, spot) AS i FROM w)
SELECT k AS img_id, n, round(10 + 120.0 / len * spot, 6) AS x1, CAST(10 + y AS DOUBLE) AS y1, round(10 + 120.0 / len * (spot + wide), 6) AS x2, CAST(30 + y AS DOUBLE) AS y2 FROM f WHERE i = 1""")
def printed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of printed choice markers in OCR boxes: circled digits or bracketed ones, the first of each number, inside the block."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = (c % 4 + 1).cast("int"), (c % 3 + 3).cast("int")
    circled = lambda n: F.substring(F.lit(marks.CIRCLED), n, F.lit(1))
    bracketed = lambda n: F.concat(F.lit("("), n.cast("string"), F.lit(")"))
    written = lambda n: F.when(k % 2 == 1, bracketed(n)).otherwise(circled(n))
    first = F.concat(F.lit("x "), written(a), F.lit(" y"), written(b))
    spot = F.struct(first.alias("text"), F.lit(0).alias("box_id"), F.lit(10).alias("y")), F.struct(written(a).alias("text"), F.lit(1).alias("box_id"), F.when(k % 5 == 0, 910).otherwise(110).alias("y"))
    rows = table(spark, sf_dir, "orders").select(k.alias("img_id"), F.explode(F.array(*spot)).alias("b")).select("img_id", "b.*")
    boxes = rows.select("img_id", "box_id", "text", F.lit(0.9).alias("conf"), F.lit(10.0).alias("x1"), F.col("y").cast("double").alias("y1"), F.lit(130.0).alias("x2"), (F.col("y") + 20).cast("double").alias("y2"))
    blocks = table(spark, sf_dir, "orders").select(k.alias("img_id"), F.lit("1").alias("question_no"), F.lit(5).alias("num_choices"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(500).alias("x2"), F.lit(500).alias("y2"))
    found = marks.find_markers(boxes, blocks)
    return found.select("img_id", "n", F.round("x1", 6).alias("x1"), "y1", F.round("x2", 6).alias("x2"), "y2")


@query("""
WITH o AS (SELECT o_orderkey AS k, CAST(2 + o_orderkey % 2 AS INT) AS cols, CAST(o_custkey % 50 AS INT) AS ox FROM orders),
g AS (SELECT k, n, ox + 100 * ((n - 1) % cols) AS x, 40 * ((n - 1) // cols) AS y FROM o, unnest(range(1, 7)) r(n))
SELECT k AS img_id, CAST(n AS INT) AS n, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(x + 20 AS DOUBLE) AS x2, CAST(y + 10 AS DOUBLE) AS y2 FROM g""")
def marker_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing markers are put on the grid that the others stand on."""
    k, n = F.col("o_orderkey"), F.col("n")
    cols = (2 + k % 2).cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
    seen = rows.where(n != F.when(k % 3 == 0, 4).otherwise(6))
    x, y = (F.col("o_custkey") % 50 + 100 * ((n - 1) % cols)).cast("double"), (40 * F.floor((n - 1) / cols)).cast("double")
    markers = seen.select(k.alias("img_id"), F.lit("1").alias("question_no"), "n", x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 10).alias("y2"))
    choices = table(spark, sf_dir, "orders").select(k.alias("img_id"), F.lit("1").alias("question_no"), F.lit(6).alias("num_choices"))
    return marks.extrapolate_markers(markers, choices).select("img_id", "n", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(f"""
WITH l AS ({_LINES}),
a AS (SELECT k, string_agg(CASE WHEN s % 5 = 0 THEN 'π' ELSE CAST(s % 5 AS VARCHAR) END, '' ORDER BY i) AS text, min(CAST(p % 64 AS DOUBLE) / 64) AS conf FROM l GROUP BY k)
SELECT k, text, conf, CASE WHEN conf < 0.5 THEN 'HOLD' WHEN text = CASE WHEN k % 2 = 0 THEN 'π' ELSE '1' END THEN 'O' ELSE 'X' END AS verdict FROM a""")
def reviewed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces put together, with symbols for their names, and reviewed where the least sure is not sure enough."""
    label = F.when(F.col("s") % 5 == 0, "pi").otherwise((F.col("s") % 5).cast("string"))
    rows = _lines(spark, sf_dir).select("k", "i", label.alias("label"), ((F.col("p") % 64).cast("double") / 64).alias("conf"))
    want = F.when(F.col("k") % 2 == 0, "π").otherwise("1")
    return marks.assemble(rows, ["k"], "i", "label", "conf").withColumn("verdict", marks.reviewed(F.col("text"), F.col("conf"), want))


@query("""
WITH s AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderkey % 2 AS INT) AS band, CAST(o_orderkey % 10000 AS INT) AS a, CAST(o_orderkey % 10000 + 20 + o_custkey % 50 AS INT) AS b FROM orders),
m AS (SELECT *, CASE WHEN a - 30 <= max(b) OVER (PARTITION BY k, band ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY k, band ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT k, min(a) AS x1, 1000 * band AS y1, max(b) AS x2, 1000 * band + 40 AS y2 FROM g GROUP BY k, band, g""")
def rects_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles in two rows of a page, merged until none are near each other."""
    return marks.merge_rects(_rects(spark, sf_dir), ["k"])


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, band = (F.col("o_orderkey") % 10000).cast("int"), (F.col("o_orderkey") % 2).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), a.alias("x1"), (1000 * band).alias("y1"), (a + 20 + F.col("o_custkey") % 50).cast("int").alias("x2"), (1000 * band + 40).alias("y2"))


@query("""
WITH s AS (SELECT o_custkey AS k, CAST(o_orderkey % 2 AS INT) AS band, CAST(o_orderkey % 10000 AS INT) AS a, CAST(o_orderkey % 10000 + 20 + o_custkey % 50 AS INT) AS b FROM orders)
SELECT k, min(a) AS x1, min(1000 * band) AS y1, max(b) AS x2, max(1000 * band + 40) AS y2 FROM s WHERE b - a >= 45 GROUP BY k""")
def answer_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of all pieces that are large enough; small ones don't count."""
    return marks.answer_area(_rects(spark, sf_dir).withColumn("y2", F.col("y2") + 60), ["k"], 45).withColumn("y2", F.col("y2") - 60)


def _share(value: Column) -> Column:
    return (value % 250).cast("double")


@query("""
SELECT o_orderkey, printf('%d %.6f %.6f %.6f %.6f', o_custkey % 10, (o_orderkey % 250 + 5) / 500.0, (o_custkey % 250 + 10) / 500.0, 10 / 500.0, 20 / 500.0) AS label_line FROM orders""")
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of boxes, as shares of the picture."""
    x, y = _share(F.col("o_orderkey")), _share(F.col("o_custkey"))
    boxes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("class_id"), x.alias("x1"), y.alias("y1"), (x + 10).alias("x2"), (y + 20).alias("y2"), F.lit(500.0).alias("w"), F.lit(500.0).alias("h"))
    return marks.yolo_boxes(boxes).select("o_orderkey", "label_line")


@query("""
SELECT 'train' AS split, CAST(o_custkey AS VARCHAR) AS img_id, CAST(o_orderkey % 5 AS INT) AS class_id, round((o_orderkey % 900 * 2 + 20) / 2.0 / 1000, 6) AS cx, round((o_orderkey % 400 * 2 + 60) / 2.0 / 500, 6) AS cy, 0.02::DOUBLE AS w, 0.12::DOUBLE AS h FROM orders""")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as label files, a file a picture, and read back."""
    x, y = (F.col("o_orderkey") % 900).cast("double"), (F.col("o_orderkey") % 400).cast("double")
    boxes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("img_id"), (F.col("o_orderkey") % 5).alias("class_id"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 60).alias("y2"), F.lit(1000.0).alias("w"), F.lit(500.0).alias("h"))
    folder = own_folder(spark, "labels")
    labels.write_labels(boxes, folder, list("01234"))
    return labels.read_labels(spark, folder)
