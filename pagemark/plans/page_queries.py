"""Driver queries for answer keys, page layout, grading by blocks, sessions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.equivalence import with_equality
from ..operators import grading, layout, marks, providers
from ..sources import answers, pictures
from ..streaming import session
from . import report
from .registry import own_folder, query, table

BOX = "img_id", "box_id", "text", "conf", "x1", "y1", "x2", "y2"


def _books(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON files, one a nation: its region's book, so that several files say what the same book is.

    Nations whose key is divisible by 11 have a question of an unknown type, and those divisible by 7 no pages.
    """
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = F.col("n_nationkey")
    kind = F.when(n % 11 == 10, "essay").when(F.col("i") == 2, K.SUBJECTIVE).otherwise(K.MCQ)
    asked = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i"))
    question = F.struct(F.format_string("%03d", F.col("i")).alias("question_no"), kind.alias("type"), (n * 10 + F.col("i")).cast("string").alias("answer"), F.when(F.col("i") == 3, "4").alias("num_choices"))
    pages = asked.groupBy("n_nationkey", "r_name").agg(F.array_sort(F.collect_list(question)).alias("q"))
    book = pages.select(F.concat(F.lit(" "), F.lower("r_name")).alias("book"), F.when(n % 7 != 6, F.create_map((n % 4).cast("string"), F.col("q"))).alias("pages"), "n_nationkey")
    folder = own_folder(spark, "books")
    book.coalesce(1).sortWithinPartitions("n_nationkey").select("book", "pages").write.option("maxRecordsPerFile", 1).json(folder)
    return folder


@query("""
WITH f AS (SELECT lower(r_name) AS book_key, min(n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT book_key, CAST(n % 4 AS VARCHAR) AS page, CAST(i - 1 AS INT) AS ord, '00' || i AS question_no, CAST(i AS VARCHAR) AS qkey,
       CASE WHEN i = 2 THEN 'subjective' ELSE 'multiple_choice' END AS qtype, CAST(n * 10 + i AS VARCHAR) AS answer, CASE WHEN i = 3 THEN 4 ELSE 5 END AS num_choices
FROM f, unnest(range(1, 4)) r(i) WHERE n % 7 <> 6 AND n % 11 <> 10""")
def json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answer files: of equal books the first file; a book with an unknown type, or without pages, is left out."""
    key = answers.read_answer_key(spark, "json", folder=_books(spark, sf_dir))
    return key.select("book_key", "page", "ord", "question_no", "qkey", "qtype", F.array_join("answer", ",").alias("answer"), "num_choices")


@query("""
SELECT lower(r_name) AS book_key, min(n_nationkey) % 7 <> 6 AS has_pages FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a folder of JSON files: one file of each book."""
    return answers.book_index(spark, _books(spark, sf_dir)).select("book_key", F.col("pages").isNotNull().alias("has_pages"))


@query("""
WITH f AS (SELECT min(n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT CAST(n % 4 AS VARCHAR) AS page, '00' || i AS question_no FROM f, unnest(range(1, 4)) r(i) WHERE n % 7 <> 6 AND n % 11 <> 10""")
def json_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book by a name that is written another way."""
    return answers.find_book(answers.read_answer_key(spark, "json", folder=_books(spark, sf_dir)), "  Asia ").select("page", "question_no")


@query("""
SELECT CAST(p_size AS VARCHAR) AS page, CAST(p_partkey AS VARCHAR) AS question_no, CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS INT) AS ord, p_brand AS book,
       CASE WHEN p_partkey % 3 = 0 THEN 'subjective' ELSE 'multiple_choice' END AS qtype,
       CASE WHEN p_partkey % 3 = 0 OR len(regexp_extract_all(CAST(p_partkey AS VARCHAR), '[1-9]')) = 0 THEN CAST(p_partkey AS VARCHAR) ELSE array_to_string(regexp_extract_all(CAST(p_partkey AS VARCHAR), '[1-9]'), ',') END AS answer,
       CAST(CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE p_partkey % 5 END AS INT) AS num_choices
FROM part""")
def tables_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer key of two tables, by their names."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(k % 3 == 0, " Subjective").otherwise("MULTIPLE_CHOICE ")
    part.select(F.col("p_brand").alias("worksheet_id"), F.col("p_size").alias("page"), k.alias("question_number"), kind.alias("type"), k.cast("string").alias("correct_answer"), F.nullif((k % 5).cast("int"), F.lit(0)).alias("num_choices")).createOrReplaceTempView("pagemark_question")
    part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("title")).distinct().createOrReplaceTempView("pagemark_worksheet")
    key = answers.read_answer_key(spark, "tables", question="pagemark_question", worksheet="pagemark_worksheet")
    return key.select("page", "question_no", "ord", "book", "qtype", F.array_join("answer", ",").alias("answer"), "num_choices")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND length(p_name) > 0 THEN p_name END AS said FROM part""")
def base64_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict base64: a prefix, a blank inside, missing padding and empty text are refused."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    code = F.base64(F.encode(F.concat("p_name", F.repeat(F.lit(" "), F.pmod(-F.length("p_name") + 1, F.lit(3)))), "UTF-8"))  # ends with padding
    sent = F.when(k % 5 == 0, code).when(k % 5 == 1, F.concat(F.lit("data:;base64,"), code)).when(k % 5 == 2, F.concat(F.left(code, F.lit(4)), F.lit("\n"), F.substring(code, F.lit(5), F.length(code)))).when(k % 5 == 3, F.regexp_replace(code, "=+$", "")).otherwise("")
    return part.select("p_partkey", F.nullif(F.rtrim(F.decode(answers.decoded_base64(sent), "UTF-8")), F.lit("")).alias("said"))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 OR o_orderkey % 4 = 3 THEN 422 WHEN o_orderkey % 9 = 0 THEN 400 WHEN o_custkey % 5 = 0 THEN 404 ELSE 200 END AS status FROM orders""")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of requests: fields and source, then base64, then the book."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(c % 7 == 0, None).when(c % 5 == 0, "nobody").otherwise("The  BOOK")
    source = F.element_at(F.array(F.lit("exam"), F.lit(None).cast("string"), F.lit("WorkBook"), F.lit("other")), (k % 4 + 1).cast("int"))
    requests = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), source.alias("workSheetSource"), F.when(k % 9 == 0, "@@").otherwise("aGk=").alias("image_base64"))
    key = table(spark, sf_dir, "region").select(F.lit("the book").alias("book_key")).distinct()
    return grading.status(requests, key).select("o_orderkey", "status")


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """results and page_results of orders as pages and their lines as questions."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(F.lit("O"), F.lit("X"), F.lit("HOLD")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("verdict"), F.when(F.col("l_suppkey") % 3 == 2, "why").otherwise("").alias("detail"), F.when(F.col("l_suppkey") % 3 != 2, (F.col("l_partkey") % 5).cast("string")).otherwise("").alias("student_answer"))
    one = line.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("verdict", "detail", "student_answer")).alias("r"))
    results = one.select(F.col("l_orderkey").alias("img_id"), F.lit("1").alias("page_no"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("question_no"), "r.*")
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(k.alias("img_id"), F.when(k % 6 == 0, "").otherwise((k % 6).cast("string")).alias("page_no"), F.when(k % 6 == 0, "page not recognised").otherwise("").alias("hold_reason"))
    return results, grading.page_counts(pages, results)


_RESULTS = """
WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'X' ELSE 'HOLD' END AS v, CASE WHEN l_suppkey % 3 = 2 THEN 'why' ELSE '' END AS d,
                  CASE WHEN l_suppkey % 3 <> 2 THEN CAST(l_partkey % 5 AS VARCHAR) ELSE '' END AS a FROM lineitem),
q AS (SELECT l_orderkey, l_linenumber, v, d, a FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY v, d, a) AS i FROM l) WHERE i = 1),
c AS (SELECT o_orderkey AS k, count(l_orderkey) FILTER (WHERE v = 'O') AS o, count(l_orderkey) FILTER (WHERE v = 'X') AS x, count(l_orderkey) FILTER (WHERE v = 'HOLD') AS h, count(l_orderkey) AS n
      FROM orders LEFT JOIN q ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT k, CASE WHEN k % 6 = 0 THEN '' ELSE CAST(k % 6 AS VARCHAR) END AS page_no, CASE WHEN k % 6 = 0 THEN 'page not recognised' ELSE '' END AS reason,
             CASE WHEN k % 6 = 0 THEN 0 ELSE o END AS o, CASE WHEN k % 6 = 0 THEN 0 ELSE x END AS x, CASE WHEN k % 6 = 0 THEN n ELSE h END AS h FROM c)
"""


@query(
    _RESULTS
    + """
SELECT k AS img_id, CASE WHEN reason <> '' THEN '== ' || k || '  (p.?)' || chr(10) || '  !! page held: ' || reason
  ELSE '== ' || k || '  (p.' || page_no || ')' || chr(10) || coalesce((SELECT string_agg('  ' || lpad(CAST(l_linenumber AS VARCHAR), 4, ' ') || '  ' || v || CASE WHEN a <> '' THEN '  [' || a || ']' ELSE '' END || CASE WHEN d <> '' THEN '  (' || d || ')' ELSE '' END || chr(10), '' ORDER BY l_linenumber) FROM q WHERE l_orderkey = k), '')
       || '  -- O ' || o || ' / X ' || x || ' / HOLD ' || h END AS report FROM p"""
)
def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text reports of pages, held ones with their reason only."""
    return report.format_report(*_graded(spark, sf_dir))


@query(_RESULTS + """SELECT CAST(sum(o) AS BIGINT) AS "O", CAST(sum(x) AS BIGINT) AS "X", CAST(sum(h) AS BIGINT) AS "HOLD" FROM p""")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.totals(_graded(spark, sf_dir)[1])


@query(
    _RESULTS
    + """
SELECT k AS img_id, CASE WHEN k % 5 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN k % 5 <> 0 THEN '{"workSheetSource":"EXAM","name":"n' || k || '","page_no":"' || page_no || '","results":['
  || coalesce((SELECT string_agg('{"question_no":"' || l_linenumber || '","verdict":"' || v || '","student_answer":"' || a || '","detail":"' || d || '"}', ',' ORDER BY l_linenumber) FROM q WHERE l_orderkey = k), '')
  || '],"counts":{"O":' || o || ',"X":' || x || ',"HOLD":' || h || '},"hold_reason":"' || reason || '"}' END AS response FROM p"""
)
def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as JSON."""
    results, pages = _graded(spark, sf_dir)
    k = F.col("img_id")
    requests = pages.select("img_id", F.lit("exam").alias("workSheetSource"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.when(k % 5 == 0, 404).otherwise(200).alias("status"))
    return report.to_response(requests, results, pages)


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN (p_partkey % 1000) || '.' WHEN 1 THEN ' ' || (p_partkey % 100) || '-' || (p_partkey % 10) || ') text' WHEN 2 THEN (p_partkey % 100) || '-' || (p_partkey % 10)
  WHEN 3 THEN lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '$>' WHEN 4 THEN '(' || (p_partkey % 5) || ')' WHEN 5 THEN CAST(p_partkey % 1000 AS VARCHAR) WHEN 6 THEN (p_partkey % 100) || ' .' ELSE 'no ' || p_partkey END AS s FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_partkey % 1000 AS VARCHAR) WHEN 1 THEN (p_partkey % 100) || '-' || (p_partkey % 10) WHEN 2 THEN (p_partkey % 100) || '-' || (p_partkey % 10)
  WHEN 3 THEN lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') WHEN 6 THEN CAST(p_partkey % 100 AS VARCHAR) END AS number FROM t""")
def anchor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question numbers at the start of texts."""
    k = F.col("p_partkey")
    text = lambda m: (k % m).cast("string")
    said = F.element_at(
        F.array(
            F.concat(text(1000), F.lit(".")), F.concat(F.lit(" "), text(100), F.lit("-"), text(10), F.lit(") text")), F.concat(text(100), F.lit("-"), text(10)), F.concat(F.lpad(text(10000), 4, "0"), F.lit("$>")),
            F.concat(F.lit("("), text(5), F.lit(")")), text(1000), F.concat(text(100), F.lit(" .")), F.concat(F.lit("no "), k.cast("string")),
        ), (k % 8 + 1).cast("int"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", K.anchor_number(said).alias("number"))


def _boxes(rows: DataFrame) -> DataFrame:
    return rows.select("img_id", "box_id", "text", F.lit(0.9).alias("conf"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("""
WITH b AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_partkey % 40 AS VARCHAR) AS page, l_suppkey * 7 % 1000 AS cx, l_partkey * 13 % 1400 AS cy FROM lineitem),
n AS (SELECT k, least(cx, 1000 - cx) AS edge, page FROM b WHERE cy >= 1260 AND least(cx, 1000 - cx) <= 250 AND CAST(page AS INT) < 30)
SELECT k AS img_id, page AS page_no FROM (SELECT k, page, row_number() OVER (PARTITION BY k ORDER BY edge, page) AS i FROM n) WHERE i = 1""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page number of a scan: a valid one in the footer, nearest to an edge."""
    line = table(spark, sf_dir, "lineitem")
    cx, cy = F.col("l_suppkey") * 7 % 1000, F.col("l_partkey") * 13 % 1400
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    said = F.when(F.col("l_linenumber") % 2 == 0, F.concat((F.col("l_partkey") % 40).cast("string"), F.lit(" | unit"))).otherwise(F.concat(F.lit("unit "), (F.col("l_partkey") % 40).cast("string")))
    boxes = _boxes(line.select(F.col("l_orderkey").alias("img_id"), place.alias("box_id"), said.alias("text"), (cx - 5).alias("x1"), (cy - 5).alias("y1"), (cx + 5).alias("x2"), (cy + 5).alias("y2")))
    dims = line.select(F.col("l_orderkey").alias("img_id"), F.lit("b").alias("book_key"), F.lit(1400).alias("img_h"), F.lit(1000).alias("img_w")).distinct()
    pages = spark.range(30).select(F.lit("b").alias("book_key"), F.col("id").cast("string").alias("page"))
    return layout.read_page_number(boxes, dims, pages)


@query("""
WITH s AS (SELECT l_orderkey % 100 AS k, greatest(0, l_partkey % 90 * 10 + CASE WHEN l_partkey % 90 BETWEEN 38 AND 45 THEN 300 ELSE 0 END) AS a, l_linenumber * 15 AS w FROM lineitem),
p AS (SELECT k, a, least(1000, a + w) AS b FROM s WHERE a < least(1000, a + w)),
n AS (SELECT l_orderkey % 100 AS k, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT n.k, x, n, (SELECT count(*) FROM p WHERE p.k = n.k AND p.a <= x AND x < p.b) AS cover FROM n, unnest(range(300, 700)) r(x)),
o AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM c WHERE cover < greatest(1, 0.03 * n)),
r AS (SELECT k, min(x) AS x1, count(*) AS len FROM o GROUP BY k, g),
m AS (SELECT k, x1, len FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY len DESC, x1) AS i FROM r) WHERE i = 1),
d AS (SELECT n.k, CASE WHEN len >= 15 THEN x1 + len - 1 - len // 2 END AS mid FROM n LEFT JOIN m USING (k))
SELECT k AS img_id, 0 AS col_no, 0 AS cx1, CAST(coalesce(mid, 1000) AS INT) AS cx2 FROM d
UNION ALL SELECT k, 1, CAST(mid AS INT), 1000 FROM d WHERE mid IS NOT NULL""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a page by its widest gutter; the SQL looks at every pixel, the operator at the ends of boxes."""
    line = table(spark, sf_dir, "lineitem")
    a = F.col("l_partkey") % 90 * 10 + F.when((F.col("l_partkey") % 90).between(38, 45), 300).otherwise(0)
    boxes = line.select((F.col("l_orderkey") % 100).alias("img_id"), F.lit(0).alias("box_id"), F.lit("t").alias("text"), a.alias("x1"), F.lit(0).alias("y1"), (a + F.col("l_linenumber") * 15).alias("x2"), F.lit(9).alias("y2"))
    dims = boxes.select("img_id", F.lit(1400).alias("img_h"), F.lit(1000).alias("img_w")).distinct()
    return layout.split_columns(_boxes(boxes), dims)


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """boxes, dims, answer_key and submissions of orders as scans in two columns.

    An order's page is one of 1 to 6, with one question more than its number: the first half left, the rest right. Orders divisible by 11
    have no page number, by 13 an unknown page as a hint; by 5 the second number is misread as 99 where it has two digits; by 7 the first question's number is missing.
    """
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    page = (k % 6 + 1).cast("int")
    asked = orders.select(k.alias("img_id"), page.alias("p"), F.explode(F.sequence(F.lit(1), page + 1)).alias("q"))
    number = F.col("p") * 10 + F.col("q")
    said = F.when((F.col("img_id") % 5 == 0) & (F.col("q") == 2), F.lit(99)).otherwise(number).cast("string")
    seen = asked.where((F.col("img_id") % 7 != 0) | (F.col("q") > 1))
    x = F.when(2 * F.col("q") <= F.col("p") + 2, 60).otherwise(560)
    anchors = seen.select("img_id", F.col("q").alias("box_id"), F.concat(said, F.lit(".")).alias("text"), x.alias("x1"), (100 * F.col("q")).alias("y1"), (x + 30).alias("x2"), (100 * F.col("q") + 20).alias("y2"))
    body = seen.select("img_id", (F.col("q") + 50).alias("box_id"), F.lit("3 of the text").alias("text"), (x + 100).alias("x1"), (100 * F.col("q")).alias("y1"), (x + 400).alias("x2"), (100 * F.col("q") + 20).alias("y2"))
    foot = orders.where(k % 11 != 0).select(k.alias("img_id"), F.lit(99).alias("box_id"), page.cast("string").alias("text"), F.lit(80).alias("x1"), F.lit(1350).alias("y1"), F.lit(100).alias("x2"), F.lit(1370).alias("y2"))
    dims = orders.select(k.alias("img_id"), F.lit(1400).alias("img_h"), F.lit(1000).alias("img_w"))
    shown = asked.select("p", "q").distinct()
    number = (F.col("p") * 10 + F.col("q")).cast("string")
    qtype = F.when(F.col("q") % 3 == 0, K.SUBJECTIVE).otherwise(K.MCQ)
    key = shown.select(F.lit("b").alias("book"), F.lit("b").alias("book_key"), F.col("p").cast("string").alias("page"), (F.col("q") - 1).alias("ord"), number.alias("question_no"), number.alias("qkey"), qtype.alias("qtype"), F.array((F.col("q") % 5 + 1).cast("string")).alias("answer"), F.lit(5).alias("num_choices"))
    submissions = orders.select(k.alias("img_id"), F.lit("B ").alias("book"), F.when(k % 13 == 0, "77").otherwise("").alias("page_hint"))
    return _boxes(anchors.unionByName(body).unionByName(foot)), dims, key, submissions


_SCANS = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 6 + 1 AS INT) AS p FROM orders),
h AS (SELECT k, p, CASE WHEN k % 13 = 0 THEN '77' WHEN k % 11 = 0 THEN '' ELSE CAST(p AS VARCHAR) END AS page_no,
             CASE WHEN k % 13 = 0 THEN 'page not in the answer key' WHEN k % 11 = 0 THEN 'page number not read' WHEN k % 7 = 0 THEN 'anchors do not match the questions' ELSE '' END AS reason FROM o),
q AS (SELECT k, p, q, 100 * q AS y, 2 * q <= p + 2 AS first FROM h, unnest(range(1, 9)) r(q) WHERE reason = '' AND q <= p + 1)
"""


@query(_SCANS + """SELECT k AS img_id, page_no, reason AS hold_reason FROM h""")
def layout_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout of scans, end to end: which pages are held and why."""
    return layout.analyze_layout(*_scans(spark, sf_dir))[1]


@query(
    _SCANS
    + """
SELECT k AS img_id, CAST(p * 10 + q AS VARCHAR) AS question_no, CASE WHEN first THEN 0 ELSE 509 END AS x1, CAST(y AS INT) AS y1, CASE WHEN first THEN 509 ELSE 1000 END AS x2,
       CAST(CASE WHEN q < CASE WHEN first THEN (p + 2) // 2 ELSE p + 1 END THEN y + 100 ELSE 1400 END AS INT) AS y2 FROM q"""
)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout of scans, end to end: blocks of the questions, misread numbers mended."""
    return layout.analyze_layout(*_scans(spark, sf_dir))[0]


@query(
    _SCANS
    + """
, e AS (SELECT h.k, h.p, h.page_no, h.reason, q FROM h, unnest(range(1, 9)) r(q) WHERE k % 13 <> 0 AND k % 11 <> 0 AND q <= p + 1),
v AS (SELECT k, page_no, reason, CASE WHEN reason <> '' THEN 'HOLD' WHEN (k + q) % 4 = 0 THEN 'HOLD' WHEN (k + q) % 4 = 1 THEN 'X' ELSE 'O' END AS v FROM e)
SELECT h.k AS img_id, h.page_no, h.reason AS hold_reason, count(v) FILTER (WHERE v = 'O') AS "O", count(v) FILTER (WHERE v = 'X') AS "X", count(v) FILTER (WHERE v = 'HOLD') AS "HOLD"
FROM h LEFT JOIN v ON v.k = h.k GROUP BY 1, 2, 3"""
)
def grade_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grading in blocks: replies for each question, of which a quarter decline and a quarter are wrong."""
    boxes, dims, key, submissions = _scans(spark, sf_dir)
    asked = submissions.select("img_id", (F.col("img_id") % 6 + 1).cast("int").alias("p")).select("img_id", "p", F.explode(F.sequence(F.lit(1), F.col("p") + 1)).alias("q"))
    case, right = (F.col("img_id") + F.col("q")) % 4, (F.col("q") % 5 + 1).cast("string")
    math = F.col("q") % 3 == 0
    said = F.when(case == 1, F.lit("0.5")).otherwise(right)
    first = F.when(math, F.when(case == 0, "UNSURE").otherwise(said)).otherwise(F.when(case == 0, "none").when(case == 1, F.lit("` 9 `")).otherwise(F.concat(F.lit("`"), right, F.lit("`"))))
    second = F.concat(F.lit(" "), said)
    calls = F.when(math, F.array(F.struct(F.lit("math").alias("kind"), F.lit(0).alias("call_no"), first.alias("raw")), F.struct(F.lit("math").alias("kind"), F.lit(1).alias("call_no"), second.alias("raw")))).otherwise(F.array(F.struct(F.lit("mcq").alias("kind"), F.lit(0).alias("call_no"), first.alias("raw"))))
    replies = asked.select("img_id", (F.col("p") * 10 + F.col("q")).cast("string").alias("question_no"), F.explode(calls).alias("c")).select("img_id", "c.kind", "question_no", "c.call_no", "c.raw")
    return grading.grade("blocks", submissions, replies, key, boxes, dims)[1]


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) + 1 + l_linenumber % 3 AS b, l_suppkey % 4 AS t FROM lineitem)
SELECT k, n, a, b, t, CASE t WHEN 0 THEN TRUE WHEN 1 THEN a = b + 1 WHEN 2 THEN FALSE END AS same FROM l""")
def solution_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of solutions against a key of two: in another order, one wrong, one too few, one that does not parse."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("a"), (F.col("l_quantity").cast("int") + 1 + F.col("l_linenumber") % 3).cast("int").alias("b"), (F.col("l_suppkey") % 4).alias("t"))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    said = F.element_at(F.array(F.concat(F.lit("x="), b, F.lit(", "), a, F.lit(".0")), F.concat(a, F.lit(","), (F.col("b") + 1).cast("string"), F.lit("-2")), a, F.concat(a, F.lit(", ??"))), (F.col("t") + 1).cast("int"))
    key = F.when(F.col("t") == 1, F.array(a, F.concat(F.lit("2*"), b, F.lit("-"), b))).otherwise(F.array(F.concat(F.lit("2×"), a, F.lit("÷2")), b))
    return with_equality(rows.withColumn("said", F.array(said)).withColumn("want", key), "said", "want", "same").select("k", "n", "a", "b", "t", "same")


@query("""
WITH r AS (SELECT 'crop' || (event_id % 50) || CASE WHEN event_id % 2 = 0 THEN '.png' ELSE '' END AS name, CASE WHEN event_id % 50 < 10 THEN 'x 1' ELSE 'x' || (event_id % 3) END AS answer, event_id % 8 / 4.0 AS seconds FROM events),
e AS (SELECT name, answer, seconds, CASE WHEN name LIKE '%.png' THEN 'x1' WHEN CAST(regexp_extract(name, '[0-9]+') AS INT) % 5 <> 0 THEN 'x 0' END AS want FROM r),
c AS (SELECT name, count(DISTINCT answer) = 1 AS alike, count(*) FILTER (WHERE replace(answer, ' ', '') = replace(want, ' ', '')) AS m, count(*) AS n, sum(seconds) AS s, max(seconds) AS l FROM e GROUP BY name)
SELECT count(*) AS crops, count(*) FILTER (WHERE alike) AS repeated_alike, CAST(sum(m) AS BIGINT) AS matches, CAST(sum(n) AS BIGINT) AS reads, round(sum(s) / sum(n), 6) AS mean_seconds, max(l) AS max_seconds FROM c""")
def repeat_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated reads of crops against what is expected by name, or by stem."""
    e = F.col("event_id")
    reads = table(spark, sf_dir, "events").select(
        F.concat(F.lit("crop"), (e % 50).cast("string"), F.when(e % 2 == 0, ".png").otherwise("")).alias("name"), F.when(e % 50 < 10, "x 1").otherwise(F.concat(F.lit("x"), (e % 3).cast("string"))).alias("answer"), (e % 8 / 4.0).cast("double").alias("seconds")
    )
    known = reads.select("name").distinct()
    number = F.regexp_extract("name", "[0-9]+", 0).cast("int")
    by_name = known.where("name LIKE '%.png'").select("name", F.lit("x1").alias("want"))
    by_stem = known.where((number % 5 != 0) & ~F.col("name").like("%.png")).select("name", F.lit("x 0").alias("want"))
    return marks.repeat_agreement(reads, by_name.unionByName(by_stem)).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("""
SELECT 'p' || doc_id AS stem, 't' || doc_id AS truth, 'g' || (doc_id + 1) AS guess FROM documents WHERE doc_id % 3 = 0""")
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two folders by their stems; those without a partner are left out."""
    docs, d = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    truths = docs.select(F.concat(F.lit("/labels/val/p"), d.cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("t"), d.cast("string")).alias("text"))
    guesses = docs.select(F.concat(F.lit("images/p"), d.cast("string"), F.when(d % 3 == 0, ".png").otherwise("-b.png")).alias("path"), F.concat(F.lit("g"), (d + 1).cast("string")).alias("text"))
    return marks.paired(truths, guesses)


@query("""
SELECT CAST(count(*) FILTER (WHERE event_id % 3 = 0 AND event_id % 10 <> 0) AS BIGINT) AS "O", CAST(count(*) FILTER (WHERE event_id % 3 = 1 AND event_id % 10 <> 0) AS BIGINT) AS "X",
       CAST(count(*) FILTER (WHERE event_id % 3 = 2 AND event_id % 10 <> 0) AS BIGINT) AS "HOLD" FROM events""")
def stream_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session over a stream of rows: all go through the gate, which rejects some; totals at the end."""
    accepted, _ = _session(spark, sf_dir)
    return grading.totals(session.page_results(spark, accepted))


@query("""SELECT CAST(event_id AS VARCHAR) AS path, 'divisible by ten' AS reason FROM events WHERE event_id % 10 = 0""")
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate of a session rejects."""
    _, rejected = _session(spark, sf_dir)
    return spark.read.parquet(rejected).select("path", "reason")


def _session(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of the accepted and rejected rows of a session over all events."""
    event = F.col("event_id")
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").select(event.cast("string").alias("path"), "event_id")

    def gate(given: DataFrame) -> DataFrame:
        return given.withColumn("ok", event % 10 != 0).withColumn("reason", F.when(event % 10 == 0, "divisible by ten").otherwise(""))

    def grade(given: DataFrame) -> DataFrame:
        one = lambda k: F.when(event % 3 == k, 1).otherwise(0).cast("long")
        return given.select(F.col("path").alias("img_id"), F.lit("1").alias("page_no"), F.lit("").alias("hold_reason"), one(0).alias("O"), one(1).alias("X"), one(2).alias("HOLD"))

    folder = own_folder(spark, "session")
    accepted, rejected = f"{folder}/accepted", f"{folder}/rejected"
    running = session.run_session(rows, f"{folder}/state", gate, grade, accepted, rejected)
    running.awaitTermination()
    return accepted, rejected


@query("""
WITH k AS (SELECT c_nationkey AS book, CAST(c_custkey AS VARCHAR) AS page, unnest(range(1, 3 + c_custkey % 6)) AS q FROM customer),
a AS (SELECT o_orderkey AS img_id, c_nationkey AS book, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'x' || o_custkey WHEN 2 THEN '' END AS hint FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT l_orderkey AS img_id, l_linenumber + l_suppkey % 3 AS q, CASE WHEN l_orderkey % 5 = 0 THEN CAST(l_orderkey % 7 AS VARCHAR) END AS stated FROM lineitem),
h AS (SELECT a.img_id, k.page, count(*) AS n FROM a JOIN (SELECT DISTINCT img_id, q FROM r) USING (img_id) JOIN k USING (book, q) GROUP BY 1, 2),
v AS (SELECT img_id, page, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, page) AS i FROM h),
s AS (SELECT img_id, min(stated) AS stated FROM r GROUP BY 1)
SELECT a.img_id, coalesce(nullif(hint, ''), v.page, stated) AS page_no, EXISTS (SELECT 1 FROM k WHERE k.book = a.book AND k.page = coalesce(nullif(hint, ''), v.page, stated)) AS known,
  s.img_id IS NOT NULL AS read, coalesce((SELECT count(DISTINCT q) FROM r WHERE r.img_id = a.img_id), 0) AS answers
FROM a LEFT JOIN v ON v.img_id = a.img_id AND i = 1 LEFT JOIN s ON s.img_id = a.img_id""")
def page_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of books whose question numbers begin anew on every page, by hints, valid or not, by votes, or as stated."""
    customer, orders, line = (table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem"))
    book = F.concat(F.lit("Book "), F.col("c_nationkey"))
    number = F.explode(F.sequence(F.lit(1).cast("long"), 2 + F.col("c_custkey") % 6)).alias("n")
    key = customer.select(K.book_key(book).alias("book_key"), F.col("c_custkey").cast("string").alias("page"), number).withColumn("qkey", F.col("n").cast("string"))
    who = F.col("o_custkey").cast("string")
    hint = F.when(F.col("o_orderkey") % 4 == 0, who).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("x"), who)).when(F.col("o_orderkey") % 4 == 2, F.lit(""))
    asked = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(F.col("o_orderkey").alias("img_id"), book.alias("book"), hint.alias("page_hint"))
    stated = F.when(F.col("l_orderkey") % 5 == 0, (F.col("l_orderkey") % 7).cast("string"))
    merged = line.select(F.col("l_orderkey").alias("img_id"), stated.alias("page"), (F.col("l_linenumber") + F.col("l_suppkey") % 3).cast("string").alias("qkey"), F.col("l_partkey").cast("string").alias("value"))
    found = grading.resolve_page(asked, merged, key)
    return found.select("img_id", "page_no", "known", "read", F.when(F.col("read"), F.size("answers")).otherwise(0).cast("long").alias("answers"))


def _picture(k: Column) -> Column:
    """Bytes by a part's number: PNGs, JPEGs that stand, lie or have no frame, bitmaps, and what is cut off or spoilt."""
    hex_ = lambda c, n: F.lpad(F.hex(c), n, "0")
    w, h = 1 + k % 900, 2 + k % 77
    header = F.concat(F.lit("49484452"), hex_(w, 8), hex_(h, 8), F.lit("0802000000"))
    png = lambda spoilt: F.concat(F.lit("89504E470D0A1A0A0000000D"), header, hex_(F.crc32(F.unhex(header)).bitwiseXOR(spoilt), 8))
    pixels = F.lit("0000000149444154" + "00" * 5)
    exif = F.concat(F.lit("FFE1001E457869660000" + "4D4D002A00000008" + "0001" + "011200030000000100"), hex_(1 + k % 8, 2), F.lit("0000"))
    frame = F.concat(F.lit("FFC0000B08"), hex_(h, 4), hex_(w, 4), F.lit("01011100"))
    scan = F.lit("FFDA0008010100003F00" + "FFD9")
    turned = lambda n: F.concat(*(F.substring(hex_(n, 8), i, 2) for i in (7, 5, 3, 1)))
    bitmap = F.concat(F.lit("424D" + "00" * 12 + "28000000"), turned(w), turned(h), F.lit("00" * 28))
    made = [F.concat(png(0), pixels), F.concat(F.lit("FFD8"), exif, frame, scan), bitmap, F.concat(F.lit("FFD8"), exif, scan), png(0), F.concat(png(1), pixels), F.concat(F.lit("FFD8FFFF"), F.substring(frame, 3, 99), scan), F.lit("6869")]
    return F.unhex(F.element_at(F.array(*made), (k % 8 + 1).cast("int")))


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS c, CAST(1 + p_partkey % 900 AS INT) AS w, CAST(2 + p_partkey % 77 AS INT) AS h FROM part),
n AS (SELECT k, CASE c WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'bmp' WHEN 6 THEN 'jpeg' END AS kind, w, h, CASE WHEN c = 1 THEN CAST(1 + k % 8 AS INT) ELSE 1 END AS turn FROM p)
SELECT k, kind, CASE WHEN kind IS NULL THEN NULL WHEN turn >= 5 THEN h ELSE w END AS width, CASE WHEN kind IS NULL THEN NULL WHEN turn >= 5 THEN w ELSE h END AS height, CASE WHEN kind IS NOT NULL THEN turn END AS orientation,
  CASE WHEN k % 11 = 0 THEN 422 WHEN kind IS NULL OR k % 13 = 0 THEN 400 WHEN k % 5 = 0 THEN 404 ELSE 200 END AS status FROM n""")
def picture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures by their headers, upright, and the status of requests with them."""
    k = F.col("k")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).withColumn("data", _picture(k))
    name = F.when(k % 11 == 0, None).when(k % 5 == 0, "nobody").otherwise("The book")
    sent = F.when(k % 13 == 0, "not base64").otherwise(F.regexp_replace(F.base64("data"), r"\s", ""))
    requests = part.select("k", "data", name.alias("name"), F.lit(None).cast("string").alias("workSheetSource"), sent.alias("image_base64"))
    key = table(spark, sf_dir, "region").select(F.lit("the book").alias("book_key")).distinct()
    told = grading.status(requests, key, pictures=True).withColumn("header", pictures.picture_header(F.col("data")))
    size = pictures.upright_size(F.col("header"))
    return told.select("k", "header.kind", size["width"].alias("width"), size["height"].alias("height"), "header.orientation", "status")


@query("""
WITH e AS (SELECT event_id // 4 AS r, CAST(1 + event_id % 4 // 2 AS INT) AS t, event_id % 2 AS second, user_id % 7 AS u, event_id // 4 % 4 AS p, user_id AS n FROM events),
o AS (SELECT r, t, second, p, CASE WHEN u = 0 THEN 'fail' WHEN u = 1 THEN 'late' WHEN u = 2 THEN 'bad' WHEN u = 3 THEN 'none' ELSE 'said' END AS kind, n FROM e WHERE p <= 2 AND (p = 0 OR second = 0)),
a AS (SELECT o.r, o.t, o.second, o.kind, o.n, row_number() OVER (PARTITION BY o.r ORDER BY o.t, o.second) AS i FROM o LEFT JOIN o f ON f.r = o.r AND f.t = o.t AND f.second = 0 AND o.second = 1
      WHERE o.second = 0 OR f.kind = 'late'),
d AS (SELECT r, min(i) AS i FROM a WHERE kind IN ('none', 'said') GROUP BY r),
c AS (SELECT a.r, max(a.i) AS calls, max(CASE WHEN a.i = d.i AND kind = 'said' THEN 'reply ' || n END) AS reply FROM a LEFT JOIN d USING (r) WHERE d.i IS NULL OR a.i <= d.i GROUP BY a.r)
SELECT q.r, reply, CAST(coalesce(calls, 0) AS INT) AS calls FROM (SELECT DISTINCT r FROM e) q LEFT JOIN c USING (r)""")
def provider_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to providers as they were answered: retries, the second endpoint, refusals and unknown providers."""
    e, u = F.col("event_id"), F.col("user_id") % 7
    provider = F.element_at(F.array(*(F.lit(x) for x in (providers.OPENAI, providers.GEMINI, providers.ANTHROPIC, "other"))), (F.floor(e / 4) % 4 + 1).cast("int"))
    text = F.concat(F.lit(" `reply "), F.col("user_id"), F.lit("` "))
    chat = F.when(e % 2 == 1, providers.CHAT).otherwise(providers.RESPONSES)
    q = lambda start, end: F.concat(F.lit(start), text, F.lit(end))
    said = (
        F.when((provider == providers.OPENAI) & (e % 2 == 1), q('{"choices":[{"message":{"content":"', '"}}]}'))
        .when(provider == providers.OPENAI, q('{"output":[{"type":"reasoning"},{"type":"message","content":[{"type":"other"},{"type":"output_text","text":"', '"}]}]}'))
        .when(provider == providers.GEMINI, q('{"candidates":[{"content":{"parts":[{"text":"', '"}]}}]}'))
        .otherwise(q('{"stop_reason":"end","content":[{"type":"thinking"},{"type":"text","text":"', '"}]}'))
    )
    silent = (
        F.when((provider == providers.OPENAI) & (e % 2 == 1), F.lit('{"choices":[{"message":{"content":null}}]}')).when(provider == providers.OPENAI, F.lit('{"output":[{"type":"message","content":[]}]}'))
        .when(provider == providers.GEMINI, F.lit('{"candidates":[{"content":{"parts":[{"text":""}]}}]}')).otherwise(F.lit('{"stop_reason":"refusal","content":[{"type":"text","text":"no"}]}'))
    )
    status, body = F.when(u == 0, None).when(u == 1, 503).otherwise(200), F.when(u == 2, "{broken").when(u == 3, silent).when(u > 3, said)
    attempts = table(spark, sf_dir, "events").select(F.floor(e / 4).alias("r"), provider.alias("provider"), (1 + F.floor(e % 4 / 2)).cast("int").alias("try"), chat.alias("endpoint"), status.alias("status"), body.alias("body"))
    return providers.replies(attempts, ["r"])
