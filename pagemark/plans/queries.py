"""Driver queries: each applies an operator to grading data derived from the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.equivalence import with_equality
from ..operators import grading, layout, marks, reads
from ..sources.answers import mapped_questions
from . import ink_queries, mark_queries, page_queries  # noqa: F401  they add their queries
from .registry import ORACLE_SQL, QUERIES, query
from .registry import table as _table

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("""
WITH q AS (
  SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'multiple_choice' ELSE 'subjective' END AS qtype,
         1 + CAST(l_quantity AS INT) % 5 AS k,
         CASE WHEN l_discount >= 0.005 THEN 1 + CAST(round(l_tax * 100) AS INT) % 5 END AS r FROM lineitem)
SELECT qtype, count(*) FILTER (WHERE r IS NOT NULL AND r = k) AS o, count(*) FILTER (WHERE r IS NOT NULL AND r <> k) AS x,
       count(*) FILTER (WHERE r IS NULL) AS hold
FROM q GROUP BY qtype""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of readings against a key, by question type."""
    line = _table(spark, sf_dir, "lineitem")
    read = F.when(F.col("l_discount") >= 0.005, (1 + F.round(F.col("l_tax") * 100).cast("int") % 5).cast("string"))
    rows = line.select(
        F.when(F.col("l_linenumber") % 2 == 1, K.MCQ).otherwise(K.SUBJECTIVE).alias("qtype"),
        F.array((1 + F.col("l_quantity").cast("int") % 5).cast("string")).alias("answer"), read.alias("raw"),
    )
    graded = grading.grade_questions(rows)
    total = lambda v: F.count_if(F.col("verdict") == v).alias(v.lower())
    return graded.groupBy("qtype").agg(total("O"), total("X"), total("HOLD"))


@query("""
SELECT p_partkey, regexp_replace(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), '^0+([0-9])', '\\1') AS qkey FROM part""")
def qkey_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", K.question_key(F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("qkey"))


@query("""
SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS book_key, min(p_partkey) AS first_key, count(*) AS n
FROM part GROUP BY 1""")
def book_key_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal books the first wins."""
    part = _table(spark, sf_dir, "part").withColumn("book_key", K.book_key(F.concat(F.lit("  "), F.initcap("p_name"))))
    return part.groupBy("book_key").agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n"))


@query("""
WITH v AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS n, min(l_linenumber * 10000000 + l_partkey) AS f FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_orderkey, v, n, sum(n) OVER (PARTITION BY l_orderkey) AS participants, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f, v) AS k FROM v)
SELECT l_orderkey, v AS winner, n, CAST(participants AS BIGINT) AS participants FROM t WHERE k = 1""")
def vote_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_linenumber") * F.lit(10000000) + F.col("l_partkey"))
    return reads.vote(line, ["l_orderkey"], "l_returnflag", ["at"])


@query("""
WITH k AS (SELECT DISTINCT c_mktsegment AS page, c_nationkey AS qkey FROM customer),
r AS (SELECT DISTINCT s_suppkey % 20 AS img_id, s_nationkey AS qkey FROM supplier),
h AS (SELECT img_id, page, count(*) AS n FROM r JOIN k USING (qkey) GROUP BY 1, 2),
o AS (SELECT img_id, page, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, page) AS i FROM h)
SELECT img_id, page AS inferred FROM o WHERE i = 1""")
def infer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _table(spark, sf_dir, "customer").select(F.lit("b").alias("book_key"), F.col("c_mktsegment").alias("page"), F.col("c_nationkey").alias("qkey"))
    read = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("img_id"), F.lit("b").alias("book_key"), F.col("s_nationkey").alias("qkey"))
    return grading.infer_page(read, key).select("img_id", "inferred")


@query("""
WITH d AS (SELECT o_orderpriority AS p, CAST(datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS a,
                  CAST(datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 1 + o_custkey % 2 AS INT) AS b FROM orders),
e AS (SELECT p, a AS x, 1 AS d FROM d UNION ALL SELECT p, b, -1 FROM d UNION ALL SELECT DISTINCT p, 1000, 0 FROM d UNION ALL SELECT DISTINCT p, 4000, 0 FROM d),
s AS (SELECT p, x, sum(d) AS d FROM e GROUP BY 1, 2),
c AS (SELECT p, x, sum(d) OVER (PARTITION BY p ORDER BY x) AS cover, lead(x) OVER (PARTITION BY p ORDER BY x) AS nx FROM s),
o AS (SELECT p, x, nx FROM c WHERE x >= 1000 AND nx <= 4000 AND cover < 1),
g AS (SELECT p, x, nx, CASE WHEN lag(nx) OVER (PARTITION BY p ORDER BY x) = x THEN 0 ELSE 1 END AS n FROM o),
i AS (SELECT p, x, nx, sum(n) OVER (PARTITION BY p ORDER BY x) AS island FROM g)
SELECT p, min(x) AS x1, max(nx) AS x2 FROM i GROUP BY p, island""")
def gutter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that no span covers, by sweeping the ends of spans."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    spans = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), day.alias("a"), (day + 1 + F.col("o_custkey") % 2).cast("int").alias("b"))
    return layout.coverage_runs(spans, ["p"], F.lit(1000), F.lit(4000), F.col("cover") < 1)


@query("""
WITH RECURSIVE s AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CAST(left(o_orderpriority, 1) AS INT) AS e FROM orders),
r(c, i, e, n) AS (SELECT c, i, e, 1 FROM s UNION SELECT s.c, s.i, s.e, r.n + 1 FROM r JOIN s ON s.c = r.c AND s.i > r.i AND s.e > r.e)
SELECT c, CAST(max(n) AS INT) AS longest FROM r GROUP BY c""")
def lis_anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest chains in expected order."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    items = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (F.row_number().over(order) - 1).alias("i"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("e"))
    return layout.match_in_order(items, ["c"]).groupBy("c").agg(F.count("*").cast("int").alias("longest"))


@query("""
WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CAST(round(l_tax * 100) AS INT) AS s FROM lineitem),
p AS (SELECT a.k, a.i, a.s, b.s AS r FROM l a JOIN l b ON a.k = b.k AND a.i <> b.i),
m AS (SELECT k, i, s, median(r) AS m FROM p GROUP BY 1, 2, 3),
d AS (SELECT p.k, p.i, p.s, m.m, median(abs(p.r - m.m)) AS d FROM p JOIN m USING (k, i) GROUP BY 1, 2, 3, 4)
SELECT k, CAST(i AS INT) AS i, round((s - m) / greatest(d, 0.02), 4) AS z FROM d""")
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    scores = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(order).alias("i"), F.round(F.col("l_tax") * 100).cast("int").alias("s"))
    return marks.robust_z(scores, ["k"], "i", "s").select("k", "i", F.round("z", 4).alias("z"))


@query("""
SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn) AS text, min(CAST(length(text) AS DOUBLE)) AS conf FROM conversations GROUP BY conv_id""")
def assemble_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.left("role", F.lit(1)).alias("s"), F.length("text").cast("double").alias("c"))
    return marks.assemble(rows, ["conv_id"], "turn", "s", "c")


@query("""
SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(props, '[1-9]'))), ',') AS digits FROM events""")
def digits_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(K.picked_digits(F.col("props")).cast("array<string>"), ",").alias("digits"))


@query("""SELECT event_id % 100 AS img_id, event_id AS call_no, 'k' AS qkey, CAST(props ->> '$.k' AS VARCHAR) AS value FROM events""")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers out of replies with text around the JSON."""
    raw = F.concat(F.lit('```json {"page": "1", "answers": '), F.col("props"), F.lit("}```"))
    replies = _table(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("img_id"), F.lit("page").alias("kind"), F.col("event_id").alias("call_no"), raw.alias("raw"))
    return reads.parse_page_reads(replies).select("img_id", "call_no", "qkey", "value")


@query("""
SELECT year(o_orderdate) AS img_id, count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'F') AS "X",
       count(*) FILTER (WHERE o_orderstatus = 'P') AS "HOLD" FROM orders GROUP BY 1""")
def verdict_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of verdicts by page."""
    verdict = F.when(F.col("o_orderstatus") == "O", K.RIGHT).when(F.col("o_orderstatus") == "F", K.WRONG).when(F.col("o_orderstatus") == "P", K.HOLD)
    results = _table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("img_id"), verdict.alias("verdict"))
    pages = results.select("img_id").distinct().withColumn("page_no", F.lit("1")).withColumn("hold_reason", F.lit(""))
    return grading.page_counts(pages, results).select("img_id", "O", "X", "HOLD")


@query("""
SELECT o_custkey AS img_id, CAST(o_orderkey AS VARCHAR) AS question_no, 0 AS x1, CAST(o_totalprice AS INT) AS y1, 100 AS x2,
       CAST(trunc(coalesce(lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), 1000000.0)) AS INT) AS y2
FROM (SELECT o_custkey, o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders)""")
def block_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("y1", F.col("o_totalprice").cast("int").cast("double"))
    order = Window.partitionBy("o_custkey").orderBy("y1", "o_orderkey")
    anchors = orders.select(F.col("o_custkey").alias("img_id"), F.row_number().over(order).alias("e"), F.col("o_orderkey").cast("string").alias("question_no"), F.lit(0).alias("col_no"), F.lit(0).alias("cx1"), F.lit(100).alias("cx2"), "y1")
    dims = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("img_id"), F.lit(1000000.0).alias("img_h"))
    return layout.cut_blocks(anchors, dims)


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey || ' · unit' WHEN 1 THEN 'unit · ' || (p_partkey % 1000) WHEN 2 THEN 'none' ELSE '  ' || (p_partkey % 500) || ' x ' || (p_partkey % 7) END AS s FROM part)
SELECT p_partkey, coalesce(nullif(regexp_extract(s, '^\\s*(\\d{1,3})(?:\\D|$)', 1), ''), nullif(regexp_extract(s, '(?:^|\\D)(\\d{1,3})\\s*$', 1), ''), '') AS page FROM t""")
def page_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = (
        F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(" · unit")))
        .when(k % 4 == 1, F.concat(F.lit("unit · "), (k % 1000).cast("string")))
        .when(k % 4 == 2, "none")
        .otherwise(F.concat(F.lit("  "), (k % 500).cast("string"), F.lit(" x "), (k % 7).cast("string")))
    )
    found = K.page_candidates(text)
    return _table(spark, sf_dir, "part").select("p_partkey", F.coalesce(found[0], found[1], F.lit("")).alias("page"))


@query("""
WITH c AS (SELECT l_orderkey AS k, l_partkey % 1000 AS cx, l_suppkey * 13 % 1400 AS cy, CAST(l_linenumber AS VARCHAR) AS page FROM lineitem),
n AS (SELECT k, least(cx, 1000 - cx) AS edge, page FROM c WHERE cy >= 0.9 * 1400 AND least(cx, 1000 - cx) <= 250)
SELECT k, page FROM (SELECT k, page, row_number() OVER (PARTITION BY k ORDER BY edge, page) AS i FROM n) WHERE i = 1""")
def edge_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 1000).alias("cx"), (F.col("l_suppkey") * 13 % 1400).alias("cy"), F.lit(1000).alias("img_w"), F.lit(1400).alias("img_h"), F.col("l_linenumber").cast("string").alias("page")
    )
    return layout.edge_candidate(line, ["k"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'x = ' || o_custkey END AS value FROM orders""")
def two_read_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads that differ in spaces agree; one that declines, or differs, holds."""
    k = F.col("o_orderkey")
    first = F.concat(F.lit("x = "), F.col("o_custkey").cast("string"))
    second = F.when(k % 5 == 0, "unsure").when(k % 7 == 0, F.concat(F.lit("x="), (F.col("o_custkey") + 1).cast("string"))).otherwise(F.concat(F.lit(" x="), F.col("o_custkey").cast("string")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", reads.two_reads_agree(first, second).alias("value"))


@query("""
SELECT r_name AS book, n_nationkey % 3 AS page, CAST(n_nationkey AS VARCHAR) AS question_no, 'multiple_choice' AS qtype,
       array_to_string(regexp_extract_all(CAST(n_nationkey * 7 + 1 AS VARCHAR), '[1-9]'), ',') AS answer
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the worksheet with a title."""
    nation = _table(spark, sf_dir, "nation")
    questions = nation.select(
        F.col("n_regionkey").alias("worksheet_id"), (F.col("n_nationkey") % 3).alias("page"), F.col("n_nationkey").cast("string").alias("question_number"), F.lit(" MULTIPLE_CHOICE ").alias("type"), (F.col("n_nationkey") * 7 + 1).cast("string").alias("correct_answer"), F.lit(None).cast("int").alias("num_choices")
    )
    worksheets = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"))
    found = mapped_questions(questions, worksheets, " asia ")
    return found.select("book", F.col("page").cast("int").alias("page"), "question_no", "qtype", F.array_join("answer", ",").alias("answer"))


@query("""
WITH p AS (SELECT DISTINCT CAST(l_quantity AS INT) AS a, 1 + l_linenumber AS b, CAST(round(l_discount * 100) AS INT) AS c FROM lineitem)
SELECT a, b, c, CASE WHEN b = 8 THEN NULL ELSE a * 20 = (2 * a + c % 2) * 10 END AS same FROM p""")
def math_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions against decimals; what does not parse is null."""
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("a"), (1 + F.col("l_linenumber")).alias("b"), F.round(F.col("l_discount") * 100).cast("int").alias("c"))
    said = F.when(F.col("b") == 8, "@#$!").otherwise(F.format_string("x = (%d*%d)/(%d*2)", F.col("a"), F.col("b"), F.col("b")))
    # a / 2 against (2a + c % 2) / 4, written with two decimals
    want = F.format_string("%s", F.concat(F.floor((2 * F.col("a") + F.col("c") % 2) / 4).cast("string"), F.lit("."), F.lpad(((2 * F.col("a") + F.col("c") % 2) % 4 * 25).cast("string"), 2, "0")))
    rows = pairs.withColumn("s", F.array(said)).withColumn("w", F.array(want))
    return with_equality(rows, "s", "w", "same").groupBy("a", "b", "c").agg(F.any_value("same").alias("same"))


@query("""
WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_orderkey + o_custkey % 3 AS VARCHAR) AS b FROM orders),
c AS (SELECT a, b, (SELECT count(*) FROM range(1, 20) r(i) WHERE i <= least(length(a), length(b)) AND substr(a, i::INT, 1) = substr(b, i::INT, 1)) AS s, greatest(length(a), length(b)) AS l FROM t)
SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 8) AS exact, round(CAST(sum(s) AS DOUBLE) / sum(l), 8) AS chars FROM c""")
def char_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("a"), (F.col("o_orderkey") + F.col("o_custkey") % 3).cast("string").alias("b"))
    out = marks.char_accuracy(rows, "a", "b")
    return out.select(F.round("exact", 8).alias("exact"), F.round("chars", 8).alias("chars"))


@query("""
WITH s AS (SELECT o_custkey AS k, CAST(o_orderkey % 10000 AS INT) AS a, CAST(o_orderkey % 10000 + 20 + o_custkey % 50 AS INT) AS b FROM orders),
m AS (SELECT k, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 THEN 0 ELSE 1 END AS n FROM s),
g AS (SELECT k, a, b, sum(n) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, g""")
def rect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 10000).cast("int").alias("a"), (F.col("o_orderkey") % 10000 + 20 + F.col("o_custkey") % 50).cast("int").alias("b"))
    return marks.merge_spans(spans, ["k"])


@query("""
WITH k AS (SELECT s_nationkey AS page, s_suppkey AS q, s_suppkey % 5 + 1 AS answer FROM supplier),
v AS (SELECT k.page, k.q, k.answer, CASE WHEN k.q % 9 = 0 THEN NULL ELSE (k.q * 3) % 5 + 1 END AS r FROM k)
SELECT CAST(page AS VARCHAR) AS page_no, count(*) FILTER (WHERE r = answer) AS "O", count(*) FILTER (WHERE r <> answer) AS "X", count(*) FILTER (WHERE r IS NULL) AS "HOLD"
FROM v GROUP BY page""")
def grade_fullpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole page grading: parsed and merged reads, inferred pages, verdicts and counts."""
    supplier = _table(spark, sf_dir, "supplier")
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    number = F.col("s_suppkey").cast("string")
    key = supplier.select(
        F.lit("book").alias("book"), F.lit("book").alias("book_key"), F.col("s_nationkey").cast("string").alias("page"), (F.row_number().over(order) - 1).alias("ord"), number.alias("question_no"), number.alias("qkey"),
        F.lit(K.MCQ).alias("qtype"), F.array((F.col("s_suppkey") % 5 + 1).cast("string")).alias("answer"), F.lit(5).alias("num_choices"),
    )
    said = F.format_string('"%s": "%s"', F.lpad(number, 6, "0"), F.when(F.col("s_suppkey") % 9 == 0, "").otherwise((F.col("s_suppkey") * 3 % 5 + 1).cast("string")))
    raw = F.concat(F.lit('{"page": "?", "answers": {'), F.array_join(F.collect_list(said), ", "), F.lit("}}"))
    replies = supplier.groupBy(F.concat(F.lit("img"), "s_nationkey").alias("img_id")).agg(raw.alias("raw"))
    model_reads = replies.select("img_id", F.lit("page").alias("kind"), F.lit(None).cast("string").alias("question_no"), F.explode(F.array(F.lit(0), F.lit(1))).alias("call_no"), "raw")
    submissions = replies.select("img_id", F.lit(" Book ").alias("book"), F.lit(None).cast("string").alias("page_hint"))
    _, pages = grading.grade_fullpage(submissions, reads.merge_votes(reads.parse_page_reads(model_reads)), key)
    return pages.select("page_no", "O", "X", "HOLD")
