"""Answer keys: JSON files, tables and JDBC, as one flat table.

answer_key: book, book_key, page, ord, question_no, qkey, qtype, answer (array of strings),
num_choices. A page without questions has one row whose question_no is null.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import MCQ, SUBJECTIVE, book_key, question_key

QUESTION = "struct<question_no:string,type:string,answer:variant,num_choices:string>"
BOOK = f"book string, pages map<string,array<{QUESTION}>>, _corrupt_record string"
DEFAULT_CHOICES = 5
KEY = "book string, book_key string, page string, ord int, question_no string, qkey string, qtype string, answer array<string>, num_choices int"
COLUMNS = ("book", "book_key", "page", "ord", "question_no", "qkey", "qtype", "answer", "num_choices")


def _choices(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(DEFAULT_CHOICES))


def book_index(spark: SparkSession, folder: str) -> DataFrame:
    """book, book_key, path and pages of each readable JSON file; of equal books the first path stays."""
    raw = spark.read.schema(BOOK).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder, pathGlobFilter="*.json")
    named = raw.select("*", F.col("_metadata.file_path").alias("path")).where(F.col("_corrupt_record").isNull())
    keyed = named.withColumn("book_key", book_key(F.col("book"))).where("book_key <> ''")
    first = Window.partitionBy("book_key").orderBy("path")
    return keyed.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "_corrupt_record")


def json_answer_key(spark: SparkSession, folder: str) -> DataFrame:
    """answer_key of a folder of JSON files. A book with an unknown question type, or without pages, is left out whole."""
    books = book_index(spark, folder).where("pages IS NOT NULL")
    pages = books.select("book", "book_key", F.explode("pages").alias("page", "questions"))
    rows = pages.select("book", "book_key", "page", F.posexplode_outer("questions").alias("ord", "q"))
    scalar = F.expr("try_variant_get(q.answer, '$', 'string')")
    flat = rows.select(
        "book", "book_key", "page", "ord", F.col("q.question_no").alias("question_no"), question_key(F.col("q.question_no")).alias("qkey"), F.col("q.type").alias("qtype"),
        F.coalesce(F.expr("try_variant_get(q.answer, '$', 'array<string>')"), F.when(scalar.isNotNull(), F.array(scalar))).alias("answer"),
        F.when(F.col("q").isNotNull(), _choices(F.col("q.num_choices"))).alias("num_choices"),
    )
    bad = flat.where(F.col("question_no").isNotNull() & ~F.coalesce(F.col("qtype").isin(MCQ, SUBJECTIVE), F.lit(False))).select("book_key").distinct()
    return flat.join(bad, "book_key", "left_anti").select(*COLUMNS)


def mapped_questions(questions: DataFrame, worksheets: DataFrame, title: str | None = None) -> DataFrame:
    """answer_key of the tables question and worksheet, for one title or all."""
    named = worksheets if title is None else worksheets.where(book_key(F.col("title")) == book_key(F.lit(title)))
    rows = questions.join(named.select(F.col("id").alias("worksheet_id"), "title"), "worksheet_id")
    kind = F.lower(F.trim("type"))
    digits = F.regexp_extract_all(F.col("correct_answer"), F.lit("[1-9]"), F.lit(0))
    answer = F.when((kind == MCQ) & (F.size(digits) > 0), digits).otherwise(F.array("correct_answer"))
    number = F.col("question_number").cast("string")
    order = Window.partitionBy("title", "page").orderBy(F.expr("try_cast(question_number AS int)"), number)
    return rows.select(
        F.col("title").alias("book"), book_key(F.col("title")).alias("book_key"), F.col("page").cast("string").alias("page"), (F.row_number().over(order) - 1).alias("ord"),
        number.alias("question_no"), question_key(number).alias("qkey"), kind.alias("qtype"), answer.alias("answer"), F.coalesce(F.col("num_choices").cast("int"), F.lit(DEFAULT_CHOICES)).alias("num_choices"),
    )


#: Seconds until a database that does not answer counts as failed.
TIMEOUT = "10"
#: Parts that the questions of a book are read in, each a range of worksheets' numbers.
PARTS = 8
_ASCII = re.compile(r"[^a-z0-9]+")


def title_pattern(title: str) -> str:
    """A LIKE pattern that the lower-cased title of a book with this name fits: its plain letters and digits, in order.

    What else is in a title, blanks and their number included, is compared by Spark; a pattern without quotes or wildcards of its own is safe to be put in a query.
    """
    return "%" + "%".join(x for x in _ASCII.split(title.lower()) if x) + "%"


def _jdbc(spark: SparkSession, title: str | None, question: str, worksheet: str, options: dict[str, str]) -> DataFrame:
    """The two tables, for one title only its worksheets and their questions; no rows, with a warning, where the database does not answer.

    The title is asked of the database as a pattern, then compared as a book's name; questions are asked for by worksheet, in ranges of their numbers.
    """
    try:
        return _asked(spark, title, question, worksheet, {"queryTimeout": TIMEOUT, **options})
    except Exception as error:  # noqa: BLE001  a database that fails has no book
        warnings.warn(f"the answer key could not be read: {str(error)[:300]}", stacklevel=3)
        return spark.createDataFrame([], KEY)


def _asked(spark: SparkSession, title: str | None, question: str, worksheet: str, options: dict[str, str]) -> DataFrame:
    read = lambda table, **more: spark.read.format("jdbc").options(**options, dbtable=table, **more).load()
    sheets, rows = read(worksheet), read(question)
    if title is not None:
        named = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier("title")  # as Spark itself asks for it
        may_be = read(f"(SELECT DISTINCT {named} FROM {worksheet} WHERE LOWER({named}) LIKE '{title_pattern(title)}') named")
        spelled = [r.title for r in may_be.where(book_key(F.col("title")) == book_key(F.lit(title))).collect()]  # a book's name in its spellings
        sheets = sheets.where(F.col("title").isin(spelled))
        ids = [r.id for r in sheets.select("id").distinct().limit(WORKSHEETS + 1).collect()]
        if len(ids) <= WORKSHEETS:
            return mapped_questions(rows.where(F.col("worksheet_id").isin(ids)), sheets)
    told = sheets.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()  # asked now, so that a failure is seen here
    if told.low is not None and dict(rows.dtypes)["worksheet_id"].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "decimal"):
        low, high = int(told.low), int(told.high)
        rows = read(question, partitionColumn="worksheet_id", lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(max(1, min(PARTS, high + 1 - low))))
        rows = rows.where(F.col("worksheet_id").between(low, high))
    return mapped_questions(rows, sheets)


#: Worksheets of one title whose questions are asked for by number; of more by the range of their numbers.
WORKSHEETS = 1_000


def read_answer_key(spark: SparkSession, backend: str = "json", **options: str) -> DataFrame:
    """answer_key from `json` (folder), `tables` (question, worksheet: names of tables or views) or `jdbc` (url, question, worksheet, ...).

    An unknown backend is `json`, with a warning. With a title, `jdbc` asks the database for what may be that book, whatever its capitals and blanks.
    """
    if backend == "tables":
        return mapped_questions(spark.table(options["question"]), spark.table(options["worksheet"]), options.get("title"))
    if backend == "jdbc":
        names = {"question", "worksheet", "title"}
        return _jdbc(spark, options.get("title"), options.get("question", "question"), options.get("worksheet", "worksheet"), {k: v for k, v in options.items() if k not in names})
    if backend != "json":
        warnings.warn(f"unknown backend {backend!r}; json is used", stacklevel=2)
    return json_answer_key(spark, options["folder"])


def find_book(answer_key: DataFrame, name: str) -> DataFrame:
    """Rows of one book; none for a blank or unknown name."""
    return answer_key.where((F.col("book_key") == book_key(F.lit(name))) & (F.col("book_key") != ""))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, image of the pictures of a folder, by path; one that can't be decoded has height -1."""
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    return found.select(F.col("image.origin").alias("path"), "image").where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")).orderBy("path")


def decoded_base64(text: Column) -> Column:
    """Bytes of strict base64; null for anything else, empty included."""
    strict = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
    return F.when((text != "") & text.rlike(strict), F.try_to_binary(text, F.lit("base64")))
