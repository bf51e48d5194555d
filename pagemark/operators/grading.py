"""Verdicts. What is uncertain is null inside and HOLD outside, never wrong.

results: img_id, page_no, ord, question_no, verdict, student_answer, detail
page_results: img_id, page_no, hold_reason, O, X, HOLD
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equivalence import with_equality
from ..functions.keys import HOLD, MCQ, RIGHT, WRONG, book_key, picked_digits
from ..sources.shared import tasks

#: Images that a task works on.
IMAGES = 50_000
# Reasons for a hold.
UNCLEAR, NO_MARK, NOT_PARSED, BAD_KEY = "unclear reading", "unclear marking", "not parsed", "answer key is not a number"
NO_PAGE, NO_READER, NO_BLOCK, UNKNOWN_PAGE = "page not recognised", "no reader", "no block", "page not in the answer key"


def verdict(equal: Column) -> Column:
    """Three values to three verdicts."""
    return F.when(equal.isNull(), F.lit(HOLD)).when(equal, F.lit(RIGHT)).otherwise(F.lit(WRONG))


def mcq_equal(picked: Column, answer: Column) -> Column:
    """Is the set of picked digits (distinct ones) the key's? Null without either, or if the key is not all numbers."""
    key = F.transform(answer, lambda a: a.try_cast("int"))
    usable = (F.size(picked) > 0) & (F.size(key) > 0) & ~F.exists(key, lambda k: k.isNull())
    return F.when(usable, F.sort_array(picked) == F.sort_array(F.array_distinct(key)))


def page_classes(answer_key: DataFrame) -> DataFrame:
    """book_key, qkey, pages: for each question of a book the pages that have it, of pages with the same questions only the smallest.

    They always get the same votes and the smallest wins, so a book whose numbers begin anew on every page has as many pages here as there are different
    sets of numbers. A page's numbers are a page's size; a question's pages are the book's classes at most.
    """
    page = answer_key.where("qkey IS NOT NULL").groupBy("book_key", "page").agg(F.array_sort(F.collect_set("qkey")).alias("_set"))
    first = page.groupBy("book_key", "_set").agg(F.min("page").alias("_page"))
    return first.select("book_key", "_page", F.explode("_set").alias("qkey")).groupBy("book_key", "qkey").agg(F.collect_list("_page").alias("pages"))


def infer_page(reads: DataFrame, answer_key: DataFrame) -> DataFrame:
    """img_id, book_key, inferred: the page that most of the read keys are on; of equal ones the smallest. reads: img_id, book_key, qkey.

    A read meets one row of the key; votes are summed in the tasks before they are shuffled.
    """
    met = reads.select("img_id", "book_key", "qkey").distinct().join(page_classes(answer_key), ["book_key", "qkey"])
    hits = met.select("img_id", "book_key", F.explode("pages").alias("_page")).groupBy("img_id", "book_key", "_page").agg(F.count("*").alias("n"))
    return hits.groupBy("img_id", "book_key").agg(F.min_by("_page", F.struct(-F.col("n"), F.col("_page"))).alias("inferred"))


def _answers() -> Column:
    """A map of values by question key; of several values of one key the smallest."""
    listed = F.sort_array(F.collect_list(F.when(F.col("qkey").isNotNull(), F.struct("qkey", "value"))))
    once = F.filter(listed, lambda x, k: (k == 0) | (F.get(listed, k - 1)["qkey"] != x["qkey"]))
    return F.map_from_entries(once)


def resolve_page(submissions: DataFrame, merged: DataFrame, answer_key: DataFrame) -> DataFrame:
    """img_id, book_key, page_no, known, read, answers: hint, else inferred, else stated page; known if the book has it.

    read: there is a read of the image; answers: its values by question key, attached once the page is chosen.
    Both tables are dealt by images, and what was chosen by pages, IMAGES a task.
    """
    n = tasks(submissions, IMAGES)
    submissions, merged = (x.repartition(n, "img_id") for x in (submissions, merged))
    asked = submissions.select("img_id", book_key(F.col("book")).alias("book_key"), F.nullif("page_hint", F.lit("")).alias("hint"))
    each = merged.groupBy("img_id").agg(F.first("page", True).alias("stated"), _answers().alias("answers"))
    # a hint decides without votes
    votes = asked.where("hint IS NULL").select("img_id", "book_key").distinct().join(merged.where("qkey IS NOT NULL").select("img_id", "qkey"), "img_id")
    pages = answer_key.select("book_key", F.col("page").alias("page_no")).distinct().withColumn("known", F.lit(True))
    named = asked.join(each, "img_id", "left").join(infer_page(votes, answer_key), ["img_id", "book_key"], "left")
    chosen = named.select("img_id", "book_key", F.coalesce("hint", "inferred", "stated").alias("page_no"), "answers")
    chosen, pages = (x.repartition(n, "book_key", "page_no") for x in (chosen, pages))
    return chosen.join(pages, ["book_key", "page_no"], "left").select("img_id", "book_key", "page_no", F.coalesce("known", F.lit(False)).alias("known"), F.col("answers").isNotNull().alias("read"), "answers")


def grade_questions(questions: DataFrame) -> DataFrame:
    """questions with verdict, student_answer and detail, from qtype, answer and raw (the full-page reading; null if absent)."""
    raw, mcq = F.trim(F.coalesce("raw", F.lit(""))), F.col("qtype") == MCQ
    # columns that can clash with no other: longer than any here
    before = "_" + max(questions.columns, key=len)
    said, equal_, picks = f"{before}_said", f"{before}_same", f"{before}_picks"
    rows = with_equality(questions.withColumns({said: F.when(~mcq & (raw != ""), F.array(raw)), picks: F.when(mcq, picked_digits(raw))}), said, "answer", equal_)
    picked = F.col(picks)
    equal = F.when(mcq, mcq_equal(picked, F.col("answer"))).otherwise(F.col(equal_))
    marked = F.array_join(picked.cast("array<string>"), ",")
    detail = (
        F.when(raw == "", F.lit(UNCLEAR))
        .when(mcq & (F.size(picked) == 0), F.lit(NO_MARK))
        .when(equal.isNull(), F.when(mcq, F.lit(BAD_KEY)).otherwise(F.lit(NOT_PARSED)))
        .otherwise(F.lit(""))
    )
    return rows.select(*questions.columns, verdict(F.when(raw != "", equal)).alias("verdict"), F.when(mcq, marked).otherwise(raw).alias("student_answer"), detail.alias("detail"))


def grade_fullpage(submissions: DataFrame, merged: DataFrame, answer_key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results and page_results from merged page reads (img_id, page, qkey, value). submissions: img_id, book, page_hint."""
    where = resolve_page(submissions, merged, answer_key)
    reason = F.when(~F.col("read"), F.lit(NO_READER)).when(~F.col("known"), F.lit(NO_PAGE)).otherwise(F.lit(""))
    key = answer_key.where("question_no IS NOT NULL").select(F.col("book_key").alias("_book"), F.col("page").alias("_page"), "ord", "question_no", "qkey", "qtype", "answer")
    listed = where.withColumn("hold_reason", reason).join(key, F.col("known") & (where["book_key"] == key["_book"]) & (where["page_no"] == key["_page"]), "left")
    asked = listed.select("img_id", "page_no", "hold_reason", "ord", "question_no", "qtype", "answer", F.try_element_at("answers", F.col("qkey")).alias("raw"))
    graded = grade_questions(asked)
    results = graded.where("question_no IS NOT NULL AND hold_reason = ''").select("img_id", "page_no", "ord", "question_no", "verdict", "student_answer", "detail")
    pages = graded.groupBy("img_id", F.coalesce("page_no", F.lit("")).alias("page_no"), "hold_reason").agg(*_counts(F.col("question_no").isNotNull(), F.col("hold_reason") != ""))
    return results, pages


def _counts(there: Column, held: Column) -> list[Column]:
    """O, X and HOLD over the questions that are there; where a page is held all are HOLD."""
    count = lambda name, some: F.count_if(there & some).cast("long").alias(name)
    is_ = lambda v: F.col("verdict") == v
    return [count("O", ~held & is_(RIGHT)), count("X", ~held & is_(WRONG)), count("HOLD", held | is_(HOLD))]


def grade(mode: str, submissions: DataFrame, model_reads: DataFrame, answer_key: DataFrame, boxes: DataFrame | None = None, dims: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """results and page_results by `fullpage` (replies for whole pages) or `blocks` (OCR boxes and replies for each question)."""
    from .layout import analyze_layout
    from .reads import merge_votes, parse_page_reads

    if mode == "fullpage":
        return grade_fullpage(submissions, merge_votes(parse_page_reads(model_reads)), answer_key)
    if mode == "blocks":
        return grade_blocks(*analyze_layout(boxes, dims, answer_key, submissions), model_reads, answer_key, submissions)
    raise ValueError(f"unknown mode {mode!r}")


def page_counts(pages: DataFrame, results: DataFrame) -> DataFrame:
    """page_results: counts of the verdicts; on a page that is held all listed questions are HOLD."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    counted = results.groupBy("img_id").agg(count(RIGHT).alias("o"), count(WRONG).alias("x"), count(HOLD).alias("h"), F.count("*").alias("n"))
    held = F.col("hold_reason") != ""
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return pages.join(counted, "img_id", "left").select(
        "img_id", "page_no", "hold_reason",
        F.when(held, F.lit(0)).otherwise(some(F.col("o"))).cast("long").alias("O"), F.when(held, F.lit(0)).otherwise(some(F.col("x"))).cast("long").alias("X"),
        F.when(held, some(F.col("n"))).otherwise(some(F.col("h"))).cast("long").alias("HOLD"),
    )


def totals(page_results: DataFrame) -> DataFrame:
    """O, X and HOLD over all pages."""
    return page_results.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("O", "X", "HOLD")))


def grade_blocks(blocks: DataFrame, page_holds: DataFrame, model_reads: DataFrame, answer_key: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results and page_results from question blocks (img_id, question_no, ...) and their reads.

    page_holds: img_id, page_no, hold_reason. A held page lists all its expected questions as HOLD.
    """
    from .reads import math_reads, mcq_reads

    asked = submissions.select("img_id", book_key(F.col("book")).alias("book_key"))
    pages = page_holds.join(asked, "img_id")
    expected = pages.join(answer_key.where("question_no IS NOT NULL"), (pages["book_key"] == answer_key["book_key"]) & (pages["page_no"] == answer_key["page"])).select(
        "img_id", "page_no", "hold_reason", "ord", "question_no", "qtype", "answer"
    )
    rows = (
        expected.join(blocks.select("img_id", "question_no").distinct().withColumn("_block", F.lit(True)), ["img_id", "question_no"], "left")
        .join(mcq_reads(model_reads), ["img_id", "question_no"], "left")
        .join(math_reads(model_reads), ["img_id", "question_no"], "left")
        .withColumn("_said", F.when(F.col("qtype") != MCQ, F.array("value")))
    )
    rows = with_equality(rows.withColumn("_said", F.when(F.col("value").isNotNull(), F.col("_said"))), "_said", "answer", "_same")
    mcq = F.col("qtype") == MCQ
    read = F.when(mcq, F.col("picked").isNotNull()).otherwise(F.col("value").isNotNull())
    equal = F.when(mcq, mcq_equal(F.col("picked"), F.col("answer"))).otherwise(F.col("_same"))
    open_ = (F.col("hold_reason") == "") & F.col("_block").isNotNull() & read
    detail = (
        F.when(F.col("hold_reason") != "", F.col("hold_reason"))
        .when(F.col("_block").isNull(), F.lit(NO_BLOCK))
        .when(~read, F.lit(UNCLEAR))
        .when(equal.isNull(), F.when(mcq, F.lit(BAD_KEY)).otherwise(F.lit(NOT_PARSED)))
        .otherwise(F.lit(""))
    )
    said = F.when(mcq, F.array_join(F.col("picked").cast("array<string>"), ",")).otherwise(F.col("value"))
    results = rows.select("img_id", "page_no", "ord", "question_no", verdict(F.when(open_, equal)).alias("verdict"), F.when(open_, F.coalesce(said, F.lit(""))).otherwise("").alias("student_answer"), detail.alias("detail"))
    return results, page_counts(page_holds.select("img_id", F.coalesce("page_no", F.lit("")).alias("page_no"), F.coalesce("hold_reason", F.lit("")).alias("hold_reason")), results)


def status(request: DataFrame, answer_key: DataFrame, pictures: bool = False) -> DataFrame:
    """request with status: 422 for a missing field or unknown source, 400 for bad base64, 404 for an unknown book, else 200.

    pictures: bytes that are no picture by their header give 400 too.
    """
    from ..sources.answers import decoded_base64
    from ..sources.pictures import picture_header

    books = answer_key.select(F.col("book_key").alias("_book")).distinct()
    source = F.upper(F.coalesce("workSheetSource", F.lit("WORKBOOK")))
    out = request.join(books, book_key(F.col("name")) == books["_book"], "left")
    missing = F.col("name").isNull() | F.col("image_base64").isNull() | ~source.isin("WORKBOOK", "EXAM")
    # bytes of requests that are refused before are not looked at
    data = F.when(~missing, decoded_base64(F.col("image_base64")))
    unreadable = picture_header(data)["kind"].isNull() if pictures else data.isNull()
    code = F.when(missing, 422).when(unreadable, 400).when(F.col("_book").isNull(), 404).otherwise(200)
    return out.select(*request.columns, code.alias("status"))
