from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from pagemark import __main__ as job
from pagemark.operators import grading, reads
from pagemark.plans import report
from pagemark.sources import answers

BOOK = {
    "book": "Winter  Sheets",
    "pages": {
        "31": [
            {"question_no": "1", "type": "multiple_choice", "answer": 4, "num_choices": 6},
            {"question_no": "2", "type": "multiple_choice", "answer": 1},
            {"question_no": "3", "type": "subjective", "answer": "48/6"},
            {"question_no": "7-1", "type": "subjective", "answer": ["0.5", "-9"]},
        ],
        "32": [{"question_no": 21, "type": "multiple_choice", "answer": [2, 4]}, {"question_no": "22", "type": "multiple_choice", "answer": "word"}],
        "33": [],
    },
}


@pytest.fixture(scope="module")
def key(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    for name, content in {
        "a.json": json.dumps(BOOK), "b.json": json.dumps({**BOOK, "book": " winter sheets ", "pages": {}}), "c.json": "{broken", "d.json": json.dumps({"book": " ", "pages": {}}),
        "e.json": json.dumps({"book": "bad", "pages": {"1": [{"question_no": "1", "type": "essay", "answer": 1}]}}), "f.json": json.dumps({"book": "no pages"}),
    }.items():
        (folder / name).write_text(content)
    return answers.read_answer_key(spark, "json", folder=str(folder)).cache()


def test_answer_key(key):
    rows = {(r.page, r.ord): r for r in key.collect()}
    assert {r.book_key for r in rows.values()} == {"winter sheets"}
    assert rows["31", 0].answer == ["4"] and (rows["31", 0].num_choices, rows["31", 1].num_choices) == (6, 5) and rows["31", 3].answer == ["0.5", "-9"]
    assert rows["32", 0].question_no == "21" and rows["32", 0].answer == ["2", "4"]
    assert [r.question_no for (p, _), r in rows.items() if p == "33"] == [None]
    assert answers.find_book(key, " WINTER sheets").count() == len(rows) and answers.find_book(key, "").count() == 0 and answers.find_book(key, "bad").count() == 0


def test_an_unknown_backend_is_json_with_a_warning(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(BOOK))
    with pytest.warns(UserWarning, match="unknown backend"):
        assert answers.read_answer_key(spark, "oracle", folder=str(tmp_path)).count() == 7


def test_a_title_is_asked_of_the_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, "Winter Sheets"), (2, "other")], "id long, title string").write.option("createTableColumnTypes", "title VARCHAR(99)").jdbc(url, "worksheet", properties=driver)
    rows = [(1, 12, "46", "MULTIPLE_CHOICE", "2,4", 4), (2, 1, "1", "SUBJECTIVE", "9", 5)]
    spark.createDataFrame(rows, "worksheet_id long, page int, question_number string, type string, correct_answer string, num_choices int").write.jdbc(url, "question", properties=driver)
    one = answers.read_answer_key(spark, "jdbc", url=url, title="Winter Sheets", **driver)
    assert [(r.question_no, r.answer) for r in one.collect()] == [("46", ["2", "4"])]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(worksheet_id,1)" in plan and "EqualTo(title,Winter Sheets)" in plan
    assert answers.read_answer_key(spark, "jdbc", url=url, **driver).count() == 2
    assert answers.read_answer_key(spark, "jdbc", url=url, title="none", **driver).count() == 0


def test_spellings_ranges_and_failures_of_a_database(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    sheets = [(1, "Winter  SHEETS"), (2, " winter sheets "), (3, "Winter Sheets 2"), (4, "It's 100% 'Ä'"), (40, "other")]
    spark.createDataFrame(sheets, "id long, title string").write.option("createTableColumnTypes", "title VARCHAR(99)").jdbc(url, "worksheet", properties=driver)
    rows = [(i, 1, f"{i}", "SUBJECTIVE", "9", 5) for i, _ in sheets]
    spark.createDataFrame(rows, "worksheet_id long, page int, question_number string, type string, correct_answer string, num_choices int").write.jdbc(url, "question", properties=driver)
    told = lambda title=None: {r.question_no for r in answers.read_answer_key(spark, "jdbc", url=url, **({"title": title} if title else {}), **driver).collect()}
    assert told("winter sheets") == {"1", "2"} and told("it's  100% 'ä'") == {"4"} and told("%") == set() and told("'; DROP TABLE worksheet; --") == set()
    assert told() == {"1", "2", "3", "4", "40"}
    everything = answers.read_answer_key(spark, "jdbc", url=url, **driver)
    plan = everything._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(worksheet_id,1)" in plan and "LessThanOrEqual(worksheet_id,40)" in plan
    monkeypatch.setattr(answers, "WORKSHEETS", 1)
    assert told("winter sheets") == {"1", "2"}
    with pytest.warns(UserWarning, match="could not be read"):
        none = answers.read_answer_key(spark, "jdbc", url=f"jdbc:derby:{tmp_path}/nowhere", title="winter sheets", **driver)
    assert none.count() == 0 and none.columns == everything.columns


def test_mapped_questions(spark):
    questions = spark.createDataFrame(
        [(1, 12, "46", "MULTIPLE_CHOICE", "2,4", 4), (1, 13, "47", "SUBJECTIVE", "1/2", None), (2, 1, "1", "SUBJECTIVE", "9", None)],
        "worksheet_id long, page int, question_number string, type string, correct_answer string, num_choices int",
    )
    sheets = spark.createDataFrame([(1, "W One"), (2, "other")], "id long, title string")
    got = {r.question_no: r for r in answers.mapped_questions(questions, sheets, " w  one").collect()}
    assert set(got) == {"46", "47"}
    assert (got["46"].qtype, got["46"].answer, got["46"].num_choices, got["46"].page) == ("multiple_choice", ["2", "4"], 4, "12")
    assert (got["47"].answer, got["47"].num_choices) == (["1/2"], 5)
    assert answers.mapped_questions(questions, sheets, "none").count() == 0


def page_reads(spark, raws, img="a"):
    rows = [(img, "page", None, k, r) for k, r in enumerate(raws)]
    return spark.createDataFrame(rows, "img_id string, kind string, question_no string, call_no int, raw string")


def merged(spark, raws, **options):
    out = reads.merge_votes(reads.parse_page_reads(page_reads(spark, raws)), **options).collect()
    return {r.page for r in out}, {r.qkey: r.value for r in out if r.qkey is not None}


def said(page, answers):
    return json.dumps({"page": page, "answers": answers})


def test_votes(spark):
    assert merged(spark, [said("12", {"0046": "2", "0047": "3", "48": ""}), said("12", {"0046": "2", "0047": "5", "48": ""}), said("13", {"0046": "4", "0047": "5", "48": ""})]) == ({"12"}, {"46": "2", "47": "5", "48": ""})
    assert merged(spark, [said("9", {"1": "3"}), said("9", {"1": "4"}), said("9", {"1": ""})]) == ({"9"}, {"1": "3"})
    assert merged(spark, [said("9", {"1": "3"}), said("9", {"1": "4"}), said("9", {"1": ""})], on_no_majority="hold") == ({"9"}, {"1": ""})
    assert merged(spark, [said("9", {"2": "5"}), said("9", {}), said("9", {})]) == ({"9"}, {"2": "5"})


def test_parsing_of_reads(spark):
    assert merged(spark, ['Here: {"page": 12, "answers": {"1": "2"}} ok']) == ({"12"}, {"1": "2"})
    assert merged(spark, ['{"page": 0, "answers": {"1": "a", "1": "b"}}']) == ({None}, {"1": "b"})
    assert merged(spark, ['{"page": "0", "answers": {"1": null}}']) == ({"0"}, {"1": ""})
    assert merged(spark, ['{"page": "5", "answers": [1, 2]}'])[1] == {}
    assert merged(spark, ["nothing", None]) == (set(), {})


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_order_does_not_change_a_majority(spark, order):
    raws = [said("1", {"1": "2"}), said("1", {"1": "2"}), said("2", {"1": "3"})]
    assert merged(spark, [raws[i] for i in order]) == ({"1"}, {"1": "2"})


def test_two_reads(spark):
    def agree(a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(reads.two_reads_agree(F.col("a"), F.col("b")).alias("x")).first().x

    assert agree("x=-2, 3", "x=-2,3") == "x=-2, 3"
    assert agree("unsure", "unsure") is None and agree("PRINTED", "3") is None and agree(None, "3") is None and agree("3", "4") is None


def submissions(spark, hint=None, book="winter SHEETS"):
    return spark.createDataFrame([("a", book, hint)], "img_id string, book string, page_hint string")


def graded(spark, key, raws, hint=None, book="winter SHEETS"):
    results, pages = grading.grade_fullpage(submissions(spark, hint, book), reads.merge_votes(reads.parse_page_reads(page_reads(spark, raws))), key)
    p = pages.first()
    return {r.question_no: (r.verdict, r.student_answer) for r in results.collect()}, (p.page_no, p.hold_reason, p.O, p.X, p.HOLD)


def test_full_page(spark, key):
    got = graded(spark, key, [said("99", {"0001": "4", "2": "2", "3": "8.0", "7-1": "x=-9,1/2"})])
    assert got == ({"1": ("O", "4"), "2": ("X", "2"), "3": ("O", "8.0"), "7-1": ("O", "x=-9,1/2")}, ("31", "", 3, 1, 0))
    assert graded(spark, key, [said("31", {"1": "?", "3": "@#", "7-1": ""})])[0] == {"1": ("HOLD", ""), "2": ("HOLD", ""), "3": ("HOLD", "@#"), "7-1": ("HOLD", "")}
    assert graded(spark, key, [said("32", {"21": "4,2", "22": "1"})])[0] == {"21": ("O", "2,4"), "22": ("HOLD", "1")}


def test_modes(spark, key):
    results, pages = grading.grade("fullpage", submissions(spark), page_reads(spark, [said("31", {"1": "4"})]), key)
    assert pages.first().O == 1 and results.count() == 4
    with pytest.raises(ValueError, match="unknown mode"):
        grading.grade("other", submissions(spark), page_reads(spark, []), key)


def test_page_holds(spark, key):
    assert graded(spark, key, [said("99", {"999": "1"})]) == ({}, ("99", grading.NO_PAGE, 0, 0, 0))
    assert graded(spark, key, [said("99", {"1": "4"})], hint="32")[1][0] == "32"
    assert graded(spark, key, [None]) == ({}, ("", grading.NO_READER, 0, 0, 0))


def test_counts_of_a_held_page(spark):
    pages = spark.createDataFrame([("a", "1", "why"), ("b", "1", ""), ("c", "1", "why")], "img_id string, page_no string, hold_reason string")
    results = spark.createDataFrame([("a", "O"), ("a", "X"), ("a", "HOLD"), ("b", "O"), ("b", "X"), ("b", "HOLD")], "img_id string, verdict string")
    got = {r.img_id: (r.O, r.X, r.HOLD) for r in grading.page_counts(pages, results).collect()}
    assert got == {"a": (0, 0, 3), "b": (1, 1, 1), "c": (0, 0, 0)}
    assert tuple(grading.totals(grading.page_counts(pages, results)).first()) == (1, 1, 4)


def test_blocks(spark, key):
    kinds = "img_id string, kind string, question_no string, call_no int, raw string"
    raw = spark.createDataFrame([("a", "mcq", "1", 0, "4"), ("a", "mcq", "2", 0, "NONE"), ("a", "math", "3", 0, "16/2"), ("a", "math", "3", 1, "16 / 2"), ("a", "math", "7-1", 0, "1"), ("a", "math", "7-1", 1, "2")], kinds)
    blocks = spark.createDataFrame([("a", q) for q in ("1", "2", "3")], "img_id string, question_no string")
    holds = spark.createDataFrame([("a", "31", "")], "img_id string, page_no string, hold_reason string")
    results, pages = grading.grade_blocks(blocks, holds, raw, key, submissions(spark))
    assert {r.question_no: (r.verdict, r.detail) for r in results.collect()} == {"1": ("O", ""), "2": ("HOLD", grading.UNCLEAR), "3": ("O", ""), "7-1": ("HOLD", grading.NO_BLOCK)}
    held = spark.createDataFrame([("a", "31", "why")], "img_id string, page_no string, hold_reason string")
    results, pages = grading.grade_blocks(blocks, held, raw, key, submissions(spark))
    assert {r.verdict for r in results.collect()} == {"HOLD"} and (pages.first().HOLD, pages.first().O) == (4, 0)


def test_status_report_and_response(spark, key):
    requests = spark.createDataFrame(
        [("1", "exam", "Winter Sheets", "aGk="), ("2", "EXAM", "winter sheets", "@@@"), ("3", None, "who", "aGk="), ("4", "x", "Winter Sheets", "aGk="), ("5", None, None, "aGk="), ("6", None, "winter sheets", "data:x;aGk="), ("7", None, "winter sheets", "")],
        "img_id string, workSheetSource string, name string, image_base64 string",
    )
    told = grading.status(requests, key)
    assert {r.img_id: r.status for r in told.collect()} == {"1": 200, "2": 400, "3": 404, "4": 422, "5": 422, "6": 400, "7": 400}
    results = spark.createDataFrame([("1", "12", 1, "2", "X", "4", "why"), ("1", "12", 0, "1", "O", "3", "")], "img_id string, page_no string, ord int, question_no string, verdict string, student_answer string, detail string")
    pages = spark.createDataFrame([("1", "12", "", 1, 1, 0), ("9", "", "no page", 0, 0, 0)], "img_id string, page_no string, hold_reason string, O long, X long, HOLD long")
    text = {r.img_id: r.report for r in report.format_report(results, pages).collect()}
    assert text["1"] == "== 1  (p.12)\n     1  O  [3]\n     2  X  [4]  (why)\n  -- O 1 / X 1 / HOLD 0"
    assert text["9"] == "== 9  (p.?)\n  !! page held: no page"
    answer = {r.img_id: r.response for r in report.to_response(told, results, pages).collect()}
    body = json.loads(answer["1"])
    assert body["workSheetSource"] == "EXAM" and body["counts"] == {"O": 1, "X": 1, "HOLD": 0} and [r["question_no"] for r in body["results"]] == ["1", "2"]
    assert answer["3"] is None
    assert report.health(spark, False, True).first().asDict() == {"status": "ok", "ocr": False, "vlm": True}


def test_job(spark, tmp_path):
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.json").write_text(json.dumps(BOOK))
    page_reads(spark, [said("31", {"1": "4", "2": "5"})]).unionByName(page_reads(spark, [said("?", {"1": "4"})], "b")).write.parquet(f"{tmp_path}/reads")
    asked = spark.createDataFrame([("a", "winter sheets", None), ("b", "winter sheets", None)], "img_id string, book string, page_hint string")
    asked.write.parquet(f"{tmp_path}/asked")
    given = ["--answers", f"{tmp_path}/books", "--reads", f"{tmp_path}/reads", "--submissions", f"{tmp_path}/asked", "--out", f"{tmp_path}/out"]
    total = job.run(spark, job.arguments(given)).first()
    assert (total.O, total.X, total.HOLD) == (2, 1, 5)
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/out/reports").orderBy("value").collect())
    assert "== a  (p.31)" in text and "== b  (p.31)" in text
    total = job.run(spark, job.arguments([*given, "--image", "b", "--page", "32"])).first()
    assert (total.O, total.X, total.HOLD) == (0, 0, 2)


def test_images_of_a_task(spark, monkeypatch):
    """More images are more tasks, whatever joins them to pages."""
    monkeypatch.setattr(grading, "IMAGES", 5)
    asked = spark.createDataFrame([(f"p{i}", "B", "1") for i in range(100)], "img_id string, book string, page_hint string")
    merged = spark.createDataFrame([(f"p{i}", None, "1", "2") for i in range(100)], "img_id string, page string, qkey string, value string")
    key = spark.createDataFrame([("b", "1", "1")], "book_key string, page string, qkey string")
    found = grading.resolve_page(asked, merged, key)
    assert found.rdd.getNumPartitions() >= 20
    assert found.count() == 100 and {(r.page_no, r.known, r.read) for r in found.collect()} == {("1", True, True)}
