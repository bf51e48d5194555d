from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemark.functions import equivalence as E
from pagemark.functions import keys as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keys(spark):
    rows = spark.createDataFrame([("0021",), ("21",), ("0",), ("7-1",), ("007-1",), ("0-1",), (None,)], "k string")
    assert [r.x for r in rows.select(K.question_key(F.col("k")).alias("x")).collect()] == ["21", "21", "0", "7-1", "7-1", "0-1", None]
    books = spark.createDataFrame([(" 쎈  2-1 ",), ("",), (None,), ("Straße　X",)], "k string")
    assert [r.x for r in books.select(K.book_key(F.col("k")).alias("x")).collect()] == ["쎈 2-1", "", "", "straße x"]


def test_picked_digits_and_replies(spark):
    assert one(spark, K.picked_digits(F.lit("4,2"))) == [2, 4]
    assert one(spark, K.picked_digits(F.lit("10"))) == [1]
    assert one(spark, K.picked_digits(F.lit("NONE"))) == []
    assert one(spark, K.cleaned_reply(F.lit(" ``` x ``` "))) == "x"
    assert one(spark, K.cleaned_reply(F.lit("```"))) is None
    assert one(spark, K.first_json(F.lit('so {"a": {"b": 1}} it is'))) == '{"a": {"b": 1}}'


def test_anchor_numbers(spark):
    texts = ["7-1.", "7-1", "(3)", "0062", "00596>", "0063$>", "123", " 4)", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.x for r in rows.select(K.anchor_number(F.col("t")).alias("x")).collect()] == ["7-1", "7-1", None, "0062", "0059", "0063", None, "4", None]


def test_page_candidates(spark):
    assert one(spark, K.page_candidates(F.lit("14·Ⅰ"))) == ["14", None]
    assert one(spark, K.page_candidates(F.lit("01 text 15"))) == ["01", "15"]
    assert one(spark, K.page_candidates(F.lit("1234"))) == [None, None]


CASES = [
    ("x=-2,3", ["-2", "3"], True), ("x=3,-2", ["-2", "3"], True), ("1/2", ["0.5"], True), ("0.5", ["3"], False), ("sqrt(4)", ["2"], True), ("2^3", ["8"], True),
    ("3", ["-2", "3"], False), ("@#$!", ["3"], None), ("a=90 b=40", ["b=40,a=90"], True), ("2x", ["2*x"], None), ("π/2", ["pi*0.5"], True), ("sqrt(2)*sqrt(8)", ["4"], True),
    ("9**9**9", ["1"], None), ("1/0", ["1"], None), ("(x+1)^2", ["x^2+2*x+1"], True), ("", ["1"], None), ("x−1", ["x-1"], True), ("6÷4×2", ["3"], True), ("1/sqrt(2)", ["sqrt(2)/2"], True),
]


def test_math_equality(spark):
    rows = spark.createDataFrame([(i, [s], w) for i, (s, w, _) in enumerate(CASES)], "i int, s array<string>, w array<string>")
    got = {r.i: r.e for r in E.with_equality(rows, "s", "w", "e").collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(CASES)}
    nulls = spark.createDataFrame([(None, ["1"])], "s array<string>, w array<string>")
    assert E.with_equality(nulls, "s", "w", "e").first().e is None


NUMBERS = ["0", "-0", "7", "+7", "007", "0.50", "1/2", "-3/6", "(2*3)/(4*3)", "2*3/4", "2*3*5*7", "1/2*3", "3/0", "0/5", "(0*3)/(0*2)", "12345678.1234", "123456789", "-99999*99999*99999", "1.00005", "(-2)", "1/(3)", "2/(1*4)", ".5", "1e2", "1_0", "1//2", "99999/99999"]


def test_columns_and_algebra_agree_on_numbers(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in NUMBERS for b in NUMBERS)]
    df = spark.createDataFrame(pairs, "i int, a string, b string").withColumns({"s": F.array("a"), "w": F.array("b")})
    plain = {r.i: r.p for r in E.with_plain_equality(df, "s", "w", "p").collect()}
    got = {r.i: r.e for r in E.with_equality(df, "s", "w", "e").collect()}
    for i, a, b in pairs:
        assert got[i] == E.same_sets([a], [b])
        assert plain[i] in (None, got[i])
    assert sum(v is not None for v in plain.values()) > 200


def test_limits_go_to_the_workers(spark):
    rows = spark.createDataFrame([("2**100", "2**100"), ("x+1", "x + 1"), ("12345", "12345.0")], "a string, b string").withColumns({"s": F.array("a"), "w": F.array("b")})
    told = lambda **limits: [r.e for r in E.with_equality(rows, "s", "w", "e", E.Limits(**limits)).collect()]
    assert told() == [None, True, True] and told(power=1000) == [True, True, True] and told(length=2) == [None, None, None] and told(length=4) == [None, True, None]


parts = st.lists(st.sampled_from(["1/2", "0.5", "-3", "sqrt(2)", "x+1", "2*x", "pi", "7"]), min_size=1, max_size=4)


@given(parts, st.randoms())
def test_equality_ignores_order(values, random):
    other = list(values)
    random.shuffle(other)
    assert E.same_sets(values, other) is True
    assert E.same_sets(values, [*other, "1"]) is False


@given(parts, parts)
def test_equality_is_symmetric(a, b):
    assert E.same_sets(a, b) == E.same_sets(b, a)
