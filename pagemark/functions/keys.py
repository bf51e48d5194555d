"""Keys, answers and texts as columns. Uncertainty is null and ends as a hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MCQ, SUBJECTIVE = "multiple_choice", "subjective"
RIGHT, WRONG, HOLD = "O", "X", "HOLD"
# Replies in which a reader declines to answer.
DECLINED = ("UNSURE", "PRINTED")
# How a question's number stands at a text's start (7. or 7-1), alone (7-1), or of four digits), and a page's at its start or end.
ANCHORS = (r"^\s*(\d{1,3}(?:-\d{1,2})?)\s*[.)]", r"^\s*(\d{1,3}-\d{1,2})\s*$", r"^\s*(\d{4})")
PAGES = (r"^\s*(\d{1,3})(?!\d)", r"(?<!\d)(\d{1,3})\s*$")


def question_key(number: Column) -> Column:
    """A question number without zeros before its first digit; a lone zero and parts such as 7-1 stay."""
    return F.regexp_replace(number, r"^0+(\d)", "$1")


def book_key(name: Column) -> Column:
    """A book's name in lower case with single spaces; empty for null."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " ")))


def picked_digits(text: Column) -> Column:
    """The distinct digits 1 to 9 of a text, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit("[1-9]"), F.lit(0)))).cast("array<int>")


def cleaned_reply(text: Column) -> Column:
    """A reply without blanks and back-ticks around it; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(text), "^`+|`+$", "")), F.lit(""))


def declined(text: Column) -> Column:
    return F.upper(text).isin(*DECLINED)


def same_set(a: Column, b: Column) -> Column:
    """Do two arrays have the same elements, whatever their order and repeats?"""
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def first_json(text: Column) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def anchor_number(text: Column) -> Column:
    """Question number with which a text begins: 7., 7-1), 7-1 alone, or four digits; else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ANCHORS))


def page_candidates(text: Column) -> Column:
    """Numbers of up to three digits at a text's start and end, the start first; nulls where there is none."""
    return F.array(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in PAGES))
