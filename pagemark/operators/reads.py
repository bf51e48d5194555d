"""Model reads: parsing and voting.

model_reads: img_id, kind (page, mcq, math), question_no, call_no, raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import cleaned_reply, declined, first_json, picked_digits, question_key


def parse_page_reads(model_reads: DataFrame) -> DataFrame:
    """img_id, call_no, page, pos, qkey, value of each answer in the page reads; a read without answers has one row without a key.

    Of equal raw keys in one read the last stays. A null value is empty text. Reads without a
    JSON object are left out.
    """
    page = model_reads.where("kind = 'page'").select("img_id", "call_no", first_json(cleaned_reply(F.col("raw"))).alias("json"))
    parsed = page.where("json IS NOT NULL").select(
        "img_id", "call_no", F.from_json("json", "page string, answers map<string,string>").alias("r"), F.col("json").rlike(r'"page"\s*:\s*-?0(?:\.0*)?\s*[,}]').alias("zero")
    )
    stated = F.nullif(F.trim(F.col("r.page")), F.lit(""))
    # a page that is the number 0 counts as none, the text "0" as itself
    named = parsed.where("r IS NOT NULL").select("img_id", "call_no", F.when(F.col("zero"), None).otherwise(stated).alias("page"), F.col("r.answers").alias("answers"))
    rows = named.select("img_id", "call_no", "page", F.posexplode_outer("answers").alias("pos", "key", "value"))
    last = Window.partitionBy("img_id", "call_no", "key").orderBy(F.desc("pos"))
    kept = rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    return kept.select("img_id", "call_no", "page", "pos", question_key("key").alias("qkey"), F.when(F.col("key").isNotNull(), F.coalesce(F.trim("value"), F.lit(""))).alias("value"))


def vote(votes: DataFrame, keys: list[str], value: str, order: list[str], on_no_majority: str = "best") -> DataFrame:
    """keys, winner, n, participants: the value of a strict majority of the votes, else the most frequent that is not empty, else empty.

    A row is a vote, an empty value too; who is absent abstains. Ties go to the first by order, then to the smaller value.
    on_no_majority: `best`, or `hold` for an empty winner.
    """
    counted = votes.groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    some = F.col("_value") != ""
    rank = F.struct(-F.col("_n"), F.col("_first"), F.col("_value"))
    total = counted.groupBy(*keys).agg(
        F.sum("_n").alias("participants"),
        F.min_by("_value", rank).alias("_top"),
        F.max("_n").alias("n"),
        F.min_by(F.when(some, F.col("_value")), F.when(some, rank)).alias("_best"),
    )
    fallback = F.col("_best") if on_no_majority == "best" else F.lit(None)
    winner = F.when(F.col("n") > F.floor(F.col("participants") / 2), F.col("_top")).otherwise(F.coalesce(fallback, F.lit("")))
    return total.select(*keys, winner.alias("winner"), "n", "participants")


def merge_votes(parsed: DataFrame, on_no_majority: str = "best") -> DataFrame:
    """img_id, page, qkey, value over all reads of an image. In one read the last of equal keys stays."""
    last = Window.partitionBy("img_id", "call_no", "qkey").orderBy(F.desc("pos"))
    one = parsed.where("qkey IS NOT NULL").withColumn("_k", F.row_number().over(last)).where("_k = 1")
    values = vote(one, ["img_id", "qkey"], "value", ["call_no", "pos"], on_no_majority)
    reads = parsed.select("img_id", "call_no", "page").distinct()
    seen = reads.where("page IS NOT NULL").groupBy("img_id", "page").agg(F.count("*").alias("n"), F.min("call_no").alias("first"))
    pages = seen.groupBy("img_id").agg(F.min_by("page", F.struct(-F.col("n"), F.col("first"))).alias("page"))
    everyone = reads.select("img_id").distinct().join(pages, "img_id", "left")
    return everyone.join(values.select("img_id", "qkey", F.col("winner").alias("value")), "img_id", "left")


def two_reads_agree(first: Column, second: Column) -> Column:
    """The first read if both are the same but for spaces and neither declines; else null."""
    a, b = cleaned_reply(first), cleaned_reply(second)
    return F.when(~declined(a) & ~declined(b) & (F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit(""))), a)


def math_reads(model_reads: DataFrame) -> DataFrame:
    """img_id, question_no, value: what the first two math reads agree on."""
    raw = lambda n: F.max(F.when(F.col("call_no") == n, F.col("raw")))
    both = model_reads.where("kind = 'math'").groupBy("img_id", "question_no").agg(raw(0).alias("a"), raw(1).alias("b"))
    return both.select("img_id", "question_no", two_reads_agree(F.col("a"), F.col("b")).alias("value"))


def mcq_reads(model_reads: DataFrame) -> DataFrame:
    """img_id, question_no, picked: digits of the mcq read; null if it declines or has none."""
    one = model_reads.where("kind = 'mcq'").groupBy("img_id", "question_no").agg(F.min_by("raw", "call_no").alias("raw"))
    text = cleaned_reply(F.col("raw"))
    refused = declined(text) | F.contains(F.upper(text), F.lit("NONE"))
    return one.select("img_id", "question_no", F.when(~refused & (F.size(picked_digits(text)) > 0), picked_digits(text)).alias("picked"))
