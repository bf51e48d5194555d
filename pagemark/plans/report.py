"""Results at the edge: text reports, responses and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_report(results: DataFrame, page_results: DataFrame) -> DataFrame:
    """img_id, report: header, a line for each question, totals; a held page has its reason only."""
    header = F.format_string("== %s  (p.%s)", F.col("img_id"), F.when(F.col("page_no") == "", "?").otherwise(F.col("page_no")))
    line = F.concat(
        F.lit("  "), F.lpad("question_no", F.greatest(F.lit(4), F.length("question_no")), F.lit(" ")), F.lit("  "), F.col("verdict"),
        F.when(F.col("student_answer") != "", F.concat(F.lit("  ["), "student_answer", F.lit("]"))).otherwise(""),
        F.when(F.col("detail") != "", F.concat(F.lit("  ("), "detail", F.lit(")"))).otherwise(""),
    )
    lines = results.select("img_id", F.struct("ord", line.alias("line")).alias("l")).groupBy("img_id").agg(F.array_sort(F.collect_list("l"))["line"].alias("lines"))
    footer = F.format_string("  -- O %d / X %d / HOLD %d", F.col("O"), F.col("X"), F.col("HOLD"))
    held = F.concat_ws("\n", header, F.concat(F.lit("  !! page held: "), "hold_reason"))
    full = F.array_join(F.concat(F.array(header), F.coalesce("lines", F.array().cast("array<string>")), F.array(footer)), "\n")
    return page_results.join(lines, "img_id", "left").select("img_id", F.when(F.col("hold_reason") != "", held).otherwise(full).alias("report"))


def to_response(requests: DataFrame, results: DataFrame, page_results: DataFrame) -> DataFrame:
    """img_id, status, response (JSON) for requests (img_id, workSheetSource, name, status)."""
    one = F.struct("ord", F.struct("question_no", "verdict", "student_answer", "detail").alias("r"))
    listed = results.groupBy("img_id").agg(F.array_sort(F.collect_list(one))["r"].alias("results"))
    rows = requests.join(page_results, "img_id", "left").join(listed, "img_id", "left")
    body = F.struct(
        F.upper("workSheetSource").alias("workSheetSource"), "name", F.coalesce("page_no", F.lit("")).alias("page_no"),
        F.coalesce("results", F.array().cast("array<struct<question_no:string,verdict:string,student_answer:string,detail:string>>")).alias("results"),
        F.struct("O", "X", "HOLD").alias("counts"), F.coalesce("hold_reason", F.lit("")).alias("hold_reason"),
    )
    return rows.select("img_id", "status", F.when(F.col("status") == 200, F.to_json(body)).alias("response"))


def health(spark, ocr: bool, reader: bool) -> DataFrame:
    """One row: status, ocr, vlm."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(ocr).alias("ocr"), F.lit(reader).alias("vlm"))
