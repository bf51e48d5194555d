"""Grading as a job: python -m pagemark --answers books/ --reads reads.parquet --submissions asked.parquet --out graded/.

Tables are Parquet. With --boxes and --dims pages are graded in blocks, else whole. --image grades one
page, --page says which page of its book it is. Results, page results and text reports go to folders of --out.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.grading import grade, totals
from .plans.report import format_report
from .sources.answers import read_answer_key


def run(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Grade, write the folders, and return the totals."""
    read = lambda path: spark.read.parquet(path) if path else None
    asked = read(options.submissions)
    if options.image is not None:
        asked = asked.where(F.col("img_id").cast("string") == options.image)
    if options.page is not None:
        asked = asked.withColumn("page_hint", F.lit(options.page))
    key = read_answer_key(spark, options.backend, folder=options.answers)
    mode = "blocks" if options.boxes else "fullpage"
    one = lambda df: None if df is None else df.join(asked.select("img_id"), "img_id", "left_semi")
    results, pages = grade(mode, asked, one(read(options.reads)), key, one(read(options.boxes)), one(read(options.dims)))
    results.write.mode("overwrite").parquet(f"{options.out}/results")
    pages.write.mode("overwrite").parquet(f"{options.out}/pages")
    # from what is written, so that nothing is graded again
    written = read(f"{options.out}/pages")
    format_report(read(f"{options.out}/results"), written).orderBy("img_id").select("report").write.mode("overwrite").text(f"{options.out}/reports", lineSep="\n\n")
    return totals(written)


def arguments(values: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("pagemark", description="Grade pages from tables of model replies.")
    for name in ("answers", "reads", "submissions", "out"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("boxes", "dims", "image", "page"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--backend", default="json")
    return parser.parse_args(values)


if __name__ == "__main__":
    session = SparkSession.builder.appName("pagemark").getOrCreate()
    total = run(session, arguments()).first()
    print(f"O {total.O} / X {total.X} / HOLD {total.HOLD}")
    session.stop()
