"""Scan sessions: a folder of captures as a stream, gated and graded in micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grading import totals

PICTURES = r"(?i)\.(jpg|jpeg|png)$"
Grade = Callable[[DataFrame], DataFrame]


@dataclass
class Metrics:
    """What the batches of a session tell of themselves, without another pass over their rows."""

    batches: dict[int, dict[str, float]] = field(default_factory=dict)  #: by number: accepted, rejected, held, failed (0 or 1), seconds, done (when)

    def summary(self, last_arrival: float | None = None) -> dict[str, float]:
        """pages, accepted, rejected, held; mean and longest seconds of a batch; with the time of the last arrival the wait after it."""
        total = lambda name: sum(x[name] for x in self.batches.values())
        seconds = [x["seconds"] for x in self.batches.values()]
        out = {"pages": total("accepted") + total("rejected"), **{x: total(x) for x in ("accepted", "rejected", "held")}, "mean_seconds": sum(seconds) / len(seconds) if seconds else 0.0, "max_seconds": max(seconds, default=0.0)}
        if last_arrival is not None:
            out["wait"] = max(0.0, max((x["done"] for x in self.batches.values()), default=last_arrival) - last_arrival)
        return out


def held(rows: DataFrame, reason: str) -> DataFrame:
    """page_results of pages (path) that could not be graded."""
    nothing = (F.lit(0).cast("long").alias(c) for c in ("O", "X", "HOLD"))
    return rows.select(F.col("path").cast("string").alias("img_id"), F.lit("").alias("page_no"), F.lit(f"processing failed: {reason[:200]}").alias("hold_reason"), *nothing)


def run_session(
    rows: DataFrame, checkpoint: str, gate: Grade, grade: Grade, accepted: str, rejected: str, on_result: Callable[[DataFrame], None] | None = None, interval: str | None = None, metrics: Metrics | None = None
) -> StreamingQuery:
    """A query over a stream of rows (path, ...). metrics: gets the counts and times of each batch.

    gate: the rows with ok and reason. grade: page_results of the accepted rows. If the grading of a batch fails, its
    pages are graded one by one, and only those that fail are held, with the error as their reason. Results go to the
    folders accepted and rejected, each batch to a folder of its own, so that a batch done again
    replaces itself; on_result gets the page_results of each batch once they are written.
    """

    def batch(given: DataFrame, number: int) -> None:
        spark, out, began, failed = given.sparkSession, f"{accepted}/batch={number}", time.time(), 0
        counts, pages = Observation(), Observation()
        checked = gate(given).observe(counts, F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected")).persist()
        told = lambda graded: graded.observe(pages, F.count_if(F.col("hold_reason") != "").alias("held"))
        try:
            checked.where("NOT ok").select("path", "reason").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            good = checked.where("ok").drop("ok", "reason")
            try:
                told(grade(good)).write.mode("overwrite").parquet(out)
            except Exception:  # noqa: BLE001  the session goes on
                failed = 1
                held(good.limit(0), "").write.mode("overwrite").parquet(out)
                for path in [r.path for r in good.select("path").distinct().orderBy("path").toLocalIterator()]:
                    one = good.where(F.col("path") == path)
                    try:
                        grade(one).write.mode("append").parquet(out)
                    except Exception as error:  # noqa: BLE001  this page is held
                        held(one.select("path").distinct(), str(error)).write.mode("append").parquet(out)
            if on_result is not None:
                on_result(spark.read.parquet(out))
            if metrics is not None:
                # a batch that was graded page by page is counted in what it wrote
                n_held = spark.read.parquet(out).where("hold_reason <> ''").count() if failed else pages.get["held"]
                metrics.batches[number] = {**counts.get, "held": n_held, "failed": failed, "seconds": time.time() - began, "done": time.time()}
        finally:
            checked.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def start_session(
    spark: SparkSession, folder: str, checkpoint: str, gate: Grade, grade: Grade, accepted: str, rejected: str, per_batch: int = 4, on_result: Callable[[DataFrame], None] | None = None, interval: str | None = None, metrics: Metrics | None = None
) -> StreamingQuery:
    """A session over the pictures that arrive in folder, `path` each, per_batch at a time."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).load(folder)
    return run_session(files.select("path").where(F.col("path").rlike(PICTURES)), checkpoint, gate, grade, accepted, rejected, on_result, interval, metrics)


def page_results(spark: SparkSession, accepted: str) -> DataFrame:
    """What a session has graded so far, page by page."""
    return spark.read.parquet(accepted).drop("batch")


def finish(spark: SparkSession, query: StreamingQuery, accepted: str) -> DataFrame:
    """Totals of a session, once all that has arrived is graded."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    return totals(spark.read.parquet(accepted))
