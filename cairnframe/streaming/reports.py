"""Report lines as a stream: the same judgement as in batches, record by record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.operators.badrows import judged
from cairnframe.sources.reports import report_rows


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Arriving Parquet files of (report_id, line_no, loaded_at, raw)."""
    return spark.readStream.schema("report_id long, line_no int, loaded_at timestamp, raw string").parquet(folder)


def judged_lines(lines: DataFrame, late: str = "7 days") -> DataFrame:
    """(report_id, line_no, reason, f0 .. f6) of a stream; a record delivered again within `late` counts once."""
    once = lines.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["report_id", "line_no", "raw"])
    return judged(once, ["report_id", "line_no"])


def sound_rows(judged: DataFrame) -> DataFrame:
    return report_rows(judged, ["report_id", "line_no"])


def failed_rows(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNotNull() & (F.col("reason") != "header")).select("report_id", "line_no", "reason")
