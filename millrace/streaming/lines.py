"""Incremental forms of the line operators, on file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import key_of, unicode_trim


def stream_lines(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """``value``: lines of files as they appear in ``folder``."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_a_batch).text(folder)


def new_lines(lines: DataFrame, time_col: str | None = None, late: str = "1 hour") -> DataFrame:
    """``key`` of each trimmed line the first time it is seen.

    With a time column a line counts as new again once none was seen for
    ``late``, and what is older is forgotten; without one every key is kept for
    as long as the stream runs.
    """
    line = unicode_trim(F.col("value"))
    if time_col is None:
        return lines.select(line.alias("line")).where("line <> ''").select(key_of(F.col("line")).alias("key")).dropDuplicates(["key"])
    timed = lines.select(line.alias("line"), F.col(time_col).alias("seen")).where("line <> ''").withWatermark("seen", late)
    return timed.select(key_of(F.col("line")).alias("key"), "seen").dropDuplicatesWithinWatermark(["key"])


def counts_by_window(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window; a window closes ``late`` after the newest event, and its state goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))
