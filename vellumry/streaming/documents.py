"""Streams of documents: formatting as they arrive, each content once.

Formatting is stateless, so the batch transform serves streams unchanged.  State is kept
only to drop contents seen before, and a watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.functions.text import content_hash
from vellumry.operators.documents import format_documents
from vellumry.options import FormatOptions


def format_stream(stream: DataFrame, text_col: str = "text", options: FormatOptions = FormatOptions()) -> DataFrame:
    return format_documents(stream, text_col, options)


def new_contents(stream: DataFrame, time_col: str, text_col: str = "text", delay: str = "7 days") -> DataFrame:
    """Documents whose content was not seen within ``delay``; later copies are dropped."""
    timed = stream.withWatermark(time_col, delay).withColumn("content_hash", content_hash(F.col(text_col).cast("binary")))
    return timed.dropDuplicatesWithinWatermark(["content_hash"])


def verdicts_per_window(formatted: DataFrame, time_col: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Documents and changed documents per window of time, late rows within ``delay``."""
    return (
        formatted.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("window"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.coalesce("changed", F.lit(False))).alias("n_changed"))
    )
