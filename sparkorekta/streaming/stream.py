"""Detection and correction on streams: stateless per document, so the batch transforms are used as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect


def analyze_stream(docs: DataFrame, **options) -> DataFrame:
    return detect.findings(docs, **options)


def correct_stream(docs: DataFrame, **options) -> DataFrame:
    return detect.correct(docs, **options).select("doc_id", "corrected", F.size("applied").alias("n_applied"))


def counts_by_window(found: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings by source and window of event time, with a watermark."""
    return found.withWatermark(time, late).groupBy(F.window(time, width), "source").agg(F.count("*").alias("n"))
