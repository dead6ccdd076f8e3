"""Event-time counts over the evidence feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence_counts(evidence: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(window, source_type, rows) by observed_at; works on batches and, with the watermark, on streams."""
    e = evidence.withWatermark("observed_at", late) if evidence.isStreaming else evidence
    return e.groupBy(F.window("observed_at", window), "source_type").agg(F.count(F.lit(1)).alias("rows"))
